import pytest
from pyspark.sql import functions as F

from collatio.llm import p03_truncation as t
from collatio.llm.kernels import prefix_distances

R = "Timenrere plallorcionis per uicuunt rispet est stimuepionis."
CUT = [R[:40], R[:38] + "…", R[:37] + "...", R[:35] + "<l", R[:35] + "&am", R[:35] + "\\u01", R[:30] + '"', R[:33] + "�", "Timenrere plallorcionis", "Tirnenrere plalorcionis per uicunt ri"]
WHOLE = [R, R[:-1], R.replace("rispet ", ""), R.replace("Timenrere ", ""), R + "..", "", None, R.replace("per", "per per"), R.upper(), R[:-4]]


def test_cases():
    for p in CUT:
        assert t.examine(R, p)[4], p
    for p in WHOLE:
        assert not t.examine(R, p)[4], p
    assert not t.examine(None, "x")[4] and not t.examine("", "x")[4]
    hyphen = "rerquaret gartilirlam braudando uelti uasgi-"
    assert not t.examine(hyphen, hyphen)[4]
    again = "Timenrere plall Timenrere plall Timenrere plall"
    assert not t.examine(R, again)[4]


def test_structure_decides():
    # four letters are missing: only what is left open, with a source that always ends its lines, makes it a cut
    quoted = "Timenrere “plallorcionis per uicuunt rispet est stimuepionis”."
    short = quoted[: -len("onis”.")]
    assert t.examine(quoted, short, 0.95)[1:] == (t.OPEN + t.MOST_SURPRISE, 4, 0, True)
    assert not t.examine(quoted, short, 0.2)[4]  # many lines of this source end without a sign
    assert not t.examine(quoted.replace("”", ""), short, 0.95)[4]  # the reference leaves it open too
    assert not t.examine(R, R[:-5], 0.95)[4]  # nothing is open
    # without a reference the structure alone makes suspects
    for text in ("Timenrere plall…", "Timenrere (plallor", "Timenrere pl&am", "Timenrere pl�"):
        mask, score, *_, cut = t.examine(None, text, 0.95)
        assert mask and score >= t.SUSPECT and not cut, text
    assert t.examine(None, "Timenrere (plallor).", 0.95)[1] < 0
    assert t.examine(None, "Timenrere plall", 0.95, [15])[1] >= t.SUSPECT > t.examine(None, "Timenrere plall", 0.95, [16])[1]


@pytest.mark.parametrize(("text", "bit"), [("a (b", t.OPEN_BRACKET), ("a “b", t.OPEN_QUOTE), ("ab&am", t.BROKEN_ENTITY), ("ab<l", t.BROKEN_MARKUP), ("ab\\u01", t.BROKEN_ESCAPE), ("ab�", t.BROKEN_BYTES), ("ab...", t.DOTS), ("a ⟦b", t.OPEN_BRACKET)])
def test_structure(text, bit):
    assert t.structure(text)[0] & bit


def test_structure_of_whole_texts():
    for s in ("", "a (b) ⟦c⟧ “d” \"e\"", "a & b", "x.", "«a»"):
        assert t.structure(s)[0] == 0


def test_prefix_distances_equal_brute_force():
    a, b = "abcab", "abxcabdd"
    row = list(range(len(a) + 1))
    want = [row[-1]]
    for i, y in enumerate(b, 1):
        new = [i]
        for j, x in enumerate(a, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
        want.append(row[-1])
    assert prefix_distances(a, b) == want and prefix_distances("", "ab") == [0, 1, 2]


def test_table(spark):
    rows = [(i, "s" if i % 2 else None, R, p) for i, p in enumerate([*CUT, *WHOLE])] + [(99, "s", R * 50, R * 30)]
    df = spark.createDataFrame(rows, "row_id long, system string, reference string, prediction string").withColumns({"key": F.lit(1), "cut": F.lit(2)})
    assert {r.row_id for r in t.found(df).collect()} == {*range(len(CUT)), 99}
    assert t.found(df.limit(0)).count() == 0
    report = {r.system: r for r in t.report(df).collect()}
    assert 0 < sum(r.n_suspect_cut for r in report.values()) <= sum(r.n_suspect for r in report.values())
    assert 0 < report["s"].missing_terminator_share < 1
    assert sum(r.n_rows for r in report.values()) == len(rows) and sum(r.n_cut for r in report.values()) == len(CUT) + 1
    assert t.report(df.limit(0)).count() == 0


def test_more_sources_than_may_be_sent(spark, monkeypatch):
    rows = [(i, [None, "a", "b"][i % 3], R, p) for i, p in enumerate([*CUT, *WHOLE])]
    df = spark.createDataFrame(rows, "row_id long, system string, reference string, prediction string")
    before = sorted(map(tuple, t.examined(df).collect()), key=str)
    monkeypatch.setattr(t, "MOST_SOURCES", 1)
    assert sorted(map(tuple, t.examined(df).collect()), key=str) == before


def test_habits(spark):
    rows = [(i, "a", None, "x" * (20 + i % 17) + ("." if i % 4 else "")) for i in range(200)] + [(i, "a", None, "x" * 48) for i in range(200, 240)] + [(300, None, None, " ")]
    df = spark.createDataFrame(rows, "row_id long, system string, reference string, prediction string")
    (own,) = t.habits(df).collect()
    assert own.piles == [48] and abs(own.share_terminated - 150 / 240) < 1e-9
    assert t.examined(df).filter(f"score >= {t.SUSPECT}").count() == 40
