from pyspark.sql import functions as F

from collatio.llm import p04_repetition as p
from collatio.llm.kernels import covered, share


def brute(s, k=6):
    mark = set()
    for i in range(len(s) - k + 1):
        if any(s[j : j + k] == s[i : i + k] for j in range(i)):
            mark.update(range(i, i + k))
    return len(mark)


def test_covered():
    for s in ("", "abc", "abcdefgh", "abcdefghabcdefgh", "xyzabcdefqqabcdefrr", "aaaaaaaaaa", "abcabcabcabcabc", "plaec prouem plaec prouem".replace(" ", "")):
        assert covered(s) == brute(s)
    # a longer copy with one different letter is one copy
    assert covered("abcdefghijklmnop" + "abcdefgXijklmnop") == 16
    assert share("") == 0


R = "sandimrem hoc nermumquitet pro nilsteuo non plega"


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, reference string, prediction string")


def test_found(spark):
    loop = "broplenare trigem uixdauere " * 4
    rows = [(1, R, R), (2, R, "nilsteuo non plega " * 3), (3, loop, loop), (4, R, None), (5, R, ""), (6, None, loop), (7, R, R + " " + R[:9]), (8, R, ("Nilsteuo  non, plega " + "NILSTEUO·NON PLEGA ") * 2), (2, R, "nilsteuo non plega " * 3)]
    df = table(spark, rows).withColumns({"bits": F.lit(1), "key": F.lit("x")})
    assert sorted(r.row_id for r in p.found(df).collect()) == [2, 2, 6, 8]
    assert p.found(df.limit(0)).count() == 0
    spans = spark.createDataFrame([(1, True), (1, True), (2, None), (3, False)], "input_row long, possible_repetition boolean")
    rows = p.ledger(df, spans)
    assert rows.count() == 9 and rows.filter("row_id = 1").first().bits & p.FLAGGED
    got = {(r.policy, r.rule): r for r in p.ablation(rows).collect()}
    assert got["repetition", "repeats"].n_cases == 4 and got["repetition", "reference_repeats"].n_excused_by_rule_alone == 1
    assert got["flag_only", "flagged"].n_cases == 1


def test_rules():
    bits = p.measure("ab ab ab ab ab ab ab", None)[0]
    assert bits & p.REPEATS and bits & p.WORD_RUN
    assert p.measure("aaaaaaaaaaaaaaaaaaaa", None)[0] & p.LETTER_RUN
    assert p.measure("one long line here\none long line here", None)[0] & p.LINE_AGAIN
    assert p.measure(" ·", "x")[0] == p.NO_TEXT
    assert p.measure("lorem " * 20000, None)[1] > 0.99


def test_rules_without_repeated_stretches():
    # all of them hold where little or nothing of six letters is repeated
    bits, rate, of_reference, run = p.measure("·lx· ·lx· ·lx·", "plega " * 5)
    assert bits == p.WORD_RUN | p.REFERENCE_REPEATS and rate < 0.1 and of_reference > 0.5 and run == 3
    long = " ".join(f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst")
    assert p.measure(f"{long}\nab\nab", None)[0] == p.LINE_AGAIN
    assert p.measure(f"{long} aaaaaaaaa", None)[0] == p.LETTER_RUN
    assert p.measure(f"{long} ac ac ac", R) == (p.WORD_RUN, p.share(p.letters(f"{long} ac ac ac")), p.share(p.letters(R)), 3)
