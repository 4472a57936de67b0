import random

from pyspark.sql import functions as F

from collatio.llm import p01_overlap


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def damage(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        op = rng.randrange(3)
        if op == 0:
            s[i] = rng.choice("abcdefgh")
        elif op == 1:
            del s[i]
        else:
            s.insert(i, rng.choice("abcdefgh"))
    return "".join(s)


def table(spark, rows):
    return spark.createDataFrame(rows, "line_id string, gen_split string, reference string, subcorpus string")


def test_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        s = "".join(rng.choice("abcdefgh") for _ in range(rng.choice((18, 20, 21, 24, 29, 34, 47, 60, 90))))
        rows.append((f"t{i}", " Train", s, "x"))
        rows.append((f"e{i}", rng.choice(("dev", "TEST")), damage(rng, s, rng.randint(0, len(s) // 5)), "x"))
    got = {(r.line_a, r.line_b) for r in p01_overlap.found(table(spark, rows)).collect()}
    want = set()
    train, ev = [r for r in rows if r[0][0] == "t"], [r for r in rows if r[0][0] == "e"]
    for a, _, x, _ in train:
        for b, _, y, _ in ev:
            if min(len(x), len(y)) >= 20 and lev(x, y) * 100 <= 15 * max(len(x), len(y)):
                want.add((min(a, b), max(a, b)))
    assert got == want and len(want) > 40


def test_edges(spark):
    s = "bracurat dominum et cetera"
    rows = [("a", "train", s, "x"), ("b", "Dev ", s.upper() + "!", "y"), ("b", "dev", s, "y"), ("c", None, s, "y"), ("d", "test", None, "y"), ("e", "test", "", "y"), ("f", "train", "short", "y"), ("g", "test", "short", "y"), ("a", "test", s, "x"), (None, "test", s, "x")]
    df = table(spark, rows).withColumns({"id": F.lit(1), "letters": F.lit("x"), "key": F.lit(2)})
    assert {tuple(r) for r in p01_overlap.found(df).collect()} == {("a", "b")}
    assert p01_overlap.found(df.limit(0)).count() == 0
    report = {(r.gen_split, r.subcorpus): (r.n_lines, r.n_overlapping, r.n_same) for r in p01_overlap.report(df).collect()}
    assert report["dev", "y"] == (1, 1, 1)
    # of short texts only those with the same letters meet, and only in links and the report
    assert {(r.gen_split, r.subcorpus): (r.n_lines, r.n_short_same) for r in p01_overlap.report(df).collect()} == {("dev", "y"): (1, 0), ("test", "y"): (1, 1), ("test", "x"): (1, 0)}
    links = {(r.line_id, r.split): (r.n_links, r.distance) for r in p01_overlap.links(df).collect()}
    assert links == {("a", "train"): (1, 0), ("a", "test"): (1, 0), ("b", "dev"): (1, 0), ("f", "train"): (1, 0), ("g", "test"): (1, 0)}
    long = "".join(random.Random(1).choice("abcdefghij") for _ in range(3000))
    both = table(spark, [("a", "train", long, "x"), ("b", "dev", long[:1000] + "zz" + long[1003:], "x")])
    assert p01_overlap.found(both).count() == 1


def test_links_are_of_classes(spark):
    s = "the same formula stands in every charter"
    rows = [(f"t{i}", "train", s, "x") for i in range(5)] + [("u", "train", s[:-1], "x"), ("e", "test", s, "x"), ("n", "dev", "nothing of the kind was ever found", "x"), ("w", "dev", "no", "x")]
    got = {r.line_id: (r.n_links, r.distance, r.class_id) for r in p01_overlap.links(table(spark, rows)).collect()}
    assert len(got) == 9 and {got[f"t{i}"] for i in range(5)} == {got["t0"]} and got["e"][:2] == (2, 0) and got["u"][:2] == (1, 1) and got["n"][:2] == got["w"][:2] == (0, None)
    assert got["e"][2] == got["t0"][2] != got["u"][2]


def test_hot_copies(spark):
    rows = [(f"t{i}", "train", "the same formula stands in every charter", "x") for i in range(60)] + [(f"e{i}", "test", "the same formula stands in every charte", "x") for i in range(40)]
    pairs, _ = p01_overlap.text_pairs(p01_overlap.lines(table(spark, rows)))
    assert pairs.count() == 1 and p01_overlap.found(table(spark, rows)).count() == 2400
