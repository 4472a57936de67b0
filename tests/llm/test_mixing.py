import itertools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from collatio.llm import p07_encoding, p08_mixing as m

pytestmark = pytest.mark.skipif(not os.path.exists(p07_encoding.vocabulary_path()), reason="no vocabulary file")


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 60), st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=4))
def test_fit_is_the_best(goal, counts):
    got = m.fit(goal, counts)
    assert all(0 < got[x] <= counts[x] for x in got)
    reached = sum(k * v for k, v in got.items())
    sums = {sum(k * v for k, v in zip(counts, combo, strict=True)) for combo in itertools.product(*[range(n + 1) for n in counts.values()])}
    assert reached == max(x for x in sums if x <= goal)


def documents(spark, n=400):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(1, 30)) if i % 37 else None, "a" if i % 2 else rng.choice(["b", "c", None])) for i in range(n)]
    return spark.createDataFrame([*rows, (9001, "", "a")], "doc_id long, text string, source string").withColumn("copies", F.lit(7))


def targets(spark, rows=(("a", 300, 2), ("b", 500, 2), ("c", 150, 1), ("d", 50, 3))):
    return spark.createDataFrame(list(rows), "source string, target_permille int, max_repeats int")


@pytest.mark.parametrize("window", [1 << 16, 64])
def test_mixture(spark, monkeypatch, window):
    monkeypatch.setattr(m, "WINDOW", window)
    d, t = documents(spark), targets(spark)
    sums = {r.source: r.t for r in m.sized(d).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = sum(v or 0 for v in sums.values())
    found = {r.source for r in m.found(d, t).collect()}
    assert found == {s for s, permille, most in (("a", 300, 2), ("b", 500, 2), ("c", 150, 1)) if sums[s] * most * 1000 < permille * total} | {"d"}
    mix = m.mixed(d, t)
    rows = mix.collect()
    assert len(rows) == len({r.doc_id for r in rows}) and all(r.source in "abc" and r.tokens > 0 for r in rows)
    got = {}
    for r in rows:
        got[r.source] = got.get(r.source, 0) + r.tokens * r.copies
    for s, permille, most in (("a", 300, 2), ("b", 500, 2), ("c", 150, 1)):
        assert max(r.copies for r in rows if r.source == s) <= most
        goal = min(total * permille // 1000, sums[s] * most)
        assert goal - (2 if window == 64 else 0) <= got[s] <= goal
    shares = {r.source: r for r in m.shares(mix, t).collect()}
    assert shares["d"].mix_tokens == 0 and shares["a"].mix_tokens == got["a"]
    assert {tuple(r) for r in m.mixed(d, t).collect()} == {tuple(r) for r in rows}


def test_edges(spark):
    d, t = documents(spark), targets(spark)
    assert m.mixed(d.limit(0), t).count() == 0 and {r.source for r in m.found(d.limit(0), t).collect()} == {"a", "b", "c", "d"}
    assert m.mixed(d, t.limit(0)).count() == 0 and m.found(d, t.limit(0)).count() == 0
    assert m.mixed(d, t, budget=0).count() == 0


@pytest.mark.parametrize("lengths, permille", [([100] * 40, 500), ([100] * 30 + [3] * 40, 700), ([70, 90, 130, 250] * 10, 400), ([1000] + [100] * 5, 300)])
def test_long_documents_fill_too(spark, monkeypatch, lengths, permille):
    monkeypatch.setattr(m, "WINDOW", 64)
    rows = [(i, " ".join(["word"] * n), "a") for i, n in enumerate(lengths)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {r.doc_id: r.tokens for r in m.sized(d).collect()}
    goal = sum(size.values()) * permille // 1000
    mix = m.mixed(d, targets(spark, [("a", permille, 1)])).collect()
    got, taken = sum(r.tokens for r in mix), {r.doc_id for r in mix}
    assert len(mix) == len(taken) and all(r.copies == 1 for r in mix)
    # nothing that is left would fit
    assert 0 < got <= goal and goal - got < min(n for i, n in size.items() if i not in taken)


def test_attainable_budget_keeps_the_shares(spark):
    d = documents(spark)
    t = targets(spark, [("a", 300, 2), ("b", 500, 2), ("c", 200, 1)])
    assert m.found(d, t).count() > 0  # with the budget of all tokens someone falls short
    rows = {r.source: r for r in m.shares(m.mixed(d, t, budget="attainable"), t).collect()}
    assert all(abs(r.reached_permille - r.target_permille) < 15 for r in rows.values()), rows


def test_encodes_once(spark):
    plan = m.sized(documents(spark))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1
    got = {r.source for r in m.found(documents(spark), targets(spark, [("a", 900, 1), ("b", 10, 1), ("nobody", 90, 1)])).collect()}
    assert got == {"a", "nobody"}
