import numpy as np
import pytest
from pyspark.sql import functions as F

from collatio.operators import compare, policy_swap
from collatio.operators.evaluate import evaluate_recognition

NAMES = "document_id string, line_id string, system string, reference string, metric string, rate double, n_reference int, n_hypothesis int, substitutions int, deletions int, insertions int, distance int"


def rows(spark, data):
    return spark.createDataFrame([(d, l, s, ref, "cer", e / n if n else float(e), n, n, e, 0, 0, e) for d, l, s, ref, n, e in data], NAMES)


def paired(spark):
    return rows(spark, [("d1", "1", "A", "x", 4, 2), ("d1", "2", "A", "y", 4, 0), ("d2", "1", "A", "z", 4, 1), ("d1", "1", "B", "x", 4, 0), ("d1", "2", "B", "y", 4, 1), ("d2", "1", "B", "z", 4, 0)])


def mixed(h):
    h = (h ^ h >> 16) * compare.MIX_A % 2**32
    h = (h ^ h >> 15) * compare.MIX_B % 2**32
    return h ^ h >> 15


def test_macro_and_interval(spark):
    r = compare.compare_systems(paired(spark), ("A", "B"), n_boot=300, seed=5).first()
    assert (r.estimate_a, r.estimate_b, r.n_units) == (0.25, 0.0625, 2)
    assert r.conf_low <= r.difference_b_minus_a <= r.conf_high
    index = lambda rep, slot: mixed(mixed((5 * compare.OF_SEED + rep * compare.OF_REP) % 2**32) ^ slot) % 2
    delta = np.array([0.125 - 0.25, 0 - 0.25])
    draws = [np.mean([delta[index(rep, s)] for s in (1, 2)]) for rep in range(1, 301)]
    assert r.conf_low == pytest.approx(np.quantile(draws, 0.025)) and r.conf_high == pytest.approx(np.quantile(draws, 0.975))
    micro = compare.compare_systems(paired(spark), ("A", "B"), estimand="micro", n_boot=10).first()
    assert micro.estimate_a == 3 / 12 and micro.estimate_b == 1 / 12


def test_all_pairs_is_compare_systems(spark):
    x = paired(spark)
    a = compare.compare_systems(x, ("A", "B"), n_boot=50, seed=9).drop("estimand").first().asDict()
    b = compare.compare_all_pairs(x, n_boot=50, seed=9).drop("estimand").first().asDict()
    assert a == b


def random_rows(spark, seed=4):
    rng = np.random.default_rng(seed)
    units = [None, "d1", "d2", "d3", "é", "z"]
    data = [(units[i % 6], str(i), s, f"r{i}", int(5 + i % 4), int(rng.integers(0, 5))) for i in range(40) for s in "ABC"]
    return rows(spark, data)


@pytest.mark.parametrize("estimand", ["macro", "micro"])
def test_all_pairs_with_null_units(spark, estimand, monkeypatch):
    x = random_rows(spark)
    got = {(r.system_a, r.system_b): r.asDict() for r in compare.compare_all_pairs(x, estimand=estimand, n_boot=200, seed=3).collect()}
    assert len(got) == 3
    for pair, r in got.items():
        one = compare.compare_systems(x, pair, estimand=estimand, n_boot=200, seed=3).first().asDict()
        assert r.keys() == one.keys() and all(r[k] == pytest.approx(one[k], abs=1e-12) for k in r) and r["n_units"] == 6
    # more units than may be sent to the tasks: the same draws meet them in a join
    monkeypatch.setattr(compare, "MOST_UNITS", 3)
    for r in compare.compare_all_pairs(x, estimand=estimand, n_boot=200, seed=3).collect():
        assert all(v == pytest.approx(got[r.system_a, r.system_b][k], abs=1e-12) for k, v in r.asDict().items())


@pytest.mark.parametrize("estimand", ["macro", "micro"])
@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 2, "BLOCK_GROUPS": 2, "BLOCK_DRAWS": 100, "DRAWS": 4}, {"BLOCK": 13, "DRAWS": 15}])
def test_many_units_are_dealt(spark, estimand, sizes, monkeypatch):
    x = random_rows(spark).filter("system <> 'C' or document_id <> 'd2' or document_id is null")  # groups of six and of five units
    of = lambda: {(r.system_a, r.system_b): r.asDict() for r in compare.compare_all_pairs(x, estimand=estimand, n_boot=101, seed=3, unpaired="drop").collect()}
    got = of()
    assert sorted(r["n_units"] for r in got.values()) == [5, 5, 6]
    for k, v in {"MOST_UNITS": 3, **sizes}.items():
        monkeypatch.setattr(compare, k, v)
    for pair, r in of().items():
        assert all(v == pytest.approx(got[pair][k], abs=1e-12) for k, v in r.items())
    plan = compare.compare_all_pairs(x, estimand=estimand, n_boot=101, seed=3, unpaired="drop")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "FlatMapGroupsInArrow" in plan  # slices of replicates; a draw isn't a row


def test_all_pairs_are_strict(spark):
    x = random_rows(spark)
    first = x.limit(1)
    with pytest.raises(ValueError, match="several rows"):
        compare.compare_all_pairs(x.unionByName(first), n_boot=5)
    less = x.filter("not (line_id = '3' and system = 'B')")
    with pytest.raises(ValueError, match="same pairs"):
        compare.compare_all_pairs(less, n_boot=5)
    assert {(r.system_a, r.system_b) for r in compare.compare_all_pairs(less, n_boot=5, unpaired="drop").collect()} == {("A", "B"), ("A", "C"), ("B", "C")}
    with pytest.raises(ValueError, match="texts differ"):
        compare.compare_all_pairs(x.withColumn("reference", F.concat("reference", F.when(F.col("system") == "C", "!").otherwise(""))), n_boot=5)
    assert compare.compare_all_pairs(x.limit(0), n_boot=5).count() == 0


@pytest.mark.parametrize(
    ("extra", "message"),
    [
        (("d3", "9", "A", "q", 4, 0), "same paired observations"), (("d2", "1", "B", "z", 4, 0), "several rows"),
        (None, "Reference texts differ"), (0, "Reference lengths differ"),
    ],
)
def test_strict_pairing(spark, extra, message):
    x = paired(spark)
    if isinstance(extra, tuple):
        x = x.unionByName(rows(spark, [extra]))
    elif extra is None:
        x = rows(spark, [("d", "1", "A", "x", 3, 0), ("d", "1", "B", "y", 3, 0)])
    else:
        x = rows(spark, [("d", "1", "A", "x", 3, 0), ("d", "1", "B", "x", 4, 0)])
    with pytest.raises(ValueError, match=message):
        compare.compare_systems(x, ("A", "B"), n_boot=5)
    assert compare.pairing_violations(x, ("A", "B")).count() >= 1


def test_arguments(spark):
    x = paired(spark)
    for k in ({"systems": ("A", "A")}, {"systems": ("A", "Z")}, {"systems": ("A", "B"), "n_boot": 0}, {"systems": ("A", "B"), "conf_level": 1}, {"systems": ("A", "B"), "estimand": "x"}):
        with pytest.raises(ValueError):
            compare.compare_systems(x, **k)


def test_null_units_are_a_unit(spark):
    x = rows(spark, [(None, "1", "A", "x", 4, 2), (None, "1", "B", "x", 4, 0), ("d", "2", "A", "y", 4, 0), ("d", "2", "B", "y", 4, 0)])
    assert compare.compare_systems(x, ("A", "B"), n_boot=5).first().n_units == 2


def manifest(spark):
    rows = [("n", "M", "f", "neutral", "neutral", "id", "r1", None), ("m", "M", "f", "x", "matched", "id", "r1", "p"), ("c", "K", "f", "fixed", "fixed", "k", "r", None)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in policy_swap.MANIFEST))


def swap_table(spark):
    data = [(f"d{i % 2}", str(i), s, "abcd", p) for i, (a, b) in enumerate([("abcd", "abcd"), ("abxx", "abcd"), ("abcx", "abcd"), ("abcd", "abcd")]) for s, p in (("n", a), ("m", b))]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(data)], "document_id string, line_id string, system string, reference string, prediction string, n int")
    return policy_swap.attach_manifest(evaluate_recognition(df, keep=["document_id"], metrics=["cer"], input_row="n"), manifest(spark))


def test_policy_swap(spark):
    x = swap_table(spark)
    r = policy_swap.policy_swap_summary(x, n_boot=50).collect()
    assert len(r) == 1 and len(r[0]) == 19
    r = r[0]
    assert (r.condition_a, r.condition_b, r.n_lines, r.output_change_rate) == ("matched", "neutral", 4, 0.5)
    assert r.target_difference_b_minus_a > 0 and r.worsened_from_target == 0.5 and r.unchanged_target_error == 0.5
    ordered = policy_swap.policy_swap_summary(x, n_boot=50, order="input_row").first()
    assert (ordered.condition_a, ordered.condition_b) == ("neutral", "matched") and ordered.target_difference_b_minus_a < 0
    changed = policy_swap.changed_outputs(x)
    assert changed.count() == 2 and len(changed.columns) == 13
    assert "revision_a" in policy_swap.add_provenance(changed, manifest(spark)).columns
    assert policy_swap.policy_swap_summary(x.filter("system = 'n'"), n_boot=5).count() == 0


def test_policy_swap_is_strict(spark):
    x = swap_table(spark)
    for f in (policy_swap.policy_swap_summary, policy_swap.changed_outputs):
        with pytest.raises(ValueError, match="several rows"):
            f(x.unionByName(x.limit(1)))
        with pytest.raises(ValueError, match="same pairs"):
            f(x.filter("not (line_id = '1' and system = 'n')"))
    assert policy_swap.policy_swap_summary(x.filter("not (line_id = '1' and system = 'n')"), n_boot=5, unpaired="drop").first().n_lines == 3
    nulls = x.withColumn("document_id", F.lit(None).cast("string"))
    assert policy_swap.policy_swap_summary(nulls, n_boot=5).first().n_units == 1


def test_manifest_checks(spark):
    m = manifest(spark)
    x = spark.createDataFrame([("n",), ("m",)], "system string")
    assert [r[0] for r in policy_swap.unused_systems(x, m).collect()] == ["c"]
    assert policy_swap.frozen_identity(m).first().frozen
    with pytest.raises(ValueError, match="not in the manifest"):
        policy_swap.attach_manifest(spark.createDataFrame([("zz",)], "system string"), m)
    with pytest.raises(ValueError, match="twice"):
        policy_swap.attach_manifest(x, m.unionByName(m))
    with pytest.raises(ValueError, match="locked twice"):
        policy_swap.freeze_revisions(m, spark.createDataFrame([("a/b", "1"), ("a/b", "2")], "model_id string, revision string"))
    rows = [("a", "org/x", "TO_FREEZE"), ("b", "org/x", "r1"), ("c", "local", "TO_FREEZE"), ("d", "org/y", "TO_FREEZE"), ("e", None, "TO_FREEZE")]
    open_ = spark.createDataFrame(rows, "system string, model_id string, revision string")
    got = {r.system: r.revision for r in policy_swap.freeze_revisions(open_, spark.createDataFrame([("org/x", "sha"), ("local", "no")], "model_id string, revision string")).collect()}
    assert got == {"a": "sha", "b": "r1", "c": "TO_FREEZE", "d": "TO_FREEZE", "e": "TO_FREEZE"}
