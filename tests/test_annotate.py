import pytest
from pyspark.sql import functions as F

from collatio.operators import annotate, preferences, sampling
from collatio.operators.evaluate import evaluate_recognition


def test_codebook(spark):
    c = annotate.fidelity_codebook(spark)
    assert c.count() == 11 and c.select("behavior_group").distinct().count() == 6


def batch(spark, **k):
    rows = [(f"l{i}", "AB"[i % 2], "abcdefgh", "abXdefYh", i) for i in range(20)]
    df = spark.createDataFrame(rows, "line_id string, system string, reference string, prediction string, n int")
    return annotate.prepare_fidelity_annotation(evaluate_recognition(df, input_row="n"), n=10, **k)


def test_batch(spark):
    b = batch(spark)
    assert b.items.count() == b.key.count() == 10 and "system" not in b.items.columns and "system" in b.key.columns
    assert {r.system: r.n for r in b.key.groupBy("system").agg(F.count("*").alias("n")).collect()} == {"A": 5, "B": 5}
    assert sorted(r[0] for r in b.items.select("annotation_id").collect())[0] == "ann_000001"
    assert "system" in batch(spark, blind=False).items.columns
    assert b.items.orderBy("annotation_id").collect() == batch(spark).items.orderBy("annotation_id").collect()
    with pytest.raises(ValueError):
        batch(spark, blind="yes")


def test_sampling(spark):
    df = spark.range(100).select(F.when(F.col("id") < 90, "big").otherwise(F.when(F.col("id") < 97, "small")).alias("s"), "id")
    got = sampling.stratified_sample(df, ["s"], 30, ["id"])
    by = {r.s: r.n for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert sum(by.values()) == 30 and by["small"] == 7 and by[None] == 3 and by["big"] == 20
    assert sorted(r.draw for r in got.collect()) == list(range(1, 31))
    assert sampling.stratified_sample(df, ["s"], 500, ["id"]).count() == 100
    assert sampling.stratified_sample(df, ["s"], 2, ["id"]).count() == 2
    assert sampling.stratified_sample(df.limit(0), ["s"], 5, ["id"]).count() == 0
    with pytest.raises(ValueError):
        sampling.stratified_sample(df, ["s"], 0, ["id"])


def test_balanced_sample(spark):
    df = spark.range(120).select(F.lit("g").alias("g"), (F.col("id") % 4).cast("string").alias("d"), F.col("id").cast("string").alias("l")).filter("d <> '3' or l in ('3', '7')")
    got = sampling.balanced_sample(df, "g", "d", "l", 10, 4)
    by = {r.d: r.n for r in got.groupBy("d").agg(F.count("*").alias("n")).collect()}
    assert sum(by.values()) == 10 and max(by.values()) <= 4 and by["3"] == 2 and min(by.values()) >= 2


def labels(spark, rows):
    return spark.createDataFrame(rows, "annotation_id string, annotator string, primary_label string")


def test_agreement(spark):
    four = [("1", "repetition", "repetition"), ("2", "other", "other"), ("3", "other", "repetition"), ("4", "ambiguous", "ambiguous")]
    df = labels(spark, [(i, w, x) for i, a, b in four for w, x in (("p", a), ("q", b))])
    r = annotate.fidelity_agreement(df).first()
    assert r.raw_agreement == 0.75 and r.n_items == 4 and r.expected_agreement == pytest.approx((1 * 2 + 2 * 1 + 1) / 16)
    same = annotate.fidelity_agreement(labels(spark, [("1", "p", "other"), ("1", "q", "other")])).first()
    assert same.cohen_kappa == 1
    assert annotate.pairwise_agreement(df).first().raw_agreement == 0.75
    alone = labels(spark, [("1", "p", "other"), ("2", "q", "other")])
    r = annotate.fidelity_agreement(alone).first()
    assert r.n_items == 0 and r.raw_agreement is None and r.cohen_kappa is None
    assert annotate.fidelity_agreement(alone, drop_missing=False).first().n_items == 2
    with pytest.raises(ValueError):
        annotate.fidelity_agreement(alone, strict=True)
    for bad in ([("1", "p", "x"), ("1", "q", "x")], [("1", w, "other") for w in "pqr"], [("1", "p", "other"), ("1", "p", "other"), ("1", "q", "other")]):
        with pytest.raises(ValueError):
            annotate.fidelity_agreement(labels(spark, bad))
    assert annotate.fidelity_agreement(labels(spark, [("1", "p", "A"), ("1", "q", "B")]), allowed_labels=None).first().raw_agreement == 0


def test_profile(spark):
    df = labels(spark, [("1", "p", "other"), ("2", "p", "repetition"), ("3", "p", "other"), ("4", "p", " ")])
    key = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B"), ("4", "B")], "annotation_id string, system string")
    got = {(r.system, r.label): r.proportion for r in annotate.fidelity_profile(df, key).collect()}
    assert got == {("A", "other"): 0.5, ("A", "repetition"): 0.5, ("B", "other"): 1.0}
    assert {r.label for r in annotate.fidelity_profile(df, key, include_unlabelled=True).collect()} == {"other", "repetition", "unlabelled"}
    with pytest.raises(ValueError):
        annotate.fidelity_profile(df, key.unionByName(key))
    with pytest.raises(ValueError):
        annotate.fidelity_profile(labels(spark, [("1", "p", "nope")]), key)


def changed(spark, n=40):
    rows = [("M", "matched", "neutral", "m", "n", "d", str(i), "ref", f"a{i}", f"b{i}", 0.1, 0.3, 0.2) for i in range(n)]
    names = "model,condition_a,condition_b,system_a,system_b,document_id,line_id,reference,prediction_a,prediction_b".split(",")
    return spark.createDataFrame(rows, ", ".join([f"{c} string" for c in names] + ["target_rate_a double", "target_rate_b double", "target_delta_b_minus_a double"]))


def test_preferences(spark):
    b = preferences.prepare_preference_batch(changed(spark), 20)
    key = b.key.collect()
    assert len(key) == 20 and {r.condition_A for r in key} == {"matched", "neutral"}
    assert all((r.target_delta_B_minus_A < 0) == (r.condition_A == "neutral") for r in key)
    with pytest.raises(ValueError, match="no changed outputs"):
        preferences.prepare_preference_batch(changed(spark, 0))
    better = b.items.join(b.key, "annotation_id").select("annotation_id", F.when(F.col("target_delta_B_minus_A") < 0, "B").otherwise("A").alias("preferred_output"))
    d = preferences.unblind(better, b.key)
    s = preferences.preference_summary(d).first()
    assert (s.condition_1, s.condition_1_preferred, s.human_vs_cer_agreement, s.n_decisive) == ("matched", 20, 1.0, 20) and s.condition_1_wilson_high == 1
    exact = preferences.preference_summary(d, "exact").first()
    assert exact.condition_1_conf_low == pytest.approx(0.8315665, abs=1e-6) and exact.condition_1_conf_high == 1
    assert preferences.relation_table(d).first().human_cer_relation == "agree"
    assert preferences.relation_table(d, zero_fill=True).count() == 4 and preferences.disagreements(d).count() == 0
    with pytest.raises(ValueError, match="unknown preference"):
        preferences.unblind(better.withColumn("preferred_output", F.lit("C")), b.key)
    with pytest.raises(ValueError, match="not in the key"):
        preferences.unblind(better, b.key.limit(0))


def test_relations(spark):
    key = spark.createDataFrame([("1", "M", "x", "y", 0.1)], "annotation_id string, model string, condition_A string, condition_B string, target_delta_B_minus_A double")
    for label, want in (("A", "agree"), ("B", "disagree"), ("tie", "one_tie"), ("ambiguous", "ambiguous")):
        got = preferences.unblind(spark.createDataFrame([("1", label)], "annotation_id string, preferred_output string"), key).first()
        assert got.human_cer_relation == want
