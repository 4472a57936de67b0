import pytest
from pyspark.sql import functions as F

from collatio.functions.align import cer, edit_counts, output_distance, wer
from collatio.functions.text import normalize_text, tokenize
from collatio.operators import diagnostics
from collatio.operators.evaluate import evaluate_recognition, normalization_sensitivity, number_rows
from collatio.operators.summarise import error_profile, summarise_recognition, summarise_sets
from collatio.policy import EvalPolicy


def one(spark, r, p, f, **k):
    return spark.createDataFrame([(r, p)], "reference string, prediction string").select(f("reference", "prediction", **k)).first()[0]


@pytest.mark.parametrize(("r", "p", "c"), [("abc", "abc", 0), ("abc", "axc", 1 / 3), ("", "", 0), ("", "abc", 3), (None, "a", None)])
def test_cer(spark, r, p, c):
    assert one(spark, r, p, cer) == c


def test_wer_and_units(spark):
    assert one(spark, "one two", "one 2", wer) == 0.5
    assert one(spark, "", "two words", wer) == 2
    assert one(spark, "é", "é", cer) == 0
    assert one(spark, "é", "é", cer, policy=EvalPolicy(unicode="none")) == 1
    assert one(spark, "abc", "axcd", edit_counts).asDict() == {"n_reference": 3, "n_hypothesis": 4, "equal": 2, "substitutions": 1, "deletions": 0, "insertions": 1, "distance": 2}
    assert one(spark, "", "", output_distance) == 0 and one(spark, "ab", "abcd", output_distance) == 0.5


def test_text_columns_agree_with_the_kernel(spark):
    from collatio.functions import kernel

    texts = ["", "  Hello,   WORLD!  ", " a　", "é\U0001f468‍\U0001f469 x", "a\r\nb", "q̃ ⁊ stͣ"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for settings in ({}, {"case": "lower", "whitespace": "collapse", "punctuation": "remove"}, {"unicode": "NFKC", "whitespace": "trim"}, {"unicode": "none", "case": "upper"}):
        got = [r[0] for r in df.select(normalize_text("t", **settings)).collect()]
        assert got == [*(kernel.normalize(t, EvalPolicy.of(settings)) for t in texts), None]
    for unit in ("grapheme", "codepoint", "word"):
        assert [r[0] for r in df.select(tokenize("t", unit)).collect()][:-1] == [kernel.tokenize(t, unit) for t in texts]


@pytest.fixture
def table(spark):
    rows = [("d1", "l1", "A", "abc def", "abc def", 1), ("d1", "l2", "A", "abc", "axc", 2), (None, "l3", "B", "", "ab", 3)]
    return spark.createDataFrame(rows, "document_id string, line_id string, system string, reference string, prediction string, n int")


def test_evaluate(table):
    x = evaluate_recognition(table, keep=["document_id"], input_row="n")
    assert x.count() == 6 and x.columns[:6] == ["line_id", "system", "document_id", "reference", "prediction", "input_row"]
    assert "reference" not in evaluate_recognition(table, keep_text=False, input_row="n").columns
    assert evaluate_recognition(table.limit(0), input_row="n").count() == 0
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert x.filter("rate > 0")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_evaluate_errors(spark, table):
    for k in ({"metrics": []}, {"metrics": ["x"]}, {"keep": ["nope"]}, {"truth": "nope"}):
        with pytest.raises(ValueError):
            evaluate_recognition(table, input_row="n", **k)
    holes = spark.createDataFrame([("l", "A", "a", None, 7)], "line_id string, system string, reference string, prediction string, n int")
    with pytest.raises(Exception, match="missing prediction text in input row 7"):
        evaluate_recognition(holes, input_row="n").collect()
    assert evaluate_recognition(holes, input_row="n", missing="drop").count() == 0


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    assert all(r.input_row == r.k + 1 for r in number_rows(df, "k").collect())


def pooled(spark, rows):
    names = "document_id string, metric string, n_reference int, n_hypothesis int, substitutions int, deletions int, insertions int, distance int"
    return spark.createDataFrame([(d, "cer", n, n, e, 0, 0, e) for d, n, e in rows], names)


def test_summaries(spark):
    x = pooled(spark, [("a", 2, 1), ("a", 8, 1), (None, 4, 4)])
    micro = summarise_recognition(x, ["document_id"]).collect()
    assert {r.document_id: r.rate for r in micro} == {"a": 0.2, None: 1.0}
    macro = summarise_recognition(pooled(spark, [("a", 1, 1), ("b", 4, 0), ("b", 6, 1)]), [], "macro", "document_id").first()
    assert macro.n_units == 2 and macro.rate == pytest.approx((1 + 0.1) / 2) and macro.n_rows == 3
    rows = summarise_recognition(pooled(spark, [("a", 2, 1), ("b", 8, 1)]), [], "macro").first()
    assert rows.rate == pytest.approx((0.5 + 0.125) / 2)
    assert summarise_recognition(x.limit(0), []).count() == 0
    with pytest.raises(ValueError):
        summarise_recognition(x, [], "median")
    sets = summarise_sets(x, [["document_id"], []]).collect()
    assert {(r.grouping, r.n_rows) for r in sets} == {("document_id", 2), ("document_id", 1), ("", 3)}


def test_error_profile(spark):
    x = spark.createDataFrame([("cer", 6, 6, 1, 1, 0, 2), ("wer", 0, 0, 0, 0, 2, 2)], "metric string, n_reference int, n_hypothesis int, substitutions int, deletions int, insertions int, distance int")
    r = {x.metric: x for x in error_profile(x, ["metric"]).collect()}
    assert r["cer"].error_rate == 2 / 6 and r["cer"].insertion_rate == 0 and r["wer"].substitution_rate is None and r["wer"].error_rate == 2


def test_sensitivity(spark):
    df = spark.createDataFrame([("l", "A", "Hello, world!", "hello world", 1)], "line_id string, system string, reference string, prediction string, n int")
    policies = {"strict": {}, "relaxed": {"case": "lower", "punctuation": "remove", "whitespace": "collapse"}}
    rates = {(r.policy, r.metric): r.rate for r in normalization_sensitivity(df, policies, input_row="n").collect()}
    assert rates["strict", "cer"] > rates["relaxed", "cer"] == 0
    done = normalization_sensitivity(df, policies, metrics=["cer"], summarise=True, by=["system"], input_row="n").collect()
    assert {r.policy: r.rate for r in done}["relaxed"] == 0
    for bad in ({}, {"": {}}, {"x": {"colour": 1}}):
        with pytest.raises(ValueError):
            normalization_sensitivity(df, bad, input_row="n")


def test_diagnostics(spark):
    df = spark.createDataFrame([("l1", "A", "abc", "axd", 1), ("l2", "A", "ab", "a", 2), ("l3", "A", "ab", "abc", 3)], "line_id string, system string, reference string, prediction string, n int")
    x = evaluate_recognition(df, input_row="n")
    got = {(r.reference_token, r.prediction_token, r.operation): r.n for r in diagnostics.confusion_table(x).collect()}
    assert got == {("b", "x", "substitution"): 1, ("c", "d", "substitution"): 1, ("b", "<eps>", "deletion"): 1, ("<eps>", "c", "insertion"): 1}
    assert diagnostics.confusion_table(x, include_equal=True).filter("operation = 'equal'").agg(F.sum("n")).first()[0] == 4
    spans = diagnostics.extract_error_spans(x, by=["system"], context=2).collect()
    assert len(spans) == 3 and spans[0].__fields__[:3] == ["system", "input_row", "span_id"]
    with pytest.raises(ValueError, match="keep_text"):
        diagnostics.confusion_table(evaluate_recognition(df, keep_text=False, input_row="n"))
    with pytest.raises(ValueError):
        diagnostics.extract_error_spans(x, context=-1)
    own = normalization_sensitivity(df.limit(1), {"a": {}, "b": {"case": "upper"}}, metrics=["cer"], input_row="n")
    tokens = {(r.policy, r.reference_token) for r in diagnostics.confusion_table(own, by=["policy"]).collect()}
    assert ("a", "b") in tokens and ("b", "B") in tokens
    # many policies, and one that isn't known, in one pass: nothing is dropped
    many = own.withColumn("policy_case", F.when(F.col("policy") == "b", F.lit(None).cast("string")).otherwise(F.col("policy_case")))
    assert {(r.policy, r.reference_token) for r in diagnostics.confusion_table(many, by=["policy"]).collect()} == {("a", "b"), ("a", "c"), ("b", "b"), ("b", "c")}
    plan = diagnostics.confusion_table(own, by=["policy"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the evaluation and the script
