import pytest
from pyspark.sql import functions as F

from collatio.operators.policy_swap import MANIFEST
from collatio.plans import pipelines, registry


def table(spark):
    rows = [(f"d{i % 2}", f"l{i}", s, "Latin", "abcdef gh", p) for i in range(6) for s, p in (("n", "abXdef gh" if i % 2 else "abcdef gh"), ("m", "abcdef g"))]
    return spark.createDataFrame(rows, "document_id string, line_id string, system string, language string, reference string, prediction string")


def test_run_analysis(spark, tmp_path):
    done = pipelines.run_analysis(table(spark), str(tmp_path), annotation_n=4, n_boot=20)
    assert done["evaluation"].count() == 24 and done["comparisons"].count() == 4 and done["annotation_items"].count() == 4
    assert done["summary_by_language"].count() == 4 and done["manifest"].first().annotation_n == 4 and done["error_spans"].count() == 9
    assert sorted(r.input_row for r in done["evaluation"].filter("metric = 'cer'").collect()) == list(range(1, 13))
    with pytest.raises(ValueError):
        pipelines.run_analysis(table(spark).limit(3), str(tmp_path))


def test_run_policy_swap(spark, tmp_path):
    manifest = spark.createDataFrame([("n", "M", "f", "neutral", "neutral", "id", "r", None), ("m", "M", "f", "x", "matched", "id", "r", "p")], ", ".join(f"{c} string" for c in MANIFEST))
    done = pipelines.run_policy_swap(table(spark), manifest, str(tmp_path), n_boot=20)
    assert done["policy_swap_summary"].count() == 2 and done["changed_outputs"].count() == 6 and "revision_a" in done["policy_swap_summary"].columns
    with pytest.raises(ValueError, match="frozen"):
        pipelines.run_policy_swap(table(spark), manifest.replace("r", "q", ["revision"]).unionByName(manifest).filter("system = 'n' and revision = 'q' or system = 'm' and revision = 'r'"), str(tmp_path))


def test_preferences_from_batch_to_summary(spark, tmp_path):
    manifest = spark.createDataFrame([("n", "M", "f", "neutral", "neutral", "id", "r", None), ("m", "M", "f", "x", "matched", "id", "r", "p")], ", ".join(f"{c} string" for c in MANIFEST))
    changed = pipelines.run_policy_swap(table(spark), manifest, str(tmp_path / "a"), n_boot=5)["changed_outputs"]
    batch = pipelines.run_preference_batch(changed, str(tmp_path / "b"), n=4)
    assert batch["preference_items"].count() == batch["preference_key"].count() == batch["manifest"].first().n_items == 4
    assert not {"system_A", "condition_A"} & set(batch["preference_items"].columns)
    labels = batch["preference_items"].withColumn("preferred_output", F.when(F.col("annotation_id") == "pref_000001", "tie").otherwise("A"))
    for method in ("wilson", "exact"):
        done = pipelines.run_preference_analysis(labels, batch["preference_key"], str(tmp_path / method), method)
        r = done["preference_summary"].first()
        assert (r.n_labelled, r.n_decisive, r.n_tie) == (4, 3, 1) and done["human_cer_relation"].count() == 4
    with pytest.raises(ValueError, match="no item has a label"):
        pipelines.run_preference_analysis(batch["preference_items"], batch["preference_key"], str(tmp_path / "c"))


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES) and len(registry.QUERIES) >= 38
