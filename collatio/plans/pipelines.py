"""The analyses from a recognition table to a folder of result tables.

The evaluation is written first and read by everything after it, so texts are aligned once for rates and once for spans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from collatio.operators import annotate, compare, diagnostics, policy_swap, preferences
from collatio.operators.evaluate import evaluate_recognition
from collatio.operators.summarise import error_profile, summarise_recognition
from collatio.policy import EvalPolicy
from collatio.sources import write_table
from collatio.sources.validate import require_valid, run_manifest

#: Columns kept with the evaluation where the table has them.
METADATA = (
    "benchmark", "subcorpus", "document_id", "page_id", "task", "language", "corpus_language", "script_type", "century", "year", "model", "model_family", "prompt_policy",
    "prompt_condition", "model_id", "revision", "prompt_file", "image_path", "source_xml", "gen_split",
)
STRATA = ("task", "language", "script_type", "century")


def _written(df: DataFrame, out: str, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    write_table(df, f"{out}/{name}", partition_by)
    return df.sparkSession.read.parquet(f"{out}/{name}")


def run_analysis(table: DataFrame, out: str, policy: EvalPolicy | None = None, annotation_n: int = 400, n_boot: int = 5000, seed: int = 2027, input_row: str | None = None) -> dict[str, DataFrame]:
    """Validate, evaluate, summarise (pooled, by document, by stratum), compare all pairs of systems under both
    estimands, profile, extract spans, and draw an annotation batch.  Returns what was written, by name."""
    require_valid(table)
    keep = [c for c in METADATA if c in table.columns]
    x = _written(evaluate_recognition(table, keep=keep, policy=policy, input_row=input_row, order_by=["line_id", "system"]), out, "evaluation", ("metric",))
    done = {"evaluation": x}
    done["summary_micro"] = _written(summarise_recognition(x, ["system"]), out, "summary_micro")
    done["summary_macro_document"] = _written(summarise_recognition(x, ["system"], "macro", "document_id"), out, "summary_macro_document")
    for stratum in (c for c in STRATA if c in x.columns):
        done[f"summary_by_{stratum}"] = _written(summarise_recognition(x, ["system", stratum], "macro", "document_id"), out, f"summary_by_{stratum}")
    pairs = [compare.compare_all_pairs(x, estimand=e, n_boot=n_boot, seed=seed) for e in ("macro", "micro")]
    done["comparisons"] = _written(pairs[0].unionByName(pairs[1]), out, "comparisons")
    done["error_profile"] = _written(error_profile(x, ["system"]), out, "error_profile")
    by = ["system", "line_id", *keep]
    spans = _written(diagnostics.extract_error_spans(x, "cer", by, 8, policy), out, "error_spans")
    done["error_spans"] = spans
    strata = [c for c in ("system", "task", "language") if c in x.columns]
    batch = annotate.prepare_fidelity_annotation(x, "cer", spans=spans, keep=[c for c in keep if c not in strata], strata=strata, n=annotation_n, context=8, seed=seed, policy=policy)
    for name, df in (("annotation_items", batch.items), ("annotation_key", batch.key), ("codebook", batch.codebook)):
        done[name] = _written(df, out, name)
    done["manifest"] = _written(run_manifest(table, annotation_n=done["annotation_items"].count(), seed=seed), out, "manifest")
    return done


def run_policy_swap(table: DataFrame, manifest: DataFrame, out: str, policy: EvalPolicy | None = None, n_boot: int = 5000, seed: int = 2027, input_row: str | None = None) -> dict[str, DataFrame]:
    """Attach provenance, check that every model is one frozen model, evaluate, summarise by condition, and compare
    conditions within models: summary for both metrics and all changed outputs."""
    x = policy_swap.attach_manifest(table, manifest)
    if (loose := policy_swap.frozen_identity(manifest).filter("not frozen").limit(1).collect()):
        raise ValueError(f"model {loose[0].model} has several or no frozen ids or revisions")
    keep = [c for c in METADATA if c in x.columns]
    e = _written(evaluate_recognition(x, keep=keep, policy=policy, input_row=input_row, order_by=["line_id", "system"]), out, "evaluation", ("metric",))
    by = ["system", "model", "model_family", "prompt_policy", "prompt_condition"]
    done = {"evaluation": e, "summary_micro": _written(summarise_recognition(e, by), out, "summary_micro")}
    done["summary_macro_document"] = _written(summarise_recognition(e, by, "macro", "document_id"), out, "summary_macro_document")
    swaps = [policy_swap.policy_swap_summary(e, metric=m, n_boot=n_boot, seed=seed, order="input_row") for m in ("cer", "wer")]
    done["policy_swap_summary"] = _written(policy_swap.add_provenance(swaps[0].unionByName(swaps[1]), manifest), out, "policy_swap_summary")
    done["changed_outputs"] = _written(policy_swap.changed_outputs(e, order="input_row"), out, "changed_outputs")
    done["manifest"] = _written(run_manifest(x, n_boot=n_boot, seed=seed), out, "manifest")
    return done


def run_preference_batch(changed: DataFrame, out: str, n: int = 300, seed: int = 2027) -> dict[str, DataFrame]:
    """From the changed outputs of a policy swap to what annotators get and the key that joins it back, written apart."""
    batch = preferences.prepare_preference_batch(changed, n, seed, tuple(c for c in METADATA if c in changed.columns and c not in ("document_id", "model", *policy_swap.MANIFEST)))
    done = {"preference_items": _written(batch.items, out, "preference_items"), "preference_key": _written(batch.key, out, "preference_key")}
    done["manifest"] = _written(changed.sparkSession.createDataFrame([(done["preference_items"].count(), n, seed)], "n_items long, n_wanted int, seed int"), out, "preference_manifest")
    return done


def run_preference_analysis(labels: DataFrame, key: DataFrame, out: str, method: str = "wilson") -> dict[str, DataFrame]:
    """From labelled items and their key to the unblinded items, the summary, the relation of labels and rates, and the
    items where they disagree."""
    d = _written(preferences.unblind(labels, key), out, "preferences_unblinded")
    if not d.limit(1).count():
        raise ValueError("no item has a label")
    done = {"preferences_unblinded": d, "preference_summary": _written(preferences.preference_summary(d, method), out, "preference_summary")}
    done["human_cer_relation"] = _written(preferences.relation_table(d, zero_fill=True), out, "human_cer_relation")
    done["disagreements"] = _written(preferences.disagreements(d), out, "disagreements")
    return done
