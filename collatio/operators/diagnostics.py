"""What the differences are: confusions, spans of errors, repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.functions.align import SPAN_FIELDS, align_text, error_spans
from collatio.policy import EvalPolicy, check_columns, choice


def _texts(x: DataFrame, metric: str, by: Sequence[str], policy: EvalPolicy | None) -> tuple[DataFrame, list[str], list[str]]:
    """(rows of the metric, by, columns with each row's own policy)."""
    choice("metric", metric, ("cer", "wer"))
    by = list(dict.fromkeys([by] if isinstance(by, str) else by))
    missing = [c for c in ("reference", "prediction", "input_row") if c not in x.columns]
    if missing:
        raise ValueError(f"the evaluation has no {', '.join(missing)}; evaluate again with keep_text")
    check_columns(x.columns, *by)
    rows = x.filter(F.col("metric") == metric) if "metric" in x.columns else x  # before the alignment, not after it
    # rows of several policies: each is aligned under its own, all in one pass
    own = list(EvalPolicy().columns()) if policy is None and "policy_unicode" in x.columns else []
    return rows, by, own


def confusion_table(x: DataFrame, metric: str = "cer", by: Sequence[str] = (), include_equal: bool = False, epsilon: str = "<eps>", policy: EvalPolicy | None = None) -> DataFrame:
    """by..., reference_token, prediction_token, operation, n, the commonest first; a gap is epsilon."""
    rows, by, own = _texts(x, metric, by, policy)
    script = align_text("reference", "prediction", policy, settings=own, metric=metric)
    if not include_equal:
        # one array out of Python; equal steps are dropped before it is exploded
        script = F.filter(script, lambda s: s["operation"] != "equal")
    token = lambda side: F.coalesce(F.col(f"s.{side}"), F.lit(epsilon))
    out = rows.select(*by, F.explode(script).alias("s")).select(*by, token("reference").alias("reference_token"), token("hypothesis").alias("prediction_token"), "s.operation")
    out = out.groupBy(*by, "reference_token", "prediction_token", "operation").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), *by, "reference_token", "prediction_token", "operation")


def extract_error_spans(x: DataFrame, metric: str = "cer", by: Sequence[str] = (), context: int = 5, policy: EvalPolicy | None = None) -> DataFrame:
    """One row for each maximal run of differences: by..., input_row, span_id, the span's operations, texts, 1-based
    positions, counts and contexts, whether it may be a repetition, and both full texts."""
    if not isinstance(context, int) or context < 0:
        raise ValueError("context must be an integer from 0 on")
    rows, by, own = _texts(x, metric, by, policy)
    by = [c for c in by if c not in ("input_row", "reference", "prediction")]
    spans = error_spans("reference", "prediction", policy or EvalPolicy(), metric, context, own)
    names = [n for n, _ in SPAN_FIELDS]
    return rows.select(*by, "input_row", "reference", "prediction", F.inline(spans)).select(*by, "input_row", *names, "reference", "prediction")
