"""Evaluation of recognition results as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.functions.align import error_rate
from collatio.operators.evaluate import evaluate_recognition
from collatio.operators.summarise import SUMS
from collatio.policy import EvalPolicy


def evaluate_stream(rows: DataFrame, input_row: str = "row_id", keep: Sequence[str] = (), metrics: Sequence[str] = ("cer", "wer"), policy: EvalPolicy | None = None) -> DataFrame:
    """evaluate_recognition on a stream: it looks at one row at a time, so there is no state; rows without a text are
    left out."""
    return evaluate_recognition(rows, keep=keep, metrics=metrics, policy=policy, input_row=input_row, missing="drop")


def summarise_stream(x: DataFrame, time: str, by: Sequence[str] = ("system",), window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Pooled summaries by window of event time.  State is one row a group and open window; rows later than the
    watermark are left out, resent rows should be dropped before (drop_resent)."""
    sums = [F.sum(c).cast("long").alias(c) for c in SUMS]
    out = x.withWatermark(time, late).groupBy(F.window(time, window), *by, "metric").agg(F.count("*").alias("n_rows"), *sums)
    return out.withColumn("rate", error_rate("distance", "n_reference", "insertions"))


def drop_resent(rows: DataFrame, time: str, keys: Sequence[str] = ("line_id", "system"), late: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
