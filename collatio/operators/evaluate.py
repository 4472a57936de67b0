"""Evaluation tables: one row for each input row and metric, under one or several policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions.align import COUNTS, cells, error_rate
from collatio.operators.summarise import summarise_recognition
from collatio.policy import EvalPolicy, check_columns, check_metrics
from collatio.sources import cut_lineage


def number_rows(df: DataFrame, order_by: str | Sequence[str], name: str = "input_row") -> DataFrame:
    """df with the 1-based position of each row in the given (total) order.

    Sorted by range, so no task sees all rows; only the row counts of the partitions are put in one place."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    check_columns(df.columns, *keys)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(placed.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")))
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("__before", F.coalesce(before, F.lit(0)))
    out = placed.join(F.broadcast(parts), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__id") - F.col("__first") + 1).cast("long")).drop("__part", "__id", "__n", "__first", "__before")


def _base(df: DataFrame, truth: str, prediction: str, id: str | None, system: str | None, keep: Sequence[str], input_row: str | None) -> list[str]:
    check_columns(df.columns, truth, prediction, id, system, *keep, input_row)
    names = [c for c in (id, system, *keep) if c is not None]
    return [c for c in dict.fromkeys(names) if c not in (truth, prediction)]


def _checked(column: str, input_row: str):
    message = F.concat(F.lit(f"missing {column} text in input row "), F.col(input_row).cast("string"))
    return F.when(F.col(column).isNull(), F.raise_error(message)).otherwise(F.col(column))


def evaluate_recognition(
    df: DataFrame, truth: str = "reference", prediction: str = "prediction", id: str | None = "line_id", system: str | None = "system",
    keep: Sequence[str] = (), keep_text: bool = True, metrics: Sequence[str] = ("cer", "wer"), policy: EvalPolicy | None = None,
    input_row: str | None = None, order_by: str | Sequence[str] | None = None, missing: str = "raise",
) -> DataFrame:
    """One row for each input row and metric: base columns, texts (unless keep_text is off), input_row, metric, rate
    and six counts.  input_row is a column of that name given by the caller, or the position in order_by.

    missing: "raise" fails on a null text when the row is read, "drop" leaves such rows out."""
    return _evaluate(df, truth, prediction, id, system, keep, keep_text, metrics, {"": policy or EvalPolicy()}, input_row, order_by, missing)


def normalization_sensitivity(
    df: DataFrame, policies: dict[str, dict | EvalPolicy], truth: str = "reference", prediction: str = "prediction", id: str | None = "line_id",
    system: str | None = "system", keep: Sequence[str] = (), metrics: Sequence[str] = ("cer", "wer"), summarise: bool = False,
    by: Sequence[str] = (), averaging: str = "micro", unit: str | None = None, input_row: str | None = None,
    order_by: str | Sequence[str] | None = None, missing: str = "raise", char_unit: str | None = None,
) -> DataFrame:
    """The evaluation under each named policy, with the policy's name and settings in each row; summarised by
    by and policy if asked.  All policies are evaluated in one pass over the texts."""
    if not policies or any(not name for name in policies):
        raise ValueError("policies must be named and not empty")
    defaults = {"char_unit": char_unit} if char_unit else {}
    named = {k: v if isinstance(v, EvalPolicy) else EvalPolicy.of({**defaults, **v}) for k, v in policies.items()}
    rows = _evaluate(df, truth, prediction, id, system, keep, not summarise, metrics, named, input_row, order_by, missing)
    if not summarise:
        return rows
    settings = ["policy", *next(iter(named.values())).columns()]
    return summarise_recognition(rows, by=[*by, *settings], averaging=averaging, unit=unit)


def _evaluate(df, truth, prediction, id, system, keep, keep_text, metrics, policies, input_row, order_by, missing) -> DataFrame:
    wanted = check_metrics(metrics)
    base = _base(df, truth, prediction, id, system, list(keep), input_row)
    if missing == "drop":
        df = df.filter(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    if input_row is None:
        df, input_row = number_rows(df, order_by or [c for c in (id, system) if c]), "input_row"
    grid = [(name, p, m) for name, p in policies.items() for m in wanted]
    found = cells(
        _checked(truth, input_row) if missing == "raise" else F.col(truth),
        _checked(prediction, input_row) if missing == "raise" else F.col(prediction),
        [(p.for_metric(m), p.unit(m)) for _, p, m in grid],
    )
    # positions into the one array of counts; inline keeps the alignment a single step of the plan
    label = lambda name, p, m: [F.lit(m).alias("metric")] + ([F.lit(name).alias("policy"), *[F.lit(v).alias(k) for k, v in p.columns().items()]] if name else [])
    texts = [F.col(truth).alias("reference"), F.col(prediction).alias("prediction")] if keep_text else []
    base = [c for c in base if c not in (["reference", "prediction"] if keep_text else []) and c != "input_row"]
    one = df.select(*base, *texts, F.col(input_row).alias("input_row"), F.inline(F.array(F.struct(found.alias("__cells")))))
    rows = one.select(*[c for c in one.columns if c != "__cells"], F.posexplode("__cells").alias("__at", "__c"))
    labels = F.array(*[F.struct(*label(*g)) for g in grid])
    rows = rows.withColumn("__l", labels[F.col("__at")])
    names = ["metric"] + (["policy", *next(iter(policies.values())).columns()] if "" not in policies else [])
    rate = error_rate(F.col("__c.distance"), F.col("__c.n_reference"), F.col("__c.insertions"))
    counted = [F.col(f"__c.{c}").alias(c) for c in COUNTS if c != "equal"]
    text_names = ["reference", "prediction"] if keep_text else []
    return rows.select(*base, *text_names, "input_row", *[F.col(f"__l.{n}").alias(n) for n in names[:1]], rate.alias("rate"), *counted, *[F.col(f"__l.{n}").alias(n) for n in names[1:]])
