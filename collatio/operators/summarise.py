"""Group summaries of an evaluation table: pooled, averaged, averaged by unit; error profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.functions.align import error_rate
from collatio.policy import check_columns, choice

SUMS = ("n_reference", "n_hypothesis", "substitutions", "deletions", "insertions", "distance")


def _groups(x: DataFrame, by: Sequence[str]) -> list[str]:
    by = list(dict.fromkeys([*([by] if isinstance(by, str) else by), "metric"]))
    check_columns(x.columns, *by, *SUMS)
    return by


def summarise_recognition(x: DataFrame, by: Sequence[str] = (), averaging: str = "micro", unit: str | None = None) -> DataFrame:
    """One row per group and metric: averaging, rate, n_rows, n_units and six sums.

    micro pools distances and lengths; macro is the mean of the rows' rates or, with a unit, the mean of the units'
    pooled rates.  A null group or unit is one of its own.  n_units counts units (rows without a unit)."""
    groups = _groups(x, by)
    check_columns(x.columns, unit)
    sums = [F.sum(c).cast("long").alias(c) for c in SUMS]
    if choice("averaging", averaging, ("micro", "macro")) == "macro" and unit is None:
        rates = x if "rate" in x.columns else x.withColumn("rate", error_rate("distance", "n_reference", "insertions"))
        out = rates.groupBy(*groups).agg(F.avg("rate").alias("rate"), F.count("*").alias("n_rows"), *sums).withColumn("n_units", F.col("n_rows"))
    elif unit is None:
        out = x.groupBy(*groups).agg(F.count("*").alias("n_rows"), *sums).withColumn("n_units", F.col("n_rows"))
        out = out.withColumn("rate", error_rate("distance", "n_reference", "insertions"))
    else:
        # by unit first: the second step only sees one row a unit
        units = x.groupBy(*dict.fromkeys([*groups, unit])).agg(F.count("*").alias("n_rows"), *sums)
        units = units.withColumn("rate", error_rate("distance", "n_reference", "insertions"))
        out = units.groupBy(*groups).agg(F.avg("rate").alias("rate"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_units"), *sums)
        if averaging == "micro":
            out = out.withColumn("rate", error_rate("distance", "n_reference", "insertions"))
    return out.select(*groups, F.lit(averaging).alias("averaging"), "rate", "n_rows", "n_units", *SUMS)


def summarise_sets(x: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Pooled summaries for several sets of groups in one pass (GROUPING SETS); grouping tells the set of a row by
    the names of its columns."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    groups = _groups(x, every)
    keys = [F.col(c) for c in groups]
    sums = [F.sum(c).cast("long").alias(c) for c in SUMS]
    out = x.groupingSets([[F.col(c) for c in dict.fromkeys([*s, "metric"])] for s in sets], *keys).agg(
        F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in every]).alias("grouping"), F.count("*").alias("n_rows"), *sums
    )
    return out.withColumn("rate", error_rate("distance", "n_reference", "insertions"))


def error_profile(x: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums per group and metric with the rate of each kind of difference; these are null without a reference."""
    groups = _groups(x, by)
    kinds = ("substitutions", "deletions", "insertions")
    out = x.groupBy(*groups).agg(F.count("*").alias("n_rows"), *[F.sum(c).cast("long").alias(c) for c in ("n_reference", *kinds, "distance")])
    rates = [F.when(F.col("n_reference") != 0, F.col(k) / F.col("n_reference")).alias(k[:-1] + "_rate") for k in kinds]
    return out.select("*", *rates, error_rate("distance", "n_reference", "insertions").alias("error_rate"))
