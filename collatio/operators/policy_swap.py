"""What happens to a model's output when its prompt policy is swapped."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions.align import output_distance
from collatio.operators.compare import _check, _estimates, require_pairs
from collatio.policy import check_columns

#: Rates that differ by less are the same.
TOLERANCE = sys.float_info.epsilon**0.5
# Fixed value: how a manifest marks a revision that isn't frozen yet.
TO_FREEZE = "TO_FREEZE"
MANIFEST = ("system", "model", "model_family", "prompt_policy", "prompt_condition", "model_id", "revision", "prompt_file")


def attach_manifest(x: DataFrame, manifest: DataFrame, system_col: str = "system") -> DataFrame:
    """x with the manifest's columns of each row's system (many to one, left).  Columns that x has already are left
    out; a system that stands twice in the manifest, or that it lacks, raises."""
    check_columns(manifest.columns, *MANIFEST)
    if (twice := manifest.groupBy("system").count().filter("count > 1").limit(1).collect()):
        raise ValueError(f"the manifest has system {twice[0].system} twice")
    unknown = x.select(system_col).distinct().join(manifest.select(F.col("system").alias(system_col)), system_col, "left_anti").filter(F.col(system_col).isNotNull())
    if (lost := unknown.limit(1).collect()):
        raise ValueError(f"system {lost[0][0]} is not in the manifest")
    extra = [c for c in manifest.columns if c != "system" and c not in x.columns]
    return x.join(manifest.select(F.col("system").alias(system_col), *extra), system_col, "left")


def unused_systems(x: DataFrame, manifest: DataFrame, system_col: str = "system") -> DataFrame:
    """Systems of the manifest that x doesn't have."""
    return manifest.select(F.col("system").alias(system_col)).join(x.select(system_col).distinct(), system_col, "left_anti")


def frozen_identity(manifest: DataFrame) -> DataFrame:
    """model, n_model_ids, n_revisions, frozen: whether all rows of a model that aren't fixed have one model_id and one
    revision (blanks don't count)."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    rows = manifest.filter(~F.col("prompt_condition").eqNullSafe("fixed") & (F.trim("model") != ""))
    out = rows.groupBy("model").agg(F.countDistinct(blank("model_id")).alias("n_model_ids"), F.countDistinct(blank("revision")).alias("n_revisions"))
    return out.withColumn("frozen", (F.col("n_model_ids") == 1) & (F.col("n_revisions") == 1))


def freeze_revisions(manifest: DataFrame, locked: DataFrame) -> DataFrame:
    """The manifest with the revision of locked (model_id, revision; one row a model) where its own is still to be frozen
    and the model's id is that of a repository (owner/name).  Models that locked lacks stay as they are."""
    if (twice := locked.groupBy("model_id").count().filter("count > 1").limit(1).collect()):
        raise ValueError(f"{twice[0].model_id} is locked twice")
    known = locked.select(F.col("model_id").alias("__id"), F.col("revision").alias("__revision"))
    out = manifest.join(known, F.trim("model_id") == F.col("__id"), "left")
    open_ = (F.trim("revision") == TO_FREEZE) & F.trim("model_id").rlike("^[^/.][^/]*/.+") & F.col("__revision").isNotNull()
    return out.withColumn("revision", F.when(open_, F.col("__revision")).otherwise(F.col("revision"))).select(*manifest.columns)


def condition_conflicts(x: DataFrame, model_col: str = "model", condition_col: str = "prompt_condition", system_col: str = "system") -> DataFrame:
    """Conditions that stand for more than one system, of the models that have several conditions."""
    rows = x.filter(F.trim(F.col(model_col)) != "").select(model_col, condition_col, system_col).distinct()
    counted = rows.groupBy(model_col, condition_col).agg(F.count(system_col).alias("n_systems"))
    several = F.count(condition_col).over(Window.partitionBy(model_col))  # one row a condition
    return counted.withColumn("__several", several).filter("n_systems > 1 and __several > 1").drop("__several")


def _pairs(x: DataFrame, metric: str, model_col: str, condition_col: str, system_col: str, keys: list[str], order: str | None, unpaired: str) -> DataFrame:
    """One row for each line and pair of conditions of a model; a before b by first appearance (the least value of
    order, else by name).  A line that a condition has twice, and references that differ, raise; so does, unless
    unpaired is "drop", a line that some condition of the model lacks."""
    check_columns(x.columns, model_col, condition_col, system_col, *keys, "metric", "prediction", "rate", "distance", "n_reference", "insertions", order)
    rows = x.filter((F.col("metric") == metric) & (F.trim(F.col(model_col)) != "") & F.col(condition_col).isNotNull())
    rank = rows.groupBy(F.col(model_col).alias("model"), F.col(condition_col).alias("condition")).agg(F.min(order or condition_col).alias("first"))
    # models with one condition have no pairs and needn't be in order
    several = rank.groupBy(F.col("model").alias(model_col)).count().filter("count > 1").select(model_col)
    rows = rows.join(F.broadcast(several), model_col, "left_semi")
    require_pairs(rows, [model_col], condition_col, keys, unpaired)
    side = lambda s: rows.select(
        F.col(model_col).alias("model"), *keys, F.col(condition_col).alias(f"condition_{s}"), F.col(system_col).alias(f"system_{s}"), F.col("prediction").alias(f"prediction_{s}"),
        F.col("rate").alias(f"rate_{s}"), F.col("n_reference").alias(f"ref_{s}"), F.col("insertions").alias(f"ins_{s}"), F.col("distance").alias(f"dist_{s}"), *([F.col("reference")] if s == "a" and "reference" in x.columns else []),
    ).join(F.broadcast(rank.select("model", F.col("condition").alias(f"condition_{s}"), F.col("first").alias(f"first_{s}"))), ["model", f"condition_{s}"])
    right = side("b").withColumnsRenamed({k: f"__{k}" for k in ("model", *keys)})
    on = F.col("model") == F.col("__model")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    before = (F.col("first_a") < F.col("first_b")) | ((F.col("first_a") == F.col("first_b")) & (F.col("condition_a") < F.col("condition_b")))
    return side("a").join(right, on & before).drop("__model", *[f"__{k}" for k in keys])


def policy_swap_summary(
    x: DataFrame, model_col: str = "model", condition_col: str = "prompt_condition", system_col: str = "system", pair_id: str = "line_id",
    unit: str = "document_id", metric: str = "cer", n_boot: int = 2000, conf_level: float = 0.95, seed: int = 2027, order: str | None = None, unpaired: str = "raise",
) -> DataFrame:
    """One row for each model and pair of its conditions (models with one condition have none): how often and how far
    outputs change, how lines get better or worse, and the paired macro difference with its interval."""
    _check(n_boot, conf_level)
    if condition_conflicts(x, model_col, condition_col, system_col).limit(1).count():
        raise ValueError("a model's condition stands for several systems")
    keys = list(dict.fromkeys([unit, pair_id]))
    groups = ["model", "condition_a", "condition_b", "system_a", "system_b"]
    pairs = _pairs(x, metric, model_col, condition_col, system_col, keys, order, unpaired)
    pairs = pairs.withColumn("delta", F.col("rate_b") - F.col("rate_a"))
    far = pairs.select("*", F.inline(F.array(F.struct(output_distance("prediction_a", "prediction_b").alias("far")))))
    share = lambda c: F.avg(c.cast("double"))
    lines = far.groupBy(*groups).agg(
        F.count("*").alias("n_lines"), share(F.col("prediction_a") != F.col("prediction_b")).alias("output_change_rate"),
        F.avg("far").alias("mean_output_distance"), F.median("far").alias("median_output_distance"),
        share(F.col("delta") < -TOLERANCE).alias("improved_toward_target"), share(F.col("delta") > TOLERANCE).alias("worsened_from_target"),
        share(F.abs("delta") <= TOLERANCE).alias("unchanged_target_error"), F.avg("delta").alias("mean_line_delta_b_minus_a"),
    )
    units = pairs.groupBy(*groups, F.col(unit).alias("__unit")).agg(*[F.sum(f"{c}_{s}").cast("long").alias(f"{c}_{s}") for s in "ab" for c in ("ref", "ins", "dist")])
    paired = _estimates(units, groups, "macro", n_boot, conf_level, seed).withColumnRenamed("difference_b_minus_a", "target_difference_b_minus_a")
    out = lines.join(paired.drop("estimate_a", "estimate_b", "n_boot"), groups)
    return out.select(
        *groups, F.lit(metric).alias("metric"), "n_lines", "output_change_rate", "mean_output_distance", "median_output_distance", "improved_toward_target",
        "worsened_from_target", "unchanged_target_error", "mean_line_delta_b_minus_a", "target_difference_b_minus_a", "conf_low", "conf_high", "conf_level", "n_units",
    )


def changed_outputs(
    x: DataFrame, metric: str = "cer", model_col: str = "model", condition_col: str = "prompt_condition", system_col: str = "system",
    pair_id: str = "line_id", unit: str = "document_id", order: str | None = None, unpaired: str = "raise",
) -> DataFrame:
    """The lines whose prediction differs between two conditions of a model, with both rates and their difference."""
    pairs = _pairs(x, metric, model_col, condition_col, system_col, list(dict.fromkeys([unit, pair_id])), order, unpaired)
    return pairs.filter("prediction_a <> prediction_b").select(
        "model", "condition_a", "condition_b", "system_a", "system_b", unit, pair_id, "reference", "prediction_a", "prediction_b",
        F.col("rate_a").alias("target_rate_a"), F.col("rate_b").alias("target_rate_b"), (F.col("rate_b") - F.col("rate_a")).alias("target_delta_b_minus_a"),
    )


def add_provenance(pairs: DataFrame, manifest: DataFrame, columns: Sequence[str] = ("model_id", "revision", "prompt_policy", "prompt_file")) -> DataFrame:
    """A table with system_a and system_b, with the manifest's columns of either, suffixed _a and _b."""
    for s in "ab":
        side = manifest.select(F.col("system").alias(f"system_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
        pairs = pairs.join(side, f"system_{s}", "left")
    return pairs
