"""Blinded preferences between two outputs of a model: batches, unblinding, and what they say against the rates."""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.operators.policy_swap import TOLERANCE
from collatio.operators.sampling import hash_index, stratified_sample
from collatio.sources import cut_lineage

# What a preference may be.
PREFERENCES = ("A", "B", "tie", "ambiguous")
Z95 = 1.959963984540054


class PreferenceBatch(NamedTuple):
    items: DataFrame
    key: DataFrame


def prepare_preference_batch(changed: DataFrame, n: int = 300, seed: int = 2027, metadata: tuple[str, ...] = (), unit: str = "document_id", pair_id: str = "line_id") -> PreferenceBatch:
    """A balanced sample of changed outputs, whose sides are swapped by a hash bit in half of the items; the key
    has conditions, systems, rates and their difference in the order that the annotator saw."""
    groups = ["model", "condition_a", "condition_b"]
    rows = cut_lineage(changed.filter("prediction_a <> prediction_b"))  # aligned once, read by every step of the sample
    if not rows.limit(1).count():
        raise ValueError("no changed outputs")
    drawn = stratified_sample(rows, groups, n, [*groups, unit, pair_id], seed)
    drawn = cut_lineage(drawn).withColumn("annotation_id", F.format_string("pref_%06d", "draw")).withColumn("swap", hash_index(F.lit(2), seed, F.lit("swap"), *groups, unit, pair_id) == 1)
    first = lambda c: F.when(F.col("swap"), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    second = lambda c: F.when(F.col("swap"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("preferred_output", "string"), ("reason_label", "string"), ("annotator", "string"), ("confidence", "int"), ("notes", "string"))]
    items = drawn.select("annotation_id", unit, pair_id, "reference", first("prediction").alias("output_A"), second("prediction").alias("output_B"), *empty, *[c for c in metadata if c in changed.columns])
    delta = F.when(F.col("swap"), -F.col("target_delta_b_minus_a")).otherwise(F.col("target_delta_b_minus_a"))
    key = drawn.select(
        "annotation_id", "model", first("condition").alias("condition_A"), second("condition").alias("condition_B"), first("system").alias("system_A"), second("system").alias("system_B"),
        first("target_rate").alias("target_rate_A"), second("target_rate").alias("target_rate_B"), delta.alias("target_delta_B_minus_A"),
    )
    return PreferenceBatch(items, key)


def unblind(labels: DataFrame, key: DataFrame) -> DataFrame:
    """Labelled items with their key, and three columns: preferred_condition, cer_preferred_output, human_cer_relation.
    Blank labels are left out; an unknown label or an item without a key raises."""
    rows = labels.filter(F.trim("preferred_output") != "")
    if (bad := rows.filter(~F.col("preferred_output").isin(*PREFERENCES)).select("preferred_output").limit(1).collect()):
        raise ValueError(f"unknown preference: {bad[0][0]}")
    if rows.join(key, "annotation_id", "left_anti").limit(1).count():
        raise ValueError("an annotation is not in the key")
    d = rows.join(key.select("annotation_id", *[c for c in key.columns if c not in rows.columns]), "annotation_id")
    choice, delta = F.col("preferred_output"), F.col("target_delta_B_minus_A")
    d = d.withColumn("preferred_condition", F.when(choice == "A", F.col("condition_A")).when(choice == "B", F.col("condition_B")).otherwise(choice))
    d = d.withColumn("cer_preferred_output", F.when(delta < -TOLERANCE, "B").when(delta > TOLERANCE, "A").otherwise("tie"))
    cer = F.col("cer_preferred_output")
    relation = F.when(choice == "ambiguous", "ambiguous").when(choice == cer, "agree").when((choice == "tie") | (cer == "tie"), "one_tie").otherwise("disagree")
    return d.withColumn("human_cer_relation", relation)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of k of n, within 0 and 1; null without trials."""
    p, z2 = k / n, Z95 * Z95
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def _beta_part(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(10_000):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or tiny)
        c = (1 + step / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def _beta_tail(k: int, n: int, p: float) -> float:
    """Probability of at least k successes of n."""
    return 1.0 if k <= 0 else 0.0 if k > n else _beta_part(p, k, n - k + 1)


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float | None, float | None]:
    """The Clopper-Pearson interval by bisection."""
    if not n:
        return None, None
    tail = (1 - level) / 2

    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    return (0.0 if k == 0 else solve(lambda p: _beta_tail(k, n, p) < tail), 1.0 if k == n else solve(lambda p: 1 - _beta_tail(k + 1, n, p) > tail))


def _exact(k: pa.Array, n: pa.Array) -> pa.Array:
    ends = [exact_interval(x, y) for x, y in zip(k.to_pylist(), n.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([e[i] for e in ends], pa.float64()) for i in (0, 1)], names=["low", "high"])


def preference_summary(d: DataFrame, method: str = "wilson") -> DataFrame:
    """One row per model and unordered pair of conditions of unblinded items."""
    c1, c2 = F.least("condition_A", "condition_B"), F.greatest("condition_A", "condition_B")
    if d.filter(c1.isNull() | (c1 == c2)).limit(1).count():
        raise ValueError("an item does not have two conditions")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    human, cer = F.col("preferred_output"), F.col("cer_preferred_output")
    both = human.isin("A", "B") & cer.isin("A", "B")
    g = d.groupBy("model", c1.alias("condition_1"), c2.alias("condition_2")).agg(
        F.count("*").alias("n_labelled"), n(human.isin("A", "B")).alias("n_decisive"), n(human == "tie").alias("n_tie"), n(human == "ambiguous").alias("n_ambiguous"),
        n(F.col("preferred_condition") == c1).alias("condition_1_preferred"), n(F.col("preferred_condition") == c2).alias("condition_2_preferred"),
        (n(both & (human == cer)) / n(both)).alias("human_vs_cer_agreement"), n(F.col("human_cer_relation") == "disagree").alias("n_human_cer_disagreements"),
    )
    k, m = F.col("condition_1_preferred"), F.col("n_decisive")
    if method == "wilson":
        (low, high), names = wilson(k, m), ("condition_1_wilson_low", "condition_1_wilson_high")
    elif method == "exact":
        ends = F.arrow_udf(_exact, "struct<low:double,high:double>")(k, m)
        (low, high), names = (ends["low"], ends["high"]), ("condition_1_conf_low", "condition_1_conf_high")
    else:
        raise ValueError("method must be wilson or exact")
    return g.select(
        "model", "condition_1", "condition_2", "n_labelled", "n_decisive", "n_tie", "n_ambiguous", "condition_1_preferred", "condition_2_preferred",
        F.when(m > 0, k / m).alias("condition_1_preference_rate"), low.alias(names[0]), high.alias(names[1]), "human_vs_cer_agreement", "n_human_cer_disagreements",
    )


def relation_table(d: DataFrame, zero_fill: bool = False) -> DataFrame:
    """model, human_cer_relation, n; with zero_fill every relation that occurs anywhere for every model."""
    counted = d.groupBy("model", "human_cer_relation").agg(F.count("*").alias("n"))
    if not zero_fill:
        return counted
    grid = d.select("model").distinct().withColumn("human_cer_relation", F.explode(F.array(*[F.lit(x) for x in ("ambiguous", "agree", "one_tie", "disagree")])))
    return grid.join(counted, ["model", "human_cer_relation"], "left").fillna(0, ["n"])


def disagreements(d: DataFrame) -> DataFrame:
    """The items where the annotator and the rates prefer different outputs."""
    return d.filter("human_cer_relation = 'disagree'")
