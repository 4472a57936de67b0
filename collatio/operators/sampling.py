"""Seeded, deterministic samples: every choice is a rank by a keyed hash, so any run on any cluster agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.policy import check_columns

SALTS = 64


def hash_key(seed: int, *columns: str | Column) -> Column:
    """md5 of seed and columns, joined by |; SQL engines agree on it."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def hash_index(n: str | Column, seed: int, *columns: str | Column) -> Column:
    """A number from 0 to n-1 from the first 32 bits of the hash."""
    bits = F.conv(F.substring(hash_key(seed, *columns), 1, 8), 16, 10).cast("long")
    return bits % (F.col(n) if isinstance(n, str) else n)


def first_by(df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int | Column) -> DataFrame:
    """The first rows of each group with their rank; ranked in salted parts first, so that a group that holds a
    third of all rows is never sorted in one task."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    part = Window.partitionBy(*by, "__salt").orderBy(*order)
    kept = salted.withColumn("__rank", F.row_number().over(part)).filter(F.col("__rank") <= limit).drop("__salt", "__rank")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, key: Sequence[str], seed: int = 1) -> DataFrame:
    """n rows balanced over the strata: max(1, n / strata) of each by hash, topped up from the rest, cut to n,
    numbered (draw) in a random order of its own.

    Strata are null-safe: a null is a value."""
    if not isinstance(n, int) or n < 1:
        raise ValueError("n must be a positive integer")
    check_columns(df.columns, *strata, *key)
    keyed = df.withColumn("__h", hash_key(seed, *key))
    groups = max(1, keyed.select(*strata).distinct().limit(n + 1).count() if strata else 1)
    each = max(1, n // groups)
    by = list(strata) or ["__all"]
    keyed = keyed if strata else keyed.withColumn("__all", F.lit(1))
    # no stratum can give more than n rows
    ranked = first_by(keyed, by, ["__h", *key], n)
    chosen = ranked.withColumn("__late", (F.col("rank") > each).cast("int")).orderBy("__late", "__h", *key).limit(n)
    draw = F.row_number().over(Window.orderBy(hash_key(seed + 1, *key), *key))  # n rows at most
    return chosen.withColumn("draw", draw).drop("__h", "__late", "rank", "__all")


def balanced_sample(df: DataFrame, group: str, document: str, line: str, quota: int, most: int, seed: int = 2027) -> DataFrame:
    """Up to quota lines of each group, one line a document and lap, at most `most` of a document.

    Documents are in a random order; a lap takes the next line of each of them."""
    check_columns(df.columns, group, document, line)
    lines = first_by(df.withColumn("__h", hash_key(seed, group, document, line)), [group, document], ["__h", line], most).withColumnRenamed("rank", "lap")
    lines = lines.withColumn("__d", hash_key(seed, group, document))
    # a lap of all documents comes before the next
    out = first_by(lines, [group], ["lap", "__d", document, "__h", line], quota)
    return out.withColumnRenamed("rank", "pick").drop("__h", "__d")
