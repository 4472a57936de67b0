"""Checks of recognition tables, each one aggregate; eager checks raise with the first finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.policy import check_columns


def missing_texts(df: DataFrame, truth: str = "reference", prediction: str = "prediction") -> DataFrame:
    """column and n: how many texts are null."""
    n = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in (truth, prediction)])
    return n.unpivot([], [truth, prediction], "column", "n")


def duplicate_keys(df: DataFrame, keys: tuple[str, ...] = ("line_id", "system")) -> DataFrame:
    """keys and n of the keys that stand more than once."""
    check_columns(df.columns, *keys)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def coverage(df: DataFrame, line: str = "line_id", system: str = "system", reference: str = "reference") -> DataFrame:
    """line, n_systems and n_references of the lines that some system lacks or whose reference isn't one text."""
    per_line = df.groupBy(line).agg(F.countDistinct(system).alias("n_systems"), F.countDistinct(reference).alias("n_references"))
    whole = df.agg(F.countDistinct(system).alias("all_systems"))
    return per_line.join(F.broadcast(whole)).filter("n_systems <> all_systems or n_references <> 1").drop("all_systems")


def require_valid(df: DataFrame, line: str = "line_id", system: str = "system") -> None:
    """Raise unless keys are unique, every system has every line, and references agree."""
    if (r := duplicate_keys(df, (line, system)).limit(1).collect()):
        raise ValueError(f"duplicate {line} and {system}: {r[0][line]}, {r[0][system]}")
    if df.select(system).distinct().limit(2).count() < 2:
        raise ValueError("at least two systems are needed")
    if (r := coverage(df, line, system).limit(1).collect()):
        raise ValueError(f"line {r[0][line]} has {r[0].n_systems} systems and {r[0].n_references} references")


def parity(a: DataFrame, b: DataFrame, keys: tuple[str, ...], tolerance: float = 1e-12) -> DataFrame:
    """Where two result tables differ: keys, column, left and right.  Rows without a partner count; integers and texts
    must be equal, doubles within the tolerance."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    kinds = dict(a.dtypes)
    left = a.select(*keys, *[F.col(c).alias(f"l_{c}") for c in shared], F.lit(1).alias("__l"))
    right = b.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(c).alias(f"r__{c}") for c in shared], F.lit(1).alias("__r"))
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    both = left.join(right, on, "full_outer").withColumns({k: F.coalesce(k, f"r_{k}") for k in keys})
    lost = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.lit("<row>"))
    found = [F.struct(lost.alias("column"), F.col("__l").cast("string").alias("left"), F.col("__r").cast("string").alias("right"))]
    for c in shared:
        x, y = F.col(f"l_{c}"), F.col(f"r__{c}")
        same = (x.eqNullSafe(y) | (F.abs(x - y) <= tolerance)) if kinds[c] in ("double", "float") else x.eqNullSafe(y)
        name = F.when(lost.isNull() & ~F.coalesce(same, F.lit(False)), F.lit(c))
        found.append(F.struct(name.alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right")))
    return both.select(*keys, F.inline(F.array(*found))).filter("column is not null")


def run_manifest(df: DataFrame, **extra: object) -> DataFrame:
    """One row of counts: rows, lines, documents, systems, and whatever is given."""
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("line_id").alias("n_lines"), F.countDistinct("document_id").alias("n_documents"), F.countDistinct("system").alias("n_systems"),
        *[F.first(F.lit(v)).alias(k) for k, v in extra.items()],
    )
