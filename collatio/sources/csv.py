"""CSV in and out, with the quoting and null rules of recognition tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, null_value: str = "NA", multi_line: bool = False) -> DataFrame:
    """UTF-8 with a header, names unchanged (but for a byte order mark), quotes doubled inside quotes.  A quoted empty field
    is an empty text; a bare empty field and null_value are null.  Without a schema all columns are texts.

    multi_line keeps line breaks in quotes, at the price of one task a file; without it files are split."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option("nullValue", null_value).option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("\ufeff")) if first.startswith("\ufeff") else df


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """One folder of CSV parts, or with single one part, for results that are small."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", "").csv(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, by default; partition_by lays an evaluation out by metric or system."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
