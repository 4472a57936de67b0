"""Predictions from JSON, joined with ground truth to a recognition table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the recognition table that side tables must not have.
RESERVED = ("benchmark", "document_id", "page_id", "line_id", "system", "reference", "prediction", "image_path", "source_xml", "hpos", "vpos", "width", "height", "polygon")

#: Systems of one table, which are named to the plan.
MOST_SYSTEMS = 10_000
#: Bytes of a JSON file that is read whole.
MOST_BYTES = 512 << 20


def load_predictions(spark: SparkSession, systems: dict[str, str], strict: bool = False) -> DataFrame:
    """(system, line_id, prediction) of JSON: an object line_id -> text (null reads as empty) or, unless strict, a list of
    objects with line_id or id and prediction or text (null raises).

    A path that ends in .jsonl, a file or a folder, has one such object a line and is split; other files are read whole, each
    in one task, and refused beyond MOST_BYTES."""
    entry = "line_id string, id string, prediction string, text string"
    parts = []
    for name, path in systems.items():
        lost = F.raise_error(F.lit(f"{path} has an entry without a text")).cast("string")
        text = lambda c: F.coalesce(f"{c}prediction", f"{c}text")
        if path.rstrip("/").endswith(".jsonl"):
            rows = spark.read.schema(entry).json(path)
            rows = rows.select(F.coalesce("line_id", "id").alias("line_id"), F.when(text("").isNull(), lost).otherwise(text("")).alias("prediction"))
        else:
            large = spark.read.format("binaryFile").load(path).filter(F.col("length") > MOST_BYTES).select("path").limit(1).collect()
            if large:
                raise ValueError(f"{large[0].path} has more than {MOST_BYTES} bytes; write it as .jsonl, one object a line")
            whole = spark.read.option("wholetext", True).text(path)
            whole = whole.withColumn("list", F.substring(F.trim(F.regexp_replace("value", r"^\ufeff?\s+", "")), 1, 1) == "[")
            if strict and whole.filter("list").limit(1).count():
                raise ValueError(f"{path} must hold an object of line ids")
            pairs = whole.filter("not list").select(F.explode(F.from_json("value", "map<string,string>")).alias("line_id", "prediction")).fillna("", ["prediction"])
            rows = whole.filter("list").select(F.explode(F.from_json("value", f"array<struct<{entry.replace(' string', ':string')}>>")).alias("r"))
            rows = pairs.unionByName(rows.select(F.coalesce("r.line_id", "r.id").alias("line_id"), F.when(text("r.").isNull(), lost).otherwise(text("r.")).alias("prediction")))
        parts.append(rows.select(F.lit(name).alias("system"), "line_id", "prediction"))
    out = reduce(DataFrame.unionByName, parts)
    if (twice := out.groupBy("system", "line_id").count().filter("count > 1").limit(1).collect()):
        raise ValueError(f"{twice[0].system} has line {twice[0].line_id} twice")
    return out


def build_table(ground_truth: DataFrame, predictions: DataFrame, benchmark: str = "", metadata: DataFrame | None = None, allow_missing: bool = False) -> DataFrame:
    """Every ground-truth line for every system, with its prediction.  Predictions of unknown lines raise, missing ones
    too unless allow_missing reads them as empty.  metadata adds columns by line_id ("" where it has no row)."""
    systems = [r.system for r in predictions.select("system").distinct().limit(MOST_SYSTEMS + 1).collect()]
    if len(systems) > MOST_SYSTEMS:
        raise ValueError(f"more than {MOST_SYSTEMS} systems")
    if (extra := predictions.join(ground_truth, "line_id", "left_anti").limit(1).collect()):
        raise ValueError(f"{extra[0].system} predicts {extra[0].line_id}, a line that the ground truth lacks")
    grid = ground_truth.withColumn("system", F.explode(F.array(*map(F.lit, systems)).cast("array<string>")))  # lines by systems is the result itself
    rows = grid.join(predictions, ["line_id", "system"], "left")
    if allow_missing:
        rows = rows.fillna("", ["prediction"])
    elif (short := rows.filter("prediction is null").groupBy("system").count().limit(1).collect()):
        raise ValueError(f"{short[0].system} is missing {short[0]['count']} ground-truth line(s)")
    if metadata is not None:
        if clash := set(metadata.columns) & set(RESERVED) - {"line_id"}:
            raise ValueError(f"metadata must not have {', '.join(sorted(clash))}")
        if metadata.groupBy("line_id").count().filter("count > 1").limit(1).count():
            raise ValueError("metadata has a line twice")
        rows = rows.join(metadata, "line_id", "left")
        rows = rows.fillna("", [c for c, t in metadata.dtypes if c != "line_id" and t == "string"])
    return rows.withColumn("benchmark", F.lit(benchmark)) if "benchmark" not in rows.columns else rows


def join_manifest(manifest: DataFrame, predictions: DataFrame, allow_missing: bool = False) -> DataFrame:
    """build_table for a manifest of lines (benchmark, subcorpus, document_id, line_id, reference, image_path)."""
    lost = [c for c in ("benchmark", "subcorpus", "document_id", "line_id", "reference", "image_path") if c not in manifest.columns]
    if lost:
        raise ValueError(f"the manifest of lines lacks {', '.join(lost)}")
    if manifest.groupBy("line_id").count().filter("count > 1").limit(1).count():
        raise ValueError("the manifest has a line twice")
    return build_table(manifest, predictions, allow_missing=allow_missing)


def controlled_variants(lines: DataFrame, reference: str = "reference") -> DataFrame:
    """A corpus read by three controls: exact, nfc_equivalent (decomposed) and punctuation_dropped."""
    from collatio.functions.text import normalize_text, unicode_form

    forms = {"exact": F.col(reference), "nfc_equivalent": unicode_form(reference, "NFD"), "punctuation_dropped": normalize_text(reference, unicode="none", punctuation="remove")}
    return reduce(DataFrame.unionByName, [lines.withColumns({"system": F.lit(n), "prediction": c}) for n, c in forms.items()])
