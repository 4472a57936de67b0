"""Queries that write files of each format to the shared folder and read them back with the library's sources.

The files stand under the session's checkpoint folder; each call has a folder of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio import sources
from collatio.functions.text import normalize_text, unicode_form
from collatio.operators import policy_swap
from collatio.plans import sql
from collatio.plans.registry import PREDICTIONS, _with, query, recognition
from collatio.sources import ground_truth, validate


def _folder(spark: SparkSession) -> str:
    return f"{sources.checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


_CSV_SCHEMA = "row_id long, line_id string, system string, century int, reference string, prediction string"
_CSV_COLUMNS = "row_id, line_id, system, century, reference, prediction"


@query(f"SELECT {_CSV_COLUMNS} FROM {PREDICTIONS}")
def csv_round_trip(spark, d):
    """Texts, nulls, empty texts, quotes and line breaks survive a CSV file."""
    path = _folder(spark)
    sources.write_csv(sources.table(spark, d, PREDICTIONS).selectExpr(*_CSV_COLUMNS.split(", ")), path)
    return sources.read_csv(spark, path, _CSV_SCHEMA, multi_line=True)


_LINES = "lines AS (SELECT line_id, min(document_id) AS document_id, min(subcorpus) AS subcorpus, min(reference) AS reference FROM recog GROUP BY line_id)"


def _lines(spark, d) -> DataFrame:
    return recognition(spark, d).groupBy("line_id").agg(F.min("document_id").alias("document_id"), F.min("subcorpus").alias("subcorpus"), F.min("reference").alias("reference"))


@query(_with(sql.RECOG, _LINES) + """SELECT 'd' || md5(coalesce(document_id, '')) AS document_id, 'p' || substr(md5(line_id), 1, 1) AS page_id, line_id, reference,
  length(line_id)::DOUBLE AS hpos, length(reference)::DOUBLE AS vpos, 5.5::DOUBLE * length(reference) AS width, 12::DOUBLE AS height, '' AS polygon FROM lines""")
def alto_round_trip(spark, d):
    """Lines written as ALTO pages and read back."""
    path = _folder(spark)
    n = lambda c: F.length(c).cast("double")
    lines = _lines(spark, d).select(
        F.concat(F.lit("d"), F.md5(F.coalesce("document_id", F.lit("")))).alias("document_id"), F.concat(F.lit("p"), F.substring(F.md5("line_id"), 1, 1)).alias("page_id"),
        "line_id", "reference", n("line_id").alias("hpos"), n("reference").alias("vpos"), (5.5 * n("reference")).alias("width"), F.lit(12.0).alias("height"),
    )
    ground_truth.write_files(ground_truth.alto_pages(lines), path).count()
    return sources.read_alto(spark, path).drop("source_xml")


def _line_files(spark, d, marked: bool = False) -> str:
    """Writes the reference of every line with an image beside it; gives the folder.  marked: a text that begins with a byte
    order mark gets another, as readers take a first one for the file's."""
    path = _folder(spark)
    folder = F.concat("subcorpus", F.lit("/d"), (1400 + F.length("document_id")).cast("string"), F.lit("_"), F.md5("document_id"), F.lit("/"), "line_id")
    lines = _lines(spark, d).filter("subcorpus is not null and document_id is not null")
    mark = F.when(F.col("reference").startswith("\ufeff"), "\ufeff").otherwise("") if marked else F.lit("")
    kinds = F.explode(F.array(
        F.struct(F.lit(".gt.txt").alias("suffix"), F.concat(mark, "reference", F.lit("\n")).cast("binary").alias("content")),
        F.struct(F.lit(".nrm.png").alias("suffix"), F.unhex(F.lit("89504E470D0A1A0A0000000D49484452000000070000000908000000000000")).alias("content")),
    )).alias("f")
    ground_truth.write_files(lines.select(folder.alias("base"), kinds).select(F.concat("base", "f.suffix").alias("path"), "f.content"), path).count()
    return path


_BASE = "subcorpus || '/d' || (1400 + length(document_id)) || '_' || md5(document_id) || '/' || line_id"
_FILED = f"filed AS (SELECT *, {_BASE} AS base FROM lines WHERE subcorpus IS NOT NULL AND document_id IS NOT NULL)"


@query(_with(sql.RECOG, _LINES, _FILED) + """SELECT 'lines' AS benchmark, subcorpus, '' AS corpus_language, split_part(base, '/', 2) AS document_id, 1400 + length(document_id) AS year,
  'gt4_' || substr(sha1(base), 1, 16) || '_' || substr(regexp_replace(line_id, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 40) AS line_id, reference, base || '.gt.txt' AS gt_path, base || '.nrm.png' AS image_path FROM filed""")
def line_files_round_trip(spark, d):
    """Line files and their images, scanned."""
    return sources.scan_pairs(spark, _line_files(spark, d, marked=True), benchmark="lines")


@query(_with(sql.RECOG, _LINES, _FILED) + "SELECT base || '.gt.txt' AS path, sha256(reference || chr(10)) AS digest, 7 AS width, 9 AS height FROM filed")
def file_digests(spark, d):
    """SHA-256 of every line file, and the size in the header of the image beside it."""
    root = _line_files(spark, d)
    folders = ground_truth._folders(spark, root)
    digests = ground_truth._digests(root, folders, (".gt.txt",)).select("path", "digest")
    sizes = ground_truth._png_sizes(root, folders).select(F.regexp_replace("path", r"\.nrm\.png$", ".gt.txt").alias("path"), "width", "height")
    return digests.join(sizes, "path")


@query(_with(sql.RECOG, _LINES, "systems AS (SELECT DISTINCT system FROM recog)") + """SELECT line_id, system, l.reference, coalesce(prediction, '') AS prediction, coalesce(upper(subcorpus), '') AS collection, 'b' AS benchmark
  FROM (lines l CROSS JOIN systems s) LEFT JOIN (SELECT line_id, system, prediction FROM recog) r USING (line_id, system)""")
def prediction_files_round_trip(spark, d):
    """Each system's predictions as JSON lines, read back and joined to every ground-truth line, with a side table."""
    path = _folder(spark)
    rows = recognition(spark, d)
    rows.select("line_id", "prediction", F.concat("system", F.lit(".jsonl")).alias("file")).write.partitionBy("file").json(path)
    systems = [r.system for r in rows.select("system").distinct().limit(1000).collect()]
    predictions = sources.load_predictions(spark, {s: f"{path}/file={s}.jsonl" for s in systems})
    lines = _lines(spark, d)
    table = sources.build_table(lines.select("line_id", "reference"), predictions, "b", lines.select("line_id", F.upper("subcorpus").alias("collection")), allow_missing=True)
    return table.select("line_id", "system", "reference", "prediction", "collection", "benchmark")


_LOADS = f"""loads AS (SELECT line_id, system, prediction, length(prediction) AS n, row_number() OVER (PARTITION BY line_id, system ORDER BY row_id) AS up, row_number() OVER (PARTITION BY line_id, system ORDER BY row_id DESC) AS down
    FROM {PREDICTIONS} WHERE line_id IS NOT NULL AND system IS NOT NULL),
  pair AS (SELECT a.line_id, a.system, a.prediction AS pa, b.prediction AS pb, a.n AS na, b.n AS nb FROM loads a JOIN loads b USING (line_id, system) WHERE a.up = 1 AND b.down = 1)"""


@query(_with(_LOADS) + """SELECT line_id, system, 'prediction' AS "column", pa AS "left", pb AS "right" FROM pair WHERE pa IS DISTINCT FROM pb
  UNION ALL SELECT line_id, system, 'n', na::VARCHAR, nb::VARCHAR FROM pair WHERE na IS DISTINCT FROM nb""")
def parity_of_loads(spark, d):
    """Where the first and the last row of a line and system differ."""
    rows = sources.table(spark, d, PREDICTIONS).filter("line_id is not null and system is not null").withColumn("n", F.length("prediction"))
    pick = lambda f: rows.groupBy("line_id", "system").agg(*[f(F.struct(c), "row_id")[c].alias(c) for c in ("prediction", "n")])
    return validate.parity(pick(F.min_by), pick(F.max_by), ("line_id", "system"))


@query(f"""SELECT row_id, nfc_normalize(lower(prediction)) AS lowered, regexp_replace(prediction, '^{sql.SPACE}+|{sql.SPACE}+$', '', 'g') AS trimmed, nfc_normalize(prediction) AS composed FROM {PREDICTIONS}""")
def normalization_steps(spark, d):
    """Case, outer spaces, and composition after decomposition; each step by itself."""
    rows = sources.table(spark, d, PREDICTIONS)
    return rows.select(
        "row_id", unicode_form(normalize_text("prediction", "none", "lower")).alias("lowered"), normalize_text("prediction", "none", whitespace="trim").alias("trimmed"),
        unicode_form(unicode_form("prediction", "NFD"), "NFC").alias("composed"),
    )


@query("""SELECT system, model_id, CASE WHEN trim(revision) = 'TO_FREEZE' AND regexp_matches(trim(model_id), '^[^/.][^/]*/.+') THEN coalesce(l, revision) ELSE revision END AS revision
  FROM systems_manifest LEFT JOIN (SELECT trim(model_id) AS k, 'r-' || md5(trim(model_id)) AS l FROM systems_manifest WHERE model_id IS NOT NULL GROUP BY 1) ON trim(model_id) = k""")
def frozen_revisions(spark, d):
    """The manifest with the open revisions filled in from a table of locked ones."""
    manifest = sources.table(spark, d, "systems_manifest")
    locked = manifest.filter("model_id is not null").select(F.trim("model_id").alias("model_id")).distinct().withColumn("revision", F.concat(F.lit("r-"), F.md5("model_id")))
    return policy_swap.freeze_revisions(manifest, locked).select("system", "model_id", "revision")
