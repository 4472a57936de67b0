"""Ground truth from ALTO pages and from trees of line files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.sources.tables import cut_lineage

_TEXT_LINE = (
    "_ID string, _HPOS string, _VPOS string, _WIDTH string, _HEIGHT string, Shape struct<Polygon: array<struct<_POINTS: string>>>,"
    " String array<struct<_CONTENT: string>>"
)
# Languages of subcorpora, suffixes of page and line images in the order of preference.
LANGUAGES = {"dta19": "German", "EarlyModernLatin": "Latin", "Kallimachos": "German/Latin", "RefCorpus-ENHG-Incunabula": "German", "RIDGES-Fraktur": "German"}
PAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp")
IMAGE_SUFFIXES = (".nrm.png", ".bin.png", ".png", ".tif", ".tiff")
#: Paths that a task lists and bytes that it reads before it hands them on.
BATCH_PATHS, BATCH_BYTES = 10_000, 4_000_000


def _path(index: int) -> Column:
    """A part of the file's path, counted from the end (1 is the file)."""
    return F.element_at(F.split(F.url_decode(F.replace(F.col("__path"), F.lit("+"), F.lit("%2B"))), "/"), -index)


def _numbers(points: Column, odd: bool) -> Column:
    """x (even) or y (odd) of "x,y x,y"; bad tokens are left out."""
    pairs = F.transform(F.split(F.trim(F.regexp_replace(points, ";", " ")), r"\s+"), lambda p: F.split(p, ","))
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & p[0].try_cast("double").isNotNull() & p[1].try_cast("double").isNotNull())
    return F.transform(good, lambda p: p[1 if odd else 0].try_cast("double"))


def read_alto(spark: SparkSession, root: str, check: bool = True) -> DataFrame:
    """One row for each TextLine with an ID: document_id (folder), page_id (file), line_id, reference, source_xml, hpos,
    vpos, width, height, polygon.  Tags are matched in any namespace; what a box lacks comes from its polygon."""
    raw = (
        spark.read.format("xml").option("rowTag", "TextLine").option("ignoreNamespace", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.xml").schema(_TEXT_LINE).load(root).select("*", F.col("_metadata.file_path").alias("__path"))
    )
    polygon = F.col("Shape.Polygon")[0]["_POINTS"]
    x, y = _numbers(F.coalesce(polygon, F.lit("")), False), _numbers(F.coalesce(polygon, F.lit("")), True)
    box = lambda c: F.col(c).try_cast("double")
    content = F.filter(F.transform("String", lambda s: s["_CONTENT"]), lambda s: s != "")
    rows = raw.filter(F.trim(F.col("_ID")) != "").select(
        _path(2).alias("document_id"), F.regexp_replace(_path(1), r"\.xml$", "").alias("page_id"), F.trim("_ID").alias("line_id"),
        F.coalesce(F.array_join(content, " "), F.lit("")).alias("reference"), F.col("__path").alias("source_xml"),
        F.coalesce(box("_HPOS"), F.array_min(x)).alias("hpos"), F.coalesce(box("_VPOS"), F.array_min(y)).alias("vpos"),
        F.coalesce(box("_WIDTH"), F.array_max(x) - F.array_min(x)).alias("width"), F.coalesce(box("_HEIGHT"), F.array_max(y) - F.array_min(y)).alias("height"),
        F.coalesce(polygon, F.lit("")).alias("polygon"),
    )
    if check:
        if (twice := rows.groupBy("line_id").count().filter("count > 1").limit(1).collect()):
            raise ValueError(f"duplicate line id {twice[0].line_id}")
        if not rows.limit(1).count():
            raise ValueError("no text lines were found")
    return rows


def _plain_path(path: Column) -> Column:
    """A file's path without scheme and escapes."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")


def _relative(path: Column, root: str) -> Column:
    """The plain path below the root."""
    prefix = re.sub("^file:/*", "/", root.rstrip("/")) + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def _below(path: Column) -> tuple[Column, Column]:
    """(folder, file without its last suffix) of a relative path; the folder is "" at the root."""
    return F.regexp_replace(path, "/?[^/]*$", ""), F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def find_images(spark: SparkSession, root: str) -> DataFrame:
    """(folder, stem, rank, image_path) of every image under root: the folder below root, the name without suffix, and the
    suffix's place in the order of preference."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_plain_path(F.col("path")).alias("image_path"))
    suffix = F.lower(F.regexp_extract("image_path", r"(\.[^./]*)$", 1))
    folder, stem = _below(_relative(F.col("image_path"), root))
    rank = F.array_position(F.array(*map(F.lit, PAGE_SUFFIXES)), suffix)
    return files.select(folder.alias("folder"), stem.alias("stem"), rank.alias("rank"), "image_path").filter("rank > 0")


def attach_images(pages: DataFrame, gt_root: str, image_root: str | None = None) -> DataFrame:
    """pages (with source_xml) with image_path: the image beside the page's file, else, with image_root, the one in the same
    folder there, else the only one of the page's name anywhere there; several of them raise."""
    spark = pages.sparkSession
    folder, stem = _below(_relative(_plain_path(F.col("source_xml")), gt_root))
    out = pages.withColumns({"__folder": folder, "__stem": stem})
    beside = find_images(spark, gt_root).groupBy(F.col("folder").alias("__folder"), F.col("stem").alias("__stem")).agg(F.min_by("image_path", "rank").alias("__beside"))
    out = out.join(beside, ["__folder", "__stem"], "left")
    if image_root is None:
        return out.withColumn("image_path", F.coalesce("__beside", F.lit(""))).drop("__folder", "__stem", "__beside")
    images = find_images(spark, image_root)
    same = images.groupBy(F.col("folder").alias("__folder"), F.col("stem").alias("__stem")).agg(F.min_by("image_path", "rank").alias("__same"))
    anywhere = images.groupBy(F.col("stem").alias("__stem")).agg(F.min("image_path").alias("__any"), F.count("*").alias("__n"))
    out = out.join(same, ["__folder", "__stem"], "left").join(anywhere, "__stem", "left")
    lost = F.raise_error(F.concat(F.lit("several images are called "), F.col("__stem"))).cast("string")
    found = F.when(F.col("__beside").isNotNull(), F.col("__beside")).when(F.col("__same").isNotNull(), F.col("__same")).when(F.col("__n") > 1, lost).otherwise(F.col("__any"))
    return out.withColumn("image_path", F.coalesce(found, F.lit(""))).drop("__folder", "__stem", "__beside", "__same", "__any", "__n")


def _file_system(root: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of root, and root there; any that pyarrow knows."""
    fs, base = pa.fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pa.fs.LocalFileSystem(), root)
    return fs, base.rstrip("/")


def _listed(folders: DataFrame, root: str, kind: pa.fs.FileType) -> DataFrame:
    """(path) of what lies right in the folders; these and the paths are below root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                inside = fs.get_file_info(pa.fs.FileSelector(f"{base}/{folder}"))
                paths = [f"{folder}/{x.base_name}".lstrip("/") for x in inside if x.type == kind]
                for k in range(0, len(paths), BATCH_PATHS):
                    yield pa.RecordBatch.from_arrays([pa.array(paths[k : k + BATCH_PATHS], pa.string())], names=["path"])

    return _spread(folders).mapInArrow(run, "path string")


def _spread(paths: DataFrame) -> DataFrame:
    """Paths in equal parts: a folder of many files is listed by one task, but not read by one."""
    return paths.repartition(4 * paths.sparkSession.sparkContext.defaultParallelism, "path")


def _folders(spark: SparkSession, root: str) -> DataFrame:
    """(path) of root ("") and every folder below it, listed by tasks, a level at a time."""
    fs, base = _file_system(root)
    if fs.get_file_info(base or "/").type != pa.fs.FileType.Directory:
        raise FileNotFoundError(f"{root} is no folder")
    level = found = spark.createDataFrame([("",)], "path string")
    while not (level := cut_lineage(_listed(level, root, pa.fs.FileType.Directory))).isEmpty():
        found = found.unionByName(level)
    return found


def _files(folders: DataFrame, root: str, suffixes: tuple[str, ...] = ("",)) -> DataFrame:
    """(path) of the files in the folders whose names end in one of the suffixes.

    Spark's own file sources keep all files' status in the driver and put a few small files in a task, which many thousands
    of line files don't bear."""
    right = F.lit(False)
    for x in suffixes:
        right |= F.col("path").endswith(x)
    return _listed(folders, root, pa.fs.FileType.File).filter(right)


def _contents(files: DataFrame, root: str, read: Callable[[pa.NativeFile], bytes]) -> DataFrame:
    """(path, content): what read gets from each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(root)
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
        for b in batches:
            paths, contents, size = [], [], 0
            for path in b.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{path}") as f:
                    contents.append(read(f))
                paths.append(path)
                size += len(contents[-1])
                if size > BATCH_BYTES:
                    yield batch()
                    paths, contents, size = [], [], 0
            yield batch()

    return _spread(files).mapInArrow(run, "path string, content binary")


def scan_pairs(spark: SparkSession, root: str, require_image: bool = True, benchmark: str = "") -> DataFrame:
    """Line files *.gt.txt under <root>/<subcorpus>/<document>/...: benchmark, subcorpus, corpus_language, document_id, year,
    line_id, reference, gt_path, image_path; paths are below root.

    A file right in a subcorpus belongs to a document of that name, one right in root is left out.  No file at all raises,
    and so does, with require_image, a line without an image ("" otherwise)."""
    folders = _folders(spark, root)
    texts = _contents(_files(folders, root, (".gt.txt",)), root, lambda f: f.read())
    raw = texts.select(F.col("content").cast("string").alias("value"), F.col("path").alias("gt_path"))
    parts = F.split("gt_path", "/")
    raw = raw.filter(F.size(parts) >= 2)
    base = F.regexp_replace("gt_path", r"\.gt\.txt$", "")
    safe = F.substring(F.regexp_replace(F.regexp_extract(base, "([^/]*)$", 1), r"[^A-Za-z0-9_.-]+", "_"), 1, 40)
    document = F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(parts[0])
    year = F.regexp_extract(document, r"(?<!\d)(1[4-9]\d{2})(?!\d)", 1)
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    rows = raw.select(
        F.lit(benchmark).alias("benchmark"), parts[0].alias("subcorpus"), F.coalesce(language[parts[0]], F.lit("")).alias("corpus_language"), document.alias("document_id"),
        F.when(year != "", year.cast("int")).alias("year"), F.concat(F.lit("gt4_"), F.substring(F.sha1(base), 1, 16), F.lit("_"), safe).alias("line_id"),
        F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), r"[\r\n]+$", "").alias("reference"), "gt_path", base.alias("__base"),
    )
    files = _files(folders, root, IMAGE_SUFFIXES).select(F.col("path").alias("p"))
    rank, cut = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, s in reversed(list(enumerate(IMAGE_SUFFIXES))):
        rank, cut = F.when(F.col("p").endswith(s), i).otherwise(rank), F.when(F.col("p").endswith(s), F.expr(f"substring(p, 1, length(p) - {len(s)})")).otherwise(cut)
    images = files.select("p", rank.alias("r"), cut.alias("__base")).filter("r is not null").groupBy("__base").agg(F.min_by("p", "r").alias("image_path"))
    out = cut_lineage(rows.join(images, "__base", "left").drop("__base"))  # read by the checks too
    if out.isEmpty():
        raise ValueError(f"no line files were found under {root}")
    if require_image and (lost := out.filter("image_path is null").select("gt_path").limit(1).collect()):
        raise ValueError(f"{lost[0].gt_path} has no image")
    return out.fillna("", ["image_path"])


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes (path, content) rows, the path below root; gives (path, size) of what was written.  A task that runs again
    writes the same files again.  root may be on any file system that pyarrow knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(root)
        for b in batches:
            paths, sizes = b.column(0).to_pylist(), []
            for path, content in zip(paths, b.column(1).to_pylist(), strict=True):
                full = f"{base}/{path}"
                try:
                    f = fs.open_output_stream(full)
                except FileNotFoundError:
                    fs.create_dir(full.rsplit("/", 1)[0], recursive=True)
                    f = fs.open_output_stream(full)
                with f:
                    f.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, size long")


def _xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def alto_pages(lines: DataFrame) -> DataFrame:
    """(path, content) of an ALTO page for each document_id and page_id of lines (line_id, image, hpos, vpos, width, height, and
    reference, whose null leaves a line without text, as for a recognition run); write_files() writes them.

    A page has the lines of one file, so it is put together in one place."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    box = F.concat(*[x for c in ("hpos", "vpos", "width", "height") for x in (F.lit(f' {c.upper()}="'), number(c), F.lit('"'))])
    text = F.when(F.col("reference").isNotNull(), F.concat(F.lit('<String CONTENT="'), _xml(F.col("reference")), F.lit('"/>'))).otherwise("")
    line = F.concat(F.lit('<TextLine ID="'), _xml(F.col("line_id")), F.lit('"'), box, F.lit(">"), text, F.lit("</TextLine>"))
    image = _xml(F.col("image")) if "image" in lines.columns else F.lit("")
    page = lines.groupBy("document_id", "page_id").agg(F.min(image).alias("image"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vpos", "line_id", line.alias("xml")))), lambda x: x["xml"]), "\n").alias("body"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Description><MeasurementUnit>pixel</MeasurementUnit><sourceImageInformation><fileName>'
    content = F.concat(F.lit(head), "image", F.lit("</fileName></sourceImageInformation></Description><Layout><Page><PrintSpace><TextBlock>\n"), "body", F.lit("\n</TextBlock></PrintSpace></Page></Layout></alto>\n"))
    return page.select(F.concat("document_id", F.lit("/"), "page_id", F.lit(".xml")).alias("path"), content.alias("content"))


def _full(path: str, root: str) -> Column:
    """A path below root as Spark's file sources name it."""
    return F.concat(F.lit(f"{root.rstrip('/')}/" if "://" in root and not root.startswith("file:") else f"file:{_file_system(root)[1]}/"), path)


def _sha256(f: pa.NativeFile) -> bytes:
    digest = hashlib.sha256()
    while part := f.read(BATCH_BYTES):
        digest.update(part)
    return digest.digest()


def png_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height) from the headers of PNG files."""
    sizes = _png_sizes(root, _folders(spark, root))
    return sizes.withColumn("path", _full("path", root))


def _png_sizes(root: str, folders: DataFrame) -> DataFrame:
    files = _contents(_files(folders, root, (".png",)), root, lambda f: f.read(24))
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    good = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return files.select("path", F.when(good, number(17)).alias("width"), F.when(good, number(21)).alias("height"))


def hash_files(spark: SparkSession, root: str) -> DataFrame:
    """(digest, path): the SHA-256 of every file under root."""
    digests = _digests(root, _folders(spark, root))
    return digests.select("digest", _full("path", root).alias("path")).orderBy("path")


def _digests(root: str, folders: DataFrame, suffixes: tuple[str, ...] = ("",)) -> DataFrame:
    digests = _contents(_files(folders, root, suffixes), root, _sha256)
    return digests.select(F.lower(F.hex("content")).alias("digest"), "path")
