import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from collatio import plots, sources
from collatio.operators.evaluate import evaluate_recognition
from collatio.operators.summarise import summarise_recognition
from collatio.plans import round_trips
from collatio.sources import ground_truth, validate
from collatio.streaming.recognition import drop_resent, evaluate_stream, summarise_stream


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def alto(prefix=""):
    p = f"{prefix}:" if prefix else ""
    ns = f'xmlns:{prefix}="http://x"' if prefix else 'xmlns="http://x"'
    return f"""<?xml version="1.0"?><{p}alto {ns}><{p}Layout>
    <{p}TextLine ID="{prefix}l1" HPOS="10" VPOS="20" WIDTH="30" HEIGHT="5"><{p}String CONTENT="one"/><{p}String CONTENT="two"/></{p}TextLine>
    <{p}TextLine ID="{prefix}l2"><{p}Shape><{p}Polygon POINTS="5,40 80,40 80,55 5,x 5,55"/></{p}Shape><{p}String CONTENT="three"/></{p}TextLine>
    <{p}TextLine><{p}String CONTENT="no id"/></{p}TextLine></{p}Layout></{p}alto>"""


def test_alto(spark, tmp_path):
    (tmp_path / "doc a").mkdir()
    (tmp_path / "doc a" / "p1.xml").write_text(alto())
    (tmp_path / "doc a" / "p2.xml").write_text(alto("a"))
    (tmp_path / "doc a" / "p1.png").write_bytes(png(7, 9))
    got = {r.line_id: r for r in sources.read_alto(spark, str(tmp_path)).collect()}
    assert set(got) == {"l1", "l2", "al1", "al2"} and got["l1"].reference == "one two" and got["l1"].hpos == 10
    assert (got["l2"].hpos, got["l2"].vpos, got["l2"].width, got["l2"].height) == (5, 40, 75, 15)
    assert (got["l1"].document_id, got["l1"].page_id) == ("doc a", "p1")
    found = {r.page_id: r.image_path for r in ground_truth.attach_images(sources.read_alto(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert found["p1"].endswith("p1.png") and found["p2"] == ""
    assert sources.png_sizes(spark, str(tmp_path)).first()[1:] == (7, 9)
    (tmp_path / "doc a" / "p3.xml").write_text(alto())
    with pytest.raises(ValueError, match="duplicate line id"):
        sources.read_alto(spark, str(tmp_path))


def test_image_lookup(spark, tmp_path):
    gt, images = tmp_path / "gt", tmp_path / "images"
    for d in ("a", "b"):
        (gt / d).mkdir(parents=True)
        (images / d).mkdir(parents=True)
    (images / "other").mkdir()
    for name in ("a/beside", "a/mirrored", "a/unique", "b/none", "b/twice"):
        (gt / f"{name}.xml").write_text(alto().replace('ID="l', f'ID="{name}').replace("l1", "1"))
    (gt / "a" / "beside.webp").write_bytes(b"x")
    (gt / "a" / "beside.JPG").write_bytes(b"x")
    (images / "a" / "beside.png").write_bytes(b"x")
    (images / "a" / "mirrored.tif").write_bytes(b"x")
    (images / "b" / "mirrored.tif").write_bytes(b"x")
    (images / "other" / "unique.png").write_bytes(b"x")
    pages = sources.read_alto(spark, str(gt))
    got = {r.page_id: r.image_path for r in sources.attach_images(pages, str(gt), str(images)).collect()}
    assert got == {"beside": str(gt / "a" / "beside.JPG"), "mirrored": str(images / "a" / "mirrored.tif"), "unique": str(images / "other" / "unique.png"), "none": "", "twice": ""}
    assert {r.image_path for r in sources.attach_images(pages, str(gt)).collect()} == {str(gt / "a" / "beside.JPG"), ""}
    for d in ("a", "other"):
        (images / d / "twice.png").write_bytes(b"x")
    with pytest.raises(Exception, match="several images are called twice"):
        sources.attach_images(pages, str(gt), str(images)).collect()


def test_alto_writer(spark, tmp_path):
    lines = spark.createDataFrame([("d", "p1", "l1", 'a "b" <c> & d', 1.0, 2.0, 3.0, 4.0), ("d", "p1", "l2", None, 1.0, 5.0, 3.0, 4.0), ("e", "p1", "l3", "", 0.0, 0.0, 7.0, 9.0)],
                                  "document_id string, page_id string, line_id string, reference string, hpos double, vpos double, width double, height double").withColumn("image", F.concat("page_id", F.lit(".png")))
    assert {r.path for r in sources.write_files(sources.alto_pages(lines), str(tmp_path)).collect()} == {"d/p1.xml", "e/p1.xml"}
    sources.write_files(sources.alto_pages(lines), f"file://{tmp_path}").collect()  # again, the same files
    got = {r.line_id: r for r in sources.read_alto(spark, str(tmp_path)).collect()}
    assert {k: (r.reference, r.document_id, r.vpos) for k, r in got.items()} == {"l1": ('a "b" <c> & d', "d", 2.0), "l2": ("", "d", 5.0), "l3": ("", "e", 0.0)}
    text = (tmp_path / "d" / "p1.xml").read_text()
    assert "<fileName>p1.png</fileName>" in text and text.index('ID="l1"') < text.index('ID="l2"') and text.count("<String") == 1


def test_predictions_and_table(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps({"1": "x", "2": None}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "1", "text": "y"}, {"line_id": "2", "prediction": "z"}]))
    p = sources.load_predictions(spark, {"A": str(tmp_path / "a.json"), "B": str(tmp_path / "b.json")})
    assert {(r.system, r.line_id): r.prediction for r in p.collect()} == {("A", "1"): "x", ("A", "2"): "", ("B", "1"): "y", ("B", "2"): "z"}
    (tmp_path / "c.jsonl").write_text('{"line_id": "1", "prediction": "x"}\n{"id": "2", "text": ""}\n')
    assert {r.line_id: r.prediction for r in sources.load_predictions(spark, {"C": str(tmp_path / "c.jsonl")}).collect()} == {"1": "x", "2": ""}
    (tmp_path / "d.jsonl").write_text('{"line_id": "1"}\n')
    with pytest.raises(Exception, match="without a text"):
        sources.load_predictions(spark, {"D": str(tmp_path / "d.jsonl")}).collect()
    monkeypatch.setattr("collatio.sources.predictions.MOST_BYTES", 3)
    with pytest.raises(ValueError, match="write it as .jsonl"):
        sources.load_predictions(spark, {"A": str(tmp_path / "a.json")})
    monkeypatch.undo()
    with pytest.raises(ValueError, match="object of line ids"):
        sources.load_predictions(spark, {"B": str(tmp_path / "b.json")}, strict=True)
    gt = spark.createDataFrame([("1", "d", "r1"), ("2", "d", "r2")], "line_id string, document_id string, reference string")
    assert sources.build_table(gt, p).count() == 4
    with pytest.raises(ValueError, match="missing 1 ground-truth line"):
        sources.build_table(gt, p.filter("not (system = 'A' and line_id = '2')"))
    assert sources.build_table(gt, p.filter("not (system = 'A' and line_id = '2')"), allow_missing=True).filter("prediction = ''").count() == 1
    with pytest.raises(ValueError, match="ground truth lacks"):
        sources.build_table(gt.limit(1), p)
    meta = spark.createDataFrame([("1", "Latin")], "line_id string, language string")
    assert {r.language for r in sources.build_table(gt, p, metadata=meta).collect()} == {"Latin", ""}
    with pytest.raises(ValueError):
        sources.build_table(gt, p, metadata=meta.withColumnRenamed("language", "system"))
    with pytest.raises(ValueError, match="manifest of lines lacks"):
        sources.join_manifest(gt, p)
    whole = gt.withColumns({"benchmark": F.lit("b"), "subcorpus": F.lit("s"), "image_path": F.lit("")})
    assert sources.join_manifest(whole, p).count() == 4


def test_line_pairs(spark, tmp_path):
    for sub in ("dta19", "Kallimachos"):
        for doc in ("1882-x", "y"):
            d = tmp_path / sub / doc
            d.mkdir(parents=True)
            for i in range(3):
                (d / f"0000{i}.gt.txt").write_text("text\r\n")
                (d / f"0000{i}.nrm.png").write_bytes(png(3, 4))
    (tmp_path / "root.gt.txt").write_text("left out")
    (tmp_path / "dta19" / "flat.gt.txt").write_bytes("\ufeffflat\n".encode())
    (tmp_path / "dta19" / "flat.tif").write_bytes(b"x")
    deep = tmp_path / "dta19" / "1882-x" / "deep er"
    deep.mkdir()
    (deep / "a b.gt.txt").write_text("deep")
    (deep / "a b.png").write_bytes(png(1, 1))
    rows = sources.scan_pairs(spark, str(tmp_path)).collect()
    assert len(rows) == 14 and len({r.line_id for r in rows}) == 14 and {r.year for r in rows} == {1882, None}
    by = {r.gt_path: r for r in rows}
    one = by["dta19/1882-x/00001.gt.txt"]
    assert (one.corpus_language, one.reference, one.document_id, one.image_path) == ("German", "text", "1882-x", "dta19/1882-x/00001.nrm.png")
    assert one.line_id == "gt4_" + hashlib.sha1(b"dta19/1882-x/00001").hexdigest()[:16] + "_00001"
    flat, nested = by["dta19/flat.gt.txt"], by["dta19/1882-x/deep er/a b.gt.txt"]
    assert (flat.document_id, flat.reference, flat.image_path) == ("dta19", "flat", "dta19/flat.tif")
    assert nested.document_id == "1882-x" and nested.line_id == "gt4_" + hashlib.sha1(b"dta19/1882-x/deep er/a b").hexdigest()[:16] + "_a_b"
    (deep / "c.gt.txt").write_text("no image")
    with pytest.raises(ValueError, match="c.gt.txt has no image"):
        sources.scan_pairs(spark, str(tmp_path))
    assert {r.image_path for r in sources.scan_pairs(spark, str(tmp_path), require_image=False).collect() if r.reference == "no image"} == {""}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("x")
    with pytest.raises(ValueError, match="no line files"):
        sources.scan_pairs(spark, str(tmp_path / "empty"))
    digests = sources.hash_files(spark, str(tmp_path / "dta19" / "y")).collect()
    assert len(digests) == 6 and digests[0].digest == hashlib.sha256(b"text\r\n").hexdigest()


def tree(root, names):
    (root / "sub" / "doc").mkdir(parents=True)
    for name in names:
        (root / "sub" / "doc" / f"{name}.gt.txt").write_bytes(f"{name}\n".encode())
        (root / "sub" / "doc" / f"{name}.nrm.png").write_bytes(png(7, 9))


def test_digests_of_many_files(spark, tmp_path):
    names = ["100%", "a+b", "_x", ".y", "é z", *map(str, range(300))]
    tree(tmp_path, names)
    (tmp_path / "sub" / "doc" / "empty").write_bytes(b"")
    got = {r.path: r.digest for r in sources.hash_files(spark, str(tmp_path)).collect()}
    assert len(got) == 2 * len(names) + 1 and got[f"file:{tmp_path}/sub/doc/empty"] == hashlib.sha256(b"").hexdigest()
    assert all(got[f"file:{tmp_path}/sub/doc/{n}.gt.txt"] == hashlib.sha256(f"{n}\n".encode()).hexdigest() for n in names)
    sizes = {r.path: (r.width, r.height) for r in sources.png_sizes(spark, f"file://{tmp_path}").collect()}
    assert sizes == {f"file:{tmp_path}/sub/doc/{n}.nrm.png": (7, 9) for n in names}
    # no scan of Spark's, which lists in the driver and has a task for a few files; one task doesn't read a whole folder
    digests = ground_truth._digests(str(tmp_path), ground_truth._folders(spark, str(tmp_path)))
    assert "FileScan" not in digests._jdf.queryExecution().executedPlan().toString()
    parts = [r.n for r in digests.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(parts) == 4 * spark.sparkContext.defaultParallelism and max(parts) < 100


def test_queries_of_line_files(spark, tmp_path):
    texts = {"1": "one", "100%": "two", "_x": "\ufefffour\ufeff", ".y": "", "a+b": "\ufeff"}
    rows = [(i, k, "doc é", "sub", "s", v, "p", None) for i, (k, v) in enumerate(texts.items())]
    columns = "row_id long, line_id string, document_id string, subcorpus string, system string, reference string, prediction string, loaded_at timestamp"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "catmus_medieval_controlled_predictions.parquet"))
    base = f"sub/d1405_{hashlib.md5('doc é'.encode()).hexdigest()}/"
    got = {r.gt_path: (r.reference, r.image_path, r.year) for r in round_trips.line_files_round_trip(spark, str(tmp_path)).collect()}
    assert got == {f"{base}{k}.gt.txt": (v, f"{base}{k}.nrm.png", 1405) for k, v in texts.items()}
    got = {r.path: (r.digest, r.width, r.height) for r in round_trips.file_digests(spark, str(tmp_path)).collect()}
    assert got == {f"{base}{k}.gt.txt": (hashlib.sha256(f"{v}\n".encode()).hexdigest(), 7, 9) for k, v in texts.items()}


def test_csv(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_bytes("﻿a,b,c\n\"x \"\"q\"\"\",\"\",NA\n\"two\nlines\",,1\n".encode())
    df = sources.read_csv(spark, str(f), "a string, b string, c int", multi_line=True)
    assert df.columns == ["a", "b", "c"]
    assert [tuple(r) for r in df.collect()] == [('x "q"', "", None), ("two\nlines", None, 1)]
    sources.write_csv(df, str(tmp_path / "out"), single=True)
    assert [tuple(r) for r in sources.read_csv(spark, str(tmp_path / "out"), "a string, b string, c int", multi_line=True).collect()] == [tuple(r) for r in df.collect()]
    g = tmp_path / "y.csv"
    g.write_text("a,b\n 1 ,x\n2,NA\n")
    plain = sources.read_csv(spark, str(g))
    assert plain.dtypes == [("a", "string"), ("b", "string")] and [tuple(r) for r in plain.collect()] == [(" 1 ", "x"), ("2", None)]
    sources.write_table(df, str(tmp_path / "t"), ("c",))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_controlled_variants(spark):
    lines = spark.createDataFrame([("1", "é, x."), ("2", "añb!")], "line_id string, reference string")
    v = sources.controlled_variants(lines).withColumn("n", F.monotonically_increasing_id())
    rates = {(r.system, r.metric): r.rate for r in summarise_recognition(evaluate_recognition(v, metrics=["cer"], input_row="n"), ["system"]).collect()}
    assert rates["exact", "cer"] == rates["nfc_equivalent", "cer"] == 0 < rates["punctuation_dropped", "cer"]


def test_validation(spark):
    df = spark.createDataFrame([("1", "A", "r", "p"), ("1", "B", "r", None), ("2", "A", "s", "p")], "line_id string, system string, reference string, prediction string")
    assert {r["column"]: r.n for r in validate.missing_texts(df).collect()} == {"reference": 0, "prediction": 1}
    assert validate.duplicate_keys(df).count() == 0 and validate.duplicate_keys(df.unionByName(df)).count() == 3
    assert [r.line_id for r in validate.coverage(df).collect()] == ["2"]
    with pytest.raises(ValueError, match="line 2"):
        validate.require_valid(df)
    validate.require_valid(df.filter("line_id = '1'"))
    a = spark.createDataFrame([("k", 1, 0.5), (None, 2, 1.0)], "k string, n int, x double")
    b = spark.createDataFrame([("k", 1, 0.5 + 1e-14), (None, 3, 1.0)], "k string, n int, x double")
    assert [tuple(r) for r in validate.parity(a, b, ("k",)).collect()] == [(None, "n", "2", "3")]
    assert validate.parity(a, b.limit(1), ("k",)).count() == 1
    assert validate.run_manifest(df.withColumn("document_id", F.lit("d")), seed=3).first().asDict() == {"n_rows": 3, "n_lines": 2, "n_documents": 1, "n_systems": 2, "seed": 3}


def test_plots(spark):
    p = spark.createDataFrame([("A", "cer", 0.1, 0.2, None)], "system string, metric string, substitution_rate double, deletion_rate double, insertion_rate double")
    assert {(r.error_type, r.rate) for r in plots.error_profile_data(p, "system").collect()} == {("substitution", 10.0), ("deletion", 20.0), ("insertion", None)}
    assert plots.error_profile_data(p).first().group_value == "All data"
    c = spark.createDataFrame([("A", "B", "cer", 0.1, 0.0, 0.2)], "system_a string, system_b string, metric string, difference_b_minus_a double, conf_low double, conf_high double")
    assert tuple(plots.comparison_data(c).first()) == ("B - A", "cer", 10.0, 0.0, 20.0)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, f"l{i % 5}", "A", "abcd", "abxd", f"2026-01-0{1 + i % 3} 10:00:00") for i in range(10)] + [(99, "l9", "A", "x", None, "2026-01-01 10:00:00")],
        "row_id long, line_id string, system string, reference string, prediction string, at string",
    ).withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    x = evaluate_stream(stream, keep=["at"], metrics=["cer"])
    out = summarise_stream(x, "at")
    q = out.writeStream.format("memory").queryName("summary").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("summary").agg(F.sum("n_rows"), F.sum("distance")).first() == (10, 10)
    once = drop_resent(stream, "at").writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 6
