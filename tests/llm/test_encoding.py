import base64
import os
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from collatio.llm import p07_encoding as e

pytestmark = pytest.mark.skipif(not os.path.exists(e.vocabulary_path()), reason="no vocabulary file")
TEXTS = ["", " ", "plain text, it's 42", "⁊ ſtaua q̃ καὶ Часше 🙂", "<|endoftext|> a", "a\r\nb\tc   d", "x" * 3000, "ab" * 900, "=" * 777, "Ünïcödé​"]


@pytest.fixture(scope="module")
def encoder():
    return e.Encoder(e.read_ranks(e.vocabulary_path()))


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(e.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_plain_merges(encoder, plain):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdeinost ABé⁊🙂́\n<|>=") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice("abc") for _ in range(5000))]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == plain.encode_ordinary(t)
        assert encoder.decode(ids) == t


def test_table(spark, plain):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*TEXTS, None, TEXTS[2], TEXTS[2]])], "doc_id long, text string, source string").withColumn("ids", F.lit(1))
    rows = {r.doc_id: r.ids for r in e.encoded(df).collect()}
    assert rows == {i: plain.encode_ordinary(t or "") for i, t in enumerate([*TEXTS, None, TEXTS[2], TEXTS[2]])}
    counts = {r.doc_id: r.tokens for r in e.counted(df, "doc_id").collect()}
    assert counts[0] == 0 and counts[len(TEXTS)] is None and counts[2] == len(rows[2])
    back = {r.doc_id: r.text for r in e.decoded(e.encoded(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate([*TEXTS, None, TEXTS[2], TEXTS[2]])}
    assert e.encoded(df.limit(0)).count() == 0
    report = e.report(df).first()
    assert report.n_docs == len(TEXTS) + 3 and report.n_null == 1 and report.n_empty == 1


def test_large_files_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(e, "MOST_BYTES", 10)
    f = tmp_path / "ranks"
    f.write_bytes(b"x" * 11)
    with pytest.raises(ValueError, match="more than 10 bytes"):
        e.read_ranks(str(f))
