"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: a backtracking encoder.  An Aho-Corasick automaton over the vocabulary gives, in one pass, the longest
token at every position; a longest match is kept if the table of compatible pairs says that byte-pair merging
would produce these two tokens side by side, else the next shorter prefix token is tried, else the last token is
taken back.  Every position is given up at most once, so the time is linear in the text, for any text.  Decoding
uses one blob of bytes and a table of offsets.

The file of ranks (under 1 MB, checked) is read on the driver and broadcast; each Python worker builds the tables
once.  Encoding is a projection: no shuffle, and texts are split by the public pattern, never cut.

Defined results: an empty text has the ids EMPTY_IDS and a null text NULL_IDS, both fixed as the empty list;
strings that look like special tokens are ordinary text; extra columns aren't read; repeated rows are all encoded.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("COLLATIO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A vocabulary file may have so many bytes, as it is broadcast.
MOST_BYTES = 16 << 20
EMPTY_IDS: list[int] = []
NULL_IDS: list[int] = []
#: Words kept with their ids in each worker; beyond it the store starts anew.
MEMO = 200_000
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return data


class Encoder:
    """Exact byte-pair merges by backtracking over longest matches."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.tokens = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.tokens[i] = token
        self.ids = table
        self.split = regex.compile(pattern).findall
        self._automaton = ahocorasick.Automaton()
        for token, i in table.items():
            self._automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self._automaton.make_automaton()
        # offsets for decoding
        self.blob = b"".join(self.tokens)
        self.offsets = [0]
        for t in self.tokens:
            self.offsets.append(self.offsets[-1] + len(t))
        # the longest token that is a proper prefix of each token
        self._shorter = [-1] * len(self.tokens)
        for token, i in table.items():
            for end in range(len(token) - 1, 0, -1):
                j = table.get(token[:end])
                if j is not None:
                    self._shorter[i] = j
                    break
        # the two tokens that each token is merged from (itself twice for a single byte), in the order of ranks,
        # and the pairs that merge
        self._parts = [(i, i) for i in range(len(self.tokens))]
        self._merged: dict[tuple[int, int], int] = {}
        for i, token in enumerate(self.tokens):
            left = self._shorter[i]
            while left != -1:
                right = table.get(token[len(self.tokens[left]) :])
                if right is not None and left < i and right < i and self._fit(left, right):
                    self._parts[i] = (left, right)
                    self._merged[left, right] = i
                    break
                left = self._shorter[left]
        self._memo: dict[str, list[int]] = {}

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens side by side: no pair along their common border, as it was at any
        moment, would have merged earlier."""
        merged, parts, limit = self._merged, self._parts, 1 << 60
        while True:
            rank = merged.get((left, right))
            if rank is not None and rank < limit:
                return False
            if left > right:  # the left one was merged later: look at the border before that
                limit, left = left, parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece of text."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        size = [0] * n
        for end, (i, length) in self._automaton.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, i
        tokens, shorter, fit = self.tokens, self._shorter, self._fit
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + len(tokens[token])
                if open_at[end] and (last < 0 or fit(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = shorter[token]
                if token < 0:  # nothing fits here: give this position up for good
                    open_at[at] = 0
                    token = out.pop()
                    at -= len(tokens[token])
                    break
        return out

    def encode(self, text: str) -> list[int]:
        memo, out = self._memo, []
        for word in self.split(text):
            ids = memo.get(word)
            if ids is None:
                ids = self.piece(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        blob, offsets = self.blob, self.offsets
        return b"".join([blob[offsets[i] : offsets[i + 1]] for i in ids]).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def _encoder(ranks: bytes) -> Encoder:
    """One encoder for each vocabulary in each Python process."""
    key = hash(ranks)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def _mapper(df: DataFrame, vocabulary: str, value: Callable[[Encoder, str | None], object], kind: pa.DataType):
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    names = df.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for b in batches:
            values = pa.array([value(encoder, t) for t in b.column(b.num_columns - 1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], values], names=[*names, "value"])

    return run


def vocabulary_path(path: str | None = None) -> str:
    return path or os.path.join(TOKENIZERS, VOCABULARY)


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens."""
    narrow = df.select(key, text)

    def ids(encoder: Encoder, t: str | None) -> list[int]:
        return NULL_IDS if t is None else encoder.encode(t) if t else EMPTY_IDS

    run = _mapper(narrow, vocabulary_path(vocabulary), ids, pa.list_(pa.int32()))
    kind = df.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, value array<int>").withColumnRenamed("value", "ids")


def counted(df: DataFrame, *keep: str, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(keep..., tokens): how many tokens every row's text has; 0 for an empty text, null for a null text."""
    narrow = df.select(*keep, text)
    run = _mapper(narrow, vocabulary_path(vocabulary), lambda e, t: None if t is None else len(e.encode(t)), pa.int64())
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(run, f"{kinds}, value bigint").withColumnRenamed("value", "tokens")


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, text): the texts of the ids; a null list gives a null text."""
    narrow = df.select(key, ids)
    run = _mapper(narrow, vocabulary_path(vocabulary), lambda e, x: None if x is None else e.decode(x), pa.string())
    kind = df.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, value string").withColumnRenamed("value", "text")


def report(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per source: documents, null and empty texts, tokens, characters per token."""
    rows = counted(df.withColumn("chars", F.length("text")), "source", "chars", vocabulary=vocabulary)
    return rows.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("tokens").isNull().cast("long")).alias("n_null"), F.sum((F.col("chars") == 0).cast("long")).alias("n_empty"),
        F.sum("tokens").alias("n_tokens"), F.round(F.sum("chars") / F.sum("tokens"), 6).alias("chars_per_token"),
    )
