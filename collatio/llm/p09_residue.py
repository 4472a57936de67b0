"""Template residue, filler, error messages and script notices in place of content.

Method: character n-gram models of placeholders, filler, notices and natural prose.  The residue models start from general
seed text (residue_text), natural prose from all different texts of the corpus; what the seeds find in them with
certainty is learnt as residue in the corpus's own words, what they doubt is left out of natural prose, and the
models are fitted again.  Texts are scored whole: the likelihood ratios of their n-grams are added up over windows.  A
window is a sentence, a stretch within one whose ratios exceed the threshold by most in sum, or, for placeholders, what
stands between delimiters; for these the pattern of the delimiters is one more feature.  Windows over the threshold are
residue, and a document is excluded by the share of it that they cover.

No list decides: a year, a name or a turn of speech only adds to or takes from a sum.  The one exact check is of quoting: a
placeholder between quotation marks is a text's subject, not its residue.

The fitted tables have a fixed size (2 ** BITS numbers an order and kind) whatever the corpus, besides a number for each
different pattern of delimiters; counting and scoring are projections in NumPy over whole batches of texts.  Sentences
are counted in whole units, so that the models don't depend on order or partitions.

Defined results: null and empty texts hold no residue (coverage 0); very long texts are scored whole; repeated rows
are all listed; other columns, of whatever name, are kept by kept() and not read otherwise; with an empty table the
models are those of the seeds.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatio.llm.chars import INVISIBLE_RANGES, _skeleton, lookalikes
from collatio.llm.residue_text import STRONG, seeds
from collatio.sources import cut_lineage

#: The models, and what a window of each is called: mock Latin and what page builders say are both filler.
CLASSES = ("placeholder", "filler", "mock", "notice")
KINDS = ("placeholder", "filler", "filler", "notice")
OF_SENTENCES = (1, 2, 3)
#: Different texts of sample(), by the order of a seeded hash, and characters of each from a seeded place.
NATURAL_SAMPLE = 4_000
NATURAL_CHARS = 4_000
#: Counts of a larger corpus are rates for so many texts: what the thresholds are set for, whatever the number of texts.
PER_TEXTS = 4_000
#: What all sentences that are the same, numbers aside, count together at most, and the units of such weights.
MOST_SAME, UNIT = 4, 1 << 30
BITS = 19
#: Units of ratios where they are added up exactly.
FINE = 1 << 20
ORDERS = (3, 5)
#: Mean likelihood ratio (natural logarithm, per n-gram) from which a sentence is residue, and the least sum.
THRESHOLD, LEAST_SUM = 0.5, 8.0
#: Ratios from which a sentence of the corpus is learnt as residue, or not taken for natural prose.
SURE, DOUBT = 0.8, 0.3
ROUNDS = 3
#: Grams of the shortest stretch within a sentence, and the sum by which its ratios must exceed the threshold.
STRETCH, EVIDENCE = 18, 28.0
#: Share of a residue window's n-grams that the residue model must know.
KNOWN = 0.5
#: Share of a sentence's n-grams in the seeds from which it isn't natural prose before the first fit.
MADE_UP = 0.7
#: Score from which what stands between delimiters is a placeholder: ratio of the pattern and mean ratio of the n-grams.
PLACEHOLDER, CONTENT = 1.0, 1.5
NARROW = 8
#: Coverage from which a document is excluded: any residue at all, as a text that contains some is a case.
LEAST_COVERAGE = 0.0
#: Characters that are scored at a time; a longer text is a block of its own.
BLOCK = 1 << 21

_PHONETIC = lookalikes()["phonetic"]
_PHONETIC_CHARS = re.compile("[" + "".join(_PHONETIC) + "]")
_QUOTED = re.compile(r"`[^`\n]{1,80}`|«[^«»\n]{1,80}»|“[^“”\n]{1,80}”|‘[^‘’\n]{1,80}’|„[^„“\n]{1,80}“")
_ENDS = re.compile(r"(?=[\s<])(?:(?<=[.!?:;])\s+|\n+|\s{2,}|</?[a-z]+>|\s\|\s)")
_SPAN = re.compile(
    r"\{\{\{?[^{}\n]{0,80}\}\}\}?|[$#]\{[^{}\n]{0,80}\}|\{%[^%\n]{0,80}%\}|<%[^%\n]{0,80}%>|\[\[[^\[\]\n]{0,80}\]\]|<<[^<>\n]{1,80}>>|%\([^()\n]{1,40}\)[sd]|@@[^@\n]{1,40}@@|##[^#\n]{1,40}##|%%[^%\n]{1,40}%%"
    r"|(?<!\w)__[^\W_][\w ]{0,40}?__(?!\w)|(?<![\w$])\$[A-Za-z][\w ]{0,40}\$(?!\w)|(?<![\w%])%[A-Za-z]\w{1,40}%(?!\w)|(?<![\w%])%(?:\d\$)?[sd](?!\w)|\[[^\[\]\n]{1,80}\]|\{[^{}\n]{1,80}\}|<[^<>\n]{1,80}>"
)
_SIGN = re.compile(r"[{%<\[@$#]|__")  # every span has one
_UNSEEN_CHARS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE_RANGES) + "]")
_FOREIGN = re.compile("[Ͱ-ԯ]")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\S*\d\S*")
_STRONG = tuple(a for a, _ in STRONG)


def fold(text: str) -> str:
    """Lower case, compatibility forms and look-alikes inside Latin words made plain, no invisible characters."""
    return _plain(text).lower()


def _plain(text: str) -> str:
    if not text.isascii():
        text = _UNSEEN_CHARS.sub("", unicodedata.normalize("NFKC", text))
        text = _PHONETIC_CHARS.sub(lambda m: _PHONETIC[m[0]], text)
        if _FOREIGN.search(text):
            text = _WORD.sub(lambda m: m[0].translate(_skeleton()) if _FOREIGN.search(m[0]) and re.search("[A-Za-z]", m[0]) else m[0], text)
    return text


def _codes(text: str) -> np.ndarray:
    """Code points, digits as one, white space as one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    codes[(codes >= 9) & (codes <= 13) | (codes == 160)] = 32
    return codes.astype(np.uint64)


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.full(n, order, dtype=np.uint64)
    for j in range(order):
        h = (h ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _pieces(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text."""
    start, pieces = 0, []
    for m in _ENDS.finditer(text):
        pieces.append((start, m.start()))
        start = m.end()
    pieces.append((start, len(text)))
    return pieces


def _spans(text: str) -> list[str]:
    """What stands between delimiters, but not between quotation marks too."""
    quoted = [m.span() for m in _QUOTED.finditer(text)]
    return [m.group() for m in _SPAN.finditer(text) if not any(a <= m.start() and m.end() <= b for a, b in quoted)]


def pattern(span: str) -> str:
    """The pattern of a span: delimiters as they are, words and numbers as one sign for each kind."""
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", _DIGIT.sub("0", span))
    return re.sub(r"([aA0])(?:[ _.-]?\1)+", r"\1\1", re.sub(r"0+", "0", out))


class Model(NamedTuple):
    """ratios: float32 (order, 2 ** BITS, kind) of n-grams; patterns: ratio of each pattern of a span, other: of any other."""

    ratios: np.ndarray
    patterns: dict[str, float]
    other: float


def _counts(groups: list[list[str]]) -> np.ndarray:
    """Counts of n-grams by order; a group of forms has the weight of the square root of its number."""
    out = np.zeros((len(ORDERS), 1 << BITS))
    for forms in groups:
        codes = _codes(" ".join(f" {x} " for x in forms))
        for i, o in enumerate(ORDERS):
            np.add.at(out[i], _hashes(codes, o), len(forms) ** -0.5)
    return out


def _ratios(residue: list[np.ndarray], natural: np.ndarray) -> np.ndarray:
    table = np.zeros((len(ORDERS), 1 << BITS, len(KINDS)), dtype=np.float32)
    for i in range(len(ORDERS)):
        q = (natural[i] + 0.5) / (natural[i].sum() + 0.5 * (1 << BITS))
        for k, c in enumerate(residue):
            p = (c[i] + 0.05) / (c[i].sum() + 0.05 * (1 << BITS))
            ratio = np.clip(np.log(p / q), -4, 5)
            # what neither has tells nothing but that it is new, what only prose has speaks against
            table[i, :, k] = np.where(c[i] > 0, ratio, np.where(natural[i] > 0, np.minimum(ratio, -0.5), -0.5))
    return table


def _span_ratios(placeholder: Counter, natural: Counter) -> tuple[dict[str, float], float]:
    n, m, kinds = math.fsum(placeholder.values()), math.fsum(natural.values()), len(placeholder.keys() | natural.keys()) + 1
    log = lambda p: math.log((placeholder[p] + 0.01) / (n + 0.01 * kinds) / ((natural[p] + 0.01) / (m + 0.01 * kinds)))
    return {p: min(3.0, max(-3.0, log(p))) for p in placeholder.keys() | natural.keys()}, min(0.0, log(""))


def _parts(text: str) -> Iterator[tuple[bool, str, str]]:
    """(whether a span, what is the same, as it stands) of the sentences of a text and its spans between brackets."""
    plain = _plain(text)
    for a, b in _pieces(plain):
        if piece := " ".join(plain[a:b].split()):
            yield False, _NUMBER.sub("0", piece.lower()), piece
    if _SIGN.search(plain):
        for x in _spans(plain):
            if x[0] in "[{<" and not x.startswith(_STRONG):  # what brackets mean depends on the corpus, what strong delimiters mean doesn't
                yield True, x, x


class Tally:
    """Weighted counts, in units: n-grams of natural prose and of what is learnt for each of OF_SENTENCES, and patterns of
    placeholders and of other marks.  Without a model a sentence that the known n-grams don't make up is natural prose."""

    def __init__(self, model: Model | None, known: np.ndarray) -> None:
        self.model, self.known = model, known
        self.grams = np.zeros((1 + len(OF_SENTENCES), len(ORDERS), 1 << BITS))
        self.patterns: tuple[Counter, Counter] = Counter(), Counter()

    def add(self, rows: Iterable[tuple[bool, str, int]]) -> Tally:
        """Adds (whether a span, text, weight)."""
        block: list[tuple[str, int]] = []
        size = 0
        for span, text, weight in rows:
            if span:
                self._span(text, weight)
                continue
            if block and size + len(text) > BLOCK:
                self._sentences(block)
                block, size = [], 0
            block.append((text, weight))
            size += len(text)
        if block:
            self._sentences(block)
        return self

    def _span(self, span: str, weight: int) -> None:
        # those between sure and certainly none count for neither
        if self.model and ((score := span_score(span, self.model)) >= 2 * PLACEHOLDER or score <= 0):
            self.patterns[score <= 0][pattern(span)] += weight

    def _sentences(self, rows: list[tuple[str, int]]) -> None:
        pieces = [x.lower() for x, _ in rows]
        size, flat = _flat(pieces)
        hashes = [_hashes(flat, o) for o in ORDERS]
        start = np.cumsum(size) - size
        if self.model is None:
            # a residue text that the corpus holds in many versions would pass for prose: what the seeds' n-grams make up waits
            n = np.maximum(0, size - 3 - ORDERS[-1] + 1)
            run = np.cumsum([0, *self.known[hashes[-1]]])
            label = np.where((n >= STRETCH) & (run[start + 1 + n] - run[start + 1] >= MADE_UP * n), -1, 0)
        else:
            found = _mean_ratios(size, flat, self.model, hashes)
            best, kind = found.max(axis=1), found.argmax(axis=1)
            # a sentence too short to be learnt, such as a heading, isn't doubted either
            label = np.where((best < DOUBT) | (size - 3 < STRETCH), 0, -1)
            for i in np.flatnonzero(label == 0):
                if _SIGN.search(rows[i][0]) and any(span_score(x, self.model) >= PLACEHOLDER for x in _spans(rows[i][0])):
                    label[i] = -1
            for g, k in enumerate(OF_SENTENCES, 1):
                label[(kind == k) & (best >= SURE) & (size - 3 >= STRETCH)] = g
        weight = np.array([w for _, w in rows], float)
        owner = np.repeat(np.arange(len(rows)), size)
        left = (start + size)[owner] - np.arange(len(owner))  # characters of the piece from here on
        for g in np.unique(label[label >= 0]):
            for i, o in enumerate(ORDERS):
                at = np.flatnonzero((label[owner] == g) & (left >= o))
                self.grams[g, i] += np.bincount(hashes[i][at], weights=weight[owner[at]], minlength=1 << BITS)

    def rows(self) -> pa.Table:
        """(slot, pattern, n): slots are places in grams, or -1 and -2 for the patterns of placeholders and of marks."""
        flat = self.grams.ravel()
        at = np.flatnonzero(flat)
        marks = [(-1 - i, p, n) for i, c in enumerate(self.patterns) for p, n in c.items()]
        slots = np.concatenate([at, np.array([x[0] for x in marks], np.int64)])
        n = np.concatenate([flat[at].astype(np.int64), np.array([x[2] for x in marks], np.int64)])
        return pa.table({"slot": slots, "pattern": pa.array([None] * len(at) + [x[1] for x in marks], pa.string()), "n": n})

    def put(self, rows: pa.Table) -> Tally:
        """The sums of rows() of all tasks."""
        slot, n = rows["slot"].to_numpy(), rows["n"].to_numpy()
        self.grams.ravel()[slot[slot >= 0]] = n[slot >= 0]
        for r in rows.filter(pa.array(slot < 0)).to_pylist():
            self.patterns[-1 - r["slot"]][r["pattern"]] = r["n"]
        return self


def _fit(count: Callable[[Model | None, np.ndarray], Tally]) -> Model:
    """The models, from the seeds and the counts that a model (none at first) leads to."""
    base = [_counts([[fold(x) for x in forms] for forms in seeds(k)]) for k in CLASSES]
    telling = _counts([[fold(x) for x in forms] for forms in seeds("natural")])
    seeded = Counter()
    for forms in seeds("placeholder"):
        for p in map(pattern, forms):
            seeded[p] += 20 / len(forms)
    marks = Counter(pattern(m) for forms in seeds("natural") for x in forms for m in _spans(x))
    known = np.stack([b[-1] > 0 for b in base[1:]]).any(axis=0)
    model = Model(_ratios(base, telling + count(None, known).grams[0] / UNIT), *_span_ratios(seeded, marks))
    for _ in range(ROUNDS):
        got = count(model, known)
        sure, mark = (seen + Counter({p: n / UNIT for p, n in own.items()}) for seen, own in zip((seeded, marks), got.patterns, strict=True))
        counts, *learnt = got.grams / UNIT
        # the seeds that tell of residue weigh as much as a hundredth of the corpus
        weight = max(1.0, counts.sum() / telling.sum() / 100)
        own = [np.zeros_like(counts), *learnt]
        # what was learnt weighs as much as the seeds at most
        own = [b + o * min(1.0, b.sum() / max(1.0, o.sum())) for b, o in zip(base, own, strict=True)]
        model = Model(_ratios(own, counts + telling * weight), *_span_ratios(sure, mark))
    return model


def fit(texts: list[str]) -> Model:
    """The models, from the seeds and texts."""
    parts = Counter(x for t in texts for x in _parts(t))
    same: Counter[tuple[bool, str]] = Counter()
    for (span, key, _), n in parts.items():
        same[span, key] += n
    rate = PER_TEXTS / max(PER_TEXTS, len(texts))
    rows = [(span, own, math.floor(n * min(rate, MOST_SAME / same[span, key]) * UNIT)) for (span, key, own), n in parts.items()]
    return _fit(lambda model, known: Tally(model, known).add(rows))


def _weighted(documents: DataFrame) -> DataFrame:
    """(span, own, weight) of the different parts of all different texts, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[bool, str, str]] = []
        size = 0
        for t in (t for b in batches for t in b.column(0).to_pylist()):
            block += _parts(t)
            size += len(t)
            if size > BLOCK:
                yield batch(block)
                block, size = [], 0
        if block:
            yield batch(block)

    def batch(rows: list[tuple[bool, str, str]]) -> pa.RecordBatch:
        span, same, own = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(span, pa.bool_()), pa.array(same, pa.string()), pa.array(own, pa.string())], names=["span", "same", "own"])

    texts = documents.filter("text is not null").select("text")
    rate = PER_TEXTS / max(PER_TEXTS, texts.select(F.xxhash64("text")).distinct().count())
    parts = texts.distinct().mapInArrow(run, "span boolean, same string, own string")
    n = parts.select("span", F.xxhash64("same").alias("same"), "own").groupBy("span", "same", "own").agg(F.count("*").alias("n"))
    most = F.lit(float(MOST_SAME)) / F.sum("n").over(Window.partitionBy("span", "same"))
    return cut_lineage(n.select("span", "own", F.floor(F.col("n") * F.least(F.lit(rate), most) * F.lit(float(UNIT))).alias("weight")))


def fitted(documents: DataFrame) -> Model:
    """The models, from the seeds and all different texts of the documents: what fit() has, counted by tasks."""
    spark = documents.sparkSession
    parts = _weighted(documents)

    def count(model: Model | None, known: np.ndarray) -> Tally:
        shared = spark.sparkContext.broadcast((model, known))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally = Tally(*shared.value)
            for b in batches:
                tally.add(zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield from tally.rows().to_batches(1 << 16)

        rows = parts.mapInArrow(run, "slot long, pattern string, n long").groupBy("slot", "pattern").agg(F.sum("n").alias("n")).toArrow()
        shared.destroy()
        return Tally(model, known).put(rows)

    return _fit(count)


def _sums(flat: np.ndarray, model: Model, hashes: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ratios, known) of each n-gram of the longest order and kind: the mean over the orders, and whether residue has it."""
    n = max(0, len(flat) - ORDERS[-1] + 1)
    total, known = np.zeros((n, len(KINDS)), np.float32), np.zeros((n, len(KINDS)), bool)
    for i, o in enumerate(ORDERS):
        part = model.ratios[i][(hashes[i] if hashes else _hashes(flat, o))[:n]]
        total += part
        if o == ORDERS[-1]:
            known = part > 0
    total /= len(ORDERS)
    return total, known


def _flat(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(size of each piece with the spaces around it, code points of all)."""
    return np.array([len(x) + 3 for x in pieces], dtype=np.int64), _codes("".join(f" {x}  " for x in pieces) + " " * ORDERS[-1])


def _mean_ratios(size: np.ndarray, flat: np.ndarray, model: Model, hashes: list[np.ndarray] | None = None) -> np.ndarray:
    """(piece, kind) mean ratio of each piece of _flat()."""
    run = np.zeros((len(flat) + 1, len(KINDS)))
    sums, _ = _sums(flat, model, hashes)
    np.cumsum(np.rint(sums.astype(float) * FINE), axis=0, out=run[1 : len(sums) + 1])  # whole numbers: the pieces before don't matter
    start = np.cumsum(size) - size
    n = np.maximum(1, size - 5)  # grams that begin before the last two letters
    return (run[start + n] - run[start]) / (n[:, None] * FINE)


def _sentence_ratios(pieces: list[str], model: Model) -> np.ndarray:
    """(piece, kind) mean ratio of each piece."""
    return _mean_ratios(*_flat(pieces), model)


def span_score(span: str, model: Model) -> float:
    """Score of what stands between delimiters: the pattern's ratio and the ratio of the n-grams, half of it that of the
    best window of NARROW."""
    sums = _sums(_codes(f" {fold(span)} "), model)[0][:, 0].astype(float)
    if not len(sums):
        return model.patterns.get(pattern(span), model.other)
    run = np.cumsum([0.0, *sums])
    w = min(NARROW, len(sums))
    best = float((run[w:] - run[:-w]).max()) / w
    return model.patterns.get(pattern(span), model.other) + CONTENT * (float(sums.mean()) + best) / 2


def sample(documents: DataFrame, seed: int = 2027) -> list[str]:
    """A look at a corpus, which the models don't rest on: the first NATURAL_SAMPLE different texts in the order of a seeded hash of the text."""
    h = F.xxhash64(F.lit(seed), "text")
    rows = documents.filter("text is not null").select(h.alias("h"), "text")
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.greatest(F.lit(1), F.length("text") - NATURAL_CHARS + 1)).cast("int") + 1
    last = rows.select("h").distinct().orderBy("h").limit(NATURAL_SAMPLE).agg(F.max("h")).first()[0]
    window = F.substring(F.col("text"), start, F.lit(NATURAL_CHARS)).alias("t")
    return [r.t for r in rows.filter(F.col("h") <= F.lit(last)).select("h", window).groupBy("h").agg(F.first("t").alias("t")).orderBy("h").collect()]


def windows(texts: list[str], model: Model) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, ratio) of every residue window of each plain text."""
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    if not texts:
        return out
    lead = " " * ORDERS[-1]
    folded = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    offset = np.cumsum([0, *(len(t) + len(lead) for t in folded)]) + 1  # place of each text's first character
    flat = _codes(" " + "".join(t + lead for t in folded))
    sums, known = _sums(flat, model)
    run = np.zeros((len(flat) + 1, len(KINDS)))
    np.cumsum(sums, axis=0, out=run[1 : len(sums) + 1])
    run[len(sums) + 1 :] = run[len(sums)]
    knows = np.zeros((len(flat) + 1, len(KINDS)), np.int32)
    np.cumsum(known, axis=0, out=knows[1 : len(known) + 1])
    knows[len(known) + 1 :] = knows[len(known)]
    where, spots = [], []
    for i, t in enumerate(folded):
        own = [(a, b) for a, b in _pieces(t) if b - a > 2]
        spots += [(a + offset[i], b + offset[i]) for a, b in own]
        where += [i] * len(own)
        if _SIGN.search(t):
            quoted = [m.span() for m in _QUOTED.finditer(t)]
            for m in _SPAN.finditer(texts[i]):
                a, b = m.span()
                if (score := span_score(m.group(), model)) >= PLACEHOLDER and not any(x <= a and b <= y for x, y in quoted):
                    out[i].append(("placeholder", a, b, score))
    if not spots:
        return out
    at = np.array(where)
    x, y = np.array(spots).T
    lo, hi = x - 1, np.maximum(x, y - 2)  # grams from the space before the sentence to its last three letters
    n = (hi - lo)[:, None]
    total = run[hi] - run[lo]
    ratio, share = total / n, (knows[hi] - knows[lo]) / n
    for k in OF_SENTENCES:
        least = THRESHOLD
        hit = (ratio[:, k] >= least) & (total[:, k] >= LEAST_SUM) & (share[:, k] >= KNOWN)
        for j in np.flatnonzero(hit):
            out[at[j]].append((KINDS[k], int(x[j] - offset[at[j]]), int(y[j] - offset[at[j]]), float(ratio[j, k])))
        # stretches: only sentences whose sum rises by enough somewhere are looked at one by one
        over = run[:, k] - least * np.arange(len(run))
        rise = over - np.minimum.accumulate(over) >= EVIDENCE
        rises = np.cumsum(rise)
        for j in np.flatnonzero((rises[hi] > rises[lo]) & ~hit):
            for a, b, mean in _stretches(over[lo[j] : hi[j] + 1], least):
                # a clause that one comma joins to the rest of its sentence tells of something: it needs more
                before, behind = flat[max(lo[j], lo[j] + a - 2) : lo[j] + a + 4], flat[lo[j] + b - 3 : min(hi[j] + 2, lo[j] + b + 6)]
                if (44 in before) != (44 in behind) and over[lo[j] + b] - over[lo[j] + a] < 2 * EVIDENCE:
                    continue
                if (knows[lo[j] + b, k] - knows[lo[j] + a, k]) / (b - a) >= KNOWN:
                    begin = max(int(x[j]), int(lo[j]) + a) - int(offset[at[j]])
                    out[at[j]].append((KINDS[k], begin, min(int(y[j]), int(lo[j]) + b + 2) - int(offset[at[j]]), mean))
    return out


def _stretches(over: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(first gram, gram behind, mean ratio) of the stretches whose running sum rises by EVIDENCE or more.

    The best one is the segment of the highest sum; what lies before and behind it is searched again."""
    out = []
    todo = [(0, len(over) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < STRETCH:
            continue
        own = over[a : b + 1]
        gain = own[STRETCH:] - np.minimum.accumulate(own)[:-STRETCH]
        j = int(gain.argmax())
        if gain[j] < EVIDENCE:
            continue
        i, j = a + int(own[: j + 1].argmin()), a + j + STRETCH
        out.append((i, j, float(over[j] - over[i]) / (j - i) + least))
        todo += [(a, i), (j, b)]
    return out


def examine(texts: list[str | None], model: Model) -> list[tuple[float, float, str | None]]:
    """(coverage, highest ratio, kind of the highest) of each text."""
    out: list[tuple[float, float, str | None]] = [(0.0, 0.0, None)] * len(texts)
    block: list[int] = []
    size = 0
    for i in [*range(len(texts)), None]:
        t = texts[i] if i is not None else None
        if block and (i is None or size + len(t or "") > BLOCK):
            plain = [_plain(texts[j]) for j in block]
            for j, p, found in zip(block, plain, windows(plain, model), strict=True):
                if found:
                    mark = bytearray(len(p))
                    for _, a, b, _r in found:
                        mark[a:b] = b"\x01" * (b - a)
                    best = max(found, key=lambda w: w[3])
                    out[j] = sum(mark) / len(p), best[3], best[0]
            block, size = [], 0
        if t and not t.isspace():
            block.append(i)
            size += len(t)
    return out


def examined(documents: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns..., coverage, ratio, kind) of every document."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fitted(documents))
    names = [f"__{i}" for i in range(1 + len(columns))]
    kinds = [documents.schema[c].dataType.simpleString() for c in (key, *columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = examine(b.column(b.num_columns - 1).to_pylist(), model.value)
            cover, ratio, found_kinds = zip(*rows, strict=True) if rows else ((), (), ())
            own = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(cover, pa.float64()), pa.array(ratio, pa.float64()), pa.array(found_kinds, pa.string())], names=[*names, "coverage", "ratio", "kind"])

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    rows = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip((key, *columns), names, strict=True)], "text").mapInArrow(run, f"{schema}, coverage double, ratio double, kind string")
    return rows.select(*[F.col(n).alias(c) for c, n in zip((key, *columns), names, strict=True)], "coverage", "ratio", "kind")


def found(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return examined(documents, key).filter(F.col("coverage") > LEAST_COVERAGE).select(key)


def kept(documents: DataFrame, key: str = "doc_id", most: float = LEAST_COVERAGE) -> DataFrame:
    """The documents without residue: those whose coverage is at most `most`."""
    drop = examined(documents, key).filter(F.col("coverage") > most).select(key)
    return documents.join(drop, key, "left_anti")


def report(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per source and kind (null: no residue): documents and their mean coverage."""
    rows = examined(documents, key, ("source",))
    return rows.groupBy("source", "kind").agg(F.count("*").alias("n_docs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
