"""Predictions that were cut.

Method: a structural completeness check with a stack automaton.  What stays open on the stack (quotes, brackets), what is
broken at the end (markup, multibyte sequences, entities, escapes, dots of omission) and a terminator that is missing
where the source's own lines have one, and a length at which the source's values pile up, add up to a score; how many lines
end with a terminator and where lengths pile up is counted for each source first.  The score alone makes a row a suspect, with or without a reference.  A row is cut if, besides, an
alignment of what stands before the trace with every prefix of the reference shows letters missing at the end: only the
reference tells a cut from a line that breaks off in the source.  Six missing letters are enough by themselves, of a
suspect three are.

Defined results: rows with a null or empty text are never cut (without a reference they may be suspects); a null source is
a source of its own; repeated rows are all listed; very long texts are
aligned whole (bit-parallel); other columns, of whatever name, aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatio.llm.chars import letters
from collatio.llm.kernels import prefix_distances, share

#: Letters that must be missing at the end.
LEAST_MISSING = 6
#: With a trace of the cut this many are enough.
LEAST_WITH_TRACE = 3
#: Points: of a broken end, of what stays open, of a present terminator; a missing one has the surprise of its source, this
#: at most; and from how many points a row is a suspect.
BROKEN, OPEN, PILED, TERMINATED, MOST_SURPRISE, SUSPECT = 3.0, 1.5, 3.0, -1.0, 1.5, 3.0
#: Values pile up at a length that has so many times the values of the lengths around it (one more than their mean).
PILE, AROUND = 5, 3
#: Sources whose share of terminators is sent to the tasks; beyond that it is joined.
MOST_SOURCES = 10_000
#: Differences allowed, as a part of what was compared: recognition errors and added words.
MOST_DIFFERENT = 0.6
#: A prediction with this share of repeated letters is a case of repetition, unless its reference repeats.
REPEATED, REPEATED_REFERENCE = 0.4, 0.25

# Bits of the structure mask.
OPEN_BRACKET, OPEN_QUOTE, BROKEN_MARKUP, BROKEN_ENTITY, BROKEN_ESCAPE, BROKEN_BYTES, DOTS = (1 << i for i in range(7))
_CLOSERS = {")": "(", "]": "[", "}": "{", "⟧": "⟦", "⟩": "⟨", "”": "“", "»": "«", "’": "‘"}
_OPENERS = frozenset("([{⟦⟨“„«‘")
_EVENT = re.compile(r"[()\[\]{}⟦⟧⟨⟩“”„«»‘’\"]")
_TAIL = re.compile(
    r"(?P<bytes>�+|[ÃÂ]|â€?)$|(?P<dots>\.{2,}|…)$|(?P<entity>&#?[A-Za-z0-9]{1,8})$|(?P<escape>\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?|[A-Za-z]?)|%[0-9A-Fa-f]?)$"
    r"|(?P<markup></?[A-Za-z]?[\w =\"-]{0,24})$|(?P<open>[\[({⟨“„«‘\"']+)$"
)
_TERMINATORS = frozenset(".:;,·-=!?")


def structure(text: str) -> tuple[int, int]:
    """(mask, end): what is structurally unfinished in the text, and where its text ends before the trace.

    A stack automaton over the brackets and quotes finds what stays open; the tail decides the rest."""
    end = len(text.rstrip())
    mask, stack = 0, []
    for m in _EVENT.finditer(text):
        ch = m.group()
        if ch == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append(ch)
        elif ch in _OPENERS:
            stack.append(ch)
        elif stack and stack[-1] == _CLOSERS.get(ch):
            stack.pop()
    if any(x in '"“„«‘' for x in stack):
        mask |= OPEN_QUOTE
    if any(x in "([{⟦⟨" for x in stack):
        mask |= OPEN_BRACKET
    while m := _TAIL.search(text, 0, end):
        kind, last = m.lastgroup, text[end - 1]
        # a quote at the end may close one: it must be the odd one, an apostrophe must not follow a letter
        if kind == "open" and (last == '"' and text.count('"', 0, end) % 2 == 0 or last == "'" and text[: m.start()][-1:].isalnum()):
            break
        mask |= {"bytes": BROKEN_BYTES, "dots": DOTS, "entity": BROKEN_ENTITY, "escape": BROKEN_ESCAPE, "markup": BROKEN_MARKUP, "open": OPEN_BRACKET}[kind]
        end = len(text[: m.start()].rstrip())
        if kind == "dots" or end == 0:
            break
    return mask, end


def points(mask: int, terminated: bool, piled: bool, share_terminated: float) -> float:
    """The structural score of a text: what is broken, what is open, and what its source's habits make of its end and length."""
    broken = BROKEN if mask & (BROKEN_MARKUP | BROKEN_ENTITY | BROKEN_ESCAPE | BROKEN_BYTES | DOTS) else 0.0
    left = OPEN * bool(mask & OPEN_BRACKET) + OPEN * bool(mask & OPEN_QUOTE)
    end = TERMINATED if terminated else min(MOST_SURPRISE, -math.log(max(1e-9, 1 - share_terminated)))
    return broken + left + end + PILED * (piled and not terminated)


def examine(reference: str | None, prediction: str | None, share_terminated: float = 0.0, piles: Sequence[int] = ()) -> tuple[int, float, int, int, bool]:
    """(structure mask, structural score, letters missing at the end, differences before, whether the value was cut)."""
    if not prediction or not prediction.strip():
        return 0, 0.0, 0, 0, False
    mask, end = structure(prediction)
    raw = prediction.rstrip()
    score = points(mask, raw[-1] in _TERMINATORS and not mask & DOTS, len(prediction) in piles, share_terminated)
    if not reference:
        return mask, score, 0, 0, False
    goal = reference.rstrip()
    if len(raw) >= len(goal) - LEAST_MISSING and raw[-10:] == goal[-10:]:
        return mask, score, 0, 0, False  # it ends as the reference does
    r, p = letters(reference), letters(prediction[:end])
    if not p or not r:
        return mask, score, len(r), 0, False
    if len(p) >= len(r) - LEAST_MISSING and p[-8:] == r[-8:]:
        return mask, score, 0, 0, False
    distances = prefix_distances(p, r)
    least = min(distances)
    missing = len(r) - max(i for i, d in enumerate(distances) if d == least)
    # what the reference leaves open or ends with is no trace
    suspect = score >= SUSPECT and not (end < len(raw) and goal.endswith(raw[end:].strip())) and (end < len(raw) or mask & ~structure(reference)[0])
    cut = missing >= (LEAST_WITH_TRACE if suspect else LEAST_MISSING) and least <= MOST_DIFFERENT * len(p)
    if cut and share(letters(prediction)) >= REPEATED and share(r) <= REPEATED_REFERENCE:
        cut = False
    return mask, score, missing, least, cut


_FIELDS = "structure int, score double, missing int, differences int, cut boolean"
_TYPES = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())


def habits(df: DataFrame, source: str = "system", prediction: str = "prediction") -> DataFrame:
    """(source, share_terminated, piles): of the source's predictions with text, how many end with a terminator, and the
    lengths at which they pile up."""
    marks = "[" + "".join("\\" + t for t in sorted(_TERMINATORS)) + r"]\s*$"
    rows = df.filter(F.col(prediction).rlike(r"\S")).select(F.col(source).alias("source"), F.col(prediction).rlike(marks).cast("long").alias("t"), F.length(prediction).alias("chars"))
    by_length = rows.groupBy("source", "chars").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    near = Window.partitionBy("source").orderBy("chars").rangeBetween(-AROUND, AROUND)  # one row a length
    around = (F.sum("n").over(near) - F.col("n")) / (2 * AROUND)
    by_length = by_length.withColumn("pile", F.when(F.col("n") >= PILE * (1 + around), F.col("chars")))
    return by_length.groupBy("source").agg((F.sum("t") / F.sum("n")).alias("share_terminated"), F.sort_array(F.collect_set("pile")).alias("piles"))


def examined(df: DataFrame, key: str = "row_id", reference: str = "reference", prediction: str = "prediction", source: str = "system") -> DataFrame:
    """(key, source, chars, structure, score, missing, differences, cut) of every row; two scans, no shuffle of texts."""
    kinds = [df.schema[c].dataType.simpleString() for c in (key, source)]
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(reference).alias("r"), F.col(prediction).alias("p"))
    own = habits(df, source, prediction)
    known = own.limit(MOST_SOURCES + 1).collect()
    if len(known) > MOST_SOURCES:
        own = own.withColumnRenamed("source", "__source")
        rows = rows.join(own, F.col("source").eqNullSafe(F.col("__source")), "left").select("key", "source", "r", "p", "share_terminated", "piles")
    habit_of = {r.source: (r.share_terminated, frozenset(r.piles)) for r in known[:MOST_SOURCES]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources, texts = b.column(1).to_pylist(), b.column(3).to_pylist()
            habit = zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True) if b.num_columns > 4 else [habit_of.get(x, (0.0, ())) for x in sources]
            found = [examine(r, p, t or 0.0, piles or ()) for r, p, (t, piles) in zip(b.column(2).to_pylist(), texts, habit, strict=True)]
            columns = zip(*found, strict=True) if found else ((),) * len(_TYPES)
            chars = pa.array([None if t is None else len(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), chars, *map(pa.array, map(list, columns), _TYPES)], names=["key", "source", "chars", "structure", "score", "missing", "differences", "cut"])

    return rows.mapInArrow(run, f"key {kinds[0]}, source {kinds[1]}, chars int, {_FIELDS}")


def found(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key) of the rows whose prediction was cut."""
    return examined(df, key).filter("cut").select(F.col("key").alias(key))


def report(df: DataFrame) -> DataFrame:
    """One row per system (a null system is a group of its own): rows, cut rows and their share, suspects by structure alone
    and how many of the cut rows are suspects, rows with each structural fault, the share of predictions without a
    terminator, and the length at which most of the system's cut values end with how many end there."""
    faults = (("open_brackets", OPEN_BRACKET), ("open_quotes", OPEN_QUOTE), ("broken_codes", BROKEN_MARKUP | BROKEN_ENTITY | BROKEN_ESCAPE), ("broken_bytes", BROKEN_BYTES), ("dots", DOTS))
    rows = examined(df).withColumn("suspect", F.col("score") >= SUSPECT)
    n = lambda c: F.sum(c.cast("long"))
    by_length = rows.groupBy(F.col("source").alias("system"), "chars").agg(
        F.count("*").alias("n"), n(F.col("cut")).alias("n_cut"), n(F.col("suspect")).alias("n_suspect"), n(F.col("suspect") & F.col("cut")).alias("n_suspect_cut"),
        *[n(F.col("structure").bitwiseAND(F.lit(bit)) != 0).alias(name) for name, bit in faults],
    )
    sums = ("n_cut", "n_suspect", "n_suspect_cut", *[name for name, _ in faults])
    totals = by_length.groupBy("system").agg(F.sum("n").alias("n_rows"), *[F.sum(x).alias(x) for x in sums], F.max(F.struct(F.col("n_cut").alias("c"), (-F.col("chars")).alias("l"))).alias("peak"))
    own = habits(df).select(F.col("source").alias("__source"), F.round(1 - F.col("share_terminated"), 9).alias("missing_terminator_share"))
    return totals.join(own, F.col("system").eqNullSafe(F.col("__source")), "left").select(
        "system", "n_rows", *sums, F.round(F.col("n_cut") / F.col("n_rows"), 9).alias("cut_share"), "missing_terminator_share",
        F.when(F.col("peak.c") > 0, -F.col("peak.l")).alias("usual_cut_length"), F.col("peak.c").alias("n_at_usual_cut_length"),
    )
