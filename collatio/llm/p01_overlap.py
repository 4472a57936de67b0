"""Same or nearly the same line on both sides of a split.

Method: edit-distance segment join.  The letters of every evaluation line are cut into k+1 segments, where k is
the largest number of differences that any partner may have; by the pigeonhole principle two texts within k
differences share one of them.  Segments in the front half are placed from the start, those in the back half
from the end, each at the few positions where it may stand; every substring of a training line is looked up
at its place from either end.  What meets is verified by banded dynamic programming (levenshtein with a
threshold, on the JVM).

The join works on different texts, not on lines: copies are one text with many lines, so a text that a third of
all lines share is joined once.  Joins are plain equi-joins on a hash of (place, substring), shuffled and open to
the skew handling of the adaptive planner; all that is broadcast is a bitmap, whose size follows the counted number of segments
up to a bound and which spares the shuffle of substrings that no segment has.

Texts of fewer than min_letters letters are no case of found(); links() and report() have them too, matched where all
letters are the same.

Defined results: lines without a split and null references don't count, nor do references without letters; a line given in several forms counts with each; a line that stands on both sides is never its own
partner; very long lines are joined whole; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.llm.chars import letters
from collatio.sources import cut_lineage

MIN_LETTERS = 20
#: Words of the bitmap that is broadcast, 64 bits each: from some 8 MB in all, for up to four million keys, to 40 MB.
WORD_BITS, MOST_WORD_BITS = 18, 20
#: Differences allowed, in percent of the longer text's letters.
PERCENT = 15


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = pa.array([letters(t) for t in b.column(2).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], names=["line_id", "split", "letters"])


def split_of(column: str = "gen_split") -> Column:
    """The split, read without regard to case and outer spaces."""
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def lines(df: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(line_id, split, letters), one row for each different form of a line; duplicates go before the texts are
    touched."""
    different = (
        df.select("line_id", split_of().alias("split"), "reference")
        .filter(F.col("split").isin("train", "dev", "test") & F.col("reference").isNotNull() & F.col("line_id").isNotNull())
        .distinct()
    )
    return (
        different.mapInArrow(_fold, "line_id string, split string, letters string")
        .filter(F.length("letters") >= min_letters)
        .distinct()
    )


def _most(n: Column, percent: int) -> Column:
    """The most differences that a text of n letters can have to any partner."""
    return F.floor(n * percent / (100 - percent)).cast("int")


def _key(place: str, at: Column, piece: Column) -> Column:
    return F.xxhash64(F.lit(place), at, piece)


def _segments(texts: DataFrame, percent: int) -> DataFrame:
    """Evaluation side: (key, eval_id, n, i, shift) for every segment at every place where it may stand."""
    n = F.length("letters")
    k = _most(n, percent)
    cut = texts.select("id", "letters", n.alias("n"), k.alias("k")).select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    short = F.floor(F.col("n") / (F.col("k") + 1)).cast("int")
    longer = F.col("n") - short * (F.col("k") + 1)  # so many segments, the last ones, have one letter more
    before = F.col("k") + 1 - longer
    start = F.col("i") * short + F.greatest(F.lit(0), F.col("i") - before)
    size = short + F.when(F.col("i") >= before, 1).otherwise(0)
    front = F.col("i") <= F.col("k") - F.col("i")
    reach = F.when(front, F.col("i")).otherwise(F.col("k") - F.col("i"))
    cut = cut.withColumns({"start": start, "size": size, "front": front}).withColumn("shift", F.explode(F.sequence(-reach, reach)))
    at = F.when(F.col("front"), F.col("start") + F.col("shift")).otherwise(F.col("n") - F.col("start") - F.col("size") + F.col("shift"))
    piece = F.expr("substring(letters, start + 1, size)")
    return (
        cut.withColumn("at", at)
        .filter("at >= 0")
        .select(F.when(F.col("front"), _key("<", F.col("at"), piece)).otherwise(_key(">", F.col("at"), piece)).alias("key"),
                F.col("id").alias("eval_id"), F.col("n").alias("eval_n"), F.col("i").cast("short").alias("i"), F.col("k").cast("short").alias("k"),
                F.when(F.col("front"), F.col("shift")).cast("short").alias("front_shift"), F.when(~F.col("front"), F.col("shift")).cast("short").alias("back_shift"))
    )


def _substrings(texts: DataFrame, percent: int) -> DataFrame:
    """Training side: (key, train_id, train_n) of every substring that has the size of a segment of any possible
    partner, placed from the start in the front part and from the end in the back part."""
    q = f"(({percent} * x) div {100 - percent})"  # the partner's k for length x
    sizes = F.expr(
        "array_distinct(flatten(transform(sequence(n - k, n + k), x -> "
        f"array(int(x div ({q} + 1)), int(x div ({q} + 1) + if(x % ({q} + 1) > 0, 1, 0))))))"
    )
    placed = texts.select("id", "letters", F.length("letters").alias("n")).withColumn("k", _most(F.col("n"), percent))
    placed = placed.withColumn("size", F.explode(sizes)).filter("size > 0 and size <= n")
    # a segment of the front half starts before the middle of the longest partner (n + k letters), less than k off
    far = F.least(F.col("n") - F.col("size"), F.ceil((F.col("n") + 3 * F.col("k")) / 2).cast("int") + 1)
    placed = placed.withColumn("at", F.explode(F.sequence(F.lit(0), far)))
    sides = F.explode(F.array(
        _key("<", F.col("at"), F.expr("substring(letters, at + 1, size)")),
        _key(">", F.col("at"), F.expr("substring(letters, n - at - size + 1, size)")),
    )).alias("key")
    return placed.select(sides, F.col("id").alias("train_id"), F.col("n").alias("train_n"))


def _likely(substrings: DataFrame, segments: DataFrame) -> DataFrame:
    """The substrings whose key some segment may have: most have none and needn't be shuffled.

    A bitmap of the segments' keys is broadcast.  It has four bits a key while its bound allows; with more keys it
    fills up and lets more pass, and no substring that has a partner is ever lost."""
    bits = min(MOST_WORD_BITS, max(WORD_BITS, (segments.count() // 16).bit_length()))
    word, bit = F.shiftrightunsigned("key", 64 - bits), F.expr("shiftleft(1L, int(key & 63))")
    mask = segments.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("mask"))
    return substrings.withColumn("word", word).join(F.broadcast(mask), "word").filter(F.col("mask").bitwiseAND(bit) != 0).drop("word", "mask")


def text_pairs(rows: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of lines().  pairs: (eval_id, train_id, distance), one for each pair of different texts
    (ids of texts) within reach; members: (id, side, line_id, split, letters)."""
    side = F.when(F.col("split") == "train", "train").otherwise("eval")
    texts = rows.select("letters", side.alias("side")).distinct().withColumn("id", F.monotonically_increasing_id())
    texts = cut_lineage(texts)  # the ids must stay the same when a task runs again
    ev, tr = texts.filter("side = 'eval'"), texts.filter("side = 'train'")
    segments = _segments(ev, percent)
    met = segments.join(_likely(_substrings(tr, percent), segments), "key")
    delta = F.col("train_n") - F.col("eval_n")
    shift = F.coalesce(F.col("front_shift"), delta - F.col("back_shift"))  # from the start
    right = F.coalesce(delta - F.col("front_shift"), F.col("back_shift"))
    most = F.floor(F.greatest("train_n", "eval_n") * percent / 100).cast("int")
    near = met.filter(
        (F.abs(shift) <= F.col("i")) & (F.abs(right) <= F.col("k") - F.col("i")) & (F.abs(shift) + F.abs(right) <= most)
    ).select("eval_id", "train_id").distinct()
    both = near.join(tr.select(F.col("id").alias("train_id"), F.col("letters").alias("t")), "train_id").join(
        ev.select(F.col("id").alias("eval_id"), F.col("letters").alias("e")), "eval_id"
    )
    limit = F.expr(f"int(greatest(length(e), length(t)) * {percent} div 100)")
    d = F.expr(f"levenshtein(e, t, int(greatest(length(e), length(t)) * {percent} div 100))")
    pairs = both.select("eval_id", "train_id", d.alias("distance"), limit.alias("most")).filter("distance >= 0 and distance <= most").drop("most")
    members = rows.withColumn("side", side).join(texts, ["letters", "side"]).select("id", "side", "line_id", "split", "letters")
    return pairs, members


def found(df: DataFrame) -> DataFrame:
    """(line_a, line_b), the smaller first: every pair of lines on both sides whose references are the same or
    almost the same."""
    pairs, members = text_pairs(lines(df))
    ev = members.filter("side = 'eval'").select(F.col("id").alias("eval_id"), F.col("line_id").alias("a"))
    tr = members.filter("side = 'train'").select(F.col("id").alias("train_id"), F.col("line_id").alias("b"))
    return (
        pairs.join(ev, "eval_id").join(tr, "train_id").filter("a <> b")
        .select(F.least("a", "b").alias("line_a"), F.greatest("a", "b").alias("line_b")).distinct()
    )


def _short_links(short: DataFrame) -> DataFrame:
    """(letters, side) of the short texts that stand on both sides, one row each."""
    both = short.groupBy("letters").agg(F.countDistinct("side").alias("n")).filter("n = 2").select("letters")
    return both.withColumn("side", F.explode(F.array(F.lit("train"), F.lit("eval"))))


def links(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(line_id, split, class_id, n_letters, n_links, distance): one row for each line and form of its text, whose class
    are all lines with the same letters.  n_links counts the classes on the other side within reach (short texts: the
    same class), distance is the least of them (null without any).  Copies aren't expanded to pairs."""
    rows = lines(df, 1).withColumn("side", F.when(F.col("split") == "train", "train").otherwise("eval"))
    pairs, members = text_pairs(rows.filter(F.length("letters") >= MIN_LETTERS).drop("side"), percent)
    pairs = cut_lineage(pairs)
    hit = (
        pairs.select(F.explode(F.array("eval_id", "train_id")).alias("id"), "distance")
        .groupBy("id").agg(F.count("*").alias("n_links"), F.min("distance").alias("distance"))
    )
    long = members.join(hit, "id", "left").select("line_id", "split", "letters", "n_links", "distance")
    short = rows.filter(F.length("letters") < MIN_LETTERS)
    same = _short_links(short).withColumns({"n_links": F.lit(1).cast("long"), "distance": F.lit(0)})
    short = short.join(same, ["letters", "side"], "left").select("line_id", "split", "letters", "n_links", "distance")
    return long.unionByName(short).select(
        "line_id", "split", F.md5("letters").alias("class_id"), F.length("letters").alias("n_letters"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "distance"
    )


def report(df: DataFrame) -> DataFrame:
    """One row per gen_split (dev, test) and subcorpus of the evaluation lines: lines, lines with a partner in train,
    of these lines with exactly the same letters, and of those the ones too short to be a case of found().  Nothing is
    expanded to pairs of lines."""
    where = df.filter(F.col("line_id").isNotNull() & split_of().isin("dev", "test")).select("line_id", split_of().alias("split"), "subcorpus").distinct()
    short = F.col("n_letters") < MIN_LETTERS
    ev = links(df).filter("split <> 'train'").groupBy("line_id", "split").agg(F.min(F.when(~short, F.col("distance"))).alias("least"), F.min(F.when(short, F.col("distance"))).alias("short"))
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return (
        where.join(ev, ["line_id", "split"])
        .groupBy(F.col("split").alias("gen_split"), "subcorpus")
        .agg(F.count("*").alias("n_lines"), F.count("least").alias("n_overlapping"), yes(F.col("least") == 0).alias("n_same"), yes(F.col("least").isNull() & (F.col("short") == 0)).alias("n_short_same"))
    )
