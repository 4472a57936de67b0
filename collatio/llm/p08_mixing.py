"""Mixing sources to target shares of the tokens.

Method: subset-sum budget fitting.  A source's goal is its share of the budget; whole repeats are taken while they
fit and are allowed, and the rest is filled with documents in the order of a seeded hash: level by level, sums by
hash bucket (4,096 a source and level) say which buckets fit whole, until less than the longest document is open;
then again with the documents of at most half of what is open, until that is less than WINDOW tokens.  Those are
fitted exactly: the source's other documents are counted by token length, a bounded knapsack over lengths finds the
best reachable sum, and so many seeded documents of each length are taken.  If the documents of at most WINDOW tokens
are used up before, longer ones that still fit are taken first, the longest before the others.

With the budget of all tokens, as asked, a source that falls short leaves the others with more than their share of what
there is; the budget "attainable" is the largest one that keeps the shares.

So a source stays short by less than WINDOW tokens or by less than its shortest document that isn't taken.

Defined results: null texts have no tokens and are never taken, empty ones (0 tokens) neither; documents without
a source, or with one that has no target, count in the total only; a target without documents is a shortfall of
all its tokens; copies of repeated rows are
added up; ties of the hash are broken by the key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatio.llm.p07_encoding import counted
from collatio.sources import cut_lineage

#: Tokens that the knapsack may fit, and so the largest table that it makes (in bits, for each length).
WINDOW = 1 << 16
#: Bits of the hash that one level of buckets uses.
LEVEL_BITS = 12
#: Targets are a plan made by hand; so many are allowed, as they are read on the driver.
MOST_TARGETS = 10_000


def fit(goal: int, counts: dict[int, int]) -> dict[int, int]:
    """{length: how many} whose sum comes as near to the goal from below as the counts allow.

    Bounded knapsack on bit sets: reachable sums are the bits of an integer; the counts are split in powers of two.
    Stops as soon as the goal itself is reached."""
    steps: list[tuple[int, int, int]] = []  # sums before, length, how many at once
    full = (1 << (goal + 1)) - 1
    sums = 1
    for length in sorted((x for x in counts if 0 < x <= goal), reverse=True):
        left, chunk = min(counts[length], goal // length), 1
        while left > 0:
            take = min(chunk, left)
            steps.append((sums, length, take))
            sums |= sums << length * take & full
            left -= take
            chunk *= 2
        if sums >> goal & 1:
            break
    best = sums.bit_length() - 1
    out: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            out[length] = out.get(length, 0) + take
            best -= length * take
    return out


def sized(documents: DataFrame, key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(key, source, tokens) of every document."""
    return counted(documents, key, "source", vocabulary=vocabulary)


def _marked(usable: DataFrame, edges: dict[str, list[tuple[int, int]]], sources: list[str]) -> DataFrame:
    """The documents of the sources, with taken: 1 under one of the source's edges, if not longer than goes with that edge."""
    spark = usable.sparkSession
    of = spark.createDataFrame([(s, [(str(edge), most) for edge, most in edges[s]]) for s in sources], "source string, edges array<struct<edge string, most long>>")
    of = of.withColumn("edges", F.expr("transform(edges, e -> struct(cast(e.edge as decimal(20,0)) as edge, e.most as most))"))
    return usable.join(F.broadcast(of), "source").withColumn("taken", F.expr("cast(exists(edges, e -> number < e.edge and tokens <= e.most) as int)")).drop("edges")


def _levels(level: DataFrame, sources: list[str], most: dict[str, int], goal: dict[str, int], edges: dict[str, list[tuple[int, int]]]) -> None:
    """Fills the goals with documents of at most most[source] tokens until less than that is open; appends the edges."""
    spark = level.sparkSession
    below, bits = dict.fromkeys(sources, 0), 0
    while bits < 60 and any(goal[s] >= most[s] for s in sources):
        bits += LEVEL_BITS
        open_now = [s for s in sources if goal[s] >= most[s]]
        bounds = spark.createDataFrame([(s, most[s], below[s] << LEVEL_BITS, (below[s] + 1) << LEVEL_BITS) for s in open_now], "source string, most long, first long, after long")
        got = (
            level.withColumn("bucket", F.expr(f"number div cast('{1 << (64 - bits)}' as decimal(20,0))"))
            .join(F.broadcast(bounds), "source").filter("tokens <= most and bucket >= first and bucket < after")
            .groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens")).collect()
        )  # at most 4,096 rows a source
        by: dict[str, list] = {}
        for r in got:
            by.setdefault(r.source, []).append((r.bucket, r.tokens))
        for s in sources:
            below[s] <<= LEVEL_BITS
            if s not in open_now:
                continue
            end = below[s] + (1 << LEVEL_BITS)
            for bucket, tokens in sorted(by.get(s, [])):
                if tokens > goal[s]:
                    end = bucket
                    break
                goal[s] -= tokens
            below[s] = end
    for s in sources:
        edges[s].append((below[s] << (64 - bits), most[s]))


class Fitted(NamedTuple):
    """What each source gives: wanted tokens, its own, and how often the whole of it is taken before the rest is filled."""

    mixture: DataFrame
    wanted: dict[str, int]
    own: dict[str, int]
    repeats: dict[str, int]


def fitted(documents: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 2027, budget: int | str | None = None,
           vocabulary: str | None = None) -> Fitted:
    """The mixture with what was wanted of each source.  The budget is, unless given, the tokens of all documents;
    "attainable" is the largest one for which no source that has documents falls short, so that their shares among each
    other are the wished ones."""
    spark = documents.sparkSession
    plan = {r.source: (r.target_permille, r.max_repeats) for r in targets.limit(MOST_TARGETS + 1).collect()}
    if len(plan) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    # the hash as a number from 0 to 2**64 - 1
    number = F.xxhash64(F.lit(seed), F.col(key)).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    rows = sized(documents, key, vocabulary).withColumn("number", number.cast("decimal(20,0)"))
    rows = cut_lineage(rows)  # encoded once, read by every level
    named = F.broadcast(targets.select(F.col("source").alias("named")).distinct())
    # one row a named source and one for all others together
    own_rows = rows.join(named, F.col("source") == F.col("named"), "left").groupBy("named").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest")).collect()
    sums, longest = {r.named: (r.tokens or 0) for r in own_rows}, {r.named: (r.longest or 0) for r in own_rows}
    total = sum(sums.values()) if budget is None or budget == "attainable" else budget
    if budget == "attainable":
        total = min((sums[s] * repeats * 1000 // permille for s, (permille, repeats) in plan.items() if sums.get(s) and permille), default=0)
    whole, goal, wanted_of = {}, {}, {}
    for source, (permille, repeats) in plan.items():
        wanted, own = total * permille // 1000, sums.get(source, 0)
        wanted_of[source] = total * permille  # in thousandths, so that nothing is rounded away
        whole[source] = min(repeats, wanted // own) if own else 0
        goal[source] = wanted - whole[source] * own if own and whole[source] < repeats else 0
    # level by level: documents whose number's first bits are under below[source] are taken, if they aren't too long
    at = [s for s in goal if goal[s] > 0]
    most = {s: max(WINDOW, min(goal[s], longest[s])) for s in at}
    edges: dict[str, list[tuple[int, int]]] = {s: [] for s in plan}
    usable = rows.filter("tokens > 0")
    open_now = [s for s in at if goal[s] >= most[s]]
    while open_now:
        level = _marked(usable, edges, open_now).filter("taken = 0")
        _levels(level, open_now, most, goal, edges)
        for s in open_now:
            most[s] = max(WINDOW, min(most[s], goal[s]) // 2) if most[s] > WINDOW else 0
        open_now = [s for s in open_now if most[s] and goal[s] >= WINDOW]
    marked = _marked(usable, edges, list(plan)).join(F.broadcast(spark.createDataFrame(list(whole.items()), "source string, whole int")), "source")
    # the rest: counts by exact length, of the lengths that fit
    rest = spark.createDataFrame([(s, goal[s]) for s in at if goal[s] > 0] or [("", 0)], "source string, goal long")
    lengths = marked.filter("taken = 0").join(F.broadcast(rest), "source").filter("tokens <= goal").groupBy("source", "tokens").agg(F.count("*").alias("n")).collect()
    counts: dict[str, dict[int, int]] = {}
    for r in lengths:
        counts.setdefault(r.source, {})[r.tokens] = r.n
    need = []
    for s, own in counts.items():
        for length in sorted((x for x in own if x > WINDOW), reverse=True):
            if n := min(own[length], goal[s] // length):
                need.append((s, length, n))
                goal[s] -= n * length
        need += [(s, length, n) for length, n in fit(min(goal[s], WINDOW), {x: n for x, n in own.items() if x <= WINDOW}).items()]
    wanted = F.broadcast(spark.createDataFrame(need or [("", -1, 0)], "source string, tokens long, need int"))
    pool = marked.filter("taken = 0").join(wanted, ["source", "tokens"])
    # first few of each length by the hash, salted so that no length is one task's
    salted = pool.withColumn("salt", F.pmod(F.xxhash64("number", F.lit(1)), F.lit(64)))
    first = Window.partitionBy("source", "tokens", "salt").orderBy("number", key)
    last = Window.partitionBy("source", "tokens").orderBy("number", key)
    picked = salted.withColumn("r", F.row_number().over(first)).filter("r <= need").withColumn("r", F.row_number().over(last)).filter("r <= need")
    base = marked.select(key, "source", "tokens", (F.col("whole") + F.col("taken")).alias("copies"))
    extra = picked.select(key, "source", "tokens", F.lit(1).alias("copies"))
    out = base.unionByName(extra).groupBy(key, "source", "tokens").agg(F.sum("copies").cast("int").alias("copies"))
    return Fitted(out.filter("copies > 0"), wanted_of, {s: sums.get(s, 0) for s in plan}, {s: r for s, (_, r) in plan.items()})


def mixed(documents: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 2027, budget: int | str | None = None,
          vocabulary: str | None = None) -> DataFrame:
    """(key, source, tokens, copies) of every document in the mixture; a source gives target_permille of the budget or, if
    it can't, all its documents max_repeats times."""
    return fitted(documents, targets, key, seed, budget, vocabulary).mixture


def found(documents: DataFrame, targets: DataFrame, key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(source) of the targets that the fitted mixture misses although it takes all that may be taken: every document of
    the source as often as it may be; a source without documents is one."""
    fit_ = fitted(documents, targets, key, vocabulary=vocabulary)
    taken = {r.source: r.tokens for r in fit_.mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens")).collect()}
    missed = [s for s, wanted in fit_.wanted.items() if not fit_.own[s] or taken.get(s, 0) == fit_.own[s] * fit_.repeats[s] and 1000 * taken.get(s, 0) < wanted]
    return documents.sparkSession.createDataFrame([(s,) for s in missed], "source string")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: target_permille, documents, copies and tokens in the mixture, and the share of it reached."""
    got = mixture.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").cast("long").alias("n_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"))
    total = got.agg(F.sum("mix_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return targets.join(got, "source", "left").join(F.broadcast(total)).select(
        "source", "target_permille", zero("n_docs"), zero("n_copies"), zero("mix_tokens"),
        F.round(1000 * F.coalesce("mix_tokens", F.lit(0)) / F.col("all_tokens"), 6).alias("reached_permille"),
    )
