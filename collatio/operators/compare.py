"""Strictly paired comparison of systems with cluster-bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from collatio.functions.align import error_rate
from collatio.operators.evaluate import number_rows
from collatio.policy import check_columns, choice
from collatio.sources import cut_lineage


def _keys(unit: str, pair_id: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([unit, *([pair_id] if isinstance(pair_id, str) else pair_id)]))


def pairing_violations(x: DataFrame, systems: tuple[str, str], unit: str = "document_id", pair_id: Sequence[str] = "line_id", system_col: str = "system") -> DataFrame:
    """What stands against a paired comparison: problem, metric and how many pairs: duplicate (a system has a pair
    twice), unpaired, reference (texts differ), length (numbers of tokens differ).  Nulls are values of the key."""
    a, b = systems
    keys = _keys(unit, pair_id)
    text = F.col("reference") if "reference" in x.columns else F.lit(None).cast("string")
    rows = x.filter(F.col(system_col).isin(a, b))
    own = lambda s: F.col(system_col) == s
    pairs = rows.groupBy("metric", *keys).agg(
        F.count(F.when(own(a), 1)).alias("na"), F.count(F.when(own(b), 1)).alias("nb"),
        F.min(F.when(own(a), text)).alias("ta"), F.min(F.when(own(b), text)).alias("tb"),
        F.min(F.when(own(a), F.col("n_reference"))).alias("la"), F.min(F.when(own(b), F.col("n_reference"))).alias("lb"),
    )
    both = (F.col("na") > 0) & (F.col("nb") > 0)
    checks = {"duplicate": (F.col("na") > 1) | (F.col("nb") > 1), "unpaired": ~both, "reference": both & ~F.col("ta").eqNullSafe(F.col("tb")), "length": both & (F.col("la") != F.col("lb"))}
    wide = pairs.groupBy("metric").agg(*[F.count(F.when(c, 1)).alias(k) for k, c in checks.items()])
    return wide.unpivot(["metric"], list(checks), "problem", "n").filter("n > 0")


def common_observations(x: DataFrame, systems: tuple[str, str], keys: Sequence[str], system_col: str = "system") -> DataFrame:
    """The rows of the two systems whose pair both of them have (nulls in the key are values)."""
    rows = x.filter(F.col(system_col).isin(*systems))
    both = rows.groupBy("metric", *keys).agg(F.countDistinct(system_col).alias("__n")).filter("__n = 2")
    both = both.select(F.col("metric").alias("__metric"), *[F.col(k).alias(f"__{k}") for k in keys])
    on = F.col("metric") == F.col("__metric")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(both, on, "left_semi")


def _validate(x: DataFrame, a: str, b: str, unit: str, pair_id: Sequence[str], system_col: str) -> None:
    present = {r[0] for r in x.select(system_col).filter(F.col(system_col).isin(a, b)).distinct().collect()}
    if missing := {a, b} - present:
        raise ValueError(f"systems not present: {', '.join(sorted(missing))}")
    messages = {
        "duplicate": "A system has several rows for the same pair", "unpaired": "Systems must have the same paired observations",
        "reference": "Reference texts differ between the systems", "length": "Reference lengths differ between the systems",
    }
    for r in pairing_violations(x, (a, b), unit, pair_id, system_col).collect():  # at most four rows a metric
        raise ValueError(f"{messages[r.problem]} ({r.n} pairs, {r.metric})")


def _check(n_boot: int, conf_level: float) -> None:
    if not isinstance(n_boot, int) or n_boot < 1:
        raise ValueError("n_boot must be a positive integer")
    if not 0 < conf_level < 1:
        raise ValueError("conf_level must lie between 0 and 1")


def require_pairs(x: DataFrame, groups: Sequence[str], member: str, keys: Sequence[str], unpaired: str = "raise") -> None:
    """Raise unless every member (a system, a condition) of a group has each observation once, with one reference text and
    length, and, unless unpaired is "drop", all members have the same observations.  Nulls are values of the key."""
    choice("unpaired", unpaired, ("raise", "drop"))
    text = F.coalesce("reference", F.lit(""))
    texts = [F.min(text).alias("t0"), F.max(text).alias("t1"), F.count("reference").alias("texts")] if "reference" in x.columns else []
    seen = x.groupBy(*groups, *keys).agg(F.count("*").alias("n"), F.countDistinct(member).alias("members"), F.min("n_reference").alias("l0"), F.max("n_reference").alias("l1"), *texts)
    bad = {"a member has several rows for the same pair": F.col("n") > F.col("members")}
    if texts:
        bad["reference texts differ within a pair"] = (F.col("t0") != F.col("t1")) | ((F.col("texts") > 0) & (F.col("texts") < F.col("n")))
    bad["reference lengths differ within a pair"] = F.col("l0") != F.col("l1")
    if unpaired == "raise":
        sizes = x.groupBy(*groups).agg(F.countDistinct(member).alias("all_members"))
        on = F.lit(True)
        sizes = sizes.withColumnsRenamed({g: f"__{g}" for g in groups})
        for g in groups:
            on &= F.col(g).eqNullSafe(F.col(f"__{g}"))
        seen = seen.join(sizes, on)
        bad["not all members have the same pairs"] = F.col("members") != F.col("all_members")
    for message, n in seen.agg(*[F.count(F.when(c, 1)).alias(m) for m, c in bad.items()]).first().asDict().items():
        if n:
            raise ValueError(f"{message} ({n} pairs)")


#: Rows of units that the driver collects and sends to the tasks (six numbers each, 24 MB); with more, the units are dealt to tasks.
MOST_UNITS = 500_000
#: Units and groups that a task has at most where they are dealt, and draws that it makes.
BLOCK, BLOCK_GROUPS, BLOCK_DRAWS = 500_000, 100, 200_000_000
#: Draws that a task holds at a time.
DRAWS = 2_000_000
# Multipliers of the draws' hash, all below 2 ** 32 so that 64 bits hold each product.
OF_SEED, OF_REP, MIX_A, MIX_B = 0x9E3779B1, 0x85EBCA77, 0x21F0AAAD, 0x735A2D97
_LOW = 0xFFFFFFFF


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(MIX_A)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(MIX_B)
    return h ^ (h >> np.uint32(15))


def draw_numbers(seed: int, reps: np.ndarray, n: int, slots: tuple[int, int] | None = None) -> np.ndarray:
    """(rep, slot) unit numbers from 0 to n - 1: hash(seed, rep, slot) % n.  slots: some of them, from and below, instead of 1 to n."""
    base = _mix(((seed * OF_SEED + reps.astype(np.uint64) * np.uint64(OF_REP)) & np.uint64(_LOW)).astype(np.uint32))
    return _mix(base[:, None] ^ np.arange(*(slots or (1, n + 1)), dtype=np.uint32)[None, :]) % np.uint32(n)


def _rates(units: np.ndarray, estimand: str) -> np.ndarray:
    """Of (ref_a, ins_a, dist_a, ref_b, ins_b, dist_b): what is summed over drawn units."""
    if estimand == "micro":
        return units
    ref, ins, dist = units[:, [0, 3]], units[:, [1, 4]], units[:, [2, 5]]
    return np.where(ref == 0, ins, dist / np.where(ref == 0, 1, ref))


def _replicates(units: DataFrame, groups: list[str], parts: list[str], estimand: str, n_boot: int, seed: int) -> DataFrame | None:
    """(groups..., d): the difference in each replicate; None if there are too many units.

    The units' sums go to the tasks, each of which draws some replicates for all groups: groups of one size share their
    draws, whose counts times the sums are one matrix product.  No draw is ever a row."""
    spark = units.sparkSession
    few = units.select(*groups, "__unit", *parts).limit(MOST_UNITS + 1).toArrow().to_pandas()
    if len(few) > MOST_UNITS:
        return None
    few = few.assign(__null=few["__unit"].notna()).sort_values(["__null", "__unit"], kind="stable")
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    names = []
    for name, rows in few.groupby(groups, dropna=False, sort=True):
        by_size.setdefault(len(rows), []).append((len(names), _rates(rows[parts].to_numpy(dtype=float), estimand)))
        names.append(tuple(None if x is None or x != x else x for x in name))
    sums = spark.sparkContext.broadcast({n: ([i for i, _ in x], np.concatenate([y for _, y in x], axis=1)) for n, x in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps = b.column(0).to_numpy()
            for n, (ids, s) in sums.value.items():
                step = max(1, DRAWS // n)
                for k in range(0, len(reps), step):
                    some = reps[k : k + step]
                    at = draw_numbers(seed, some, n).astype(np.int64) + np.arange(len(some))[:, None] * n
                    drawn = np.bincount(at.ravel(), minlength=len(some) * n).reshape(len(some), n) @ s
                    drawn = drawn.reshape(len(some), len(ids), -1)
                    if estimand == "macro":
                        d = (drawn[:, :, 1] - drawn[:, :, 0]) / n
                    else:
                        side = lambda i, x=drawn: np.where(x[:, :, i] == 0, x[:, :, i + 1], x[:, :, i + 2] / np.where(x[:, :, i] == 0, 1, x[:, :, i]))
                        d = side(3) - side(0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(some)), pa.int32()), pa.array(d.ravel())], names=["__g", "d"])

    tasks = max(1, min(n_boot, spark.sparkContext.defaultParallelism))
    d = spark.range(1, n_boot + 1, numPartitions=tasks).mapInArrow(run, "__g int, d double")
    fields = [units.schema[g] for g in groups]
    table = spark.createDataFrame([(i, *name) for i, name in enumerate(names)], StructType([StructField("__g", IntegerType()), *fields]))
    return d.join(F.broadcast(table), "__g").drop("__g")


def _dealt_replicates(units: DataFrame, groups: list[str], parts: list[str], estimand: str, n_boot: int, seed: int) -> DataFrame:
    """_replicates() for any number of units: they are numbered by range, no task sorts them all, and dealt to tasks.

    A task has a block of the units of some groups of one size and some replicates. It makes all draws of these, and
    multiplies the counts of those that fall into its block by the units' sums; what it finds is added over the blocks."""
    placed = number_rows(units, [*groups, "__unit"], "__place")
    ends = placed.groupBy(*groups).agg(F.min("__place").alias("__from"), F.count("*").alias("n_units")).withColumnsRenamed({g: f"__{g}" for g in groups})
    n = F.col("n_units")
    together = F.least(F.greatest(F.floor(F.lit(BLOCK) / n), F.lit(1)), F.lit(BLOCK_GROUPS))
    ends = ends.withColumns({
        "__some": F.floor((F.row_number().over(Window.partitionBy("n_units").orderBy("__from")) - 1) / together),
        "__slices": F.least(F.ceil(n * n_boot / BLOCK_DRAWS), F.lit(n_boot)).cast("int"),
    })
    ends = cut_lineage(ends)  # a row a group, read three times
    tasks = ends.groupBy("n_units", "__some").agg(F.first(F.ceil(n / BLOCK) * F.col("__slices")).alias("t")).agg(F.sum("t")).first()[0]
    on = F.lit(True)
    for g in groups:
        on &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    placed = placed.join(F.broadcast(ends), on).withColumn("__at", F.col("__place") - F.col("__from"))
    placed = placed.withColumns({"__block": F.floor(F.col("__at") / BLOCK), "__slice": F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))})
    task = ["n_units", "__some", "__block", "__slice"]
    sums = [f"__s{i}" for i in range(2 if estimand == "macro" else 6)]

    def run(t: pa.Table) -> pa.Table:
        n, lo, first, slices = (t.column(c)[0].as_py() for c in ("n_units", "__block", "__slice", "__slices"))
        lo *= BLOCK
        width = min(BLOCK, n - lo)
        names, group = np.unique(t.column("__from").to_numpy(), return_inverse=True)
        s = np.zeros((width, len(names), len(sums)))
        s[t.column("__at").to_numpy() - lo, group] = _rates(np.stack([t.column(c).to_numpy() for c in parts], axis=1).astype(float), estimand)
        s = s.reshape(width, -1)
        reps, found = np.arange(1 + first, n_boot + 1, slices), []
        step, slots = max(1, DRAWS // max(n, width)), range(1, n + 1, DRAWS)
        for k in range(0, len(reps), step):
            some, times = reps[k : k + step], 0
            for slot in slots:
                at = draw_numbers(seed, some, n, (slot, min(slot + DRAWS, n + 1))).astype(np.int64) - lo
                rep = np.broadcast_to(np.arange(len(some))[:, None] * width, at.shape)
                inside = slice(None) if width == n else (at >= 0) & (at < width)
                times = times + np.bincount((at + rep)[inside].ravel(), minlength=len(some) * width)
            found.append((times.reshape(len(some), width) @ s).reshape(-1, len(sums)))
        found = np.concatenate(found)
        return pa.table([np.tile(names, len(reps)), np.repeat(reps, len(names)), *found.T], names=["__from", "rep", *sums])

    placed = placed.select(*task, "__slices", "__from", "__at", *parts).repartition(2 * tasks, *task)
    boot = placed.groupBy(*task).applyInArrow(run, "__from long, rep long, " + ", ".join(f"{c} double" for c in sums))
    boot = boot.groupBy("__from", "rep").agg(*[F.sum(c).alias(c) for c in sums]).join(F.broadcast(ends), "__from")
    if estimand == "macro":
        d = (F.col("__s1") - F.col("__s0")) / n
    else:
        side = lambda i: F.when(F.col(f"__s{i}") == 0, F.col(f"__s{i + 1}")).otherwise(F.col(f"__s{i + 2}") / F.col(f"__s{i}"))
        d = side(3) - side(0)
    return boot.select(*[F.col(f"__{g}").alias(g) for g in groups], d.alias("d"))


def _rate(side: str, estimand: str) -> Column:
    if estimand == "macro":
        return F.avg(error_rate(f"dist_{side}", f"ref_{side}", f"ins_{side}"))
    s = {c: F.sum(f"{c}_{side}") for c in ("ref", "ins", "dist")}
    return F.when(s["ref"] == 0, s["ins"].cast("double")).otherwise(s["dist"].cast("double") / s["ref"])


def _estimates(units: DataFrame, groups: list[str], estimand: str, n_boot: int, conf_level: float, seed: int) -> DataFrame:
    """units: groups..., unit, and ref, ins, dist of each side (_a, _b), one row a unit.  Adds the estimates and the
    percentile interval of a bootstrap over units, whose draws are the same for both sides.

    Draw `slot` of replicate `rep` is unit number hash(seed, rep, slot) % n_units, in the order of the units' names."""
    parts = [f"{c}_{s}" for s in "ab" for c in ("ref", "ins", "dist")]
    units = cut_lineage(units)  # read for the estimates and for the draws
    point = units.groupBy(*groups).agg(_rate("a", estimand).alias("estimate_a"), _rate("b", estimand).alias("estimate_b"), F.count("*").alias("n_units"))
    boot = _replicates(units, groups, parts, estimand, n_boot, seed)
    if boot is None:
        boot = _dealt_replicates(units, groups, parts, estimand, n_boot, seed)
    low = (1 - conf_level) / 2
    ends = boot.groupBy(*[F.col(g).alias(f"__{g}") for g in groups]).agg(F.percentile("d", F.array(F.lit(low), F.lit(1 - low))).alias("e"))
    on = F.lit(True)
    for g in groups:
        on &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    return point.join(ends, on, "left").select(
        *groups, "estimate_a", "estimate_b", (F.col("estimate_b") - F.col("estimate_a")).alias("difference_b_minus_a"),
        F.col("e")[0].alias("conf_low"), F.col("e")[1].alias("conf_high"), F.lit(conf_level).alias("conf_level"), "n_units", F.lit(n_boot).alias("n_boot"),
    )


def compare_systems(
    x: DataFrame, systems: tuple[str, str], unit: str = "document_id", pair_id: Sequence[str] = "line_id", system_col: str = "system",
    estimand: str = "macro", n_boot: int = 2000, conf_level: float = 0.95, seed: int = 1, validate: bool = True,
) -> DataFrame:
    """One row a metric: estimates of both systems, B minus A, and its percentile interval."""
    a, b = systems
    if a == b:
        raise ValueError("systems must be two different names")
    _check(n_boot, conf_level)
    choice("estimand", estimand, ("macro", "micro"))
    check_columns(x.columns, unit, *_keys(unit, pair_id), system_col, "metric", "n_reference", "insertions", "distance")
    if validate:
        _validate(x, a, b, unit, pair_id, system_col)
    own = lambda s, c: F.sum(F.when(F.col(system_col) == s, F.col(c)).otherwise(0)).cast("long")
    units = x.filter(F.col(system_col).isin(a, b)).groupBy("metric", F.col(unit).alias("__unit")).agg(
        *[own(s, c).alias(f"{k}_{side}") for side, s in (("a", a), ("b", b)) for k, c in (("ref", "n_reference"), ("ins", "insertions"), ("dist", "distance"))]
    )
    out = _estimates(units, ["metric"], estimand, n_boot, conf_level, seed)
    return out.select("metric", F.lit(a).alias("system_a"), F.lit(b).alias("system_b"), F.lit(estimand).alias("estimand"), *out.columns[1:])


def compare_all_pairs(
    x: DataFrame, unit: str = "document_id", pair_id: Sequence[str] = "line_id", system_col: str = "system", estimand: str = "macro",
    n_boot: int = 5000, conf_level: float = 0.95, seed: int = 2027, metric: str | None = None, unpaired: str = "raise",
) -> DataFrame:
    """compare_systems of every pair of systems in one plan, under the same conditions: no system has an observation twice,
    references agree, and all systems have the same observations; with unpaired="drop" each pair is compared over the
    observations that both have.  Nulls in the key and the unit are values."""
    _check(n_boot, conf_level)
    choice("estimand", estimand, ("macro", "micro"))
    keys = _keys(unit, pair_id)
    check_columns(x.columns, *keys, system_col, "metric", "n_reference", "insertions", "distance")
    rows = (x if metric is None else x.filter(F.col("metric") == metric)).filter(F.col(system_col).isNotNull())
    require_pairs(rows, ["metric"], system_col, keys, unpaired)
    cols = ["metric", *keys, F.col(system_col).alias("system"), F.col("n_reference").alias("ref"), F.col("insertions").alias("ins"), F.col("distance").alias("dist")]
    left, right = (rows.select(*cols).withColumnsRenamed({c: f"{c}_{s}" for c in ("system", "ref", "ins", "dist")}) for s in "ab")
    right = right.withColumnsRenamed({k: f"__{k}" for k in ("metric", *keys)})
    on = F.col("system_a") < F.col("system_b")
    for k in ("metric", *keys):
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    groups = ["metric", "system_a", "system_b"]
    units = left.join(right, on).groupBy(*groups, F.col(unit).alias("__unit")).agg(*[F.sum(f"{c}_{s}").cast("long").alias(f"{c}_{s}") for s in "ab" for c in ("ref", "ins", "dist")])
    out = _estimates(units, groups, estimand, n_boot, conf_level, seed)
    return out.select(*groups, F.lit(estimand).alias("estimand"), *out.columns[3:])
