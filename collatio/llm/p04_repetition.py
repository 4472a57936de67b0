"""Repetition inside a single value.

Method: a rule bitmask ledger.  Every rule is evaluated once for each row; its failure bit and its measurement
are stored.  Versioned policies (masks) then decide without touching the texts again, and an ablation tells, by
bitwise aggregation, what each rule alone contributes.

Defined results: null or empty predictions fail no rule but NO_TEXT; texts are measured whole; repeated rows
are all listed; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.llm.chars import letters
from collatio.llm.kernels import share

# The rules, one bit each.
NO_TEXT, REPEATS, REFERENCE_REPEATS, WORD_RUN, LETTER_RUN, LINE_AGAIN, FLAGGED = (1 << i for i in range(7))
RULES = {"no_text": NO_TEXT, "repeats": REPEATS, "reference_repeats": REFERENCE_REPEATS, "word_run": WORD_RUN, "letter_run": LETTER_RUN, "line_again": LINE_AGAIN, "flagged": FLAGGED}

REPEATED, REPEATED_REFERENCE = 0.4, 0.25


class Policy(NamedTuple):
    """A row is a case if it fails any rule of fail and none of excuse."""

    name: str
    version: int
    fail: int
    excuse: int


POLICIES = (
    Policy("repetition", 1, REPEATS, NO_TEXT | REFERENCE_REPEATS),
    Policy("repetition_strict", 1, REPEATS | WORD_RUN | LETTER_RUN | LINE_AGAIN, NO_TEXT | REFERENCE_REPEATS),
    Policy("flag_only", 1, FLAGGED, NO_TEXT),
)


def _run(items: list[str]) -> int:
    best = run = 0
    before = None
    for x in items:
        run = run + 1 if x == before else 1
        best, before = max(best, run), x
    return best


def measure(prediction: str | None, reference: str | None) -> tuple[int, float, float | None, int]:
    """(bits, repeated share, repeated share of the reference, longest run of a word)."""
    s = letters(prediction) if prediction else ""
    if not s:
        return NO_TEXT, 0.0, None, 0
    rate = share(s)
    bits, of_reference, run = 0, None, _run(prediction.lower().split())
    if rate >= REPEATED:
        bits |= REPEATS
    if run >= 3:
        bits |= WORD_RUN
    if "\n" in prediction:
        lines = [x for x in map(letters, prediction.splitlines()) if x]
        if len(set(lines)) < len(lines):
            bits |= LINE_AGAIN
    if _run(list(s)) >= 8:
        bits |= LETTER_RUN
    if reference is not None:
        of_reference = share(letters(reference))
        if of_reference > REPEATED_REFERENCE:
            bits |= REFERENCE_REPEATS
    return bits, rate, of_reference, run


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(p, r) for p, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        bits, rate, ref, run = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(bits, pa.int32()), pa.array(rate, pa.float64()), pa.array(ref, pa.float64()), pa.array(run, pa.int32())],
            names=["key", "bits", "repeated_share", "reference_share", "longest_run"],
        )


def ledger(df: DataFrame, spans: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """(key, bits, repeated_share, reference_share, longest_run) of every row of df.

    With spans (input_row, possible_repetition), the export's claim is one more rule; the spans are reduced to
    one row a key before the join."""
    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), "prediction", "reference").mapInArrow(
        _batches, f"key {kind}, bits int, repeated_share double, reference_share double, longest_run int"
    ).withColumnRenamed("key", key)
    if spans is None:
        return out
    claims = spans.filter("possible_repetition").select(F.col("input_row").alias(key)).distinct().withColumn("__claim", F.lit(FLAGGED))
    return out.join(claims, key, "left").withColumn("bits", F.col("bits").bitwiseOR(F.coalesce("__claim", F.lit(0)))).drop("__claim")


def decide(rows: DataFrame, policy: Policy) -> DataFrame:
    """The rows of the ledger that are cases under the policy."""
    bits = F.col("bits")
    return rows.filter((bits.bitwiseAND(F.lit(policy.fail)) != 0) & (bits.bitwiseAND(F.lit(policy.excuse)) == 0))


def found(df: DataFrame, key: str = "row_id", policy: Policy = POLICIES[0]) -> DataFrame:
    return decide(ledger(df, key=key), policy).select(key)


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """One row per policy and rule: cases, cases that would go without the rule, rows that the rule alone excuses.

    The ledger is first reduced to one count for each bit pattern, so at most 2 ** rules rows are combined."""
    spark = rows.sparkSession
    counts = rows.groupBy("bits").agg(F.count("*").alias("n"))
    table = spark.createDataFrame(
        [(p.name, p.version, p.fail, p.excuse, rule, bit) for p in policies for rule, bit in RULES.items() if bit & (p.fail | p.excuse)],
        "policy string, version int, fail int, excuse int, rule string, rule_bit int",
    )
    failed, excused = F.col("bits").bitwiseAND(F.col("fail")), F.col("bits").bitwiseAND(F.col("excuse"))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (
        counts.join(F.broadcast(table), F.lit(True))
        .groupBy("policy", "version", "rule")
        .agg(
            n((failed != 0) & (excused == 0)).alias("n_cases"),
            n((failed == F.col("rule_bit")) & (excused == 0)).alias("n_by_rule_alone"),
            n((failed != 0) & (excused == F.col("rule_bit"))).alias("n_excused_by_rule_alone"),
        )
    )
