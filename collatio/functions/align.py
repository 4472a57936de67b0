"""Alignment as columns: Arrow batches in, structs out, one crossing for all metrics and policies of a row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from collatio.functions import kernel
from collatio.functions.text import _col
from collatio.policy import EvalPolicy

COUNTS = ("n_reference", "n_hypothesis", "equal", "substitutions", "deletions", "insertions", "distance")
COUNTS_TYPE = "struct<" + ",".join(f"{c}:int" for c in COUNTS) + ">"
SCRIPT_TYPE = "array<struct<reference:string,hypothesis:string,operation:string>>"
SPAN_FIELDS = (
    ("span_id", "int"), ("operation", "string"), ("operations", "string"), ("reference_span", "string"), ("prediction_span", "string"),
    ("reference_start", "int"), ("reference_end", "int"), ("prediction_start", "int"), ("prediction_end", "int"),
    ("substitutions", "int"), ("deletions", "int"), ("insertions", "int"), ("context_before", "string"), ("context_after", "string"),
    ("possible_repetition", "boolean"),
)
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_COUNTS_ARROW = pa.struct([(c, pa.int32()) for c in COUNTS])
_SCRIPT_ARROW = pa.list_(pa.struct([("reference", pa.string()), ("hypothesis", pa.string()), ("operation", pa.string())]))
_SPANS_ARROW = pa.list_(pa.struct([(n, _ARROW[t]) for n, t in SPAN_FIELDS]))


def _pairs(refs: list, hyps: list, policy: EvalPolicy, unit: str) -> tuple[list[int], list]:
    """(rows without a null text, their token lists); a text that comes again, as a line's reference does, is split once."""
    where = [i for i, (r, h) in enumerate(zip(refs, hyps, strict=True)) if r is not None and h is not None]
    known = {x: kernel.tokenize(kernel.normalize(x, policy), unit) for x in {x for i in where for x in (refs[i], hyps[i])}}
    return where, [(known[refs[i]], known[hyps[i]]) for i in where]


def _pairs_of(refs: list, hyps: list, ways: list[tuple[EvalPolicy, str]]) -> tuple[list[int], list]:
    """(rows without a null text, their token lists), each row read in its own way (policy, unit)."""
    where, pairs = [], []
    for i, (r, h, (policy, unit)) in enumerate(zip(refs, hyps, ways, strict=True)):
        if r is not None and h is not None:
            where.append(i)
            pairs.append((kernel.tokenize(kernel.normalize(r, policy), unit), kernel.tokenize(kernel.normalize(h, policy), unit)))
    return where, pairs


def _ways(settings: Sequence[pa.Array], n: int, policy: EvalPolicy, metric: str) -> list[tuple[EvalPolicy, str]]:
    """How each row is read: by its own settings where it has any (policy_* in the order of the policy's fields; null is
    the given policy's), else by the policy."""
    names, known = [f.name for f in fields(EvalPolicy)], {}

    def way(own: tuple) -> tuple[EvalPolicy, str]:
        if own not in known:
            p = replace(policy, **{k: v for k, v in zip(names, own, strict=True) if v is not None}) if own else policy
            known[own] = p.for_metric(metric), p.unit(metric)
        return known[own]

    return [way(own) for own in zip(*[s.to_pylist() for s in settings], strict=True)] if settings else [way(())] * n


def _lists(where: list[int], values: list[list[tuple]], n: int, kind: pa.ListType) -> pa.Array:
    """A list array of structs from lists of tuples, null where no row of where is; built column by column."""
    sizes = np.zeros(n, np.int32)
    sizes[where] = [len(v) for v in values]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    columns = list(zip(*(t for v in values for t in v), strict=True)) or [()] * kind.value_type.num_fields
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
    null = np.ones(n, bool)
    null[where] = False
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(null))


def cells(reference: str | Column, hypothesis: str | Column, wanted: Sequence[tuple[EvalPolicy, str]]) -> Column:
    """array<counts>: the counts under each (policy, unit), all in one pass; null where a text is null.

    Equal cells are aligned once: policies that differ in nothing that matters cost nothing, nor do equal pairs of a batch."""
    wanted = list(wanted)
    different = list(dict.fromkeys(wanted))

    @F.arrow_udf(f"array<{COUNTS_TYPE}>")
    def align(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        place: dict[tuple, int] = {}
        at = [place.setdefault(x, len(place)) for x in zip(refs.to_pylist(), hyps.to_pylist(), strict=True)]
        r, h = [x for x, _ in place], [x for _, x in place]
        found, where = {}, []
        for policy, unit in different:
            where, pairs = _pairs(r, h, policy, unit)
            found[policy, unit] = kernel.counts(pairs)
        return _lists(where, list(zip(*[found[w] for w in wanted], strict=True)), len(r), pa.list_(_COUNTS_ARROW)).take(pa.array(at, pa.int32()))

    return align(_col(reference), _col(hypothesis))


def edit_counts(reference: str | Column, hypothesis: str | Column, policy: EvalPolicy | None = None, unit: str | None = None) -> Column:
    """struct of n_reference, n_hypothesis, equal, substitutions, deletions, insertions, distance."""
    p = policy or EvalPolicy()
    return cells(reference, hypothesis, [(p, unit or p.char_unit)])[0]


def align_text(
    reference: str | Column, hypothesis: str | Column, policy: EvalPolicy | None = None, unit: str | None = None, settings: Sequence[str | Column] = (), metric: str | None = None
) -> Column:
    """The edit script as an array of (reference, hypothesis, operation); a gap is null.  Ties prefer the diagonal,
    then a deletion, then an insertion, read from the end.

    settings: columns with the policy of each row, for rows of several policies."""
    p, m = policy or EvalPolicy(), metric or ("wer" if unit == "word" else "cer")
    base = replace(p, char_unit=unit) if unit and unit != "word" else p

    @F.arrow_udf(SCRIPT_TYPE)
    def align(refs: pa.Array, hyps: pa.Array, *own: pa.Array) -> pa.Array:
        where, pairs = _pairs_of(refs.to_pylist(), hyps.to_pylist(), _ways(own, len(refs), base, m))
        return _lists(where, kernel.scripts(pairs), len(refs), _SCRIPT_ARROW)

    return align(_col(reference), _col(hypothesis), *map(_col, settings))


def error_spans(reference: str | Column, hypothesis: str | Column, policy: EvalPolicy, metric: str, context: int, settings: Sequence[str | Column] = ()) -> Column:
    """The maximal runs of differences as an array of structs."""

    @F.arrow_udf("array<struct<" + ",".join(f"{n}:{t}" for n, t in SPAN_FIELDS) + ">>")
    def align(refs: pa.Array, hyps: pa.Array, *own: pa.Array) -> pa.Array:
        where, pairs = _pairs_of(refs.to_pylist(), hyps.to_pylist(), _ways(own, len(refs), policy, metric))
        rows = [kernel.spans(x, metric == "wer", context) for x in kernel.scripts(pairs)]
        return _lists(where, rows, len(refs), _SPANS_ARROW)

    return align(_col(reference), _col(hypothesis), *map(_col, settings))


def error_rate(distance: str | Column, n_reference: str | Column, insertions: str | Column) -> Column:
    """Distance by reference length; without a reference the insertions themselves (0 if there are none)."""
    return F.when(_col(n_reference) == 0, _col(insertions).cast("double")).otherwise(_col(distance).cast("double") / _col(n_reference))


def cer(reference: str | Column, hypothesis: str | Column, policy: EvalPolicy | None = None) -> Column:
    p = policy or EvalPolicy()
    c = edit_counts(reference, hypothesis, p, p.char_unit)
    return error_rate(c["distance"], c["n_reference"], c["insertions"])


def wer(reference: str | Column, hypothesis: str | Column, policy: EvalPolicy | None = None) -> Column:
    c = edit_counts(reference, hypothesis, (policy or EvalPolicy()).for_metric("wer"), "word")
    return error_rate(c["distance"], c["n_reference"], c["insertions"])


def output_distance(a: str | Column, b: str | Column) -> Column:
    """Distance of two outputs by the longer one's graphemes; 0 if both are empty."""
    c = edit_counts(a, b)
    longer = F.greatest(c["n_reference"], c["n_hypothesis"])
    return F.when(longer == 0, 0.0).otherwise(c["distance"] / longer)
