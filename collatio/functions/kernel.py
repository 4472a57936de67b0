"""Alignment of token lists, for many pairs at a time: pure NumPy, no Spark.

Unit-cost edit distance with a fixed preference where costs tie: the diagonal, then a deletion, then an
insertion, as read back from the end.  One pass over the rows of the matrix serves a whole block of pairs of
similar length, so the interpreter is left out of the inner loops."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import regex

from collatio.policy import EvalPolicy

_GRAPHEMES = regex.compile(r"\X").findall
# letters, digits and signs that never join a neighbour: each is a grapheme of its own
_SIMPLE = re.compile(r"[\x20-\x7e\xa0-\xac\xae-\u02ff\u0370-\u0482\u048a-\u052f\u1e00-\u1fff\u2010-\u2027\u2030-\u205e\u2100-\u218b\u27e6-\u27eb\ua640-\ua66e\ua720-\ua7ff]*").fullmatch
_PUNCTUATION = regex.compile(r"\p{P}+")
_SPACE = regex.compile(r"\p{White_Space}+")
_WORDS = regex.compile(r"[^\p{White_Space}]+").findall

#: Cells of one matrix that is kept whole; of a larger one only some rows are kept and the rest computed again.
MOST_CELLS = 40_000_000
#: Cells that one block of pairs may have.
BLOCK_CELLS = 1_500_000
EQUAL, SUBSTITUTION, DELETION, INSERTION = "equal", "substitution", "deletion", "insertion"


def normalize(text: str, policy: EvalPolicy) -> str:
    if policy.unicode != "none" and not text.isascii():
        text = unicodedata.normalize(policy.unicode, text)
    if policy.case != "preserve":
        text = text.lower() if policy.case == "lower" else text.upper()
    if policy.punctuation == "remove":
        text = _PUNCTUATION.sub("", text)
    if policy.whitespace == "collapse":
        text = _SPACE.sub(" ", text).strip(" ")
    elif policy.whitespace == "trim":
        a, b = 0, len(text)
        while a < b and _SPACE.match(text[a]):
            a += 1
        while a < b and _SPACE.match(text[b - 1]):
            b -= 1
        text = text[a:b]
    return text


def tokenize(text: str, unit: str) -> list[str]:
    if unit == "word":
        return _WORDS(text)
    if unit == "codepoint" or _SIMPLE(text):
        return list(text)
    return _GRAPHEMES(text)


def _codes(pairs: Sequence[tuple[list[str], list[str]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    ids: dict[str, int] = {}
    code = lambda tokens: np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.int32, len(tokens))
    return [(code(a), code(b)) for a, b in pairs]


def _blocks(sizes: list[tuple[int, int]], paths: bool) -> list[list[int]]:
    """Indices of pairs in blocks of similar size."""
    out: list[list[int]] = []
    rows = width = 0
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i][1], sizes[i][0])):
        n, m = sizes[i]
        r, w = max(rows, n), max(width, m)
        cells = (len(out[-1]) + 1 if out else 1) * (w + 1) * ((r + 1) if paths else 24)
        if not out or cells > BLOCK_CELLS or w > 2 * sizes[out[-1][0]][1] + 16:
            out.append([i])
            rows, width = n, m
        else:
            out[-1].append(i)
            rows, width = r, w
    return out


def _pad(arrays: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(arrays), max(map(len, arrays), default=0)), fill, np.int32)
    for k, a in enumerate(arrays):
        out[k, : len(a)] = a
    return out


def _run(refs: list[np.ndarray], hyps: list[np.ndarray], paths: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(counts, ops).  counts: (pair, S D I).  ops: (pair, i, j) with 0 diagonal, 1 deletion, 2 insertion."""
    ref, hyp = _pad(refs, -1), _pad(hyps, -2)
    b, n, m = len(refs), ref.shape[1], hyp.shape[1]
    sizes_n, sizes_m = np.array([len(x) for x in refs]), np.array([len(x) for x in hyps])
    column = np.arange(m + 1, dtype=np.int32)
    s1, d1 = np.int64(1) << 42, np.int64(1) << 21
    dist = np.broadcast_to(column, (b, m + 1)).copy()
    count = np.broadcast_to(column.astype(np.int64), (b, m + 1)).copy()
    ops = np.empty((b, n + 1, m + 1), np.int8) if paths else None
    if paths:
        ops[:, 0, :] = 2
    final = np.zeros(b, np.int64)
    done = sizes_n == 0
    final[done] = count[done, sizes_m[done]]
    for i in range(1, n + 1):
        cost = (ref[:, i - 1 : i] != hyp).astype(np.int32)
        diagonal, up = dist[:, :-1] + cost, dist[:, 1:] + 1
        by_diagonal = diagonal <= up
        best = np.empty((b, m + 1), np.int32)
        best[:, 0] = i
        np.minimum(diagonal, up, out=best[:, 1:])
        dist = np.minimum.accumulate(best - column, axis=1) + column
        inserted = dist < best
        base = np.empty((b, m + 1), np.int64)
        base[:, 0] = i * d1
        base[:, 1:] = np.where(by_diagonal, count[:, :-1] + cost * s1, count[:, 1:] + d1)
        source = np.maximum.accumulate(np.where(inserted, 0, column), axis=1)
        count = np.take_along_axis(base, source, axis=1) + (column - source)
        if paths:
            ops[:, i, 0] = 1
            ops[:, i, 1:] = np.where(inserted[:, 1:], 2, np.where(by_diagonal, 0, 1))
        done = sizes_n == i
        if done.any():
            final[done] = count[done, sizes_m[done]]
    mask = (1 << 21) - 1
    return np.stack([final >> 42, (final >> 21) & mask, final & mask], axis=1), ops


def _row(before: np.ndarray, token: int, hyp: np.ndarray, i: int, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ops) of row i of one pair's matrix, from the row before."""
    diagonal, up = before[:-1] + (hyp != token), before[1:] + 1
    best = np.empty(len(hyp) + 1, np.int64)
    best[0] = i
    np.minimum(diagonal, up, out=best[1:])
    dist = np.minimum.accumulate(best - column) + column
    ops = np.ones(len(hyp) + 1, np.int8)
    ops[1:] = np.where(dist[1:] < best[1:], 2, np.where(diagonal <= up, 0, 1))
    return dist, ops


def _long_path(ref: np.ndarray, hyp: np.ndarray) -> list[int]:
    """The ops of one pair from the end, in memory of about sqrt(n) rows.

    Every so many rows one is kept; from the last on, the rows between two of them are computed again with their ops, only
    as far to the right as the path still is."""
    n, m = len(ref), len(hyp)
    step = max(1, int(n**0.5))
    column = np.arange(m + 1, dtype=np.int64)
    kept, row = [column], column
    for i in range(1, n + 1):
        row, _ = _row(row, ref[i - 1], hyp, i, column)
        if i % step == 0:
            kept.append(row)
    out: list[int] = []
    i, j = n, m
    while i:
        first = (i - 1) // step * step
        row, block = kept[first // step][: j + 1], []
        for k in range(first + 1, i + 1):
            row, ops = _row(row, ref[k - 1], hyp[:j], k, column[: j + 1])
            block.append(ops)
        while i > first:
            op = int(block[i - first - 1][j])
            out.append(op)
            i, j = i - (op != 2), j - (op != 1)
    return out + [2] * j


def counts(pairs: Sequence[tuple[list[str], list[str]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(n_reference, n_hypothesis, equal, substitutions, deletions, insertions, distance) of each pair.

    Common ends don't change the counts, so only what lies between them is aligned."""
    out: list = [None] * len(pairs)
    rest, where = [], []
    for i, (a, b) in enumerate(pairs):
        n, m = len(a), len(b)
        if a == b:
            out[i] = (n, m, n, 0, 0, 0, 0)
            continue
        x, y = 0, min(n, m)
        while x < y and a[x] == b[x]:
            x += 1
        z = 0
        while z < y - x and a[n - 1 - z] == b[m - 1 - z]:
            z += 1
        rest.append((a[x : n - z], b[x : m - z]))
        where.append((i, n, m))
    coded = _codes(rest)
    for block in _blocks([(len(a), len(b)) for a, b in coded], paths=False):
        found, _ = _run([coded[k][0] for k in block], [coded[k][1] for k in block], paths=False)
        for k, (s, d, ins) in zip(block, found.tolist(), strict=True):
            i, n, m = where[k]
            out[i] = (n, m, n - s - d, s, d, ins, s + d + ins)
    return out


def scripts(pairs: Sequence[tuple[list[str], list[str]]]) -> list[list[tuple[str | None, str | None, str]]]:
    """The edit script of each pair: (reference token or None, hypothesis token or None, operation).

    Only a common end may be left out of the matrix: the path is read from there."""
    out: list = [None] * len(pairs)
    rest, where = [], []
    for i, (a, b) in enumerate(pairs):
        n, m = len(a), len(b)
        z = 0
        while z < min(n, m) and a[n - 1 - z] == b[m - 1 - z]:
            z += 1
        rest.append((a[: n - z], b[: m - z]))
        where.append((i, [(t, t, EQUAL) for t in a[n - z :]]))
    coded = _codes(rest)
    short = [k for k, (a, b) in enumerate(coded) if len(a) * len(b) <= MOST_CELLS]
    paths = {k: _long_path(a, b) for k, (a, b) in enumerate(coded) if len(a) * len(b) > MOST_CELLS}
    for chosen in [*_blocks([(len(coded[k][0]), len(coded[k][1])) for k in short], paths=True), None]:
        block = list(paths) if chosen is None else [short[x] for x in chosen]
        ops = None if chosen is None else _run([coded[k][0] for k in block], [coded[k][1] for k in block], paths=True)[1]
        for row, k in enumerate(block):
            a, b = rest[k]
            i, j, script = len(a), len(b), []
            known = iter(paths.get(k, ()))
            while i or j:
                op = ops[row, i, j] if ops is not None else next(known)
                if op == 0:
                    i, j = i - 1, j - 1
                    script.append((a[i], b[j], EQUAL if a[i] == b[j] else SUBSTITUTION))
                elif op == 1:
                    i -= 1
                    script.append((a[i], None, DELETION))
                else:
                    j -= 1
                    script.append((None, b[j], INSERTION))
            script.reverse()
            out[where[k][0]] = script + where[k][1]
    return out


def spans(script: list[tuple[str | None, str | None, str]], word: bool, context: int) -> list[tuple]:
    """Maximal runs of differences of an edit script, one tuple a run: span_id, operation, operations,
    reference_span, prediction_span, the four positions, three counts, both contexts, possible_repetition."""
    join = " ".join if word else "".join
    out: list[tuple] = []
    ref_at = hyp_at = k = 0
    hyp = [h for _, h, _ in script if h is not None]
    while k < len(script):
        if script[k][2] == EQUAL:
            ref_at, hyp_at, k = ref_at + 1, hyp_at + 1, k + 1
            continue
        end = k
        while end < len(script) and script[end][2] != EQUAL:
            end += 1
        run = script[k:end]
        names = [op for *_, op in run]
        r = [x for x, *_ in run if x is not None]
        h = [x for _, x, _ in run if x is not None]
        side = lambda rows: join([a if a is not None else b for a, b, _ in rows])
        again = False
        if all(op == INSERTION for op in names):
            size = len(h)
            again = hyp[max(0, hyp_at - size) : hyp_at] == h or hyp[hyp_at + size : hyp_at + 2 * size] == h
        out.append((
            len(out) + 1, names[0] if len(set(names)) == 1 else "mixed", "+".join(names), join(r), join(h),
            ref_at + 1 if r else None, ref_at + len(r) if r else None, hyp_at + 1 if h else None, hyp_at + len(h) if h else None,
            names.count(SUBSTITUTION), names.count(DELETION), names.count(INSERTION),
            side(script[max(0, k - context) : k]), side(script[end : end + context]), again,
        ))
        ref_at, hyp_at, k = ref_at + len(r), hyp_at + len(h), end
    return out
