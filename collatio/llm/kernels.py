"""Per-value kernels without Spark: bit-parallel prefix alignment, repetition, structural completeness.

All of them take whole texts; their cost is stated with each."""

from __future__ import annotations


def prefix_distances(pattern: str, text: str) -> list[int]:
    """Edit distances of the whole pattern to every prefix of the text, the empty one first.

    Bit-parallel: one step of a few big-integer operations for each letter of the text, so
    O(len(text) * len(pattern) / 64) for any length."""
    m = len(pattern)
    if not m:
        return list(range(len(text) + 1))
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        at[ch] = at.get(ch, 0) | 1 << i
    up, down, score = full, 0, m
    out = [m]
    for ch in text:
        eq = at.get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        out.append(score)
    return out


def covered(s: str, k: int = 6, bridge: int = 3, drift: int = 2) -> int:
    """How many letters of s lie in a stretch of k or more that already stood earlier in s.

    Every position whose k-gram stood earlier is a seed and covers k letters.  Two covered stretches with the
    same source but for a shift of at most drift letters are one longer copy with a few different letters: the
    gap between them is covered if it has at most bridge letters.  Cost O(len(s)) for the seeds."""
    n = len(s)
    if n <= k:
        return 0
    grams = [s[i : i + k] for i in range(n - k + 1)]
    if len(set(grams)) == len(grams):
        return 0
    first: dict[str, int] = {}
    total = start = end = 0  # the open stretch
    shift = 0  # how far behind its source lies
    near = sorted(range(-drift, drift + 1), key=abs)
    for i, g in enumerate(grams):
        if first.setdefault(g, i) == i:
            continue
        if total or end:
            # where the source would be if the copy went on
            same = next((d for d in near if 0 <= i - shift + d < i and grams[i - shift + d] == g), None)
            if i <= end or (i <= end + bridge and same is not None):
                end = i + k
                shift = shift - same if same is not None else i - first[g]
                continue
        total += end - start
        start, end, shift = i, i + k, i - first[g]
    return total + end - start


def share(s: str, k: int = 6) -> float:
    """Covered letters by all letters; 0 without letters."""
    return covered(s, k) / len(s) if s else 0.0
