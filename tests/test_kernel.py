import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from collatio.functions import align, kernel
from collatio.policy import EvalPolicy


def brute(a, b):
    n, m = len(a), len(b)
    d = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    out = []
    i, j = n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j], "equal" if a[i] == b[j] else "substitution"))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append((a[i], None, "deletion"))
        else:
            j -= 1
            out.append((None, b[j], "insertion"))
    return out[::-1]


words = st.lists(st.sampled_from("abc"), max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), max_size=12))
def test_scripts_and_counts_equal_brute_force(pairs):
    for (a, b), script, c in zip(pairs, kernel.scripts(pairs), kernel.counts(pairs), strict=True):
        want = brute(a, b)
        assert script == want
        ops = [o for *_, o in want]
        assert c == (len(a), len(b), ops.count("equal"), ops.count("substitution"), ops.count("deletion"), ops.count("insertion"), len(ops) - ops.count("equal"))
        assert c[0] == c[2] + c[3] + c[4] and c[1] == c[2] + c[3] + c[5] and abs(c[0] - c[1]) <= c[6] <= max(c[0], c[1])


def test_long_and_mixed_sizes():
    rng = random.Random(4)
    pairs = [([rng.choice("abcd") for _ in range(n)], [rng.choice("abcd") for _ in range(m)]) for n, m in ((0, 0), (0, 7), (300, 0), (300, 280), (5, 300), (1, 1))]
    assert [c[6] for c in kernel.counts(pairs)] == [sum(o != "equal" for *_, o in s) for s in kernel.scripts(pairs)]


@pytest.mark.parametrize("limit", [0, 10, 200])
def test_pairs_beyond_the_limit_have_the_same_path(monkeypatch, limit):
    rng = random.Random(8)
    pairs = [([rng.choice("abc") for _ in range(n)], [rng.choice("abc") for _ in range(m)]) for n, m in ((0, 0), (0, 7), (9, 0), (1, 1), (30, 28), (5, 60), (61, 4), (37, 40), (16, 16))]
    want = [brute(a, b) for a, b in pairs]
    monkeypatch.setattr(kernel, "MOST_CELLS", limit)
    assert kernel.scripts(pairs) == want
    assert [c[6] for c in kernel.counts(pairs)] == [sum(o != "equal" for *_, o in s) for s in want]


def test_a_very_long_pair():
    rng = random.Random(9)
    a = [rng.choice("abcdefgh") for _ in range(9000)]
    b = a[:4000] + ["x"] * 3 + a[4005:]
    script = kernel.scripts([(a, b)])[0]  # 81 million cells
    assert [x for x, _, _ in script if x is not None] == a and [y for _, y, _ in script if y is not None] == b
    assert sum(o != "equal" for *_, o in script) == kernel.counts([(a, b)])[0][6] == 5


@pytest.mark.parametrize(
    ("text", "policy", "want"),
    [
        ("  Hello,   WORLD!  ", {"case": "lower", "whitespace": "collapse", "punctuation": "remove"}, "hello world"),
        (" a b　", {"whitespace": "trim"}, "a b"), ("é", {}, "é"), ("é", {"unicode": "NFD"}, "é"),
        ("ﬁ", {"unicode": "NFKC"}, "fi"), ("ﬁ", {}, "ﬁ"), ("a$+", {"punctuation": "remove"}, "a$+"), ("straße", {"case": "upper"}, "STRASSE"), ("", {"whitespace": "collapse"}, ""),
    ],
)
def test_normalize(text, policy, want):
    assert kernel.normalize(text, EvalPolicy.of(policy)) == want


def test_tokenize():
    assert kernel.tokenize("é\U0001f468‍\U0001f469", "grapheme") == ["é", "\U0001f468‍\U0001f469"]
    assert kernel.tokenize("a\r\nb", "grapheme") == ["a", "\r\n", "b"]
    assert kernel.tokenize("a b  c", "word") == ["a", "b", "c"]
    assert kernel.tokenize("", "codepoint") == []


def test_simple_graphemes_are_graphemes():
    rng = random.Random(6)
    signs = [chr(c) for c in range(0x20, 0xD800) if kernel._SIMPLE(chr(c))]
    assert len(signs) > 1500 and {"⁊", "ꝛ", "é", "ж", "ῶ", "⟦"} <= set(signs)
    for _ in range(300):
        text = "".join(rng.choices(signs, k=40))
        assert kernel._GRAPHEMES(text) == list(text)


def test_spans():
    s = kernel.spans(kernel.scripts([(list("abcdef"), list("abXYef"))])[0], False, 2)
    assert len(s) == 1 and s[0][1:5] == ("substitution", "substitution+substitution", "cd", "XY") and s[0][5:9] == (3, 4, 3, 4) and s[0][12:] == ("ab", "ef", False)
    again = kernel.spans(kernel.scripts([(list("abc"), list("abbc"))])[0], False, 5)
    assert again[0][-1] is True and again[0][5:7] == (None, None)
    assert kernel.spans(kernel.scripts([(list("abc"), list("abc"))])[0], False, 5) == []
    mixed = kernel.spans(kernel.scripts([("one two three".split(), "one 2".split())])[0], True, 1)
    assert mixed[0][1] == "mixed" and mixed[0][3] == "two three"


def test_policy_rejects_unknown_values():
    for bad in ({"unicode": "NFX"}, {"case": "title"}, {"whitespace": "x"}, {"punctuation": "x"}, {"char_unit": "word"}, {"colour": "red"}):
        with pytest.raises(ValueError):
            EvalPolicy.of(bad)


def test_a_text_is_split_once(monkeypatch):
    seen = []
    split = kernel.tokenize
    monkeypatch.setattr(kernel, "tokenize", lambda text, unit: seen.append(text) or split(text, unit))
    where, pairs = align._pairs(["ab", "ab", None, "ab"], ["ab", "xb", "ab", None], EvalPolicy(), "grapheme")
    assert where == [0, 1] and pairs == [(["a", "b"], ["a", "b"]), (["a", "b"], ["x", "b"])] and sorted(seen) == ["ab", "xb"]


def test_equal_pairs_of_a_batch(spark):
    data = [(i, [None, "abc", ""][i % 3], ["abd", None, "abd", "x"][i % 4]) for i in range(24)]
    got = spark.createDataFrame(data, "i int, a string, b string").coalesce(1).select("i", "a", "b", align.edit_counts("a", "b", EvalPolicy()).alias("c")).collect()
    want = {("abc", "abd"): (3, 3, 2, 1, 0, 0, 1), ("abc", "x"): (3, 1, 0, 1, 2, 0, 3), ("", "abd"): (0, 3, 0, 0, 0, 3, 3), ("", "x"): (0, 1, 0, 0, 0, 1, 1)}
    assert len(got) == 24 and all((r.c and tuple(r.c)) == want.get((r.a, r.b)) for r in got)
