"""Character knowledge shared by the text operators.

Everything here is derived from the Unicode database that ships with Python, apart from
the look-alike pairs, which are stated as fixed values.  Nothing depends on the data.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Look-alike letters, "foreign plain" pairs, one alphabet a line.
GREEK_LOOKALIKES = (
    "Αa Βb Εe Ζz Ηh Ιi Κk Μm Νn Οo Ρp Τt Υy Χx"  # capitals; the case is restored below
)
GREEK_SMALL_LOOKALIKES = "αa γy ειe ιi κk νv οo ρp σo τt υu χx ωw ϲc ϳj ηn"
CYRILLIC_LOOKALIKES = (
    "аa вb сc ԁd еe ёe һh іi їi јj кk ӏl мm нh оo рp ԛq гr ѕs тt уy ѵv ԝw хx ьb пn ѡw ꙅs ꚍt"
)
PHONETIC_LOOKALIKES = (
    "ɑa ɐa ɓb ʙb ɕc ɖd ɗd ɘe ɡg ɠg ɢg ɦh ɧh ʜh ɨi ɩi ɪi ʝj ɟj ɫl ɭl ʟl ɱm ɲn ɳn ɴn ɵo ɼr ɽr ɾr ʀr ʂs ʈt ʉu ʊu ʋv ʏy ʐz ʑz"
    " ᴀa ʙb ᴄc ᴅd ᴇe ᴊj ᴋk ᴍm ᴏo ᴘp ᴛt ᴜu ᴠv ᴡw ᴢz"
)

#: Marks of an edition, which stand inside words without dividing them.
EDITION_MARKS = "⟦⟧⟨⟩⸢⸣"

#: Characters with no visible form.
INVISIBLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xE0000, 0xE007F), (0xE0100, 0xE01EF),
)
#: Spaces that are not U+0020; tabs and line breaks are left alone.
SPACES = tuple(map(chr, (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def _pairs(*lines: str) -> dict[str, str]:
    """{foreign: plain} of "xy" tokens, in both cases where both exist as one character."""
    out: dict[str, str] = {}
    for token in " ".join(lines).split():
        foreign, plain = token[0], token[-1]
        for a, b in ((foreign.lower(), plain), (foreign.upper(), plain.upper())):
            if len(a) == 1:
                out.setdefault(a, b)
    return out


@lru_cache(1)
def lookalikes() -> dict[str, dict[str, str]]:
    """Per alphabet {foreign: latin}.  A capital Greek letter looks like another Latin one than its small form
    does (Η is H, η is n), so capitals have a line of their own."""
    capitals = {k.upper(): v.upper() for k, v in (p for p in ((t[0], t[-1]) for t in GREEK_LOOKALIKES.split()))}
    small = {t[0]: t[-1] for t in GREEK_SMALL_LOOKALIKES.split()}
    greek = {**small, **capitals}
    accents = {"ά": "á", "έ": "é", "ί": "í", "ό": "ó", "ύ": "ú", "ϊ": "ï", "ϋ": "ü"}
    return {"greek": {**accents, **greek}, "cyrillic": _pairs(CYRILLIC_LOOKALIKES), "phonetic": {t[0]: t[-1] for t in PHONETIC_LOOKALIKES.split()}}


_INVISIBLE = frozenset(chr(c) for a, b in INVISIBLE_RANGES for c in range(a, b + 1))


def invisible(ch: str) -> bool:
    return ch in _INVISIBLE


def script(ch: str) -> str:
    """latin, greek, cyrillic or "" (no letter, or a letter of no interest)."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "")
    for s in ("LATIN", "GREEK", "CYRILLIC"):
        if name.startswith(s):
            return s.lower()
    return ""


def plain_form(ch: str) -> str:
    """The plain form of a wide, mathematical, ligature or numeral-sign character, an odd space, an invisible
    or a phonetic character; any other character is its own plain form."""
    if invisible(ch):
        return ""
    if ch in SPACES:
        return " "
    if ch in lookalikes()["phonetic"]:
        return lookalikes()["phonetic"][ch]
    tag = unicodedata.decomposition(ch).split(" ")[0]
    cp = ord(ch)
    if tag in ("<wide>", "<narrow>", "<font>"):
        return unicodedata.normalize("NFKC", ch)
    if cp == 0xFB05:  # long s with t: the long s is a sign of the source
        return "ſt"
    if 0xFB00 <= cp <= 0xFB17 or 0x2160 <= cp <= 0x217F or 0x2460 <= cp <= 0x249B or 0x24EA == cp:
        return unicodedata.normalize("NFKC", ch)
    return ch


def _ranges(chars: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in chars:
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def java_class(ranges: list[tuple[int, int]]) -> str:
    """The inside of a Java character class for these code points."""
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges)


@lru_cache(1)
def composing_marks() -> frozenset[str]:
    """Characters that can be the second half of a canonical composition."""
    out = set()
    for cp in range(0xC0, 0x12000):
        d = unicodedata.decomposition(chr(cp))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            out.add(chr(int(d.split()[1], 16)))
    return frozenset(out)


@lru_cache(1)
def safe_classes() -> list[str]:
    """Java classes, a block each from the commonest on, of the characters that need no work by themselves.

    A quick check in the manner of Unicode's own: whatever is outside goes the whole way, so the list only
    saves time.  The last one is of marks, of which only one may stand at a time: several may be out of order."""
    safe: list[list[int]] = [[], [], [], [], []]
    for cp in range(0, 0xD800):
        ch = chr(cp)
        if plain_form(ch) == ch and unicodedata.normalize("NFC", ch) == ch and ch not in composing_marks():
            safe[4 if unicodedata.category(ch)[0] == "M" else 0 if cp < 0x250 else 1 if 0x370 <= cp < 0x530 else 2 if 0x2000 <= cp < 0x2800 or 0xA640 <= cp < 0xA800 else 3].append(cp)
    *letters_, marks = [f"[{java_class(_ranges(x))}]" for x in safe]
    return [*letters_, marks + "(?!\\p{M})"]


@lru_cache(1)
def script_classes() -> dict[str, str]:
    """Insides of Java classes: the letters of each alphabet."""
    out: dict[str, list[int]] = {"latin": [], "greek": [], "cyrillic": []}
    for cp in range(0x41, 0x10000):
        if s := script(chr(cp)):
            out[s].append(cp)
    return {k: java_class(_ranges(v)) for k, v in out.items()}


@lru_cache(1)
def char_table() -> list[tuple[str, str, str | None, str | None, str | None]]:
    """(ch, plain, to_latin, to_greek, to_cyrillic), each target decomposed (NFD), for every character whose
    plain decomposed form differs or that has a look-alike.  Its size is fixed by Unicode (about 20,000
    entries, most of them Hangul-free CJK compatibility and composed letters)."""
    nfd = lambda s: unicodedata.normalize("NFD", s)
    look = lookalikes()
    to_latin = {**look["greek"], **look["cyrillic"]}
    back = {s: {v: k for k, v in reversed(look[s].items())} for s in ("greek", "cyrillic")}
    across = {"greek": {}, "cyrillic": {}}
    for s, other in (("greek", "cyrillic"), ("cyrillic", "greek")):
        for ch, lat in look[other].items():
            if lat in back[s]:
                across[s][ch] = back[s][lat]
    rows = []
    for cp in (*range(0x41, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        plain = nfd(plain_form(ch))
        targets = (to_latin.get(ch), back["greek"].get(ch) or across["greek"].get(ch), back["cyrillic"].get(ch) or across["cyrillic"].get(ch))
        if plain != ch or any(targets):
            rows.append((ch, plain, *(t and nfd(t) for t in targets)))
    return rows


@lru_cache(1)
def mark_classes() -> list[tuple[str, int]]:
    """(mark, canonical combining class) of every character whose class is not 0."""
    return [(chr(cp), c) for cp in range(0x300, 0x20000) if (c := unicodedata.combining(chr(cp)))]


@lru_cache(1)
def compositions() -> dict[str, str]:
    """{first + second: composed} of every primary canonical composition, Hangul left out."""
    out = {}
    for cp in range(0xC0, 0x12000):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            out["".join(chr(int(x, 16)) for x in d.split())] = ch
    return out


@lru_cache(1)
def _skeleton() -> dict[int, str]:
    out = {}
    for name, pairs in lookalikes().items():
        for a, b in pairs.items():
            out[ord(a)] = b
    out[ord("ς")] = "o"
    out.update(str.maketrans({"ꝛ": "r", "Ꝛ": "r", "Ϲ": "c"}))
    return out


_NO_LETTER = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """The letters and digits of a text, in lower case and in one form: what is left when case, spaces, punctuation,
    marks that stand alone and the form of the characters don't count.  Look-alike letters of all alphabets
    become the Latin ones, on either side of a comparison."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_skeleton())
    return _NO_LETTER.sub("", text.lower())
