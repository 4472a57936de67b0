"""Normalization and tokenization as column expressions; only the Unicode forms leave the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from collatio.policy import UNICODE, UNITS, EvalPolicy, choice


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _unicode_form(form: str):
    @F.arrow_udf("string")
    def to_form(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return to_form


def unicode_form(text: str | Column, form: str = "NFC") -> Column:
    choice("unicode", form, UNICODE)
    return _col(text) if form == "none" else _unicode_form(form)(_col(text))


def normalize_text(text: str | Column, unicode: str = "NFC", case: str = "preserve", whitespace: str = "preserve", punctuation: str = "preserve") -> Column:
    """Unicode form, case, punctuation and whitespace, in this order; null stays null."""
    p = EvalPolicy(unicode=unicode, case=case, whitespace=whitespace, punctuation=punctuation)
    out = unicode_form(text, p.unicode)
    if p.case != "preserve":
        out = F.lower(out) if p.case == "lower" else F.upper(out)
    if p.punctuation == "remove":
        out = F.regexp_replace(out, r"\p{P}", "")
    if p.whitespace == "collapse":
        out = F.regexp_replace(out, r"(?U)\s+", " ")
    if p.whitespace != "preserve":
        out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    return out


def tokenize(text: str | Column, unit: str = "grapheme") -> Column:
    """The graphemes, code points or words of a text as an array; an empty text has none."""
    t = _col(text)
    if choice("unit", unit, UNITS) == "word":
        return F.regexp_extract_all(t, F.lit(r"(?U)\S+"), F.lit(0))
    if unit == "codepoint":
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))
    return F.regexp_extract_all(t, F.lit(r"\X"), F.lit(0))


def normalize_and_tokenize(text: str | Column, policy: EvalPolicy | None = None, unit: str | None = None) -> Column:
    p = policy or EvalPolicy()
    return tokenize(normalize_text(text, p.unicode, p.case, p.whitespace, p.punctuation), unit or p.char_unit)


def collapse_tokens(tokens: str | Column, metric: str = "cer") -> Column:
    """The tokens that are not null, joined: by nothing for cer, by a space for wer."""
    return F.array_join(F.array_compact(_col(tokens)), " " if metric == "wer" else "")
