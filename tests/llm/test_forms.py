import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from collatio.llm import chars, p02_forms

CASES = {
    "ｂｒａｕｌｒｅｔ １３１２，": "braulret 1312,", "𝐈𝐭𝐞𝐦 𝖼𝗁é": "Item ché", "ﬁr ﬆa": "fir sta", "foⅰⅴⅰet": "foiviet", "é ñ": "é ñ", "a​b­c": "abc",
    "a b　c": "a b c", "Ιncipiτ": "Incipit", "ѕunt rimsсаe": "sunt rimscae", "ρrιlι": "prili", "pɑurɑ miɡ": "paura mig", "τοῦ рόφ": "τοῦ ρόφ", "мiр": "мір", "et ехаrсерs dedit": "et exarceps dedit", "и ехаrсерs же": "и ехагсерѕ же",
    "sοx⟦τ⟧ι": "sox⟦t⟧i", "ạ̇": unicodedata.normalize("NFC", "ạ̇"), "ͣa": "ͣa",
}
SAFE = ["", "plain text", "ſtaua ꝑ ꝓ ꝛ ⁊ ⟦a⟧", "q̃ stͣurrio q̃", "Часше мѧлго", "καδάλλίρτται τοῦ", "tab\tand\nline", "ªº x² é ñ", "pro κρίφμεν cum", "a · b"]


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, t string")


def test_cases_and_safe_texts(spark):
    df = texts(spark, [*CASES, *SAFE, None])
    got = {r.t: r.form for r in p02_forms.with_forms(df, {"t": "form"}).collect()}
    assert got == {**CASES, **{s: s for s in SAFE}, None: None, "ͣa": "ͣa"}
    found = {r.row_id for r in p02_forms.found(df, ("t",)).collect()}
    assert found == {i for i, (a, b) in enumerate(CASES.items()) if a != b}


def test_several_columns_at_once(spark):
    rows = [(1, "ａb", "ａb"), (2, "ok", "ｏk"), (3, None, "ok"), (4, "ok", None), (5, "ａb", None)]
    got = {r.row_id: (r.x, r.y) for r in p02_forms.with_forms(spark.createDataFrame(rows, "row_id long, a string, b string"), {"a": "x", "b": "y"}).collect()}
    assert got == {1: ("ab", "ab"), 2: ("ok", "ok"), 3: (None, "ok"), 4: ("ok", None), 5: ("ab", None)}


def test_only_invisible_characters(spark):
    df = texts(spark, ["​‍", "​"])
    assert [r.form for r in p02_forms.with_forms(df, {"t": "form"}).collect()] == ["", ""]


def test_agrees_with_unicode(spark):
    rng = random.Random(7)
    alphabet = "aeiounAE xy" + "".join(chr(c) for c in range(0x300, 0x330)) + "ͣͤéñἀ"
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 20))) for _ in range(300)]
    got = {r.t: r.form for r in p02_forms.with_forms(texts(spark, values), {"t": "form"}).collect()}
    for t, form in got.items():
        if not any("Ͱ" <= c <= "῿" for c in t):
            assert form == unicodedata.normalize("NFC", t)


def test_edges(spark):
    long = "ａ" * 5000 + " x"
    df = texts(spark, [long, long, "ok"]).withColumns({"ch": F.lit("c"), "clean": F.lit(1), "text": F.lit("x"), "word": F.lit(2)})
    got = p02_forms.with_forms(df, {"t": "form"})
    assert got.count() == 3 and {r.form for r in got.collect()} == {"a" * 5000 + " x", "ok"}
    assert p02_forms.found(df, ("t",)).count() == 2
    assert p02_forms.found(df.limit(0), ("t",)).count() == 0 and p02_forms.with_forms(df.limit(0), {"t": "form"}).count() == 0


@pytest.mark.parametrize(("a", "b"), [("Ιncipiτ ⁊", "incipit"), ("Ａ-b C", "abc"), ("ﬆ ſt", "stst"), ("", ""), ("⁊ ·", "")])
def test_letters(a, b):
    assert chars.letters(a) == b
