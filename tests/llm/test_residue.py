import pandas as pd
import pytest
from pyspark.sql import functions as F

from collatio.llm import p09_residue as r
from collatio.llm.residue_text import seeds

# Written for these tests: none of it stands in the seeds, nor is anything fitted on it.
HELD_OUT = {
    "placeholder": [
        "Dear [FIRST NAME], thank you for your visit.", "The folio {title} is kept in the box.", "See $TITLE$ for the shelfmark.", "Written by <<title>> in the abbey.", "Hello %1$s, your copy is ready.", "Owner: {{owner.name}}",
        "Bought in ${purchase_year} from a dealer.", "[Your Name Here] copied this book.", "Date: [DATE]", "<insert city> is where it was kept.", "Price: %(price)d florins", "The codex from __LOCATION__ has 3 leaves", "[[shelfmark_value]]",
        "{% if user %} read {% endif %}", "by <%= author_name %>", "[Company Name] owns it", "TODO: [add description]", "%COMPANY% holds the deed", "Ref. #{ref_no}", "{0} of {1} leaves",
    ],
    "filler": [
        "Maecenas sed diam eget risus varius blandit sit amet non magna.", "Etiam porta sem malesuada magna mollis euismod.", "Nullam quis risus eget urna mollis ornare vel eu leo.", "LOREM IPSUM DOLOR", "This box needs some text, please write it here.",
        "Add your own text here and click to edit me.", "Insert some descriptive text here.", "Descripción de ejemplo: escriba aquí el contenido.", "Sample paragraph, replace it with real content later.", "Hier bitte noch einen Text einfügen.",
        "Your company description goes here", "Placeholder caption for this picture", "Enter a short summary of the book here.", "Ajoutez votre propre texte ici.", "Inserire qui una breve descrizione del libro.",
    ],
    "notice": [
        "HTTP/1.0 404 File not found", "Whoops, looks like something went wrong.", "This webpage is not available.", "The page was moved or deleted in 1998.", "Sorry, an error has occurred, requested page not found!",
        "This site is currently unavailable; please come back later.", "Your connection was interrupted. Reload the page.", "Please turn JavaScript on in your browser to see this content.", "JavaScript must be enabled for this viewer to function.",
        "nginx error! The page you are looking for is temporarily unavailable.", "ERR_CONNECTION_REFUSED: the server refused to connect.", "Lo sentimos, la página que busca no está disponible.", "Scripts are blocked, so the viewer cannot start.",
        "Internal error: could not load manifest.", "Gateway timed out while contacting the image server.", "Plеase enable Javascript to view this page.",
    ],
}
CONTENT = [
    "The reader could not be found in the list of monks.", "The service of the dead is on the third leaf.", "JavaScript was the topic of the talk the librarian gave in May.", "He refused the request of the abbot, who then left the town.",
    "The page that the reader requested had been lost since 1701.", "The site of the monastery was moved after the flood.", "[sic] stands in the margin, and {sic} in the edition.", "the fifth leaf [now lost] had an initial",
    "The variable `{count}` holds the number of lines.", "Our mark “{{title}}” stands for the heading.", "The word ipsum is missing in the second verse.", "Bought in 1404 from a dealer in Grauwerd for 6 florins.", "Часше мѧлго по мумити", "The share rose by 14 % since 1933.",
]
DOCUMENTS = [x for x in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.dropna() if x]
# some of the documents hold residue: this is what a corpus is fitted on, and what mustn't come out of it
NATURAL = [x for x, (cover, _, _) in zip(DOCUMENTS, r.examine(DOCUMENTS, r.fit(DOCUMENTS)), strict=True) if cover == 0 and len(x) > 200]
PROSE = [
    "The codex holds sermons for the lesser feasts, copied by two scribes on 5 leaves. Ruling in lead, 13 lines to the page. It was bought in 1404 from a dealer in Elmira.",
    "La legatura è del 1816, con restauri più tardi. Die Tinte ist verblichen. Fue comprado en Elmira el año 1874. La reliure d'origine a gardé 13 clous.",
    "Do not count a punctus twice when the system keeps it. Spaces follow the edition; a double space is no error. character error rate 0.31, word error rate 0.2.",
    "tigi dafunt stacocsando canplaunnorum surens ⁊ Часше мѧлго καδάλλίρτται τοῦ",
]


@pytest.fixture(scope="module")
def model():
    return r.fit(DOCUMENTS)


def test_held_out_is_not_in_the_seeds():
    known = {x for kind in r.CLASSES for forms in seeds(kind) for x in forms}
    assert not known & {x for xs in HELD_OUT.values() for x in xs}


@pytest.mark.parametrize("kind", HELD_OUT)
def test_recall_of_unseen_residue(model, kind):
    got = [x for x, (cover, _, _) in zip(HELD_OUT[kind], r.examine(HELD_OUT[kind], model), strict=True) if cover > 0]
    assert len(got) >= 0.9 * len(HELD_OUT[kind]), set(HELD_OUT[kind]) - set(got)
    inside = r.examine([f"{NATURAL[0]}\n{x}\n{NATURAL[1]}" for x in got], model)
    assert all(0 < cover < 0.6 for cover, _, _ in inside)


def test_content(model):
    texts = [*CONTENT, *PROSE, "", " \n", None]
    assert [t for t, (cover, _, _) in zip(texts, r.examine(texts, model), strict=True) if cover > 0] == []


def test_coverage_of_whole_and_long_texts(model):
    whole, end, start = r.examine(["Access to this page is forbidden.", " ".join(NATURAL[:300]) + " Lorem ipsum dolor sit amet, consectetur adipiscing elit.", None], model)
    assert whole[0] > 0.9 and 0 < end[0] < 0.05 and start == (0.0, 0.0, None)


def test_blocks_dont_matter(model, monkeypatch):
    texts = [*HELD_OUT["notice"], *NATURAL[:50], None, ""]
    once = r.examine(texts, model)
    monkeypatch.setattr(r, "BLOCK", 100)
    again = r.examine(texts, model)
    assert [(c, k) for c, _, k in once] == [(c, k) for c, _, k in again]


def test_table(spark):
    residue = [*HELD_OUT["notice"][:5], *HELD_OUT["placeholder"][:5]]
    texts = [*NATURAL, *residue, None, ""]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumns({"key": F.lit(1), "kind": F.lit("x"), "coverage": F.lit(2)})
    got = {x.doc_id for x in r.found(df).collect()}
    want = set(range(len(NATURAL), len(NATURAL) + len(residue)))
    assert len(want - got) <= 1 and len(got - want) <= 0.003 * len(NATURAL)
    assert r.kept(df).count() == len(texts) - len(got)
    twice = df.unionByName(df)
    assert sum(x.n_docs for x in r.report(twice).collect()) == 2 * len(texts)
    assert r.found(df.limit(0)).count() == 0
    assert r.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Error 404: page not found.", "503 Service Unavailable", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Please log in again, your session has expired."])
def test_shared_residue(text):
    # one text in a third of the rows isn't learnt as prose
    model = r.fit([*NATURAL, *[f"{text} {i}" for i in range(len(NATURAL) // 2)]])
    assert r.examine([text], model)[0][0] > 0
    assert r.examine([NATURAL[0]], model)[0][0] == 0


def test_own_words_of_the_corpus_are_learnt():
    # a notice in words that no seed has is learnt from the notices around it
    texts = [x.rstrip(".") + ", dear pilgrim." for forms in seeds("notice") for x in forms[:4] if len(x) > 40]
    of_seeds, learnt = r.fit(DOCUMENTS), r.fit([*DOCUMENTS, *texts])
    ratio = lambda m: r._sentence_ratios(["dear pilgrim"], m)[0][r.CLASSES.index("notice")]
    assert ratio(learnt) > ratio(of_seeds)


def test_sample_of_different_texts(spark):
    df = spark.createDataFrame([(i, "the same" if i % 3 else f"text {i}") for i in range(60)] + [(99, None), (100, "x" * 3000 + "y" * 3000)], "doc_id long, text string")
    got = r.sample(df)
    assert len(got) == len(set(got)) == 22 and {"the same", *(f"text {i}" for i in range(0, 60, 3))} <= set(got)
    assert max(map(len, got)) == r.NATURAL_CHARS


def test_models_rest_on_all_texts(spark, monkeypatch):
    monkeypatch.setattr(r, "NATURAL_SAMPLE", 20)
    monkeypatch.setattr(r, "NATURAL_CHARS", 50)
    texts = sorted({*DOCUMENTS[:300], *(f"{x} {i}" for i in range(3) for x in HELD_OUT["notice"]), " ".join(NATURAL[:40])})
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:9], None, ""])], "doc_id long, text string")
    want = r.examine(texts, r.fit(texts))
    for n in (1, 5):
        got = {x.doc_id: (x.coverage, x.ratio, x.kind) for x in r.examined(df.repartition(n)).collect()}
        assert [got[i][::2] for i in range(len(texts))] == [x[::2] for x in want]
        assert max(abs(got[i][1] - x[1]) for i, x in enumerate(want)) < 1e-9


def test_counts_are_the_same_in_any_blocks(spark, monkeypatch):
    texts = sorted({*DOCUMENTS[:200], "", "[a] and {b} and [[c]]"})
    once = r.fit(texts)
    monkeypatch.setattr(r, "BLOCK", 500)
    model = r.fitted(spark.createDataFrame([(t,) for t in texts[::-1]], "text string").repartition(3))
    for other in (r.fit(texts[::-1]), model):
        assert (other.ratios == once.ratios).all() and other.patterns == once.patterns and other.other == once.other


RUN = "the second annotator noted the reading next to the upper margin and the sheet was then bound with the other leaves of the same quire "


@pytest.fixture(scope="module")
def of_run():
    return r.fit([*NATURAL, *[RUN] * 40])


@pytest.mark.parametrize("text", ["please enable javascript to view this page", "sorry, this page is not available right now", "the requested page could not be found", "lorem ipsum dolor sit amet consectetur"])
def test_residue_inside_a_sentence(of_run, text):
    assert r.examine([RUN + RUN], of_run)[0][0] == 0
    cover = r.examine([RUN + text + " " + RUN], of_run)[0][0] * len(RUN + text + " " + RUN)
    assert 0.7 * len(text) <= cover <= 2 * len(text) + 10
    twice = RUN + text + " " + RUN + RUN + text + " " + RUN
    assert r.examine([twice], of_run)[0][0] * len(twice) >= 1.4 * len(text)


def test_a_clause_that_tells(of_run):
    assert r.examine([RUN + "and the viewer needs javascript, so they printed the images for the reader"], of_run)[0][0] == 0
