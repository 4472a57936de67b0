"""One form for visually identical text.

Method: texts are exploded to positioned code points, which are joined with two broadcast mappings (plain and
look-alike forms, combining classes); marks are put in canonical order, recomposed, and the texts rebuilt.

Only texts that fail a quick check (one character class and, where a Greek or Cyrillic letter stands, one look
at the word's alphabets) are exploded, and in them only the words that fail it; the rest are in form already.
The mappings are derived from Unicode, so the size of what is broadcast doesn't depend on the data.

Defined results: null stays null, an empty text stays empty, very long texts are handled whole, equal texts are
worked on once, extra columns are kept (forms) or left out (found), an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatio.llm import chars
from collatio.sources import cut_lineage

_KEY = "__form_key"


@lru_cache(1)
def _patterns() -> dict[str, str]:
    c = chars.script_classes()
    foreign = f"[{c['greek']}{c['cyrillic']}]"
    inside = "[\\p{M}" + chars.EDITION_MARKS + chars.java_class(list(chars.INVISIBLE_RANGES)) + "]"
    pairs = [(a, b) for a in ("latin", "greek", "cyrillic") for b in ("latin", "greek", "cyrillic") if a != b]
    return {
        "safe": "^(?:" + "|".join(x if x.endswith(")") else f"{x}++" for x in chars.safe_classes()) + ")*+\\z",
        "foreign": foreign,
        "mixed": "|".join(f"[{c[a]}]{inside}*+[{c[b]}]" for a, b in pairs),
        "not_foreign": f"[^{foreign[1:-1]}]",
        "hard": f"[{foreign[1:-1]}&&[^{''.join(x for a in ('greek', 'cyrillic') for x in chars.lookalikes()[a])}]]",
        **{f"not_{a}": f"[{c['latin']}&&[^{''.join(x for x in chars.lookalikes()[a].values())}]]" for a in ("greek", "cyrillic")},
        "word": f"(?:\\p{{L}}|{inside})++|[^\\p{{L}}]",
        **{k: f"[^{v}]" for k, v in c.items()},
    }


def needs_work(text: Column) -> Column:
    """True where a text may not be in form: the quick check, on the JVM."""
    p = _patterns()
    return ~text.rlike(p["safe"]) | (text.rlike(p["foreign"]) & text.rlike(p["mixed"]))


def _count(text: Column, alphabet: str) -> Column:
    return F.length(F.regexp_replace(text, _patterns()[alphabet], ""))


def _maps(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    table = spark.createDataFrame(chars.char_table(), "ch string, plain string, to_latin string, to_greek string, to_cyrillic string")
    marks = spark.createDataFrame(chars.mark_classes(), "unit string, ccc int")
    return F.broadcast(table), F.broadcast(marks)


def _compose(marks: Column) -> Column:
    """Compose a cluster: marks is the ordered array of (ccc, pos, sub, unit), the starter first."""
    table = chars.compositions()
    pairs = F.map_from_arrays(*[F.split(F.lit("\x1f".join(side)), "\x1f") for side in (table.keys(), table.values())])  # folded to a literal
    start = F.struct(marks[0]["unit"].alias("base"), F.lit(0).alias("last"), F.lit("").alias("rest"))

    def step(acc: Column, m: Column) -> Column:
        whole = pairs[F.concat(acc["base"], m["unit"])]
        free = (acc["rest"] == "") | (acc["last"] < m["ccc"])
        return F.when(free & whole.isNotNull(), F.struct(whole.alias("base"), acc["last"].alias("last"), acc["rest"].alias("rest"))).otherwise(
            F.struct(acc["base"].alias("base"), m["ccc"].alias("last"), F.concat(acc["rest"], m["unit"]).alias("rest"))
        )

    return F.when(F.size(marks) == 1, marks[0]["unit"]).otherwise(
        F.aggregate(F.slice(marks, 2, 1 << 30), start, step, lambda acc: F.concat(acc["base"], acc["rest"]))
    )


def clean_texts(texts: DataFrame) -> DataFrame:
    """(text) -> (text, clean, n_mixed), one row for each different text; meant for those that the quick check
    doesn't pass.  n_mixed counts its words of several alphabets.

    The different texts are spread by a key of their own (their hashes and length); from there on every step
    keeps that partitioning, so code points are never shuffled."""
    spark, p = texts.sparkSession, _patterns()
    table, marks = _maps(spark)
    key = F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"), F.length("text").alias("n"))
    distinct = texts.select("text").distinct().withColumn(_KEY, key).repartition(_KEY)
    # whether a text has more Latin letters than others; only asked where it has others
    in_latin = F.coalesce(F.when(F.col("text").rlike(p["foreign"]), _count(F.col("text"), "latin") > F.length(F.regexp_replace("text", p["not_foreign"], ""))), F.lit(False))
    words = distinct.select(_KEY, in_latin.alias("in_latin"), F.posexplode(F.regexp_extract_all("text", F.lit(p["word"]), F.lit(0))).alias("word_pos", "word"))
    n = {a: _count(F.col("word"), a) for a in ("latin", "greek", "cyrillic")}
    # in a Latin text a word that can be read in Latin is Latin; else it belongs to its commonest alphabet, but never to one
    # that lacks some of its Latin letters
    main = (
        F.when(F.col("in_latin") & ~F.col("word").rlike(p["hard"]) | (n["latin"] >= n["greek"]) & (n["latin"] >= n["cyrillic"]), "latin")
        .when(n["greek"] >= n["cyrillic"], F.when(F.col("word").rlike(p["not_greek"]), "latin").otherwise("greek"))
        .otherwise(F.when(F.col("word").rlike(p["not_cyrillic"]), "latin").otherwise("cyrillic"))
    )
    words = words.withColumn("main", F.when(F.col("word").rlike(p["foreign"]) & F.col("word").rlike(p["mixed"]), main))
    whole = F.col("main").isNull() & F.col("word").rlike(p["safe"])
    units = words.select(
        _KEY, "word_pos", "main", F.posexplode(F.when(whole, F.array("word")).otherwise(F.split("word", ""))).alias("pos", "ch")
    ).join(table, "ch", "left")
    look = F.when(F.col("main") == "latin", F.col("to_latin")).when(F.col("main") == "greek", F.col("to_greek")).when(
        F.col("main") == "cyrillic", F.col("to_cyrillic")
    )
    # what is still a word of several characters is in form and stays one unit
    form = F.coalesce(look, F.col("plain"))
    units = units.select(
        _KEY, "word_pos", "pos", F.posexplode(F.when(form.isNull(), F.array("ch")).when(form != "", F.split(form, ""))).alias("sub", "unit")
    )
    units = units.join(marks, "unit", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    blended = words.groupBy(_KEY).agg(F.count("main").alias("n_mixed"))
    # one list for each text, in the order of the text; then clusters (a starter and its marks) inside the list
    ordered = units.groupBy(_KEY).agg(F.sort_array(F.collect_list(F.struct("word_pos", "pos", "sub", "unit", "ccc"))).alias("units"))
    plain = F.array_join(F.transform("units", lambda u: u["unit"]), "")
    marked = F.exists("units", lambda u: u["ccc"] != 0)
    bare = ordered.filter(~marked).select(_KEY, plain.alias("clean"))
    numbered = ordered.filter(marked).select(_KEY, F.posexplode("units").alias("at", "u"))
    starter = F.sum(F.when(F.col("u.ccc") == 0, 1).otherwise(0))
    numbered = numbered.withColumn("cluster", starter.over(Window.partitionBy(_KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    clusters = numbered.groupBy(_KEY, "cluster").agg(
        F.sort_array(F.collect_list(F.struct(F.col("u.ccc").alias("ccc"), "at", F.lit(0).alias("sub"), F.col("u.unit").alias("unit")))).alias("marks")
    )
    composed = clusters.select(_KEY, "cluster", _compose(F.col("marks")).alias("text"))
    rebuilt = composed.groupBy(_KEY).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "text"))), lambda x: x["text"]), "").alias("clean")
    )
    # a text of nothing but invisible characters leaves no unit at all
    return (
        distinct.join(bare.unionByName(rebuilt), _KEY, "left")
        .join(blended, _KEY, "left")
        .select("text", F.coalesce("clean", F.lit("")).alias("clean"), F.coalesce("n_mixed", F.lit(0)).alias("n_mixed"))
    )


def with_forms(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a column for each of columns ({text column: new column}): the text in its one form.  Rows whose texts all pass
    the quick check (and nulls) go through as they are; the others are written, and the different texts of all columns
    among them are worked on once.  The join's key is the text itself."""
    checked = {c: F.coalesce(needs_work(F.col(f"`{c}`")), F.lit(False)) for c in columns}
    some = reduce(lambda a, b: a | b, checked.values())
    ready = df.filter(~some).withColumns({out: F.col(f"`{c}`") for c, out in columns.items()})
    work = cut_lineage(df.filter(some))
    texts = [work.filter(checked[c]).select(F.col(f"`{c}`").alias("text")) for c in columns]
    fixed = cut_lineage(clean_texts(reduce(DataFrame.unionByName, texts)).select(F.col("text").alias("__form_text"), F.col("clean").alias("__form_clean")))
    for c, out in columns.items():
        work = work.join(fixed, F.col(f"`{c}`") == F.col("__form_text"), "left").withColumn(out, F.coalesce("__form_clean", F.col(f"`{c}`"))).drop("__form_text", "__form_clean")
    return ready.unionByName(work)


def found(df: DataFrame, fields: tuple[str, ...] = ("reference", "prediction"), key: str = "row_id") -> DataFrame:
    """(key, field) of every text whose one form differs from it, or in which a word mixes alphabets even so."""
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")
    # the check reads every text once; what it leaves is written, as three steps read it
    long = cut_lineage(df.select(key, stack).select(key, "x.field", "x.text").filter(needs_work(F.col("text"))))
    fixed = clean_texts(long.select("text")).filter((F.col("clean") != F.col("text")) | (F.col("n_mixed") > 0)).select("text")
    return long.join(fixed, "text", "left_semi").select(key, "field")

