"""All queries of the core over the test tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatio import plots
from collatio.functions.align import COUNTS, SPAN_FIELDS, align_text, edit_counts, output_distance
from collatio.functions.text import collapse_tokens, normalize_and_tokenize, normalize_text, tokenize
from collatio.operators import annotate, compare, diagnostics, policy_swap, preferences, sampling
from collatio.operators.evaluate import evaluate_recognition, normalization_sensitivity
from collatio.operators.summarise import error_profile, summarise_recognition, summarise_sets
from collatio.plans import sql
from collatio.policy import EvalPolicy
from collatio.sources import controlled_variants, cut_lineage, table, validate

PREDICTIONS = "catmus_medieval_controlled_predictions"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
STRICT = EvalPolicy()
RELAXED = EvalPolicy(whitespace="collapse", punctuation="remove")
CODEPOINT = EvalPolicy(unicode="none", char_unit="codepoint")
KEEP = ["document_id", "language", "script_type", "subcorpus"]
PAIR = ("scriba3b_neutral", "scriba3b_catmus")
N_BOOT, ALL_PAIRS_BOOT, SEED = 2000, 5000, 2027


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def recognition(spark: SparkSession, d: str) -> DataFrame:
    """The table that the evaluation starts from: of the readings with both texts the last one loaded of each line and
    system, with one reference a line (it is the same text in several forms)."""
    rows = table(spark, d, PREDICTIONS).filter("line_id is not null and system is not null and reference is not null and prediction is not null")
    last = Window.partitionBy("line_id", "system").orderBy(F.desc_nulls_last("loaded_at"), F.desc("row_id"))
    one = rows.groupBy("line_id").agg(F.min("reference").alias("reference"))
    rows = rows.drop("reference").withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn")
    return rows.join(one, "line_id")


def evaluation(spark, d, metrics=("cer", "wer"), keep=KEEP, policy=None, once=False) -> DataFrame:
    """once: written, for plans that join the evaluation with itself; else every branch would align anew."""
    out = evaluate_recognition(recognition(spark, d), keep=keep, metrics=metrics, policy=policy, input_row="row_id")
    return cut_lineage(out) if once else out


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _eval(**k) -> str:
    return _with(sql.RECOG, sql.evaluated(**k))


_ROWS = "SELECT line_id, system, row_id AS input_row, metric, rate, n_reference, n_hypothesis, substitutions, deletions, insertions, distance FROM eval"
_ROW_COLUMNS = ["line_id", "system", "input_row", "metric", "rate", "n_reference", "n_hypothesis", "substitutions", "deletions", "insertions", "distance"]


@query(_eval(metrics=("cer",)) + _ROWS)
def cer_rows(spark, d):
    return evaluation(spark, d, ["cer"]).select(*_ROW_COLUMNS)


@query(_eval(metrics=("wer",)) + _ROWS)
def wer_rows(spark, d):
    return evaluation(spark, d, ["wer"]).select(*_ROW_COLUMNS)


def _counted(spark, d, policy, unit):
    rows = recognition(spark, d)
    return rows.select("row_id", F.inline(F.array(edit_counts("reference", "prediction", policy, unit)))).select("row_id", *COUNTS)


_COUNTS = "SELECT row_id, n AS n_reference, m AS n_hypothesis, n - s - d AS equal, s AS substitutions, d AS deletions, i AS insertions, dist AS distance FROM recog r JOIN c USING (reference, prediction)"


@query(_with(sql.RECOG, sql.counts("c", "recog", CODEPOINT, "codepoint")) + _COUNTS)
def edit_counts_codepoint(spark, d):
    return _counted(spark, d, CODEPOINT, "codepoint")


@query(_with(sql.RECOG, sql.counts("c", "recog", RELAXED, "word")) + _COUNTS)
def edit_counts_word(spark, d):
    return _counted(spark, d, RELAXED, "word")


@query(f"SELECT row_id, {sql.normalized('prediction', RELAXED)} AS text FROM {PREDICTIONS}")
def normalized_texts(spark, d):
    return table(spark, d, PREDICTIONS).select("row_id", normalize_text("prediction", "NFC", "preserve", "collapse", "remove").alias("text"))


@query(f"""SELECT row_id, length_grapheme(prediction) AS n_graphemes, length(prediction) AS n_codepoints,
  len({sql.tokens('prediction', CODEPOINT, 'word')}) AS n_words FROM {PREDICTIONS} WHERE prediction IS NOT NULL""")
def token_counts(spark, d):
    rows = table(spark, d, PREDICTIONS).filter("prediction is not null")
    n = lambda unit: F.size(tokenize("prediction", unit)).cast("long")
    return rows.select("row_id", n("grapheme").alias("n_graphemes"), n("codepoint").alias("n_codepoints"), n("word").alias("n_words"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(_eval() + f"SELECT system, metric, 'micro' AS averaging, round({sql.POOLED}, 9) AS rate, count(*) AS n_rows, count(*) AS n_units, {sql.SUMS} FROM eval GROUP BY system, metric")
def summary_micro(spark, d):
    return _rounded(summarise_recognition(evaluation(spark, d), ["system"]), "rate")


@query(_eval() + f"SELECT system, metric, 'macro' AS averaging, round(avg(rate), 9) AS rate, count(*) AS n_rows, count(*) AS n_units, {sql.SUMS} FROM eval GROUP BY system, metric")
def summary_macro_row(spark, d):
    return _rounded(summarise_recognition(evaluation(spark, d), ["system"], "macro"), "rate")


@query(_eval() + f"""SELECT system, metric, 'macro' AS averaging, round(avg(rate), 9) AS rate, sum(n_rows)::BIGINT AS n_rows, count(*) AS n_units, {sql.SUMS} FROM (
  SELECT system, metric, document_id, {sql.POOLED} AS rate, count(*) AS n_rows, {sql.SUMS} FROM eval GROUP BY ALL) GROUP BY system, metric""")
def summary_macro_document(spark, d):
    return _rounded(summarise_recognition(evaluation(spark, d), ["system"], "macro", "document_id"), "rate")


@query(_eval() + f"""SELECT concat_ws('+', CASE WHEN GROUPING(system) = 0 THEN 'system' END, CASE WHEN GROUPING(language) = 0 THEN 'language' END, CASE WHEN GROUPING(script_type) = 0 THEN 'script_type' END) AS grouping,
  system, language, script_type, metric, count(*) AS n_rows, {sql.SUMS}, round({sql.POOLED}, 9) AS rate FROM eval
  GROUP BY GROUPING SETS ((system, metric), (system, language, metric), (system, script_type, metric), (metric))""")
def summary_sets(spark, d):
    return _rounded(summarise_sets(evaluation(spark, d), [["system"], ["system", "language"], ["system", "script_type"], []]), "rate")


_PROFILE = ", ".join(f"round(CASE WHEN sum(n_reference) <> 0 THEN sum({k})::DOUBLE / sum(n_reference) END, 9) AS {k[:-1]}_rate" for k in ("substitutions", "deletions", "insertions"))


@query(_eval() + f"""SELECT system, metric, count(*) AS n_rows, sum(n_reference)::BIGINT AS n_reference, sum(substitutions)::BIGINT AS substitutions, sum(deletions)::BIGINT AS deletions,
  sum(insertions)::BIGINT AS insertions, sum(distance)::BIGINT AS distance, {_PROFILE}, round({sql.POOLED}, 9) AS error_rate FROM eval GROUP BY system, metric""")
def error_profiles(spark, d):
    return _rounded(error_profile(evaluation(spark, d), ["system"]), "substitution_rate", "deletion_rate", "insertion_rate", "error_rate")


POLICIES = {"strict": STRICT, "relaxed": RELAXED, "codepoint": CODEPOINT}


@query(_with(sql.RECOG, *[sql.evaluated(policy=p, suffix=f"_{n}") for n, p in POLICIES.items()]) + " UNION ALL ".join(
    f"SELECT system, '{n}' AS policy, '{p.unicode}' AS policy_unicode, '{p.case}' AS policy_case, '{p.whitespace}' AS policy_whitespace, '{p.punctuation}' AS policy_punctuation,"
    f" '{p.char_unit}' AS policy_char_unit, metric, 'micro' AS averaging, round({sql.POOLED}, 9) AS rate, count(*) AS n_rows, count(*) AS n_units, {sql.SUMS} FROM eval_{n} GROUP BY system, metric"
    for n, p in POLICIES.items()))
def sensitivity_policies(spark, d):
    return _rounded(normalization_sensitivity(recognition(spark, d), POLICIES, summarise=True, by=["system"], input_row="row_id"), "rate")


def _paired(spark, d):
    x = evaluation(spark, d, keep=["document_id"], once=True)
    return cut_lineage(compare.common_observations(x, PAIR, ["document_id", "line_id"]))  # read by the checks and by the comparison


_SIDES = ", ".join(f"sum(CASE WHEN system = '{s}' THEN {c} ELSE 0 END) AS {k}_{n}" for n, s in zip("ab", PAIR, strict=True) for k, c in (("ref", "n_reference"), ("ins", "insertions"), ("dist", "distance")))


def _compare_sql(estimand: str) -> str:
    units = f"""both_read AS (SELECT metric, document_id, line_id FROM eval WHERE system IN {PAIR} GROUP BY ALL HAVING count(DISTINCT system) = 2),
  units AS (SELECT e.metric, e.document_id AS u, {_SIDES} FROM eval e JOIN both_read b ON e.metric = b.metric AND e.line_id = b.line_id AND e.document_id IS NOT DISTINCT FROM b.document_id
    WHERE system IN {PAIR} GROUP BY ALL)"""
    return _with(sql.RECOG, sql.evaluated(), units, sql.boot("units", "metric", estimand, N_BOOT, SEED)) + (
        f"SELECT metric, '{PAIR[0]}' AS system_a, '{PAIR[1]}' AS system_b, '{estimand}' AS estimand, round(estimate_a, 9) AS estimate_a, round(estimate_b, 9) AS estimate_b,"
        f" round(estimate_b - estimate_a, 9) AS difference_b_minus_a, round(conf_low, 9) AS conf_low, round(conf_high, 9) AS conf_high, 0.95::DOUBLE AS conf_level, n_units, {N_BOOT} AS n_boot FROM point JOIN ends USING (metric)"
    )


_ESTIMATES = ("estimate_a", "estimate_b", "difference_b_minus_a", "conf_low", "conf_high")


@query(_compare_sql("macro"))
def compare_macro(spark, d):
    return _rounded(compare.compare_systems(_paired(spark, d), PAIR, estimand="macro", n_boot=N_BOOT, seed=SEED), *_ESTIMATES)


@query(_compare_sql("micro"))
def compare_micro(spark, d):
    return _rounded(compare.compare_systems(_paired(spark, d), PAIR, estimand="micro", n_boot=N_BOOT, seed=SEED), *_ESTIMATES)


_ALL_PAIRS = """units AS (SELECT a.metric, a.system AS system_a, b.system AS system_b, a.document_id AS u, sum(a.n_reference) AS ref_a, sum(a.insertions) AS ins_a, sum(a.distance) AS dist_a,
    sum(b.n_reference) AS ref_b, sum(b.insertions) AS ins_b, sum(b.distance) AS dist_b
  FROM eval a JOIN eval b ON a.metric = b.metric AND a.line_id = b.line_id AND a.document_id IS NOT DISTINCT FROM b.document_id AND a.system < b.system GROUP BY ALL)"""


def _all_pairs_sql(estimand: str) -> str:
    return _with(sql.RECOG, sql.evaluated(), _ALL_PAIRS, sql.boot("units", "metric, system_a, system_b", estimand, ALL_PAIRS_BOOT, SEED)) + f"""SELECT metric, system_a, system_b, '{estimand}' AS estimand,
  round(estimate_a, 9) AS estimate_a, round(estimate_b, 9) AS estimate_b, round(estimate_b - estimate_a, 9) AS difference_b_minus_a, round(conf_low, 9) AS conf_low, round(conf_high, 9) AS conf_high,
  0.95::DOUBLE AS conf_level, n_units, {ALL_PAIRS_BOOT} AS n_boot FROM point JOIN ends USING (metric, system_a, system_b)"""


def _all_pairs(spark, d, estimand):
    # without texts, of which recognition() has one reference a line: what is written is read by the checks and by both sides
    x = evaluate_recognition(recognition(spark, d), keep=["document_id"], keep_text=False, input_row="row_id")
    x = cut_lineage(x.select("document_id", "line_id", "system", "metric", "n_reference", "insertions", "distance"))
    return _rounded(compare.compare_all_pairs(x, estimand=estimand, n_boot=ALL_PAIRS_BOOT, seed=SEED, unpaired="drop"), *_ESTIMATES)


@query(_all_pairs_sql("macro"))
def compare_all_pairs(spark, d):
    return _all_pairs(spark, d, "macro")


@query(_all_pairs_sql("micro"))
def compare_all_pairs_micro(spark, d):
    return _all_pairs(spark, d, "micro")


_VIOLATIONS = f"""pairs AS (SELECT row_id, line_id, document_id, system, reference, length(reference) AS n_reference FROM {PREDICTIONS} WHERE system IN {PAIR} AND reference IS NOT NULL),
  g AS (SELECT document_id, line_id, count(*) FILTER (system = '{PAIR[0]}') AS na, count(*) FILTER (system = '{PAIR[1]}') AS nb,
    min(reference) FILTER (system = '{PAIR[0]}') AS ta, min(reference) FILTER (system = '{PAIR[1]}') AS tb, min(n_reference) FILTER (system = '{PAIR[0]}') AS la, min(n_reference) FILTER (system = '{PAIR[1]}') AS lb
    FROM pairs GROUP BY ALL)"""


@query(_with(_VIOLATIONS) + """SELECT * FROM (SELECT 'raw' AS metric, 'duplicate' AS problem, count(*) AS n FROM g WHERE na > 1 OR nb > 1 UNION ALL
  SELECT 'raw', 'unpaired', count(*) FROM g WHERE na = 0 OR nb = 0 UNION ALL SELECT 'raw', 'reference', count(*) FROM g WHERE na > 0 AND nb > 0 AND ta <> tb UNION ALL
  SELECT 'raw', 'length', count(*) FROM g WHERE na > 0 AND nb > 0 AND la <> lb) WHERE n > 0""")
def pairing_violations(spark, d):
    raw = table(spark, d, PREDICTIONS).filter("reference is not null").select("line_id", "document_id", "system", "reference", F.length("reference").alias("n_reference"), F.lit("raw").alias("metric"))
    return compare.pairing_violations(raw, PAIR)


def _with_models(spark, d, metrics=("cer",)):
    x = evaluation(spark, d, metrics, keep=["document_id"], once=True)
    return policy_swap.attach_manifest(x, table(spark, d, "systems_manifest"))


_SWAP = """mod AS (SELECT e.*, m.model, m.prompt_condition FROM eval e LEFT JOIN systems_manifest m USING (system)),
  swaps AS (SELECT a.model, a.prompt_condition AS condition_a, b.prompt_condition AS condition_b, a.system AS system_a, b.system AS system_b, a.document_id, a.line_id, a.reference AS ref_text,
    a.prediction AS prediction_a, b.prediction AS prediction_b, a.rate AS rate_a, b.rate AS rate_b, a.n_reference AS ref_a, b.n_reference AS ref_b, a.insertions AS ins_a, b.insertions AS ins_b,
    a.distance AS dist_a, b.distance AS dist_b
    FROM mod a JOIN mod b ON a.model = b.model AND a.line_id = b.line_id AND a.document_id IS NOT DISTINCT FROM b.document_id AND a.metric = b.metric AND a.prompt_condition < b.prompt_condition WHERE trim(a.model) <> '')"""
_FAR = "outs AS (SELECT DISTINCT prediction_a AS reference, prediction_b AS prediction FROM swaps),\n" + sql.counts("far", "outs", STRICT, "grapheme")
_GROUPS = "model, condition_a, condition_b, system_a, system_b"


@query(_with(sql.RECOG, sql.evaluated(metrics=("cer",)), _SWAP, _FAR, f"units AS (SELECT {_GROUPS}, document_id AS u, sum(ref_a) AS ref_a, sum(ins_a) AS ins_a, sum(dist_a) AS dist_a, sum(ref_b) AS ref_b, sum(ins_b) AS ins_b, sum(dist_b) AS dist_b FROM swaps GROUP BY ALL)",
    f"""per_line AS (SELECT {_GROUPS}, count(*) AS n_lines, avg((prediction_a <> prediction_b)::INT::DOUBLE) AS output_change_rate, avg(o) AS mean_output_distance, median(o) AS median_output_distance,
    avg((delta < -1.4901161193847656e-08)::INT::DOUBLE) AS improved_toward_target, avg((delta > 1.4901161193847656e-08)::INT::DOUBLE) AS worsened_from_target,
    avg((abs(delta) <= 1.4901161193847656e-08)::INT::DOUBLE) AS unchanged_target_error, avg(delta) AS mean_line_delta_b_minus_a FROM (
      SELECT s.*, rate_b - rate_a AS delta, CASE WHEN greatest(f.n, f.m) = 0 THEN 0.0 ELSE f.dist::DOUBLE / greatest(f.n, f.m) END AS o FROM swaps s JOIN far f ON f.reference = s.prediction_a AND f.prediction = s.prediction_b) GROUP BY ALL)""",
    sql.boot("units", _GROUPS, "macro", N_BOOT, SEED)) + f"""SELECT {_GROUPS}, 'cer' AS metric, n_lines, round(output_change_rate, 9) AS output_change_rate, round(mean_output_distance, 9) AS mean_output_distance,
  round(median_output_distance, 9) AS median_output_distance, round(improved_toward_target, 9) AS improved_toward_target, round(worsened_from_target, 9) AS worsened_from_target,
  round(unchanged_target_error, 9) AS unchanged_target_error, round(mean_line_delta_b_minus_a, 9) AS mean_line_delta_b_minus_a, round(estimate_b - estimate_a, 9) AS target_difference_b_minus_a,
  round(conf_low, 9) AS conf_low, round(conf_high, 9) AS conf_high, 0.95::DOUBLE AS conf_level, n_units FROM per_line JOIN point USING ({_GROUPS}) JOIN ends USING ({_GROUPS})""")  # fmt: skip
def policy_swaps(spark, d):
    out = policy_swap.policy_swap_summary(_with_models(spark, d), n_boot=N_BOOT, seed=SEED, unpaired="drop")
    return _rounded(out, "output_change_rate", "mean_output_distance", "median_output_distance", "improved_toward_target", "worsened_from_target", "unchanged_target_error",
                    "mean_line_delta_b_minus_a", "target_difference_b_minus_a", "conf_low", "conf_high")


_CHANGED = "changed AS (SELECT model, condition_a, condition_b, system_a, system_b, document_id, line_id, ref_text AS reference, prediction_a, prediction_b, rate_a AS target_rate_a, rate_b AS target_rate_b, round(rate_b - rate_a, 9) AS target_delta_b_minus_a FROM swaps WHERE prediction_a <> prediction_b)"


@query(_with(sql.RECOG, sql.evaluated(metrics=("cer",)), _SWAP, _CHANGED) + "SELECT * FROM changed")
def changed_outputs(spark, d):
    return _rounded(policy_swap.changed_outputs(_with_models(spark, d), unpaired="drop"), "target_delta_b_minus_a")


_OUTS = "outs AS (SELECT a.line_id, a.system AS system_a, b.system AS system_b, a.prediction AS reference, b.prediction FROM recog a JOIN recog b ON a.line_id = b.line_id AND a.system < b.system)"


@query(_with(sql.RECOG, _OUTS, sql.counts("far", "outs", STRICT, "grapheme"))
       + "SELECT line_id, system_a, system_b, CASE WHEN greatest(n, m) = 0 THEN 0.0 ELSE dist::DOUBLE / greatest(n, m) END AS output_distance FROM outs JOIN far USING (reference, prediction)")
def output_distances(spark, d):
    """The distance of the outputs of every pair of systems, line by line."""
    rows = recognition(spark, d)
    a, b = (rows.select("line_id", F.col("system").alias(f"system_{n}"), F.col("prediction").alias(n)) for n in "ab")
    return a.join(b, "line_id").filter("system_a < system_b").select("line_id", "system_a", "system_b", output_distance("a", "b").alias("output_distance"))


_SCRIPT = (sql.RECOG, sql.scripts("script", "recog", STRICT, "grapheme"))
_SPAN_COLUMNS = ", ".join(name for name, _ in SPAN_FIELDS)


@query(_with(*_SCRIPT) + """SELECT system, coalesce(r, '<eps>') AS reference_token, coalesce(h, '<eps>') AS prediction_token, op AS operation, count(*) AS n
  FROM recog JOIN script USING (reference, prediction) WHERE op <> 'equal' GROUP BY ALL""")
def confusion_table(spark, d):
    return diagnostics.confusion_table(evaluation(spark, d, ["cer"]), by=["system"])


@query(_with(*_SCRIPT, sql.spans("spans", "script", 8)) + f"SELECT system, line_id, row_id AS input_row, {_SPAN_COLUMNS}, reference, prediction FROM recog JOIN spans USING (reference, prediction)")
def error_spans(spark, d):
    return diagnostics.extract_error_spans(evaluation(spark, d, ["cer"]), by=["system", "line_id"], context=8)


@query(_with(*_SCRIPT, sql.spans("spans", "script", 5)) + """SELECT system, operation, count(*) AS n_spans, sum(possible_repetition::INT)::BIGINT AS n_possible_repetitions
  FROM recog JOIN spans USING (reference, prediction) GROUP BY ALL""")
def repetition_flags(spark, d):
    spans = diagnostics.extract_error_spans(evaluation(spark, d, ["cer"]), by=["system"])
    return spans.groupBy("system", "operation").agg(F.count("*").alias("n_spans"), F.sum(F.col("possible_repetition").cast("long")).alias("n_possible_repetitions"))


@query(_with(*_SCRIPT) + """SELECT row_id, string_agg(CASE op WHEN 'equal' THEN '=' WHEN 'substitution' THEN '~' WHEN 'deletion' THEN '-' ELSE '+' END, '' ORDER BY pos) AS script
  FROM recog JOIN script USING (reference, prediction) GROUP BY row_id""")
def edit_scripts(spark, d):
    """The operations of every row's edit script, a sign each; rows without any step (both texts empty) are left out."""
    sign = F.create_map(*[F.lit(x) for kv in {"equal": "=", "substitution": "~", "deletion": "-", "insertion": "+"}.items() for x in kv])
    script = F.array_join(F.transform(align_text("reference", "prediction", STRICT), lambda s: sign[s["operation"]]), "")
    return recognition(spark, d).select("row_id", script.alias("script")).filter("script <> ''")


def _hash(seed: int, *columns: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"coalesce({c}::VARCHAR, '')" for c in columns) + "))"


_ITEMS = f"""src AS (SELECT system, line_id, language, script_type, row_id AS input_row, {_SPAN_COLUMNS}, reference, prediction FROM recog JOIN spans USING (reference, prediction)),
  h AS (SELECT *, {_hash(SEED, 'input_row', 'span_id', 'system')} AS hh FROM src),
  r AS (SELECT *, row_number() OVER (PARTITION BY system, language ORDER BY hh, input_row, span_id, system) AS rk, greatest(1, 400 // (SELECT count(*) FROM (SELECT DISTINCT system, language FROM src))) AS each FROM h),
  c AS (SELECT * FROM r WHERE rk <= 400 ORDER BY (rk > each)::INT, hh, input_row, span_id, system LIMIT 400)"""


@query(_with(*_SCRIPT, sql.spans("spans", "script", 8), _ITEMS) + f"""SELECT printf('ann_%06d', row_number() OVER (ORDER BY {_hash(SEED + 1, 'input_row', 'span_id', 'system')}, input_row, span_id, system)) AS annotation_id,
  line_id, language, script_type, operation, reference_span, prediction_span, context_before, context_after, possible_repetition, reference, prediction,
  NULL::VARCHAR AS primary_label, NULL::VARCHAR AS secondary_label, NULL::VARCHAR AS annotator, NULL::INT AS confidence, NULL::VARCHAR AS notes FROM c""")
def fidelity_annotation_items(spark, d):
    x = evaluation(spark, d, ["cer"])
    return annotate.prepare_fidelity_annotation(x, keep=["language", "script_type"], strata=["system", "language"], n=400, context=8, seed=SEED).items


@query(_with(sql.RECOG) + """SELECT model, prompt_condition, count(DISTINCT system) AS n_systems FROM recog JOIN (SELECT system, 'all' AS model, coalesce(prompt_condition, 'none') AS prompt_condition FROM systems_manifest) USING (system)
  GROUP BY ALL HAVING count(DISTINCT system) > 1""")
def condition_conflicts(spark, d):
    """Conditions that stand for several systems once all models are taken for one."""
    manifest = table(spark, d, "systems_manifest").select("system", F.lit("all").alias("model"), F.coalesce("prompt_condition", F.lit("none")).alias("prompt_condition"))
    return policy_swap.condition_conflicts(recognition(spark, d).join(F.broadcast(manifest), "system"))


@query(_with(sql.RECOG, sql.evaluated(metrics=("cer",)), _SWAP, _CHANGED) + """SELECT line_id, system_a, system_b, a.model_id AS model_id_a, a.revision AS revision_a, a.prompt_policy AS prompt_policy_a, a.prompt_file AS prompt_file_a,
  b.model_id AS model_id_b, b.revision AS revision_b, b.prompt_policy AS prompt_policy_b, b.prompt_file AS prompt_file_b FROM changed LEFT JOIN systems_manifest a ON a.system = system_a LEFT JOIN systems_manifest b ON b.system = system_b""")
def pair_provenance(spark, d):
    pairs = policy_swap.changed_outputs(_with_models(spark, d), unpaired="drop").select("line_id", "system_a", "system_b")
    return policy_swap.add_provenance(pairs, table(spark, d, "systems_manifest"))


@query(f"SELECT row_id, nullif(array_to_string({sql.tokens('prediction', RELAXED, 'word')}, ' '), NULL) AS words, array_to_string({sql.tokens('prediction', STRICT, 'grapheme')}, '') AS graphemes FROM {PREDICTIONS} WHERE prediction IS NOT NULL")
def collapsed_tokens(spark, d):
    """Token lists put together again, words with spaces, graphemes without."""
    rows = table(spark, d, PREDICTIONS).filter("prediction is not null")
    return rows.select("row_id", collapse_tokens(normalize_and_tokenize("prediction", RELAXED, "word"), "wer").alias("words"), collapse_tokens(normalize_and_tokenize("prediction", STRICT)).alias("graphemes"))


@query("SELECT label, behavior_group, requires_image, " + "CASE label " + " ".join(f"WHEN '{label}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for label, _, text in annotate.CODEBOOK) + " END AS definition FROM fidelity_codebook")
def fidelity_codebook(spark, d):
    """The codebook as annotators get it; labels, groups and flags are those of the table, definitions are this library's own."""
    return annotate.fidelity_codebook(spark)


_LOOSE = "nullif(regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '[\\s-]+', '_', 'g'), '')"
_LABELLED = f"""labelled AS (SELECT annotation_id, lower(trim(annotator)) AS annotator, lower(trim(system)) AS system, {_LOOSE.format(c='primary_label')} AS label,
    row_number() OVER (PARTITION BY annotation_id, lower(trim(annotator)) ORDER BY labelled_at DESC NULLS LAST, loaded_at DESC NULLS LAST, primary_label DESC NULLS LAST) AS rn FROM annotation_items WHERE annotator IS NOT NULL AND annotation_id IS NOT NULL),
  latest AS (SELECT * EXCLUDE (rn) FROM labelled WHERE rn = 1)"""


def _latest_labels(spark, d):
    """The last label of each annotator and item, spelled as in the codebook; what is no label there is null."""
    rows = table(spark, d, "annotation_items").filter("annotator is not null and annotation_id is not null")
    loose = lambda c: F.lower(F.trim(c))
    label = F.regexp_replace(F.lower(F.regexp_replace("primary_label", r"^\s+|\s+$", "")), r"[\s-]+", "_")
    order = [F.desc_nulls_last("labelled_at"), F.desc_nulls_last("loaded_at"), F.desc_nulls_last("primary_label")]
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("annotation_id", loose("annotator")).orderBy(*order))).filter("rn = 1")
    known = F.when(label.isin(*annotate.LABELS), label)
    return rows.select("annotation_id", loose("annotator").alias("annotator"), loose("system").alias("system"), known.alias("primary_label"))


@query(_with(_LABELLED) + """SELECT system, coalesce(c.label, 'unlabelled') AS label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY system), 9) AS proportion
  FROM latest l LEFT JOIN fidelity_codebook c ON l.label = c.label GROUP BY system, coalesce(c.label, 'unlabelled')""")
def fidelity_profile(spark, d):
    return _rounded(annotate.fidelity_profile(_latest_labels(spark, d), include_unlabelled=True), "proportion")


@query(_with(_LABELLED) + """, l AS (SELECT annotation_id, annotator, latest.label FROM latest JOIN fidelity_codebook c ON latest.label = c.label),
  p AS (SELECT a.annotator AS annotator_a, b.annotator AS annotator_b, a.label AS la, b.label AS lb, count(*) AS n FROM l a JOIN l b ON a.annotation_id = b.annotation_id AND a.annotator < b.annotator GROUP BY ALL),
  t AS (SELECT annotator_a, annotator_b, sum(n)::BIGINT AS n_items, coalesce(sum(n) FILTER (la = lb), 0) AS same FROM p GROUP BY ALL),
  e AS (SELECT annotator_a, annotator_b, sum(x.n * y.n) AS e FROM (SELECT annotator_a, annotator_b, la AS l, sum(n) AS n FROM p GROUP BY ALL) x JOIN (SELECT annotator_a, annotator_b, lb AS l, sum(n) AS n FROM p GROUP BY ALL) y USING (annotator_a, annotator_b, l) GROUP BY ALL),
  k AS (SELECT annotator_a, annotator_b, n_items, same::DOUBLE / n_items AS o, coalesce(e, 0)::DOUBLE / (n_items * n_items) AS x FROM t LEFT JOIN e USING (annotator_a, annotator_b))
  SELECT annotator_a, annotator_b, n_items, round(o, 9) AS raw_agreement, round(x, 9) AS expected_agreement, round(CASE WHEN x = 1 THEN CASE WHEN o = 1 THEN 1.0 END ELSE (o - x) / (1 - x) END, 9) AS cohen_kappa FROM k""")
def agreement_kappa(spark, d):
    return _rounded(annotate.pairwise_agreement(_latest_labels(spark, d)), "raw_agreement", "expected_agreement", "cohen_kappa")


_STRATA = f"""src AS (SELECT DISTINCT system, operation, input_row, span_id FROM error_spans),
  h AS (SELECT *, {_hash(SEED, 'input_row', 'span_id', 'system')} AS hh FROM src),
  r AS (SELECT *, row_number() OVER (PARTITION BY system, operation ORDER BY hh, input_row, span_id, system) AS rk, greatest(1, 400 // (SELECT count(*) FROM (SELECT DISTINCT system, operation FROM src))) AS each FROM h),
  c AS (SELECT * FROM r WHERE rk <= 400 ORDER BY (rk > each)::INT, hh, input_row, span_id, system LIMIT 400)"""


@query(_with(_STRATA) + f"SELECT system, operation, input_row, span_id, row_number() OVER (ORDER BY {_hash(SEED + 1, 'input_row', 'span_id', 'system')}, input_row, span_id, system) AS draw FROM c")
def annotation_sample(spark, d):
    spans = table(spark, d, "error_spans").select("system", "operation", "input_row", "span_id").distinct()
    return sampling.stratified_sample(spans, ["system", "operation"], 400, ["input_row", "span_id", "system"], SEED)


_PREF = f"""ph AS (SELECT *, {_hash(SEED, 'model', 'condition_a', 'condition_b', 'document_id', 'line_id')} AS hh FROM changed),
  pr AS (SELECT *, row_number() OVER (PARTITION BY model, condition_a, condition_b ORDER BY hh, model, condition_a, condition_b, document_id, line_id) AS rk,
    greatest(1, 300 // (SELECT count(*) FROM (SELECT DISTINCT model, condition_a, condition_b FROM changed))) AS each FROM ph),
  pc AS (SELECT * FROM pr WHERE rk <= 300 ORDER BY (rk > each)::INT, hh, model, condition_a, condition_b, document_id, line_id LIMIT 300),
  pd AS (SELECT *, row_number() OVER (ORDER BY {_hash(SEED + 1, 'model', 'condition_a', 'condition_b', 'document_id', 'line_id')}, model, condition_a, condition_b, document_id, line_id) AS draw,
    ('0x' || substr({_hash(SEED, "'swap'", 'model', 'condition_a', 'condition_b', 'document_id', 'line_id')}, 1, 8))::BIGINT % 2 = 1 AS swap FROM pc),
  pk AS (SELECT printf('pref_%06d', draw) AS annotation_id, model, CASE WHEN swap THEN condition_b ELSE condition_a END AS condition_A, CASE WHEN swap THEN condition_a ELSE condition_b END AS condition_B,
    CASE WHEN swap THEN system_b ELSE system_a END AS system_A, CASE WHEN swap THEN system_a ELSE system_b END AS system_B, CASE WHEN swap THEN target_rate_b ELSE target_rate_a END AS target_rate_A,
    CASE WHEN swap THEN target_rate_a ELSE target_rate_b END AS target_rate_B, CASE WHEN swap THEN -target_delta_b_minus_a ELSE target_delta_b_minus_a END AS target_delta_B_minus_A FROM pd)"""


def _preferences(spark, d):
    changed = _rounded(policy_swap.changed_outputs(_with_models(spark, d), unpaired="drop"), "target_delta_b_minus_a")
    return preferences.prepare_preference_batch(changed, 300, SEED)


_PREF_CTES = (sql.RECOG, sql.evaluated(metrics=("cer",)), _SWAP, _CHANGED, _PREF)


@query(_with(*_PREF_CTES) + "SELECT * FROM pk")
def preference_key(spark, d):
    return _preferences(spark, d).key


def _unblinded(spark, d):
    """The batch with labels of a pseudo-annotator: a hash of the item decides."""
    batch = _preferences(spark, d)
    choice = F.array(*map(F.lit, preferences.PREFERENCES))[sampling.hash_index(F.lit(4), 1, "annotation_id").cast("int")]
    return preferences.unblind(batch.items.withColumn("preferred_output", choice), batch.key)


_UNBLIND = """lab AS (SELECT *, ['A', 'B', 'tie', 'ambiguous'][1 + ('0x' || substr(md5(concat_ws('|', '1', annotation_id)), 1, 8))::BIGINT % 4] AS pref FROM pk),
  ub AS (SELECT *, CASE pref WHEN 'A' THEN condition_A WHEN 'B' THEN condition_B ELSE pref END AS pc,
    CASE WHEN target_delta_B_minus_A < -1.4901161193847656e-08 THEN 'B' WHEN target_delta_B_minus_A > 1.4901161193847656e-08 THEN 'A' ELSE 'tie' END AS cer FROM lab),
  rel AS (SELECT *, CASE WHEN pref = 'ambiguous' THEN 'ambiguous' WHEN pref = cer THEN 'agree' WHEN pref = 'tie' OR cer = 'tie' THEN 'one_tie' ELSE 'disagree' END AS human_cer_relation,
    least(condition_A, condition_B) AS c1, greatest(condition_A, condition_B) AS c2 FROM ub)"""
_Z = f"{preferences.Z95}::DOUBLE"


@query(_with(*_PREF_CTES, _UNBLIND, """s AS (SELECT model, c1 AS condition_1, c2 AS condition_2, count(*) AS n_labelled, count(*) FILTER (pref IN ('A', 'B')) AS n_decisive, count(*) FILTER (pref = 'tie') AS n_tie,
    count(*) FILTER (pref = 'ambiguous') AS n_ambiguous, count(*) FILTER (pc = c1) AS k1, count(*) FILTER (pc = c2) AS k2,
    count(*) FILTER (pref IN ('A', 'B') AND pref = cer)::DOUBLE / nullif(count(*) FILTER (pref IN ('A', 'B') AND cer IN ('A', 'B')), 0) AS agree, count(*) FILTER (human_cer_relation = 'disagree') AS dis FROM rel GROUP BY ALL),
  w AS (SELECT *, k1::DOUBLE / nullif(n_decisive, 0) AS p FROM s)""") + f"""SELECT model, condition_1, condition_2, n_labelled, n_decisive, n_tie, n_ambiguous, k1 AS condition_1_preferred, k2 AS condition_2_preferred,
  round(p, 9) AS condition_1_preference_rate,
  round(greatest(0.0, (p + {_Z}*{_Z}/(2*n_decisive)) / (1 + {_Z}*{_Z}/n_decisive) - {_Z}*sqrt(p*(1-p)/n_decisive + {_Z}*{_Z}/(4*n_decisive*n_decisive)) / (1 + {_Z}*{_Z}/n_decisive)), 9) AS condition_1_wilson_low,
  round(least(1.0, (p + {_Z}*{_Z}/(2*n_decisive)) / (1 + {_Z}*{_Z}/n_decisive) + {_Z}*sqrt(p*(1-p)/n_decisive + {_Z}*{_Z}/(4*n_decisive*n_decisive)) / (1 + {_Z}*{_Z}/n_decisive)), 9) AS condition_1_wilson_high,
  round(agree, 9) AS human_vs_cer_agreement, dis AS n_human_cer_disagreements FROM w""")
def preference_summary(spark, d):
    out = preferences.preference_summary(_unblinded(spark, d))
    return _rounded(out, "condition_1_preference_rate", "condition_1_wilson_low", "condition_1_wilson_high", "human_vs_cer_agreement")


@query(_with(*_PREF_CTES, _UNBLIND) + "SELECT annotation_id, model, condition_A, condition_B, pref AS preferred_output, cer AS cer_preferred_output FROM rel WHERE human_cer_relation = 'disagree'")
def preference_disagreements(spark, d):
    return preferences.disagreements(_unblinded(spark, d)).select("annotation_id", "model", "condition_A", "condition_B", "preferred_output", "cer_preferred_output")


@query(_with(*_PREF_CTES, _UNBLIND) + "SELECT model, human_cer_relation, count(*) AS n FROM rel GROUP BY ALL")
def human_vs_cer_relation(spark, d):
    return preferences.relation_table(_unblinded(spark, d))


@query(_with(sql.RECOG, "lines AS (SELECT DISTINCT subcorpus, document_id, line_id FROM recog WHERE subcorpus IS NOT NULL AND document_id IS NOT NULL)",
    f"h AS (SELECT *, {_hash(SEED, 'subcorpus', 'document_id', 'line_id')} AS hh, {_hash(SEED, 'subcorpus', 'document_id')} AS hd FROM lines)",
    "l AS (SELECT *, row_number() OVER (PARTITION BY subcorpus, document_id ORDER BY hh, line_id) AS lap FROM h)",
    "p AS (SELECT *, row_number() OVER (PARTITION BY subcorpus ORDER BY lap, hd, document_id, hh, line_id) AS pick FROM l WHERE lap <= 75)") + "SELECT subcorpus, document_id, line_id, lap, pick FROM p WHERE pick <= 500")
def balanced_subset(spark, d):
    lines = recognition(spark, d).filter("subcorpus is not null and document_id is not null").select("subcorpus", "document_id", "line_id").distinct()
    return sampling.balanced_sample(lines, "subcorpus", "document_id", "line_id", 500, 75, SEED).select("subcorpus", "document_id", "line_id", "lap", "pick")


_CONTROLS = """controls AS (SELECT line_id, 'exact' AS system, reference, reference AS prediction FROM lines UNION ALL SELECT line_id, 'nfc_equivalent', reference, nfc_normalize(reference) FROM lines
  UNION ALL SELECT line_id, 'punctuation_dropped', reference, regexp_replace(reference, '\\p{P}', '', 'g') FROM lines)"""


@query(_with(sql.RECOG, "lines AS (SELECT DISTINCT line_id, reference FROM recog)", _CONTROLS, sql.evaluated("controls", metrics=("cer",))) + f"SELECT system, metric, 'micro' AS averaging, round({sql.POOLED}, 9) AS rate, count(*) AS n_rows, count(*) AS n_units, {sql.SUMS} FROM eval GROUP BY system, metric")
def controlled_variant_scores(spark, d):
    lines = recognition(spark, d).select("line_id", "reference").distinct()
    x = evaluate_recognition(controlled_variants(lines).withColumn("input_row", F.xxhash64("line_id", "system")), metrics=["cer"], input_row="input_row")
    return _rounded(summarise_recognition(x, ["system"]), "rate")


@query(f"SELECT 'reference' AS \"column\", count(*) FILTER (reference IS NULL) AS n FROM {PREDICTIONS} UNION ALL SELECT 'prediction', count(*) FILTER (prediction IS NULL) FROM {PREDICTIONS}")
def missing_texts(spark, d):
    return validate.missing_texts(table(spark, d, PREDICTIONS))


@query(f"SELECT line_id, system, count(*) AS n FROM {PREDICTIONS} GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return validate.duplicate_keys(table(spark, d, PREDICTIONS))


@query(f"""SELECT line_id, count(DISTINCT system) AS n_systems, count(DISTINCT reference) AS n_references FROM {PREDICTIONS} GROUP BY line_id
  HAVING count(DISTINCT system) <> (SELECT count(DISTINCT system) FROM {PREDICTIONS}) OR count(DISTINCT reference) <> 1""")
def coverage_gaps(spark, d):
    return validate.coverage(table(spark, d, PREDICTIONS))


@query(f"SELECT count(*) AS n_rows, count(DISTINCT line_id) AS n_lines, count(DISTINCT document_id) AS n_documents, count(DISTINCT system) AS n_systems, {SEED} AS seed FROM {PREDICTIONS}")
def run_manifest(spark, d):
    return validate.run_manifest(table(spark, d, PREDICTIONS), seed=SEED)


@query(_with(sql.RECOG) + """SELECT row_id, system, model, model_family, prompt_policy, prompt_condition, model_id, revision, prompt_file FROM recog LEFT JOIN systems_manifest USING (system)""")
def provenance(spark, d):
    x = policy_swap.attach_manifest(recognition(spark, d), table(spark, d, "systems_manifest"))
    return x.select("row_id", *policy_swap.MANIFEST)


@query("""SELECT model, count(DISTINCT CASE WHEN trim(model_id) <> '' THEN model_id END) AS n_model_ids, count(DISTINCT CASE WHEN trim(revision) <> '' THEN revision END) AS n_revisions,
  count(DISTINCT CASE WHEN trim(model_id) <> '' THEN model_id END) = 1 AND count(DISTINCT CASE WHEN trim(revision) <> '' THEN revision END) = 1 AS frozen
  FROM systems_manifest WHERE prompt_condition IS DISTINCT FROM 'fixed' AND trim(model) <> '' GROUP BY model""")
def frozen_identity(spark, d):
    return policy_swap.frozen_identity(table(spark, d, "systems_manifest"))


@query(f"SELECT system FROM systems_manifest WHERE system NOT IN (SELECT system FROM {PREDICTIONS} WHERE system IS NOT NULL)")
def unused_systems(spark, d):
    return policy_swap.unused_systems(table(spark, d, PREDICTIONS), table(spark, d, "systems_manifest"))


@query(_eval() + """, p AS (SELECT system, metric, sum(n_reference)::DOUBLE AS n, sum(substitutions) AS s, sum(deletions) AS d, sum(insertions) AS i FROM eval GROUP BY system, metric)
  SELECT system AS group_value, metric, error_type, round(rate, 7) AS rate FROM (SELECT system, metric, 'substitution' AS error_type, 100 * s / n AS rate FROM p UNION ALL SELECT system, metric, 'deletion', 100 * d / n FROM p
  UNION ALL SELECT system, metric, 'insertion', 100 * i / n FROM p)""")
def error_profile_plot(spark, d):
    out = plots.error_profile_data(error_profile(evaluation(spark, d), ["system"]), "system")
    return out.withColumn("rate", F.round("rate", 7))


@query(_compare_sql("macro").replace("SELECT metric, '", f"SELECT '{PAIR[1]} - {PAIR[0]}' AS comparison, metric, '").replace("0.95::DOUBLE AS conf_level, n_units, 2000 AS n_boot FROM", "1 AS one FROM")
       .replace(f"'{PAIR[0]}' AS system_a, '{PAIR[1]}' AS system_b, 'macro' AS estimand, round(estimate_a, 9) AS estimate_a, round(estimate_b, 9) AS estimate_b, round(estimate_b - estimate_a, 9) AS difference_b_minus_a, round(conf_low, 9) AS conf_low, round(conf_high, 9) AS conf_high, 1 AS one",
                "round(100 * (estimate_b - estimate_a), 7) AS difference_plot, round(100 * conf_low, 7) AS conf_low_plot, round(100 * conf_high, 7) AS conf_high_plot"))
def comparison_plot(spark, d):
    out = plots.comparison_data(compare.compare_systems(_paired(spark, d), PAIR, n_boot=N_BOOT, seed=SEED))
    return out.withColumns({c: F.round(c, 7) for c in ("difference_plot", "conf_low_plot", "conf_high_plot")})
