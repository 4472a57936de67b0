"""The queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collatio.llm import (
    p01_overlap,
    p02_forms,
    p03_truncation,
    p04_repetition,
    p05_consensus,
    p06_sampling,
    p07_encoding,
    p08_mixing,
    p09_residue,
)
from collatio.sources import table

PREDICTIONS = "catmus_medieval_controlled_predictions"


def _predictions(spark, d):
    return table(spark, d, PREDICTIONS)


def _documents(spark, d):
    return table(spark, d, "documents")


def p1_found(spark, d):
    return p01_overlap.found(_predictions(spark, d))


def p1_by_split(spark, d):
    return p01_overlap.report(_predictions(spark, d))


def p1_links(spark, d):
    return p01_overlap.links(_predictions(spark, d))


def p2_found(spark, d):
    return p02_forms.found(_predictions(spark, d))


def p2_normalized(spark, d):
    df = _predictions(spark, d).select("row_id", "reference", "prediction")
    return p02_forms.with_forms(df, {"reference": "reference_form", "prediction": "prediction_form"}).select("row_id", "reference_form", "prediction_form")


def p3_found(spark, d):
    return p03_truncation.found(_predictions(spark, d))


def p3_by_system(spark, d):
    return p03_truncation.report(_predictions(spark, d))


def p4_found(spark, d):
    return p04_repetition.found(_predictions(spark, d))


def p4_shares(spark, d):
    return p04_repetition.ledger(_predictions(spark, d), table(spark, d, "error_spans"))


def p4_ablation(spark, d):
    return p04_repetition.ablation(p4_shares(spark, d))


def p5_found(spark, d):
    return p05_consensus.found(table(spark, d, "annotation_items"), table(spark, d, "fidelity_codebook"))


def p5_consensus(spark, d):
    return p05_consensus.consensus(table(spark, d, "annotation_items"), table(spark, d, "fidelity_codebook"))


def p5_annotators(spark, d):
    return p05_consensus.annotators(table(spark, d, "annotation_items"), table(spark, d, "fidelity_codebook"))


def _sampling(spark, d):
    return table(spark, d, "sample_targets"), table(spark, d, "annotation_items"), _predictions(spark, d)


def p6_found(spark, d):
    return p06_sampling.found(*_sampling(spark, d))


def p6_sample(spark, d):
    return p06_sampling.sample(*_sampling(spark, d))


def p6_report(spark, d):
    return p06_sampling.report(*_sampling(spark, d))


def p7_ids(spark, d):
    return p07_encoding.encoded(_documents(spark, d))


def p7_by_source(spark, d):
    return p07_encoding.report(_documents(spark, d))


def p8_found(spark, d):
    return p08_mixing.found(_documents(spark, d), table(spark, d, "mix_targets"))


def p8_mixture(spark, d):
    return p08_mixing.mixed(_documents(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return p08_mixing.shares(p8_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_attainable(spark, d):
    """The shares at the largest budget that no source with documents falls short of."""
    return p08_mixing.shares(p08_mixing.mixed(_documents(spark, d), table(spark, d, "mix_targets"), budget="attainable"), table(spark, d, "mix_targets"))


def p9_found(spark, d):
    return p09_residue.found(_documents(spark, d))


def p9_residue(spark, d):
    return p09_residue.examined(_documents(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_by_split, p1_links, p2_found, p2_normalized, p3_found, p3_by_system, p4_found, p4_shares, p4_ablation, p5_found, p5_consensus, p5_annotators,
        p6_found, p6_sample, p6_report, p7_ids, p7_by_source, p8_found, p8_mixture, p8_shares, p8_attainable, p9_found, p9_residue,
    )
}
_L = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_P6_COUNTS = f"""WITH t AS (SELECT *, {_L.format("system")} AS s, {_L.format("language")} AS l, {_L.format("script_type")} AS c,
    bool_or(system IS NOT NULL) OVER w AS by_s, bool_or(script_type IS NOT NULL) OVER w AS by_c FROM sample_targets WINDOW w AS (PARTITION BY plan_id)),
  spans AS (SELECT annotation_id, min({_L.format("system")}) AS s FROM annotation_items WHERE annotation_id IS NOT NULL AND system IS NOT NULL GROUP BY 1),
  lines AS (SELECT line_id, min({_L.format("language")}) AS l FROM {PREDICTIONS} WHERE line_id IS NOT NULL AND language IS NOT NULL GROUP BY 1),
  both_ AS (SELECT line_id, min([{_L.format("language")}, {_L.format("script_type")}]) AS lc FROM {PREDICTIONS} WHERE line_id IS NOT NULL AND language IS NOT NULL AND script_type IS NOT NULL GROUP BY 1),
  n AS (SELECT t.*, CASE WHEN by_s THEN (SELECT count(*) FROM spans) WHEN by_c THEN (SELECT count(*) FROM both_) ELSE (SELECT count(*) FROM lines) END AS pool,
    CASE WHEN by_s THEN (SELECT count(*) FROM spans x WHERE x.s = t.s) WHEN by_c THEN (SELECT count(*) FROM both_ x WHERE x.lc = [t.l, t.c]) ELSE (SELECT count(*) FROM lines x WHERE x.l = t.l) END AS ids FROM t)"""
ORACLE: dict[str, str] = {
    "p6_found": _P6_COUNTS + " SELECT target_id FROM n WHERE ids < min_rows OR ids * 100000 < pool_percent * target_permille * pool",
}
