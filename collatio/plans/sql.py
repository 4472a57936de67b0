"""SQL for the same results: recognition view, token lists and an edit-distance matrix by nested list_reduce."""

from __future__ import annotations

from collatio.operators.compare import _LOW, MIX_A, MIX_B, OF_REP, OF_SEED
from collatio.policy import EvalPolicy

SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_READABLE = "line_id IS NOT NULL AND system IS NOT NULL AND reference IS NOT NULL AND prediction IS NOT NULL"
RECOG = f"""recog AS (
  SELECT p.* EXCLUDE (reference, rn), r.reference FROM (
    SELECT *, row_number() OVER (PARTITION BY line_id, system ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn
    FROM catmus_medieval_controlled_predictions WHERE {_READABLE}) p
  JOIN (SELECT line_id, min(reference) AS reference FROM catmus_medieval_controlled_predictions WHERE {_READABLE} GROUP BY line_id) r USING (line_id)
  WHERE rn = 1)"""


def normalized(x: str, p: EvalPolicy) -> str:
    if p.unicode == "NFC":
        x = f"nfc_normalize({x})"
    if p.punctuation == "remove":
        x = f"regexp_replace({x}, '\\p{{P}}', '', 'g')"
    if p.whitespace == "collapse":
        x = f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"
    if p.whitespace != "preserve":
        x = f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    return x


def tokens(x: str, p: EvalPolicy, unit: str) -> str:
    x = normalized(x, p)
    if unit == "word":
        return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> '')"
    if unit == "codepoint":
        return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '') END"
    return f"list_transform(range(1, length_grapheme({x}) + 1), lambda i: substring_grapheme({x}, i::INT, 1))"


def counts(name: str, pairs: str, p: EvalPolicy, unit: str) -> str:
    """CTEs that end in name(reference, prediction, n, m, s, d, i, dist), one row for each different pair of texts
    in pairs.  Common ends don't change the counts and are left out of the matrix; a cell packs distance and counts."""
    return f"""{name}_tok AS (SELECT reference, prediction, {tokens('reference', p, unit)} AS a, {tokens('prediction', p, unit)} AS b
   FROM (SELECT DISTINCT reference, prediction FROM {pairs})),
  {name}_pre AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b))) AS p FROM {name}_tok),
  {name}_suf AS (SELECT *, coalesce(list_position(list_transform(range(0, least(len(a), len(b)) - p), lambda i: a[len(a) - i] = b[len(b) - i]), false) - 1, least(len(a), len(b)) - p) AS q FROM {name}_pre),
  {name}_mid AS (SELECT reference, prediction, len(a) AS n, len(b) AS m, a[p + 1:len(a) - q] AS x, b[p + 1:len(b) - q] AS y FROM {name}_suf),
  {name}_dp AS (SELECT reference, prediction, n, m,
   list_reduce(range(1, len(x) + 1), lambda acc, i:
    list_reduce(range(1, len(y) + 1), lambda cur, j: list_append(cur,
      CASE WHEN (acc[j] >> 30) + (x[i] <> y[j])::BIGINT <= (acc[j + 1] >> 30) + 1 AND (acc[j] >> 30) + (x[i] <> y[j])::BIGINT <= (cur[j] >> 30) + 1
                THEN acc[j] + (x[i] <> y[j])::BIGINT * 1074790400
           WHEN (acc[j + 1] >> 30) <= (cur[j] >> 30) THEN acc[j + 1] + 1073742848
           ELSE cur[j] + 1073741825 END),
      [i * 1073742848]),
    list_transform(range(0, len(y) + 1), lambda k: k * 1073741825))[len(y) + 1] AS c FROM {name}_mid),
  {name} AS (SELECT reference, prediction, n, m, (c >> 20) & 1023 AS s, (c >> 10) & 1023 AS d, c & 1023 AS i, c >> 30 AS dist FROM {name}_dp)"""


def scripts(name: str, pairs: str, p: EvalPolicy, unit: str) -> str:
    """CTEs that end in name(reference, prediction, pos, op, r, h, i, j): the edit script of each different pair of texts.

    The whole matrix is kept, but for a common end; the path is read back from its corner, a letter a step."""
    d = "m[acc.i + 1][acc.j + 1]"
    step = (
        f"CASE WHEN acc.i > 0 AND acc.j > 0 AND {d} = m[acc.i][acc.j] + (x[acc.i] <> y[acc.j])::BIGINT THEN CASE WHEN x[acc.i] = y[acc.j] THEN 'E' ELSE 'S' END"
        f" WHEN acc.i > 0 AND {d} = m[acc.i][acc.j + 1] + 1 THEN 'D' ELSE 'I' END"
    )
    return f"""{name}_tok AS (SELECT reference, prediction, {tokens('reference', p, unit)} AS a, {tokens('prediction', p, unit)} AS b FROM (SELECT DISTINCT reference, prediction FROM {pairs})),
  {name}_suf AS (SELECT *, coalesce(list_position(list_transform(range(0, least(len(a), len(b))), lambda k: a[len(a) - k] = b[len(b) - k]), false) - 1, least(len(a), len(b))) AS q FROM {name}_tok),
  {name}_mid AS (SELECT *, a[1:len(a) - q] AS x, b[1:len(b) - q] AS y FROM {name}_suf),
  {name}_dp AS (SELECT *, list_reduce(range(1, len(x) + 1), lambda acc, i: list_append(acc,
      list_reduce(range(1, len(y) + 1), lambda cur, j: list_append(cur, least(acc[i][j] + (x[i] <> y[j])::BIGINT, acc[i][j + 1] + 1, cur[j] + 1)), [i])), [range(0, len(y) + 1)]) AS m FROM {name}_mid),
  {name}_path AS (SELECT reference, prediction, a, b, reverse(list_reduce(range(0, len(x) + len(y)), lambda acc, t: CASE WHEN acc.i = 0 AND acc.j = 0 THEN acc ELSE
      struct_pack(i := acc.i - (({step}) <> 'I')::BIGINT, j := acc.j - (({step}) <> 'D')::BIGINT, s := acc.s || ({step})) END,
      struct_pack(i := len(x)::BIGINT, j := len(y)::BIGINT, s := '')).s) || repeat('E', q) AS ops FROM {name}_dp),
  {name}_steps AS (SELECT *, substr(ops, pos::INT, 1) AS o FROM (SELECT *, unnest(range(1, length(ops) + 1)) AS pos FROM {name}_path)),
  {name}_at AS (SELECT *, sum((o <> 'I')::INT) OVER w AS i, sum((o <> 'D')::INT) OVER w AS j FROM {name}_steps WINDOW w AS (PARTITION BY reference, prediction ORDER BY pos)),
  {name} AS (SELECT reference, prediction, pos, CASE o WHEN 'E' THEN 'equal' WHEN 'S' THEN 'substitution' WHEN 'D' THEN 'deletion' ELSE 'insertion' END AS op,
    CASE WHEN o <> 'I' THEN a[i::INT] END AS r, CASE WHEN o <> 'D' THEN b[j::INT] END AS h, i, j FROM {name}_at)"""


def spans(name: str, script: str, context: int) -> str:
    """CTEs that end in name(reference, prediction, ... the fields of a span): runs of differences of a script of characters."""
    return f"""{name}_run AS (SELECT *, pos - row_number() OVER (PARTITION BY reference, prediction ORDER BY pos) AS run FROM {script} WHERE op <> 'equal'),
  {name}_all AS (SELECT reference, prediction, list(coalesce(r, h) ORDER BY pos) AS shown, list(h ORDER BY pos) FILTER (h IS NOT NULL) AS hyp FROM {script} GROUP BY ALL),
  {name}_agg AS (SELECT reference, prediction, min(pos) AS first, max(pos) AS last, CASE WHEN count(DISTINCT op) = 1 THEN min(op) ELSE 'mixed' END AS operation, string_agg(op, '+' ORDER BY pos) AS operations,
    coalesce(string_agg(r, '' ORDER BY pos), '') AS reference_span, coalesce(string_agg(h, '' ORDER BY pos), '') AS prediction_span, min(i) FILTER (r IS NOT NULL) AS reference_start, max(i) FILTER (r IS NOT NULL) AS reference_end,
    min(j) FILTER (h IS NOT NULL) AS prediction_start, max(j) FILTER (h IS NOT NULL) AS prediction_end, count(*) FILTER (op = 'substitution') AS substitutions, count(*) FILTER (op = 'deletion') AS deletions,
    count(*) FILTER (op = 'insertion') AS insertions, list(h ORDER BY pos) FILTER (h IS NOT NULL) AS hs FROM {name}_run GROUP BY reference, prediction, run),
  {name} AS (SELECT reference, prediction, row_number() OVER (PARTITION BY reference, prediction ORDER BY first)::INT AS span_id, operation, operations, reference_span, prediction_span,
    reference_start::INT AS reference_start, reference_end::INT AS reference_end, prediction_start::INT AS prediction_start, prediction_end::INT AS prediction_end,
    substitutions::INT AS substitutions, deletions::INT AS deletions, insertions::INT AS insertions,
    array_to_string(shown[greatest(1, first - {context}):first - 1], '') AS context_before, array_to_string(shown[last + 1:last + {context}], '') AS context_after,
    operation = 'insertion' AND (coalesce(hyp[greatest(1, prediction_start - len(hs)):prediction_start - 1] = hs, false) OR coalesce(hyp[prediction_start + len(hs):prediction_start + 2 * len(hs) - 1] = hs, false)) AS possible_repetition
    FROM {name}_agg JOIN {name}_all USING (reference, prediction))"""


RATE = "CASE WHEN {n} = 0 THEN ({i})::DOUBLE ELSE ({dist})::DOUBLE / ({n})::DOUBLE END"


def evaluated(source: str = "recog", policy: EvalPolicy | None = None, metrics: tuple[str, ...] = ("cer", "wer"), suffix: str = "") -> str:
    """CTEs that end in eval{suffix}: the rows of source by metric, with rate and counts."""
    p = policy or EvalPolicy()
    parts = [counts(f"{m}{suffix}", source, p.for_metric(m), p.unit(m)) for m in metrics]
    rows = [
        f"SELECT r.*, '{m}' AS metric, {RATE.format(n='n', i='i', dist='dist')} AS rate, n AS n_reference, m AS n_hypothesis, s AS substitutions, d AS deletions, i AS insertions, dist AS distance"
        f" FROM {source} r JOIN {m}{suffix} c ON r.reference = c.reference AND r.prediction = c.prediction"
        for m in metrics
    ]
    return ",\n".join([*parts, f"eval{suffix} AS ({' UNION ALL '.join(rows)})"])


SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("n_reference", "n_hypothesis", "substitutions", "deletions", "insertions", "distance"))
POOLED = RATE.format(n="sum(n_reference)", i="sum(insertions)", dist="sum(distance)")


def mix(x: str, name: str) -> str:
    """Columns that end in name: the draws' hash of the expression x."""
    return (
        f"{x} AS {name}0, (xor({name}0, {name}0 >> 16) * {MIX_A}) & {_LOW} AS {name}1, (xor({name}1, {name}1 >> 15) * {MIX_B}) & {_LOW} AS {name}2, xor({name}2, {name}2 >> 15) AS {name}"
    )


def boot(units: str, groups: str, estimand: str, n_boot: int, seed: int, level: float = 0.95) -> str:
    """CTEs that end in point and ends, from units(groups, u, ref_a, ins_a, dist_a, ref_b, ins_b, dist_b)."""
    one = lambda s: f"(CASE WHEN ref_{s} = 0 THEN ins_{s}::DOUBLE ELSE dist_{s}::DOUBLE / ref_{s} END)"
    if estimand == "macro":
        est, draw = {s: f"avg({one(s)})" for s in "ab"}, {s: f"sum({one(s)} * times) / sum(times)" for s in "ab"}
    else:
        pooled = lambda s, w: f"CASE WHEN sum(ref_{s}{w}) = 0 THEN sum(ins_{s}{w})::DOUBLE ELSE sum(dist_{s}{w})::DOUBLE / sum(ref_{s}{w}) END"
        est, draw = {s: pooled(s, "") for s in "ab"}, {s: pooled(s, " * times") for s in "ab"}
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY u NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY {groups}) AS n_units FROM {units}),
  point AS (SELECT {groups}, {est['a']} AS estimate_a, {est['b']} AS estimate_b, count(*) AS n_units FROM placed GROUP BY ALL),
  bases AS (SELECT n_units, rep, {mix(f'({seed * OF_SEED} + rep * {OF_REP}) & {_LOW}', 'base')} FROM (SELECT n_units, unnest(range(1, {n_boot} + 1)) AS rep FROM (SELECT DISTINCT n_units FROM point))),
  draws AS (SELECT n_units, rep, h % n_units AS pos, count(*) AS times FROM (SELECT n_units, rep, {mix('xor(base, slot)', 'h')} FROM (SELECT n_units, rep, base, unnest(range(1, n_units + 1)) AS slot FROM bases)) GROUP BY ALL),
  reps AS (SELECT {', '.join('placed.' + g.strip() for g in groups.split(','))}, rep, ({draw['b']}) - ({draw['a']}) AS d FROM placed JOIN draws USING (n_units, pos) GROUP BY ALL),
  ends AS (SELECT {groups}, quantile_cont(d, {low}) AS conf_low, quantile_cont(d, {high}) AS conf_high FROM reps GROUP BY {groups})"""
