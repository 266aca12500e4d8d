"""Queries of scoring: typed comparisons, join statuses, and roll-ups over scored cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import values as v
from marginalia.operators import evaluate as ev
from marginalia.session import table

KEY = ("run_id", "row_id", "column_name")
LATEST = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, row_id, column_name ORDER BY written_at DESC) AS rn FROM scored_cells) WHERE rn = 1)"
ABS_TOL, REL_TOL = 0.1, 0.02


def scored(spark: SparkSession, d: str) -> DataFrame:
    return ev.latest(table(spark, d, "scored_cells"), KEY, ["written_at"])


def numeric(spark: SparkSession, d: str) -> DataFrame:
    cells = scored(spark, d).where("field_type = 'numeric'").select(*KEY, "gold_value", "proposed_value")
    return ev.compare_numbers(cells, "gold_value", "proposed_value", ABS_TOL, REL_TOL)


def boolean(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").selectExpr(
        "o_orderkey", "case when o_totalprice > 150000 then 'Yes' else ' no ' end as gold",
        "case when o_orderkey % 7 = 0 then 'not reported' when o_orderkey % 5 = 0 then '?' when o_orderkey % 3 = 0 then 'present' when o_totalprice > 150000 then 'TRUE' else '0' end as proposed",
    )
    return ev.compare_booleans(orders, "gold", "proposed")


def categorical(spark: SparkSession, d: str) -> DataFrame:
    cells = scored(spark, d).where("field_type = 'categorical'").select(*KEY, "gold_value", "proposed_value")
    return ev.compare_categories(cells, table(spark, d, "schema_columns"), "gold_value", "proposed_value").select(*KEY, "is_correct", "failure_class")


def overlap(spark: SparkSession, d: str) -> DataFrame:
    cells = scored(spark, d).where("field_type = 'text'").select(*KEY, "gold_value", "proposed_value")
    return ev.text_overlap(cells, "gold_value", "proposed_value").drop("gold_value", "proposed_value")


def _gold_and_proposals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    long = "stack(3, 'price', cast(cast(o_totalprice as bigint) as string), 'status', o_orderstatus, 'priority', o_orderpriority) as (column_name, value)"
    cells = table(spark, d, "orders").selectExpr("concat('row_', o_orderkey) as row_id", "o_orderkey as k", long)
    gold = cells.selectExpr("row_id", "column_name", "case when k % 17 <> 0 then value end as gold_value", f"{v.stable_id('cell', 'row_id', 'column_name')} as cell_id").where("column_name <> 'priority' or k % 23 <> 0")
    made = cells.where("k % 7 <> 0").selectExpr(
        "row_id", "column_name", "value as proposed_value", f"case when k % 13 = 0 then 'cell_other' else {v.stable_id('cell', 'row_id', 'column_name')} end as cell_id",
        "explode(sequence(1, case when k % 11 = 0 then 2 else 1 end)) as copy", "false as excluded",
    )
    extra = table(spark, d, "orders").where("o_orderkey % 19 = 0").selectExpr("concat('row_', o_orderkey) as row_id", "'notes' as column_name", "'x' as proposed_value", "'cell_x' as cell_id", "1 as copy", "o_orderkey % 2 = 0 as excluded")
    return gold, made.unionByName(extra)


def join_status(spark: SparkSession, d: str) -> DataFrame:
    gold, proposals = _gold_and_proposals(spark, d)
    return ev.join_status(gold, proposals, ["row_id", "column_name"], gold_value="gold_value", cell_id="cell_id", proposed_value="proposed_value", excluded="excluded")


def duplicate_gold(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur more than once, with their number of versions (V1)."""
    return table(spark, d, "scored_cells").groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("written_at").alias("versions")).where("n > 1")


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    filled = table(spark, d, "genome_editing_tools_filled").select("row_index", "title").distinct()
    return filled.selectExpr("row_index", f"{v.stable_id('row', 'row_index', chr(96) + 'title' + chr(96))} as row_key", f"{v.stable_id('cell', v.stable_id('row', 'row_index', 'title'), chr(39) + 'doi' + chr(39))} as cell_key")


def summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.run_summary(scored(spark, d))


def by_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return ev.run_summary(scored(spark, d), ["benchmark_id", "text_model_id"])


def failures(spark: SparkSession, d: str) -> DataFrame:
    return ev.failure_counts(scored(spark, d))


def difficulty(spark: SparkSession, d: str) -> DataFrame:
    return ev.difficulty(scored(spark, d))


QUERIES = {
    "eval_numeric_compare": numeric, "eval_boolean_compare": boolean, "eval_categorical_compare": categorical, "eval_text_overlap": overlap, "eval_join_status": join_status,
    "eval_duplicate_keys": duplicate_gold, "stable_ids": stable_ids, "eval_run_summary": summary, "eval_benchmark_summary": by_benchmark, "eval_failure_counts": failures, "eval_difficulty": difficulty,
}

D = v.DUCK
_ws = lambda x: rf"trim(regexp_replace({x}, '[ \t\n\r\f\x0b]+', ' ', 'g'))"
_N = r"[-+]?(?:[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_words_of = lambda x: rf"trim(regexp_replace(lower({_ws(x)}), '[^0-9a-z]+', ' ', 'g'))"


def _parsed(x: str, p: str) -> str:
    """Columns of a value as a number or range: its tidy text, the text behind a word of approximation, both ends."""
    near = rf"regexp_matches(lower({p}_t), '^(~|≈|about([^0-9a-z_]|$)|approx(\.|imately)?([^0-9a-z_]|$))')"
    bare = rf"CASE WHEN {near} THEN trim(regexp_replace({p}_t, '(?i)^(~|≈|approximately|approx\.|approx|about)', '')) ELSE {p}_t END"
    return f"(SELECT *, try_cast(replace(CASE WHEN {p}_l <> '' THEN {p}_l ELSE {p}_s END, ',', '') AS DOUBLE) AS {p}_x, try_cast(replace(CASE WHEN {p}_l <> '' THEN {p}_r ELSE {p}_s END, ',', '') AS DOUBLE) AS {p}_y FROM (SELECT *, regexp_extract({p}_b, '^({_N}) *(?:to|-|–|—) *{_N}$', 1) AS {p}_l, regexp_extract({p}_b, '^{_N} *(?:to|-|–|—) *({_N})$', 1) AS {p}_r, regexp_extract({p}_b, '^({_N})$', 1) AS {p}_s FROM (SELECT *, {bare} AS {p}_b FROM (SELECT *, {_ws(x)} AS {p}_t FROM "


_ends = ")))) "
_any = lambda pattern: f"(regexp_matches(coalesce(g_t, ''), '{pattern}') OR regexp_matches(coalesce(p_t, ''), '{pattern}'))"
_listed = lambda p: f"(len(regexp_extract_all(coalesce({p}_t, ''), '{_N}')) > 1 AND regexp_matches(coalesce({p}_t, ''), '[,;]') AND NOT regexp_matches(coalesce({p}_t, ''), '{_N} *(?:to|-|–|—) *{_N}'))"
_NUMERIC = f"""WITH a AS (SELECT * FROM {_parsed('gold_value', 'g')} (SELECT * FROM {_parsed('proposed_value', 'p')} (SELECT run_id, row_id, column_name, gold_value, proposed_value FROM {LATEST} WHERE field_type = 'numeric'){_ends}){_ends}),
  b AS (SELECT *, least(g_x, g_y) AS gold_lower, greatest(g_x, g_y) AS gold_upper, least(p_x, p_y) AS proposed_lower, greatest(p_x, p_y) AS proposed_upper FROM a),
  c AS (SELECT *, greatest(proposed_lower - gold_upper, gold_lower - proposed_upper, 0) AS gap, greatest(0.1::DOUBLE, abs((gold_lower + gold_upper) / 2) * 0.02::DOUBLE) AS allowed, greatest(0.2::DOUBLE, abs((gold_lower + gold_upper) / 2) * 0.05::DOUBLE) AS wide FROM b),
  d AS (SELECT *, CASE WHEN gold_lower IS NULL OR proposed_lower IS NULL THEN CASE WHEN {_any('±|[+]/-')} THEN 'numeric_plus_minus_format' WHEN {_any('<|>|≤|≥')} THEN 'numeric_inequality_format' WHEN {_any('%')} OR {_any(_N + ' *[A-Za-zµμ]')} THEN 'numeric_unit_or_percent_format'
    WHEN {_any(_N + ' *(?:to|-|–|—) *' + _N)} THEN 'numeric_range_format' WHEN {_listed('g')} OR {_listed('p')} THEN 'numeric_list_format' ELSE 'numeric_parse_failure' END WHEN gap <= allowed THEN NULL WHEN gap <= greatest(allowed * 2, wide) THEN 'numeric_near_miss' ELSE 'numeric_hard_mismatch' END AS failure_class FROM c)
  SELECT run_id, row_id, column_name, gold_value, proposed_value, gold_lower, gold_upper, proposed_lower, proposed_upper, failure_class, failure_class IS NULL AS is_correct FROM d"""
_plain = lambda x: f"CASE WHEN {_ws(x)} <> '' THEN {_words_of(x)} END"
_list_cue = lambda x: f"(coalesce(regexp_matches(lower({_ws(x)}), '[,;/|]|(^|[^0-9a-z_])and([^0-9a-z_]|$)'), false) AND len(list_filter(string_split(coalesce({_plain(x)}, ''), ' '), lambda w: w <> '')) > 1)"
_bag = lambda x: f"list_distinct(list_filter(string_split(coalesce({_plain(x)}, ''), ' '), lambda w: w <> ''))"
_statuses = ("matched", "missing_proposal", "duplicate_proposals", "cell_id_mismatch", "gold_empty_diagnostic", "excluded_proposal", "unmatched_proposal")


def _summary_sql(by: str) -> str:
    return f"""WITH c AS (SELECT {by}, count(*) AS cells, count(*) FILTER (WHERE is_gold_present) AS gold_present, count(*) FILTER (WHERE was_scored) AS scored, count(*) FILTER (WHERE is_correct) AS correct,
      count(*) FILTER (WHERE is_gold_present AND is_correct) AS gold_correct, count(*) FILTER (WHERE evidence_outcome = 'validated') AS evidence_valid, sum(floor(judge_score_mean * 1000000 + 0.5)) AS judge_ppm, count(judge_score_mean) AS judged,
      {', '.join(f"count(*) FILTER (WHERE join_status = '{s}') AS {s}" for s in _statuses)},
      {', '.join(f"count(*) FILTER (WHERE field_type = '{t}' AND is_correct) AS {t}_correct, count(*) FILTER (WHERE field_type = '{t}' AND was_scored) AS {t}_scored" for t in ('numeric', 'categorical', 'text'))}
      FROM {LATEST} GROUP BY {by})
    SELECT * EXCLUDE (judge_ppm), {v.ratio('gold_correct', 'gold_present')} AS content_correctness, {v.ratio('correct', 'scored')} AS scored_only_correctness, {v.ratio('scored', 'gold_present')} AS coverage,
      {v.ratio('evidence_valid', 'cells')} AS evidence_rate, {v.round6('cast(judge_ppm AS DOUBLE) / 1000000 / nullif(judged, 0)')} AS mean_judge_score,
      {', '.join(f"{v.ratio(f'{t}_correct', f'{t}_scored')} AS {t}_accuracy" for t in ('numeric', 'categorical', 'text'))} FROM c"""


_correct = "count(*) FILTER (WHERE coalesce(is_correct, false))"
ORACLES = {
    "eval_numeric_compare": _NUMERIC,
    "eval_boolean_compare": """SELECT *, failure_class IS NULL AS is_correct FROM (SELECT *, CASE WHEN proposed = 'not reported' THEN 'boolean_unknown_vocabulary' WHEN proposed = '?' THEN 'boolean_unknown_vocabulary' WHEN (gold = 'Yes') = (proposed IN ('present', 'TRUE')) THEN NULL ELSE 'boolean_contradiction' END AS failure_class
        FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'Yes' ELSE ' no ' END AS gold, CASE WHEN o_orderkey % 7 = 0 THEN 'not reported' WHEN o_orderkey % 5 = 0 THEN '?' WHEN o_orderkey % 3 = 0 THEN 'present' WHEN o_totalprice > 150000 THEN 'TRUE' ELSE '0' END AS proposed FROM orders))""",
    "eval_categorical_compare": f"""WITH al AS (SELECT column_name, {_plain('e.key')} AS a, min({_plain('e.value')}) AS t FROM (SELECT column_name, unnest(map_entries(aliases)) AS e FROM schema_columns) GROUP BY ALL),
        ok AS (SELECT column_name, list({_plain('x')}) AS allowed FROM (SELECT column_name, unnest(allowed_values) AS x FROM schema_columns) GROUP BY 1),
        c AS (SELECT run_id, row_id, s.column_name, gold_value, proposed_value, coalesce(ga.t, {_plain('gold_value')}) AS g, coalesce(pa.t, {_plain('proposed_value')}) AS p
          FROM {LATEST} s LEFT JOIN al ga ON ga.column_name = s.column_name AND ga.a = {_plain('gold_value')} LEFT JOIN al pa ON pa.column_name = s.column_name AND pa.a = {_plain('proposed_value')} WHERE field_type = 'categorical')
        SELECT *, failure_class IS NULL AS is_correct FROM (SELECT run_id, row_id, c.column_name, CASE WHEN g = p THEN NULL WHEN {_list_cue('gold_value')} OR {_list_cue('proposed_value')} THEN 'categorical_list_format_mismatch'
          WHEN list_contains(allowed, g) AND list_contains(allowed, p) THEN 'categorical_allowed_value_mismatch' ELSE 'categorical_alias_gap' END AS failure_class FROM c LEFT JOIN ok USING (column_name))""",
    "eval_text_overlap": f"SELECT run_id, row_id, column_name, coalesce({_plain('gold_value')}, '') <> '' AND coalesce({_plain('gold_value')}, '') = coalesce({_plain('proposed_value')}, '') AS exact, len(list_filter(string_split(coalesce({_plain('gold_value')}, ''), ' '), lambda w: w <> '')) AS gold_tokens, len(list_filter(string_split(coalesce({_plain('proposed_value')}, ''), ' '), lambda w: w <> '')) AS proposed_tokens, len(list_intersect({_bag('gold_value')}, {_bag('proposed_value')})) AS common_tokens, CASE WHEN len(list_distinct(list_concat({_bag('gold_value')}, {_bag('proposed_value')}))) > 0 THEN floor(len(list_intersect({_bag('gold_value')}, {_bag('proposed_value')}))::DOUBLE / len(list_distinct(list_concat({_bag('gold_value')}, {_bag('proposed_value')}))) * 1000000 + 0.5) / 1000000 END AS overlap FROM {LATEST} WHERE field_type = 'text'",
    "eval_join_status": f"""WITH cells AS (SELECT concat('row_', o_orderkey) AS row_id, o_orderkey AS k, unnest(['price', 'status', 'priority']) AS column_name, unnest([cast(cast(trunc(o_totalprice) AS BIGINT) AS VARCHAR), o_orderstatus, o_orderpriority]) AS value FROM orders),
        g AS (SELECT row_id, column_name, CASE WHEN k % 17 <> 0 THEN value END AS gold_value, 'cell_' || left(sha256(row_id || '::' || column_name), 12) AS g_cell FROM cells WHERE column_name <> 'priority' OR k % 23 <> 0),
        p AS (SELECT row_id, column_name, value AS proposed_value, CASE WHEN k % 13 = 0 THEN 'cell_other' ELSE 'cell_' || left(sha256(row_id || '::' || column_name), 12) END AS cell_id, false AS excluded, CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END AS copies FROM cells WHERE k % 7 <> 0
          UNION ALL SELECT concat('row_', o_orderkey), 'notes', 'x', 'cell_x', o_orderkey % 2 = 0, 1 FROM orders WHERE o_orderkey % 19 = 0)
        SELECT row_id, column_name, gold_value, proposed_value, coalesce(copies, 0)::BIGINT AS n_proposals, CASE WHEN g_cell IS NULL AND excluded THEN 'excluded_proposal' WHEN g_cell IS NULL THEN 'unmatched_proposal' WHEN trim(coalesce(gold_value, '')) = '' THEN 'gold_empty_diagnostic'
          WHEN copies IS NULL THEN 'missing_proposal' WHEN copies > 1 THEN 'duplicate_proposals' WHEN g_cell IS DISTINCT FROM cell_id THEN 'cell_id_mismatch' ELSE 'matched' END AS join_status FROM g FULL JOIN p USING (row_id, column_name)""",
    "eval_duplicate_keys": "SELECT run_id, row_id, column_name, count(*) AS n, count(DISTINCT written_at) AS versions FROM scored_cells GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "stable_ids": "WITH r AS (SELECT DISTINCT row_index, 'row_' || left(sha256(concat_ws('::', row_index::VARCHAR, title)), 12) AS row_key FROM genome_editing_tools_filled) SELECT row_index, row_key, 'cell_' || left(sha256(row_key || '::doi'), 12) AS cell_key FROM r",
    "eval_run_summary": _summary_sql("run_id"),
    "eval_benchmark_summary": _summary_sql("benchmark_id, text_model_id"),
    "eval_failure_counts": f"SELECT benchmark_id, column_name, join_status, coalesce(failure_attribution, 'none') AS attribution, count(*) AS n, sum(count(*)) OVER (PARTITION BY benchmark_id, column_name)::BIGINT AS total, {v.ratio('count(*)', 'sum(count(*)) OVER (PARTITION BY benchmark_id, column_name)')} AS share FROM {LATEST} GROUP BY 1, 2, 3, 4",
    "eval_difficulty": f"SELECT benchmark_id, column_name, candidate_id, count(*) AS cells, {_correct} AS correct, count(*) FILTER (WHERE join_status = 'missing_proposal') AS missing, count(*) FILTER (WHERE join_status IN ('duplicate_proposal', 'duplicate_proposals')) AS duplicates, count(DISTINCT run_id) AS runs, grouping(candidate_id) = 1 AS over_candidates, {v.ratio(_correct, 'count(*)')} AS correctness FROM {LATEST} GROUP BY GROUPING SETS ((benchmark_id, column_name), (benchmark_id, column_name, candidate_id))",
}
