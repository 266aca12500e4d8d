"""Queries of intake, matching, controls and judge roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import tokens as tk
from marginalia.functions import values as v
from marginalia.operators import ingest as ig
from marginalia.operators import match as mt
from marginalia.session import table

TARGETS = ("editing_modality", "main_editor_or_system_name", "best_or_selected_variant", "primary_assay_system", "max_editing_efficiency_pct", "main_improvement_claim")
META = ("authors", "publication_year", "title", "journal", "doi")


def filled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "genome_editing_tools_filled").groupBy("row_id").agg(*[F.max(c).alias(c) for c in ("row_index", *META, *TARGETS)])


def cells(spark: SparkSession, d: str) -> DataFrame:
    return ig.target_cells(filled(spark, d), ["row_id"], TARGETS)


def masked(spark: SparkSession, d: str) -> DataFrame:
    return ig.masked(filled(spark, d), TARGETS).select("row_id", "title", "n_masked", *TARGETS)


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return ig.column_profiles(cells(spark, d), "column_name", "current_value")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows with each metadata field."""
    long = ig.target_cells(filled(spark, d), ["row_id"], META)
    return long.groupBy("column_name", "eligibility").agg(F.count("*").alias("n"))


def listed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "schema_columns").where("allowed_values is not null")
    forms = s.select("column_name", F.explode(F.array(F.to_json("allowed_values"), F.array_join("allowed_values", " | "), F.concat(F.array_join("allowed_values", ";"), F.lit(";;")), F.concat_ws(", ", F.lit(""), "allowed_values"))).alias("raw"))
    return forms.select("column_name", "raw", F.expr(f"array_join({ig.listed_values('raw')}, '~')").alias("items"), F.expr(f"cast(size({ig.listed_values('raw')}) as bigint)").alias("n"))


def shuffled(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("row_id", "column_name", F.expr(ig.shuffled_words("coalesce(current_value, '')", "7")).alias("control_value"))


def deranged(spark: SparkSession, d: str) -> DataFrame:
    return ig.deranged(cells(spark, d).where("eligibility = 'filled'"), "column_name", "row_id", "current_value", 7)


def blank(spark: SparkSession, d: str) -> DataFrame:
    return ig.blank_columns(ig.masked(filled(spark, d), TARGETS).withColumn("row_index", F.col("row_index").cast("string")), [*META, *TARGETS])




def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = filled(spark, d)
    papers = rows.selectExpr(
        "row_id as paper_id", "case when row_index % 7 = 0 then reverse(title) when row_index % 5 = 0 then regexp_replace(title, ' [^ ]+$', '') else title end as title", "case when row_index % 7 <> 0 then authors end as authors",
        "case when row_index % 4 = 0 then cast(try_cast(regexp_extract(publication_year, '([0-9]{4})', 1) as int) + 1 as string) else publication_year end as publication_year", "case when row_index % 3 <> 0 and row_index % 7 <> 0 then concat('https://doi.org/', upper(doi)) end as doi",
    )
    return mt.features(papers, "paper_id", "title", "authors", "publication_year", "doi", "p"), mt.features(rows, "row_id", "title", "authors", "publication_year", "doi", "r")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return mt.score_pairs(*_sides(spark, d))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return mt.outcomes(*_sides(spark, d))


def best(spark: SparkSession, d: str) -> DataFrame:
    """The five best rows of each paper."""
    return mt.best_candidates(mt.score_pairs(*_sides(spark, d), best=5))


def appended(spark: SparkSession, d: str) -> DataFrame:
    """New rows for papers without one, numbered behind the last row."""
    last = table(spark, d, "genome_editing_tools_filled").agg(F.max("row_index")).first()[0]
    return mt.append_papers(mt.unmatched(*_sides(spark, d)), int(last or 0))


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return mt.outcome_counts(*_sides(spark, d))


def judges(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts and response modes of each judge."""
    j = table(spark, d, "judge_records").distinct().withColumn("verdict", F.expr(v.plain_text("judge_verdict")))
    return j.groupBy("judge_label").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("verdict") == x).alias(x) for x in ("correct", "incorrect", "unclear")], F.count_if(F.col("verdict").isNull()).alias("none"),
        *[F.count_if(F.col("judge_response_mode") == m).alias(m) for m in ("json_schema", "json_object", "text")], F.count_if("input_was_truncated").alias("truncated"), F.sum("request_tokens").alias("tokens"),
    )


def judge_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For each pair of judges, cells both judged and cells they agree on. Latest usable verdict per judge and cell."""
    j = table(spark, d, "judge_records").withColumn("verdict", F.expr(v.plain_text("judge_verdict"))).where("verdict in ('correct', 'incorrect', 'unclear')")
    j = j.groupBy("run_id", "row_id", "column_name", "judge_label").agg(F.max(F.struct("judged_at", "verdict")).alias("x"))
    # Judges of one cell are few by nature and sorted into one array, whose pairs are made in place
    per = j.groupBy("run_id", "row_id", "column_name").agg(F.array_sort(F.collect_list(F.struct(F.col("judge_label").alias("l"), F.col("x.verdict").alias("v")))).alias("a"))
    made = F.expr("flatten(transform(a, (x, i) -> transform(slice(a, i + 2, size(a)), y -> named_struct('judge_a', x.l, 'judge_b', y.l, 'same', x.v = y.v))))")
    both = per.select(F.inline(made)).groupBy("judge_a", "judge_b").agg(F.count("*").alias("both"), F.count_if("same").alias("agree"))
    return both.withColumn("agreement", F.expr(v.ratio("agree", "both")))


def json_repair(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").selectExpr("event_id", r"case event_id % 4 when 0 then concat('```json\n', replace(props, '}', ',}'), '\n```') when 1 then concat('<think>so {', event_type, '}</think>', props) when 2 then concat('Answer: ', props, ' done') else replace(props, '\"', '') end as raw")
    return raw.select("event_id", F.expr(f"get_json_object({ig.repaired_json('raw')}, '$.k')").alias("k"))


QUERIES = {
    "ingest_cells": cells, "ingest_masked": masked, "column_profiles": profiles, "metadata_coverage": coverage, "listed_values": listed, "control_word_shuffle": shuffled, "control_derangement": deranged, "blank_columns": blank,
    "match_pairs": pairs, "match_outcomes": outcomes, "match_best": best, "match_appended": appended, "match_summary": outcome_counts, "judge_summary": judges, "judge_agreement": judge_pairs, "json_repair": json_repair,
}

D = v.DUCK
_F = f"(SELECT row_id, {', '.join(f'max({c}) AS {c}' for c in ('row_index', *META, *TARGETS))} FROM genome_editing_tools_filled GROUP BY 1)"
_long = lambda cols: " UNION ALL ".join(f"SELECT row_id, '{c}' AS column_name, {c} AS current_value FROM {_F}" for c in cols)
_tidy = lambda x: rf"trim(regexp_replace(coalesce({x}, ''), '[ \t\n\r\f\x0b]+', ' ', 'g'))"
_kind = f"CASE lower({_tidy('current_value')}) WHEN '' THEN 'blank' " + " ".join(f"WHEN '{w}' THEN 'placeholder'" for w in ("n/a", "na", "tbd", "tba", "unknown", "-", "--", "none", "?")) + " ELSE 'filled' END"
_CELLS = f"(SELECT *, {_kind} AS eligibility FROM ({_long(TARGETS)}))"


_P = f"(SELECT row_id AS paper_id, CASE WHEN row_index % 7 = 0 THEN reverse(title) WHEN row_index % 5 = 0 THEN regexp_replace(title, ' [^ ]+$', '') ELSE title END AS title, CASE WHEN row_index % 7 <> 0 THEN authors END AS authors, CASE WHEN row_index % 4 = 0 THEN cast(try_cast(regexp_extract(publication_year, '([0-9]{{4}})', 1) AS INTEGER) + 1 AS VARCHAR) ELSE publication_year END AS publication_year, CASE WHEN row_index % 3 <> 0 AND row_index % 7 <> 0 THEN 'https://doi.org/' || upper(doi) END AS doi FROM {_F})"
_norm = lambda x: rf"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_one = lambda x: rf"trim(regexp_split_to_array({x}, '(?i);|\band\b')[1])"
_family = lambda x: rf"nullif({_norm(rf'CASE WHEN contains({_one(x)}, {chr(39)},{chr(39)}) THEN split_part({_one(x)}, {chr(39)},{chr(39)}, 1) ELSE regexp_extract({_one(x)}, {chr(39)}(\S+)${chr(39)}, 1) END')}, '')"
_DOI = r"CASE WHEN trim(coalesce(doi, '')) <> '' THEN regexp_replace(rtrim(lower(regexp_extract(doi, '(10\.[0-9]{4,9}/[^\s\"<>]+)', 1)), '.,;:)]}>'), '(^10\.1101/.*)v[0-9]+$', '\1') END"


def _features(src: str, key: str, p: str) -> str:
    """Features by DuckDB's own functions; the DOIs of these tables all hold the pattern."""
    names = rf"list_distinct(list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(coalesce(authors, ''), '(?i);|\band\b'), lambda a: trim(a)), lambda a: a <> ''), lambda a: {_family('a')}), lambda a: a IS NOT NULL))"
    whole = f"SELECT {key} AS id, {_DOI} AS doi, {_norm('title')} AS norm, list_distinct(list_filter(string_split({_norm('title')}, ' '), lambda w: w <> '')) AS title, {names} AS names, {_family('authors')} AS first, try_cast(left(regexp_replace(coalesce(publication_year, ''), '[^0-9]', '', 'g'), 4) AS INTEGER) AS year FROM {src}"
    return f"{p}_all AS ({whole}), {p} AS (SELECT min(id) AS id, count(DISTINCT id) AS n, doi, norm, list_sort(title) AS title, list_sort(names) AS names, first, year FROM {p}_all GROUP BY doi, norm, list_sort(title), list_sort(names), first, year)"


_FINAL = "least(1.0, greatest(base, CASE WHEN same_doi AND NOT (shortest > 0 AND j < 0.4 AND inside < 0.6) THEN 0.95 WHEN j >= 0.999 THEN 0.62 + CASE apart WHEN 0 THEN 0.08 WHEN 1 THEN 0.04 ELSE 0 END WHEN shortest >= 6 AND (j >= 0.85 OR inside >= 0.9) THEN 0.68 WHEN j >= 0.75 AND apart = 0 THEN 0.6 ELSE 0 END, CASE WHEN same_first AND overlap > 0 AND apart = 0 AND j >= 0.4 THEN 0.8 ELSE 0 END))::DOUBLE"
_MATCH = f"""{_features(_P, 'paper_id', 'p')}, {_features(_F, 'row_id', 'r')},
  x AS (SELECT p.id AS p_id, r.id AS r_id, r.n AS r_n, r.title AS r_title, r.year AS r_year, coalesce(p.doi = r.doi, false) AS same_doi, len(list_intersect(p.title, r.title)) AS common, least(len(p.title), len(r.title)) AS shortest,
    len(list_distinct(list_concat(p.title, r.title))) AS whole, coalesce(abs(p.year - r.year), 9) AS apart, coalesce(p.first = r.first, false) AS same_first, len(list_intersect(p.names, r.names)) AS shared, len(p.names) AS n_names, p.norm <> '' AND p.norm = r.norm AS exact FROM p, r),
  y AS (SELECT *, CASE WHEN shortest > 0 THEN common / whole ELSE 0 END AS j, CASE WHEN shortest > 0 THEN common / shortest ELSE 0 END AS inside, CASE WHEN n_names > 0 THEN shared / n_names ELSE 0 END AS overlap FROM x),
  z AS (SELECT *, 0.45 * same_doi::INTEGER + 0.3 * j + 0.15 * exact::INTEGER + CASE apart WHEN 0 THEN 0.1 WHEN 1 THEN 0.05 ELSE 0 END + 0.15 * same_first::INTEGER + 0.1 * overlap AS base FROM y WHERE same_doi OR (apart <= 1 AND shared > 0) OR j >= 1 / 3),
  s AS (SELECT p_id, r_id, r_n, r_title, r_year, {v.round6(_FINAL)} AS score FROM z)"""
_OUT = f"""{_MATCH}, b AS (SELECT *, sum(r_n) OVER (PARTITION BY p_id) AS n, row_number() OVER w AS rn, lead(score) OVER w AS nx, lead(r_title) OVER w AS nt, lead(r_year) OVER w AS ny FROM s WINDOW w AS (PARTITION BY p_id ORDER BY score DESC, r_id)),
  t AS (SELECT p_id, r_id, score, n, CASE WHEN r_n > 1 THEN score ELSE coalesce(nx, 0) END AS up, coalesce(CASE WHEN r_n > 1 THEN len(r_title) > 0 AND r_year IS NOT NULL ELSE r_year = ny AND len(list_intersect(r_title, nt)) / len(list_distinct(list_concat(r_title, nt))) >= 0.85 END, false) AS twin FROM b WHERE rn = 1),
  o AS (SELECT a.id AS p_id, r_id, coalesce(score, 0) AS score, {v.round6('coalesce(score, 0) - coalesce(up, 0)')} AS gap, coalesce(t.n, 0)::BIGINT AS n_candidates, coalesce(twin, false) AS twin FROM p_all a JOIN p ON a.doi IS NOT DISTINCT FROM p.doi AND a.norm = p.norm AND list_sort(a.names) = p.names AND a.first IS NOT DISTINCT FROM p.first AND a.year IS NOT DISTINCT FROM p.year LEFT JOIN t ON t.p_id = p.id),
  w AS (SELECT *, CASE WHEN score < 0.35 THEN 'unmatched' WHEN gap < 0.15 AND NOT twin THEN 'ambiguous' ELSE 'matched' END AS oc FROM o)
  SELECT p_id, CASE WHEN oc <> 'unmatched' THEN r_id END AS r_id, score, gap, n_candidates, CASE WHEN oc = 'matched' AND count(*) FILTER (WHERE oc = 'matched') OVER (PARTITION BY r_id) > 1 THEN 'conflict' ELSE oc END AS outcome FROM w"""
_verdict = v.plain_text("judge_verdict", D)
_n = lambda cond: f"count(*) FILTER (WHERE {cond})"
_H = "sha256(concat_ws('|', '7', row_id, column_name))"
_numeric = r"regexp_matches(lower(trim(regexp_replace(current_value, '\s+', ' ', 'g'))), '^(~|≈|about|approx\.|approximately|approx)? *[-+]?([0-9]+(,[0-9]{3})*(\.[0-9]+)?|\.[0-9]+)(e[-+]?[0-9]+)?( *(to|-|–|—) *[-+]?([0-9]+(,[0-9]{3})*(\.[0-9]+)?|\.[0-9]+)(e[-+]?[0-9]+)?)?$')"
ORACLES = {
    "ingest_cells": f"SELECT * FROM {_CELLS}",
    "ingest_masked": f"SELECT row_id, title, {' + '.join(f'CASE WHEN {v.is_empty(c, D)} THEN 0 ELSE 1 END' for c in TARGETS)} AS n_masked, {', '.join(f'{chr(39)}{chr(39)} AS {c}' for c in TARGETS)} FROM {_F}",
    "column_profiles": f"SELECT column_name, filled, distinct_values, {v.ratio('numbers', 'filled')} AS number_share, {v.ratio('chars', 'filled')} AS mean_length, CASE WHEN numbers >= 0.6 * filled THEN 'numeric' WHEN chars <= 20 * filled THEN 'short' WHEN chars <= 80 * filled THEN 'phrase' ELSE 'long' END AS profile FROM (SELECT column_name, count(*) AS filled, count(DISTINCT current_value) AS distinct_values, {_n(_numeric)} AS numbers, sum(length(current_value)) AS chars FROM {_CELLS} WHERE eligibility <> 'blank' GROUP BY 1)",
    "metadata_coverage": f"SELECT column_name, eligibility, count(*) AS n FROM (SELECT *, {_kind} AS eligibility FROM ({_long(META)})) GROUP BY 1, 2",
    "listed_values": "WITH r AS (SELECT column_name, allowed_values AS v, unnest([to_json(allowed_values)::VARCHAR, array_to_string(allowed_values, ' | '), array_to_string(allowed_values, ';') || ';;', ', ' || array_to_string(allowed_values, ', ')]) AS raw FROM schema_columns WHERE allowed_values IS NOT NULL) SELECT column_name, raw, array_to_string(v, '~') AS items, len(v) AS n FROM r",
    "control_word_shuffle": f"SELECT row_id, column_name, {ig.shuffled_words('coalesce(current_value, ' + chr(39) * 2 + ')', '7', D)} AS control_value FROM {_CELLS}",
    "control_derangement": f"WITH c AS (SELECT *, row_number() OVER (ORDER BY trim(current_value), {_H}) - 1 AS i, count(*) OVER () AS n FROM {_CELLS} WHERE eligibility = 'filled'), m AS (SELECT max(k) AS most FROM (SELECT count(*) AS k FROM c GROUP BY trim(current_value))) SELECT a.row_id, a.column_name, a.current_value, b.current_value AS control_value, trim(a.current_value) = trim(b.current_value) AS unchanged FROM c a JOIN m ON true JOIN c b ON b.i = (a.i + most) % a.n",
    "blank_columns": "SELECT unnest([" + ", ".join(f"'{c}'" for c in TARGETS) + "]) AS column_name",
    "match_pairs": f"WITH {_MATCH} SELECT p_id, r_id, score, r_n FROM s",
    "match_best": f"WITH {_MATCH} SELECT * FROM (SELECT p_id, row_number() OVER (PARTITION BY p_id ORDER BY score DESC, r_id)::INTEGER AS rank, r_id, score FROM s) WHERE rank <= 5",
    "match_appended": f"SELECT p_id, (SELECT max(row_index) FROM genome_editing_tools_filled) + row_number() OVER (ORDER BY p_id) AS row_index FROM (WITH {_OUT}) WHERE outcome = 'unmatched'",
    "match_outcomes": f"WITH {_OUT}",
    "match_summary": f"SELECT outcome, count(*) AS n, count(r_id) AS with_row FROM (WITH {_OUT}) GROUP BY 1",
    "judge_summary": f"SELECT judge_label, count(*) AS n, {', '.join(f'{_n(f"vd = {chr(39)}{x}{chr(39)}")} AS {x}' for x in ('correct', 'incorrect', 'unclear'))}, {_n('vd IS NULL')} AS none, {', '.join(f'{_n(f"judge_response_mode = {chr(39)}{m}{chr(39)}")} AS {m}' for m in ('json_schema', 'json_object', 'text'))}, {_n('input_was_truncated')} AS truncated, sum(request_tokens)::BIGINT AS tokens FROM (SELECT DISTINCT *, {_verdict} AS vd FROM judge_records) GROUP BY 1",
    "judge_agreement": f"WITH j AS (SELECT run_id, row_id, column_name, judge_label, {_verdict} AS vd, judged_at FROM judge_records), l AS (SELECT * FROM j WHERE vd IN ('correct', 'incorrect', 'unclear') QUALIFY row_number() OVER (PARTITION BY run_id, row_id, column_name, judge_label ORDER BY judged_at DESC, vd DESC) = 1) SELECT a.judge_label AS judge_a, b.judge_label AS judge_b, count(*) AS both, {_n('a.vd = b.vd')} AS agree, {v.ratio(_n('a.vd = b.vd'), 'count(*)')} AS agreement FROM l a JOIN l b ON a.run_id = b.run_id AND a.row_id = b.row_id AND a.column_name = b.column_name AND a.judge_label < b.judge_label GROUP BY 1, 2",
    "json_repair": "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN json_extract_string(props, '$.k') END AS k FROM events",
}
