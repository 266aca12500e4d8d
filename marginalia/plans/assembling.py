"""Queries of records put together from several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import assemble as am
from marginalia.operators import study as st
from marginalia.plans import passages, studies
from marginalia.session import table


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "proposals").select("proposal_id", "row_id", "column_name", "pdf_id").distinct()


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """Cells with paper, text and column, and what is missing."""
    g = table(spark, d, "genome_editing_tools_filled").where("row_id is not null").groupBy("row_id").agg(F.max("row_index").alias("i"))
    matches = g.selectExpr("row_id", "concat('paper_', i % 40) as doc", "case when i % 6 = 0 then 'unmatched' else 'matched' end as outcome")
    docs = spark.range(40).selectExpr("concat('paper_', id) as doc", "case when id % 4 <> 0 then 'text' end as text").where("doc <> 'paper_7'")
    schema = table(spark, d, "schema_columns").selectExpr("column_name", "case when length(column_name) % 3 <> 0 then field_type end as description")
    cells = _cells(spark, d).select("proposal_id", "row_id", "column_name").join(g.select("row_id"), "row_id", "left_semi")
    return am.extraction_inputs(cells, matches, docs, schema, row="row_id", doc="doc", column="column_name").select("proposal_id", "doc", F.array_join("warnings", ",").alias("warnings"))


def context(spark: SparkSession, d: str) -> DataFrame:
    """Context of a proposal from its row, else its paper."""
    rows = table(spark, d, "genome_editing_tools_filled").where("row_id is not null and row_index % 2 = 0").select("row_id", F.col("title").alias("label"), F.col("publication_year").alias("year"))
    papers = passages.chunks(spark, d).where("chunk_type = 'section'").select("pdf_id", F.col("display_text").alias("label"), F.col("page_number").cast("string").alias("year"))
    return am.with_context(_cells(spark, d).select("proposal_id", "row_id", "pdf_id"), rows, papers, row="row_id", doc="pdf_id", fields=["label", "year"]).select("proposal_id", "label", "year", "context_source")


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of a paper by precedence of its sources (V9)."""
    c = passages.chunks(spark, d)
    year = F.expr(r"regexp_extract(display_text, r'((?:19|20)[0-9][0-9])', 1)")
    found = c.select("pdf_id", F.lit("year").alias("field"), year.alias("value"), F.expr("case chunk_type when 'section' then 'parser' when 'abstract' then 'front_matter' else 'full_text' end").alias("source"))
    return am.resolved_metadata(found, "pdf_id", "field", "value", "source", ["parser", "front_matter", "full_text"])


def synthetic(spark: SparkSession, d: str) -> DataFrame:
    """Proposals of cells that were not tried."""
    cells = _cells(spark, d).withColumn("reason", F.expr("case length(column_name) % 5 when 0 then 'schema_not_applicable' when 1 then 'column_excluded' when 2 then 'pdf_unmatched' end"))
    return am.synthetic_proposals(cells, ["proposal_id"], "reason").withColumn("reason_codes", F.array_join("reason_codes", ","))


def figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures named by a plan, unknown ones left out."""
    c = passages.chunks(spark, d)
    named = c.where("chunk_type in ('caption', 'section')").groupBy("pdf_id").agg(F.reverse(F.array_sort(F.collect_set("chunk_id"))).alias("ids"))
    known = c.where("chunk_type = 'caption'").select("pdf_id", "chunk_id", "page_number")
    return am.chosen_figures(named, known, doc="pdf_id", ids="ids", figure="chunk_id").select("pdf_id", "chunk_id", "ordinal", "page_number")


def resumed(spark: SparkSession, d: str) -> DataFrame:
    """Candidates a resumed study has to run, the next batch of them."""
    grid = table(spark, d, "supplier").selectExpr("s_suppkey as candidate", "s_nationkey as knob").distinct()
    done = table(spark, d, "lineitem").selectExpr("l_suppkey as candidate", "l_returnflag = 'R' and l_linenumber = 7 as failed")
    left = am.remaining(grid, done.groupBy("candidate").agg(F.count_if("failed").alias("n")), "candidate", F.col("n") < 3, F.col("knob") % 5 != 0)
    return am.next_batch(left, grid.where("knob = 7"), ["candidate", "knob"], 12)


def stages(spark: SparkSession, d: str) -> DataFrame:
    """Time per stage and its share."""
    e = table(spark, d, "events").selectExpr("user_id % 10 as run", "event_type as stage", "cast(floor(value) as bigint) as ms")
    return am.stage_times(e, ["run"], "stage", "ms")


def counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of cells summed per run."""
    s = table(spark, d, "scored_cells").select("run_id", "row_id", "column_name", "join_status", "is_correct", "gold_value").distinct()
    m = F.create_map(F.lit("seen"), F.lit(1), F.concat(F.lit("join_"), F.coalesce("join_status", F.lit("none"))), F.lit(1), F.lit("gold_chars"), F.coalesce(F.length("gold_value"), F.lit(0)))
    return am.rolled_up(s.withColumn("m", m), ["run_id"], "m")


def front(spark: SparkSession, d: str) -> DataFrame:
    """The first passages of the first two pages."""
    c = passages.chunks(spark, d).where("reading_order is not null").withColumn("o", F.struct("reading_order", "chunk_id"))
    return am.first_blocks(c, "pdf_id", "page_number", "o", "display_text").select("pdf_id", "chunk_id", "place")


def bullets(spark: SparkSession, d: str) -> DataFrame:
    """Reasons as lists."""
    t = table(spark, d, "part").selectExpr("p_partkey as k", r"case p_partkey % 4 when 0 then concat('1. ', p_name, '\n\n* ', p_brand) when 1 then concat(p_name, '. Then ', p_brand, '!') when 2 then ' ' else p_name end as reason")
    return t.select("k", am.bulleted("reason").alias("listed"))


def handoff(spark: SparkSession, d: str) -> DataFrame:
    """What the runs hand over."""
    p = table(spark, d, "proposals").select("proposal_id", "run_id", "proposal_status").distinct()
    return am.handoff_counts(p, table(spark, d, "evidence").select("proposal_id", "evidence_id").distinct(), ["run_id"])


def board(spark: SparkSession, d: str) -> DataFrame:
    """A board that shows controls but ranks the others."""
    r = studies.replicates(spark, d).groupBy("candidate_id").agg(F.max("prompt").alias("prompt"), F.max("model").alias("model"), F.expr("floor(sum(score) / count(score) * 1000000 + 0.5) / 1000000").alias("score"))
    return am.shown_board(r, st.is_control("candidate_id", "prompt", "model"), "score", ["candidate_id"]).select("candidate_id", "score", "is_control", "rank", "is_winner")


QUERIES = {
    "extraction_inputs": inputs, "proposal_context": context, "metadata_precedence": metadata, "synthetic_proposals": synthetic, "chosen_figures": figures, "resumed_batch": resumed, "stage_times": stages, "counter_rollup": counters, "front_blocks": front, "bulleted_reasons": bullets, "handoff_counts": handoff, "study_board": board,
}

_C = passages._C
_P = "(SELECT DISTINCT proposal_id, row_id, column_name, pdf_id FROM proposals)"
ORACLES = {
    "extraction_inputs": f"WITH g AS (SELECT row_id, max(row_index) AS i FROM genome_editing_tools_filled WHERE row_id IS NOT NULL GROUP BY 1), c AS (SELECT p.proposal_id, CASE WHEN i % 6 <> 0 THEN 'paper_' || (i % 40) END AS doc, i % 40 AS j, p.column_name FROM {_P} p JOIN g USING (row_id)), s AS (SELECT column_name, max(CASE WHEN length(column_name) % 3 <> 0 THEN field_type END) AS description FROM schema_columns GROUP BY 1) SELECT proposal_id, doc, concat_ws(',', CASE WHEN doc IS NULL THEN 'row_without_paper' END, CASE WHEN doc IS NOT NULL AND (j % 4 = 0 OR j = 7) THEN 'paper_without_text' END, CASE WHEN description IS NULL THEN 'column_without_description' END) AS warnings FROM c LEFT JOIN s USING (column_name)",
    "proposal_context": f"WITH r AS (SELECT row_id, max(title) AS label, max(publication_year) AS year FROM genome_editing_tools_filled WHERE row_id IS NOT NULL AND row_index % 2 = 0 GROUP BY 1), q AS (SELECT pdf_id, max(display_text) AS label, max(page_number::VARCHAR) AS year FROM {_C} WHERE chunk_type = 'section' GROUP BY 1), j AS (SELECT p.proposal_id, nullif(trim(r.label), '') AS rl, nullif(trim(r.year), '') AS ry, nullif(trim(q.label), '') AS ql, nullif(trim(q.year), '') AS qy, r.label AS a, r.year AS b, q.label AS c, q.year AS d FROM {_P} p LEFT JOIN r USING (row_id) LEFT JOIN q USING (pdf_id)) SELECT proposal_id, CASE WHEN rl IS NOT NULL THEN a WHEN ql IS NOT NULL THEN c END AS label, CASE WHEN ry IS NOT NULL THEN b WHEN qy IS NOT NULL THEN d END AS year, CASE WHEN coalesce(rl, ry) IS NOT NULL THEN 'row' WHEN coalesce(ql, qy) IS NOT NULL THEN 'paper' ELSE 'none' END AS context_source FROM j",
    "metadata_precedence": f"WITH f AS (SELECT pdf_id, regexp_extract(display_text, '((?:19|20)[0-9][0-9])', 1) AS v, CASE chunk_type WHEN 'section' THEN 1 WHEN 'abstract' THEN 2 ELSE 3 END AS o FROM {_C}), g AS (SELECT pdf_id, o, count(DISTINCT v) AS n, min(v) AS v FROM f WHERE v <> '' GROUP BY 1, 2), b AS (SELECT pdf_id, min(o) FILTER (WHERE n = 1) AS o, max(n) AS most FROM g GROUP BY 1) SELECT d.pdf_id, 'year' AS field, g.v AS value, CASE b.o WHEN 1 THEN 'parser' WHEN 2 THEN 'front_matter' WHEN 3 THEN 'full_text' END AS source, CASE WHEN b.o IS NOT NULL THEN 'found' WHEN b.most > 1 THEN 'ambiguous' ELSE 'missing' END AS state FROM (SELECT DISTINCT pdf_id FROM f) d LEFT JOIN b ON b.pdf_id = d.pdf_id LEFT JOIN g ON g.pdf_id = d.pdf_id AND g.o = b.o",
    "synthetic_proposals": f"SELECT proposal_id, CASE length(column_name) % 5 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'not_attempted' ELSE 'unresolved' END AS proposal_status, CASE WHEN length(column_name) % 5 = 2 THEN 'no_evidence' ELSE 'not_applicable' END AS evidence_status, 'diagnostic' AS review_bucket, CASE length(column_name) % 5 WHEN 0 THEN 'schema_not_applicable' WHEN 1 THEN 'column_excluded' ELSE 'pdf_unmatched' END AS reason_codes, NULL::VARCHAR AS proposed_value FROM {_P} WHERE length(column_name) % 5 < 3",
    "chosen_figures": f"WITH n AS (SELECT pdf_id, chunk_id, chunk_type, page_number, row_number() OVER (PARTITION BY pdf_id ORDER BY chunk_id DESC) - 1 AS ordinal FROM {_C} WHERE chunk_type IN ('caption', 'section')) SELECT pdf_id, chunk_id, ordinal::INTEGER AS ordinal, page_number FROM n WHERE chunk_type = 'caption'",
    "resumed_batch": "SELECT s_suppkey AS candidate, s_nationkey AS knob FROM supplier WHERE s_nationkey % 5 <> 0 AND s_nationkey <> 7 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber = 7) < 3) ORDER BY 1, 2 LIMIT 12",
    "stage_times": "SELECT run, stage, ms, runs, CASE WHEN sum(ms) OVER (PARTITION BY run) > 0 THEN floor(ms::DOUBLE / sum(ms) OVER (PARTITION BY run) * 1000000 + 0.5) / 1000000 END AS share FROM (SELECT user_id % 10 AS run, event_type AS stage, sum(floor(value)::BIGINT)::BIGINT AS ms, count(*) AS runs FROM events GROUP BY 1, 2)",
    "counter_rollup": "WITH s AS (SELECT DISTINCT run_id, row_id, column_name, join_status, is_correct, gold_value FROM scored_cells), u AS (SELECT run_id, 'seen' AS counter, 1 AS n FROM s UNION ALL SELECT run_id, 'join_' || coalesce(join_status, 'none'), 1 FROM s UNION ALL SELECT run_id, 'gold_chars', coalesce(length(gold_value), 0) FROM s) SELECT run_id, counter, sum(n)::BIGINT AS n, count(*) FILTER (WHERE n > 0) AS cells FROM u GROUP BY 1, 2",
    "front_blocks": f"SELECT * FROM (SELECT pdf_id, chunk_id, row_number() OVER (PARTITION BY pdf_id ORDER BY page_number, reading_order, chunk_id)::INTEGER AS place FROM {_C} WHERE reading_order IS NOT NULL AND page_number <= 2 AND trim(coalesce(display_text, '')) <> '') WHERE place <= 40",
    "bulleted_reasons": "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '- ' || p_name || chr(10) || '- ' || p_brand WHEN 1 THEN '- ' || p_name || '.' || chr(10) || '- Then ' || p_brand || '!' WHEN 3 THEN '- ' || p_name END AS listed FROM part",
    "handoff_counts": "WITH e AS (SELECT proposal_id, count(DISTINCT evidence_id) AS n FROM evidence GROUP BY 1) SELECT run_id, count(*) AS proposals, count(*) FILTER (WHERE proposal_status = 'value_proposed') AS valued, count(*) FILTER (WHERE proposal_status = 'value_proposed' AND n IS NULL) AS valued_without_evidence, coalesce(sum(n), 0)::BIGINT AS evidence, count(*) FILTER (WHERE proposal_status = 'value_proposed' AND n IS NULL) > 0 AS warned FROM (SELECT DISTINCT proposal_id, run_id, proposal_status FROM proposals) LEFT JOIN e USING (proposal_id) GROUP BY 1",
    "study_board": f"WITH c AS (SELECT candidate_id, floor(sum(score)::DOUBLE / count(score) * 1000000 + 0.5) / 1000000 AS score, candidate_id LIKE 'ext%' AS is_control FROM {studies._RP} GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY is_control ORDER BY score DESC NULLS LAST, candidate_id) AS n FROM c) SELECT candidate_id, score, is_control, CASE WHEN NOT is_control AND score IS NOT NULL THEN n END::INTEGER AS rank, NOT is_control AND score IS NOT NULL AND n = 1 AS is_winner FROM r",
}
