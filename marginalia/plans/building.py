"""Queries of passage building, query expansion, index reuse and record checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import checks as ck
from marginalia.operators import retrieve as rt
from marginalia.operators import review as rv
from marginalia.plans import passages
from marginalia.session import spread, table

ANSWER = {
    "type": "object", "required": ["state", "amount", "notes", "sure"],
    "properties": {"state": {"type": "string", "enum": ["found", "inferred", "unclear"]}, "amount": {"type": ["integer", "null"]}, "proposed_value": {"type": ["string", "null"]}, "notes": {"type": "array", "items": {"type": "string"}}, "sure": {"type": "boolean"}},
}


def expanded(spark: SparkSession, d: str) -> DataFrame:
    """Requests with hint terms."""
    s = table(spark, d, "schema_columns").select("column_name", F.concat_ws(" ", F.lit("the"), "field_type", F.lit("design of a library"), F.when(F.col("field_type") == "number", "variant")).alias("description")).distinct()
    return rt.expanded_queries(s, "column_name", "description").select("column_name", F.array_join("tags", ",").alias("tags"), F.array_join("hint_terms", " ").alias("hints"), "query_text")


def built(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the blocks of each document, with kind and section."""
    typed = rt.blocks(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    out = rt.passages_of_blocks(typed, "doc_id", "reading_order", "block", "block_type", "section")
    return out.select("doc_id", "reading_order", "chunk_type", "section_context", F.md5("display_text").alias("display_md5"), F.md5("retrieval_text").alias("retrieval_md5"))


def figures(spark: SparkSession, d: str) -> DataFrame:
    """Passages of figures, sections standing in for figures and captions for their blocks."""
    c = passages.chunks(spark, d)
    f = c.where("chunk_type = 'section'").select("pdf_id", F.col("chunk_id").alias("figure_id"), F.when(F.col("reading_order") % 2 == 0, F.col("display_text")).alias("caption_text"), (F.col("reading_order") + 1).alias("caption_block_id"), F.col("section_context").alias("nearby_text"))
    own = c.where("chunk_type = 'caption' and reading_order is not null").select("pdf_id", F.col("reading_order").alias("block_id"), F.col("display_text").alias("text"))
    return rt.figure_passages(f, own, "pdf_id").select("pdf_id", "figure_ref", "display_text", F.md5("retrieval_text").alias("retrieval_md5"))


def index_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which documents an index of an earlier state can keep (R5): there some lacked a passage and others were not there."""
    now = rt.indexed_passages(passages.chunks(spark, d), "chunk_type").select("pdf_id", "chunk_id", "retrieval_text")
    before = now.where("conv(left(md5(chunk_id), 2), 16, 10) % 16 <> 0 and conv(left(md5(pdf_id), 2), 16, 10) % 5 <> 0").unionByName(now.where("conv(left(md5(pdf_id), 2), 16, 10) % 7 = 0").withColumn("pdf_id", F.concat(F.lit("old_"), "pdf_id")))
    return rt.index_plan(rt.fingerprints(now, "pdf_id", "chunk_id", "retrieval_text"), rt.fingerprints(before, "pdf_id", "chunk_id", "retrieval_text"), "pdf_id")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers coerced and checked by a schema."""
    raw = table(spark, d, "events").selectExpr("event_id", """case event_id % 6 when 0 then concat('{"state": "YES", "amount": "', user_id, '", "notes": ["a", 5]}') when 1 then '{"state": null, "amount": 1.5}' when 2 then '{"amount": null, "state": "possible", "proposed_value": {"text": " x "}}'
        when 3 then '{"state": "propose value", "proposed_value": "v", "sure": true, "notes": []}' when 4 then '{"state": "maybe"}' else 'no json' end as raw""")
    return ck.validated_json(raw, "raw", ANSWER).select("event_id", "json", "error")


def schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the rows of the schema."""
    s = table(spark, d, "schema_columns").selectExpr("column_name", "case when length(column_name) % 3 <> 0 then column_name end as description", "case when length(column_name) % 5 = 0 then 'colour' else field_type end as field_type", "case when length(column_name) % 2 = 0 then coalesce(allowed_values, array('x')) end as allowed_values")
    return s.select("column_name", F.array_join(ck.schema_errors("column_name", "description", "field_type", "allowed_values"), ",").alias("errors"))


def generic(spark: SparkSession, d: str) -> DataFrame:
    """Texts that would fit any value."""
    t = table(spark, d, "part").selectExpr("p_partkey as k", "case p_partkey % 5 when 0 then concat('Supported by the  provided evidence', '.') when 1 then concat(p_name, ' is recorded because the cited page says so') when 2 then ' ' else p_name end as reason")
    return t.select("k", ck.is_generic("reason").alias("generic"))


def types(spark: SparkSession, d: str) -> DataFrame:
    """Types by which the values of scored cells are compared."""
    s = table(spark, d, "scored_cells").select("run_id", "row_id", "column_name", "gold_value", "proposed_value", "field_type").distinct()
    typed = s.withColumn("declared", F.when(F.col("field_type") == "text", F.lit("text"))).withColumn("allowed", F.when(F.col("field_type") == "categorical", F.array(F.lit("x"))))
    return typed.groupBy("field_type", ck.inferred_type("gold_value", "proposed_value", "declared", "allowed").alias("compared_as")).agg(F.count("*").alias("n"))


STATUSES = ("value_proposed", "no_data", "unresolved", "error")


def package_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the proposals break as a package (V5)."""
    p = table(spark, d, "proposals").select("proposal_id", "row_id", "column_name", "proposal_status", "review_bucket")
    e = table(spark, d, "evidence").select("evidence_id", "proposal_id", "page_number")
    rows = table(spark, d, "genome_editing_tools_filled").select("row_id").where("row_id is not null")
    columns = table(spark, d, "schema_columns").where("field_type <> 'text'").select("column_name")
    out = ck.package_errors(p, e, rows, columns, {"proposal_status": STATUSES, "review_bucket": ("review", "attention")})
    return out.groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def one_record(spark: SparkSession, d: str) -> DataFrame:
    """The first proposal that has most evidence, with its decisions and evidence."""
    e = table(spark, d, "evidence").select("proposal_id", "evidence_rank", "evidence_id")
    top = e.distinct().groupBy("proposal_id").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("o"), "proposal_id"))["proposal_id"]).first()[0]
    p = table(spark, d, "proposals").select("proposal_id", "column_name")
    ledger = table(spark, d, "proposals").select("proposal_id", "created_at", "proposal_status")
    r = rv.record_of(p, ledger, e, "proposal_id", top or "", at=["created_at"], rank="evidence_rank")
    return r.select("proposal_id", "column_name", F.size("history").alias("n_history"), F.array_join(F.transform("evidence", lambda x: x["evidence_id"]), ",").alias("evidence_ids"))


QUERIES = {"package_errors": package_errors, "one_record": one_record, "expanded_queries": expanded, "passages_built": built, "figure_passages": figures, "index_plan": index_plan, "json_answers": answers, "schema_errors": schema_errors, "generic_reasons": generic, "inferred_types": types}

_C = passages._C
_sp = r"[\s\x0b\x1c-\x1f\x85\pZ]"
_trim = lambda x: rf"regexp_replace({x}, '^{_sp}+|{_sp}+$', '', 'g')"
_asked = "lower(concat_ws(' ', column_name, description))"
_hint = [("count_like", r"(^\s*#)|\b(how many|number|count|total|sample size|n\s*=)\b", "count total number pairs pair combinations constructed tested included coverage"), ("variant_or_sequence", r"\b(variants?|sequences?|pairs?|barcodes?|constructs?|plasmids?|elements?)\b", "sequences pairs combinations plasmids barcodes"), ("vector_or_backbone", r"\b(episomal|ori|origin of replication|backbone|vector)\b", "episomal plasmid vector backbone origin replication polya"), ("methods_or_library", r"\b(clon|library|design|construct|assay format|readout)\b", "methods design library cloning construct")]
_tags = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(a, '{p}') THEN '{t}' END" for t, p, _ in _hint) + "], lambda t: t IS NOT NULL)"
_terms = "list_concat(" + ", ".join(f"CASE WHEN regexp_matches(a, '{p}') THEN string_split('{w}', ' ') ELSE [] END" for _, p, w in _hint) + ")"
_old = "SELECT * FROM n WHERE ('0x' || left(md5(chunk_id), 2))::INTEGER % 16 <> 0 AND ('0x' || left(md5(pdf_id), 2))::INTEGER % 5 <> 0 UNION ALL SELECT 'old_' || pdf_id, chunk_id, retrieval_text FROM n WHERE ('0x' || left(md5(pdf_id), 2))::INTEGER % 7 = 0"
ORACLES = {
    "expanded_queries": f"WITH s AS (SELECT DISTINCT column_name, concat_ws(' ', 'the', field_type, 'design of a library', CASE WHEN field_type = 'number' THEN 'variant' END) AS description FROM schema_columns), a AS (SELECT *, {_asked} AS a FROM s), t AS (SELECT *, {_tags} AS tags, {_terms} AS w FROM a), h AS (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i) AS u FROM t) SELECT column_name, array_to_string(tags, ',') AS tags, array_to_string(u, ' ') AS hints, column_name || ': ' || description || CASE WHEN len(u) > 0 THEN chr(10) || 'Retrieval hints: ' || array_to_string(u, ' ') ELSE '' END AS query_text FROM h",
    "passages_built": rf"WITH b AS ({passages.ORACLES['blocks_typed']}), t AS (SELECT doc_id, reading_order, block_type, section, {_trim('block')} AS s FROM b JOIN ({passages._BLOCKS}) USING (doc_id, reading_order)), k AS (SELECT *, CASE block_type WHEN 'heading' THEN 'section' WHEN 'section_heading' THEN 'section' ELSE block_type END AS c FROM t WHERE s <> '') SELECT doc_id, reading_order, c AS chunk_type, section AS section_context, md5(s) AS display_md5, md5(trim('[Chunk type: ' || c || ']' || CASE WHEN section IS NOT NULL THEN ' [Section: ' || section || ']' ELSE '' END || ' ' || CASE WHEN section IS NOT NULL AND c <> 'section' THEN '[Section: ' || section || '] ' ELSE '' END || s)) AS retrieval_md5 FROM k",
    "figure_passages": f"WITH f AS (SELECT pdf_id, chunk_id, CASE WHEN reading_order % 2 = 0 THEN display_text END AS own, reading_order + 1 AS b, section_context AS near FROM {_C} WHERE chunk_type = 'section'), c AS (SELECT pdf_id, reading_order AS b, min(display_text) AS t FROM {_C} WHERE chunk_type = 'caption' GROUP BY 1, 2), j AS (SELECT pdf_id, chunk_id, near, coalesce(nullif(trim(own), ''), nullif(trim(t), '')) AS cap FROM f LEFT JOIN c USING (pdf_id, b)) SELECT pdf_id, chunk_id AS figure_ref, coalesce(cap, chunk_id) AS display_text, md5(concat_ws(' ', '[Chunk type: figure]', '[Figure: ' || chunk_id || ']', '[Figure: ' || chunk_id || ']', cap, nullif(trim(near), ''))) AS retrieval_md5 FROM j",
    "index_plan": f"WITH n AS (SELECT pdf_id, chunk_id, retrieval_text FROM {_C} WHERE chunk_type IN ('paragraph', 'section', 'abstract', 'list_item', 'figure', 'caption', 'table_region')), o AS ({_old}), a AS (SELECT pdf_id, list_sort(list((chunk_id, coalesce(retrieval_text, chr(0))))) AS l FROM n GROUP BY 1), b AS (SELECT pdf_id, list_sort(list((chunk_id, coalesce(retrieval_text, chr(0))))) AS l FROM o GROUP BY 1) SELECT coalesce(a.pdf_id, b.pdf_id) AS pdf_id, CASE WHEN a.pdf_id IS NULL THEN 'drop' WHEN a.l = b.l THEN 'reuse' ELSE 'build' END AS action FROM a FULL JOIN b ON a.pdf_id = b.pdf_id",
    "json_answers": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN user_id IS NOT NULL THEN '{"amount": ' || user_id || ', "notes": ["a", "5"], "state": "found", "sure": false}' END WHEN 2 THEN '{"amount": null, "notes": [], "proposed_value": "x", "state": "inferred", "sure": false}' WHEN 3 THEN '{"amount": null, "notes": [], "proposed_value": "v", "state": "found", "sure": true}' END AS json,
        CASE event_id % 6 WHEN 0 THEN CASE WHEN user_id IS NULL THEN 'no json' END WHEN 1 THEN '$.amount: expected integer, null' WHEN 4 THEN '$.state: not one of the values' WHEN 5 THEN 'no json' END AS error FROM events""",
    "schema_errors": "WITH s AS (SELECT column_name AS c, CASE WHEN length(column_name) % 3 = 0 THEN 'missing description' END AS a, CASE WHEN length(column_name) % 5 = 0 OR field_type NOT IN ('text', 'number', 'categorical', 'boolean') THEN 'invalid field_type' END AS b, CASE WHEN length(column_name) % 2 = 0 AND (length(column_name) % 5 = 0 OR field_type IS DISTINCT FROM 'categorical') THEN 'allowed_values need categorical' END AS d FROM schema_columns) SELECT c AS column_name, concat_ws(',', a, b, d) AS errors FROM s",
    "generic_reasons": "SELECT p_partkey AS k, p_partkey % 5 IN (0, 1) AS generic FROM part",
    "inferred_types": rf"WITH s AS (SELECT DISTINCT run_id, row_id, column_name, gold_value, proposed_value, field_type FROM scored_cells), n AS (SELECT *, regexp_matches(lower(trim(regexp_replace(gold_value, '\s+', ' ', 'g'))), '{{P}}') AS g, regexp_matches(lower(trim(regexp_replace(proposed_value, '\s+', ' ', 'g'))), '{{P}}') AS p FROM s) SELECT field_type, CASE WHEN field_type = 'text' THEN 'text' WHEN field_type = 'categorical' THEN 'categorical' WHEN g AND p THEN 'numeric' ELSE 'text' END AS compared_as, count(*) AS n FROM n GROUP BY 1, 2".replace("{P}", r"^(~|≈|about|approx\.|approximately|approx)? *[-+]?([0-9]+(,[0-9]{3})*(\.[0-9]+)?|\.[0-9]+)(e[-+]?[0-9]+)?( *(to|-|–|—) *[-+]?([0-9]+(,[0-9]{3})*(\.[0-9]+)?|\.[0-9]+)(e[-+]?[0-9]+)?)?$"),
    "package_errors": """WITH p AS (SELECT DISTINCT proposal_id, row_id, column_name, proposal_status, review_bucket FROM proposals), r AS (
        SELECT 'unknown row' AS rule, proposal_id AS key FROM p WHERE row_id IS NULL OR row_id NOT IN (SELECT row_id FROM genome_editing_tools_filled WHERE row_id IS NOT NULL) UNION SELECT 'unknown column', proposal_id FROM p WHERE column_name IS NULL OR column_name NOT IN (SELECT column_name FROM schema_columns WHERE field_type <> 'text')
        UNION SELECT 'id used twice', proposal_id FROM p GROUP BY proposal_id HAVING count(*) > 1 UNION SELECT 'unknown proposal_status', proposal_id FROM p WHERE proposal_status NOT IN ('value_proposed', 'no_data', 'unresolved', 'error') UNION SELECT 'unknown review_bucket', proposal_id FROM p WHERE review_bucket NOT IN ('review', 'attention')
        UNION SELECT 'evidence of unknown proposal', evidence_id FROM evidence WHERE proposal_id IS NULL OR proposal_id NOT IN (SELECT proposal_id FROM p) UNION SELECT 'evidence on no page', evidence_id FROM evidence WHERE page_number IS NULL OR page_number <= 0 UNION SELECT 'value without evidence', proposal_id FROM p WHERE proposal_status = 'value_proposed' AND proposal_id NOT IN (SELECT proposal_id FROM evidence WHERE proposal_id IS NOT NULL))
        SELECT rule, count(*) AS n, min(key) AS first_key FROM r GROUP BY 1""",
    "one_record": "WITH e AS (SELECT DISTINCT proposal_id, evidence_rank, evidence_id FROM evidence), t AS (SELECT proposal_id FROM e GROUP BY 1 ORDER BY count(*) DESC, proposal_id LIMIT 1) SELECT proposal_id, min(column_name) AS column_name, count(DISTINCT (created_at, proposal_status))::INTEGER AS n_history, (SELECT string_agg(evidence_id, ',' ORDER BY evidence_rank NULLS FIRST, evidence_id) FROM e WHERE e.proposal_id = (SELECT proposal_id FROM t)) AS evidence_ids FROM proposals WHERE proposal_id = (SELECT proposal_id FROM t) GROUP BY 1",
}
