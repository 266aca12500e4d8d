"""Queries of retrieval and evidence over chunks, evidence, schema columns and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import tokens as tk
from marginalia.functions import values as v
from marginalia.operators import anchor as an
from marginalia.operators import retrieve as rt
from marginalia.session import saved, spread, table

TOP_K = 6
# Sources of evidence, the most authoritative first.
AUTHORITY = (
    "direct_quote", "calculation", "caption_grounded_figure_evidence", "inferred_reasoning", "visual_interpretation_figure_evidence", "approximate_highlight", "quote_plus_page",
)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    columns = ("pdf_id", "chunk_type", "page_number", "reading_order", "display_text", "retrieval_text", "section_context")
    return table(spark, d, "chunks").groupBy("chunk_id").agg(*[F.first(c).alias(c) for c in columns]).select("pdf_id", "chunk_id", *columns[1:])


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "schema_columns").select("column_name", F.concat_ws(" ", "column_name", F.array_join("allowed_values", " ")).alias("query_text"))


def idf(spark: SparkSession, d: str) -> DataFrame:
    return rt.term_statistics(chunks(spark, d), "pdf_id", "chunk_id", "retrieval_text")


def _scored(spark: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    return rt.score_passages(chunks(spark, d) if c is None else c, queries_of(spark, d), doc="pdf_id", chunk="chunk_id", text="retrieval_text", query="column_name", query_text="query_text")


def _signs(spark: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    return rt.passage_signs(chunks(spark, d) if c is None else c, "pdf_id", "chunk_id", "chunk_type", "display_text", "retrieval_text")


def _ranking(spark: SparkSession, d: str, scored: DataFrame, score: str, boosted: bool = False, c: DataFrame | None = None) -> DataFrame:
    return rt.ranking(scored, _signs(spark, d, c), queries_of(spark, d), doc="pdf_id", query="column_name", chunk="chunk_id", score=score, k=TOP_K, boosted=boosted)


def bm25(spark: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    return _ranking(spark, d, _scored(spark, d, c), "bm25", c=c).drop("boosted")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return rt.hybrid(_scored(spark, d), "pdf_id", "column_name")


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d, _hybrid(spark, d), "hybrid").drop("boosted")


def rerank(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d, _hybrid(spark, d), "hybrid", boosted=True)


def rerank_changes(spark: SparkSession, d: str) -> DataFrame:
    """At how many of the first ranks another passage stands once boosted (O2)."""
    scored = saved(_hybrid(spark, d), "hybrid")  # ranked twice
    return rt.rank_changes(_ranking(spark, d, scored, "hybrid"), _ranking(spark, d, scored, "hybrid", boosted=True), "pdf_id", "column_name", "chunk_id")


def window(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return rt.neighbours(c, c.where("chunk_type = 'caption'"), "pdf_id", "chunk_id", "reading_order")


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by kind for every listed kind, zero included."""
    kinds = spark.createDataFrame([(k,) for k in ("paragraph", "section", "caption", "table_region", "abstract", "list_item", "figure")], "chunk_type string")
    n = chunks(spark, d).groupBy("chunk_type").agg(F.count("*").alias("n"), F.count("section_context").alias("with_section"))
    return kinds.join(n, "chunk_type", "left").na.fill(0)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    typed = rt.blocks(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return typed.select("doc_id", "reading_order", "block_type", "section", F.length("block").alias("n_chars"))


def captions(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("pdf_id", "reading_order", "chunk_type").distinct()
    order = c.groupBy("pdf_id", "reading_order").agg(F.max(F.col("chunk_type") == "section").alias("fig"), F.max(F.col("chunk_type") == "caption").alias("cap"))
    return rt.attach_captions(order, "pdf_id", "reading_order", F.col("fig"), F.col("cap")).na.fill(-1, ["caption_order"])


def located(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence").where("quote_text is not null and page_number is not null")
    return an.contained_quotes(e, chunks(spark, d), keys=("pdf_id", "page_number"), quote_id="evidence_id", quote="quote_text", passage_id="chunk_id", passage="display_text")


def audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence").select("evidence_id", "proposal_id", "page_number", "quote_text").distinct()
    return an.anchor_outcomes(e, located(spark, d), "evidence_id", "page_number", "quote_text").select("evidence_id", "proposal_id", "outcome", "chunk_id", "n_places")


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes per proposal, the best of them, and evidence by source."""
    a = audit(spark, d)
    return a.groupBy("proposal_id").agg(
        F.count("*").alias("n_evidence"), F.count_if(F.col("outcome") == "anchor_valid").alias("n_valid"), F.count_if(F.col("outcome").startswith("anchor_invalid")).alias("n_invalid"),
        F.max(F.when(F.col("outcome") == "anchor_valid", 3).when(F.col("outcome") == "evidence_present_but_unvalidated", 2).otherwise(1)).alias("best"),
        F.min(F.when(F.col("outcome") == "anchor_valid", 3).when(F.col("outcome") == "evidence_present_but_unvalidated", 2).otherwise(1)).alias("worst"),
    )


def ranked(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence").select("proposal_id", "evidence_id", "source_type", "evidence_rank").distinct()
    return an.rank_evidence(e, "proposal_id", "source_type", "evidence_rank", "evidence_id", AUTHORITY)


def reused(spark: SparkSession, d: str) -> DataFrame:
    return an.reused_sets(table(spark, d, "evidence").select("proposal_id", "quote_text").where("trim(quote_text) <> ''"), table(spark, d, "proposals"), "proposal_id", "quote_text", "column_name")


def figure_references(spark: SparkSession, d: str) -> DataFrame:
    """Figures named in each document with how often."""
    found = table(spark, d, "documents").select("doc_id", F.explode(F.expr(r"regexp_extract_all(coalesce(text, ''), r'(?:Figure|Fig\.) ([0-9]+[a-z]?)', 1)")).alias("figure"))
    return found.groupBy("doc_id", "figure").agg(F.count("*").alias("n"))


def years(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent year of each document; of equal ones the first to appear."""
    hit = table(spark, d, "documents").select("doc_id", F.posexplode(F.expr(r"regexp_extract_all(coalesce(text, ''), r'\(((?:19|20)[0-9]{2})\)', 1)")).alias("pos", "year"))
    per = hit.groupBy("doc_id", "year").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return per.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("pos")).alias("p"), "year")).alias("x")).select("doc_id", F.col("x.year").alias("year"), F.col("x.n").alias("n"))


QUERIES = {
    "retrieval_idf": idf, "retrieval_bm25_topk": bm25, "retrieval_hybrid_topk": hybrid, "retrieval_rerank_topk": rerank, "retrieval_rank_changes": rerank_changes, "retrieval_neighbours": window, "chunk_type_counts": type_counts, "blocks_typed": blocks,
    "caption_asof": captions, "quote_located": located, "anchor_audit": audit, "evidence_outcomes": outcome_counts, "evidence_rank": ranked, "evidence_reused": reused, "figure_references": figure_references, "document_year": years,
}

D = v.DUCK
_C = "(SELECT DISTINCT ON (chunk_id) pdf_id, chunk_id, chunk_type, page_number, reading_order, display_text, retrieval_text, section_context FROM chunks)"
_Q = "(SELECT column_name, concat_ws(' ', column_name, array_to_string(allowed_values, ' ')) AS query_text FROM schema_columns)"
_T = f"t AS (SELECT pdf_id, chunk_id, {tk.tokens('retrieval_text', D)} AS toks FROM {_C})"
_SCORED = f"""{_T}, n AS (SELECT pdf_id, count(*) AS n_chunks, sum(len(toks))::BIGINT AS n_tokens FROM t GROUP BY 1), q AS (SELECT column_name, term, count(*) AS qtf FROM (SELECT column_name, unnest({tk.tokens('query_text', D)}) AS term FROM {_Q}) GROUP BY 1, 2),
  tf AS (SELECT pdf_id, chunk_id, dl, term, count(*) AS tf FROM (SELECT pdf_id, chunk_id, greatest(len(toks), 1) AS dl, unnest(toks) AS term FROM t) GROUP BY 1, 2, 3, 4), df AS (SELECT pdf_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
  s AS (SELECT tf.pdf_id, q.column_name, tf.chunk_id, sum({rt.idf_sql('n_chunks', 'df')} * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (n_tokens / n_chunks))) * qtf) AS s, count(*) AS hits FROM tf JOIN df USING (pdf_id, term) JOIN n USING (pdf_id) JOIN q USING (term) GROUP BY 1, 2, 3),
  scored AS (SELECT pdf_id, s.column_name, chunk_id, {v.round6('s')} AS bm25, {v.ratio('hits', 'q_terms')} AS coverage FROM s JOIN (SELECT column_name, count(*) AS q_terms FROM q GROUP BY 1) USING (column_name)),
  hyb AS (SELECT *, {v.round6('CASE WHEN max(bm25) OVER (PARTITION BY pdf_id, column_name) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY pdf_id, column_name) ELSE 0 END * 0.7::DOUBLE + coverage * 0.3::DOUBLE')} AS hybrid FROM scored)"""
_top = lambda src, score: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pdf_id, column_name ORDER BY {score} DESC, chunk_id)::INTEGER AS rank FROM {src}) WHERE rank <= {TOP_K}"
_all = lambda src, score: f"(SELECT c.pdf_id, q.column_name, c.chunk_id, coalesce({score}, 0.0::DOUBLE) AS {score} FROM {_C} c CROSS JOIN {_Q} q LEFT JOIN {src} s ON s.pdf_id = c.pdf_id AND s.column_name = q.column_name AND s.chunk_id = c.chunk_id)"
_number = r"(?i)\b(number|count|max|maximum|highest|best|length|size|unit|efficiency|percent|percentage|rate|temperature|thickness|diameter|dose|concentration|bp|nt|kb|mm|um|nm|cm|fold)\b"
_BOOSTED = rf"""(SELECT pdf_id, column_name, chunk_id, hybrid, {v.round6('hybrid + gain')} AS boosted FROM (SELECT a.*,
  CASE WHEN regexp_matches(query_text, '{_number}') AND regexp_matches(concat_ws(' ', display_text, retrieval_text), '(^|[^\pL\pN_])\p{{Nd}}+(\.\p{{Nd}}+)?\s*(bp|nt|kb|mm|um|µm|nm|cm|x|fold)?($|[^\pL\pN_])') THEN 0.12 ELSE 0 END + CASE WHEN regexp_matches(query_text, '{_number}') AND chunk_type = 'table_region' THEN 0.1 ELSE 0 END
  + CASE WHEN regexp_matches(query_text, '(?i)\b(fig(ure)?\.?|panel|plot|chart|graph|image|microscopy|visual)\b') AND chunk_type IN ('caption', 'figure') THEN 0.1 ELSE 0 END
  + CASE WHEN regexp_matches(query_text, '(?i)\b(identifier|architecture|system|barcode|sequence|construct|vector|plasmid|name)\b') AND regexp_matches(display_text, '(^|[^\pL\pN_])([A-Z]{{2,}}[A-Za-z0-9-]*[A-Za-z0-9]|[A-Z]{{2,}}|[A-Za-z]+-[A-Za-z0-9-]*[A-Za-z0-9]|[A-Za-z]*\p{{Nd}}([A-Za-z0-9-]*[A-Za-z0-9])?)($|[^\pL\pN_])') THEN 0.05 ELSE 0 END
  - CASE WHEN chunk_type IN ('abstract', 'section') THEN 0.02 ELSE 0 END AS gain FROM {_all('hyb', 'hybrid')} a JOIN {_C} c USING (pdf_id, chunk_id) JOIN {_Q} q USING (column_name)))"""
_LONG = {"ß": "ss", "ς": "σ", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "µ": "μ", "ſ": "s"}


def _fold(x: str) -> str:
    """White space collapsed and case folded by DuckDB's own functions; the letters of these tables that fold otherwise than to lower case."""
    out = rf"lower(trim(regexp_replace({x}, '[\s\x0b\x1c-\x1f\x85\pZ]+', ' ', 'g')))"
    for a, b in _LONG.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


_LOC = f"SELECT DISTINCT e.pdf_id, e.page_number, evidence_id, chunk_id FROM (SELECT pdf_id, page_number, evidence_id, {_fold('quote_text')} AS q FROM evidence WHERE quote_text IS NOT NULL AND page_number IS NOT NULL) e JOIN (SELECT pdf_id, page_number, chunk_id, {_fold('display_text')} AS t FROM {_C}) c USING (pdf_id, page_number) WHERE q <> '' AND contains(t, q)"
_AUDIT = f"""SELECT evidence_id, proposal_id, CASE WHEN page_number IS NULL OR page_number <= 0 THEN 'anchor_invalid:missing_or_invalid_page' WHEN trim(coalesce(quote_text, '')) = '' THEN 'anchor_invalid:missing_quote_text'
    WHEN chunk_id IS NOT NULL THEN 'anchor_valid' ELSE 'evidence_present_but_unvalidated' END AS outcome, chunk_id, coalesce(n_places, 0) AS n_places FROM (SELECT DISTINCT evidence_id, proposal_id, page_number, quote_text FROM evidence) LEFT JOIN (SELECT evidence_id, min(chunk_id) AS chunk_id, count(*) AS n_places FROM ({_LOC}) GROUP BY 1) USING (evidence_id)"""
_lines = r"regexp_split_to_array(text, '\r\n|\r|\n')"
_BLOCKS = f"SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS reading_order, unnest(l) AS block FROM (SELECT doc_id, {_lines} AS l FROM documents WHERE text IS NOT NULL)"
_auth = "CASE source_type WHEN 'direct_quote' THEN 1 WHEN 'calculation' THEN 2 WHEN 'caption_grounded_figure_evidence' THEN 3 WHEN 'inferred_reasoning' THEN 4 WHEN 'visual_interpretation_figure_evidence' THEN 5 WHEN 'approximate_highlight' THEN 6 WHEN 'quote_plus_page' THEN 7 ELSE 99 END"
ORACLES = {
    "retrieval_idf": f"WITH {_T}, n AS (SELECT pdf_id, count(*) AS n_chunks FROM t GROUP BY 1) SELECT pdf_id, term, df, n_chunks, {v.round6(rt.idf_sql('n_chunks', 'df'))} AS idf FROM (SELECT pdf_id, term, count(*) AS df FROM (SELECT pdf_id, unnest(list_distinct(toks)) AS term FROM t) GROUP BY 1, 2) JOIN n USING (pdf_id)",
    "retrieval_bm25_topk": f"WITH {_SCORED} {_top(_all('scored', 'bm25'), 'bm25')}",
    "retrieval_hybrid_topk": f"WITH {_SCORED} {_top(_all('hyb', 'hybrid'), 'hybrid')}",
    "retrieval_rerank_topk": f"WITH {_SCORED} {_top(_BOOSTED, 'boosted')}",
    "retrieval_rank_changes": f"WITH {_SCORED} SELECT pdf_id, column_name, count(*) AS ranks, count(*) FILTER (WHERE x.chunk_id <> y.chunk_id) AS changed FROM ({_top(_all('hyb', 'hybrid'), 'hybrid')}) x JOIN ({_top(_BOOSTED, 'boosted')}) y USING (pdf_id, column_name, rank) GROUP BY 1, 2",
    "retrieval_neighbours": f"SELECT pdf_id, chunk_id, reading_order, NOT sel AS is_neighbour FROM (SELECT *, coalesce(lag(sel) OVER w, false) OR coalesce(lead(sel) OVER w, false) AS near FROM (SELECT *, chunk_type IS NOT DISTINCT FROM 'caption' AS sel FROM {_C}) WINDOW w AS (PARTITION BY pdf_id ORDER BY reading_order, chunk_id)) WHERE sel OR near",
    "chunk_type_counts": f"SELECT k.chunk_type, coalesce(n, 0) AS n, coalesce(with_section, 0) AS with_section FROM (SELECT unnest(['paragraph', 'section', 'caption', 'table_region', 'abstract', 'list_item', 'figure']) AS chunk_type) k LEFT JOIN (SELECT chunk_type, count(*) AS n, count(section_context) AS with_section FROM {_C} GROUP BY 1) USING (chunk_type)",
    "blocks_typed": rf"SELECT doc_id, reading_order, block_type, last_value(CASE WHEN block_type IN ('heading', 'section_heading') THEN {v.tidy('block', D)} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS UNBOUNDED PRECEDING) AS section, length(block)::INTEGER AS n_chars FROM (SELECT *, CASE WHEN length(t) < 80 AND t = upper(t) AND regexp_matches(t, '^\pL+$') THEN 'heading' WHEN length(t) < 120 AND regexp_matches(t, '^([0-9]+\.?\s+)?[A-Z][a-zA-Z\s]+$') THEN 'section_heading' WHEN starts_with(lower(t), 'abstract') THEN 'abstract' WHEN starts_with(lower(t), 'references') AND length(t) < 30 THEN 'heading' WHEN regexp_matches(t, '(?i)^(fig(ure)?\.?\s*[0-9]|table\s*[0-9])') THEN 'caption' ELSE 'paragraph' END AS block_type FROM (SELECT *, regexp_replace(block, '^[\s\x0b\x1c-\x1f\x85\pZ]+|[\s\x0b\x1c-\x1f\x85\pZ]+$', '', 'g') AS t FROM ({_BLOCKS}) WHERE NOT {v.is_empty('block', D)}))",
    "caption_asof": f"SELECT pdf_id, figure_no, min(CASE WHEN fig THEN reading_order END) AS figure_order, coalesce(min(CASE WHEN cap THEN reading_order END), -1) AS caption_order FROM (SELECT *, count(*) FILTER (WHERE fig) OVER (PARTITION BY pdf_id ORDER BY reading_order ROWS UNBOUNDED PRECEDING) AS figure_no FROM (SELECT pdf_id, reading_order, bool_or(chunk_type = 'section') AS fig, bool_or(chunk_type = 'caption') AS cap FROM {_C} GROUP BY 1, 2)) WHERE figure_no > 0 GROUP BY 1, 2",
    "quote_located": _LOC,
    "anchor_audit": _AUDIT,
    "evidence_outcomes": f"SELECT proposal_id, count(*) AS n_evidence, count(*) FILTER (WHERE outcome = 'anchor_valid') AS n_valid, count(*) FILTER (WHERE starts_with(outcome, 'anchor_invalid')) AS n_invalid, max(CASE outcome WHEN 'anchor_valid' THEN 3 WHEN 'evidence_present_but_unvalidated' THEN 2 ELSE 1 END)::INTEGER AS best, min(CASE outcome WHEN 'anchor_valid' THEN 3 WHEN 'evidence_present_but_unvalidated' THEN 2 ELSE 1 END)::INTEGER AS worst FROM ({_AUDIT}) GROUP BY 1",
    "evidence_rank": f"SELECT *, new_rank = 1 AS is_first FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY {_auth}, evidence_rank NULLS LAST, evidence_id)::INTEGER AS new_rank FROM (SELECT DISTINCT proposal_id, evidence_id, source_type, evidence_rank FROM evidence))",
    "evidence_reused": "WITH s AS (SELECT proposal_id, list_sort(list(DISTINCT quote_text)) AS q FROM evidence WHERE trim(quote_text) <> '' GROUP BY 1) SELECT len(q) AS n, q[1] AS first_piece, q[-1] AS last_piece, count(DISTINCT column_name) AS n_columns, count(DISTINCT proposal_id) AS n_proposals FROM s JOIN (SELECT DISTINCT proposal_id, column_name FROM proposals) USING (proposal_id) GROUP BY q HAVING count(DISTINCT column_name) > 1",
    "figure_references": r"SELECT doc_id, figure, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?:Figure|Fig\.) ([0-9]+[a-z]?)', 1)) AS figure FROM documents) GROUP BY 1, 2",
    "document_year": r"WITH h AS (SELECT doc_id, unnest(y) AS year, unnest(range(0, len(y))) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\(((?:19|20)[0-9]{2})\)', 1) AS y FROM documents)), p AS (SELECT doc_id, year, count(*) AS n, min(pos) AS pos FROM h GROUP BY 1, 2) SELECT doc_id, year, n FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1",
}
