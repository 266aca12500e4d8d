"""Queries of grounding: anchoring chain, support, status and buckets, tiers, figures, triggers and diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import values as v
from marginalia.operators import anchor as an
from marginalia.operators import ground as gr
from marginalia.plans import passages
from marginalia.session import saved, table

STATE = "case proposal_status when 'value_proposed' then 'found' when 'unresolved' then 'unclear' when 'no_data' then 'unclear' when 'error' then 'error' when 'not_attempted' then 'skipped' else 'blocked' end"
NUMERIC = "coalesce(field_type in ('number', 'numeric'), false)"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").select("evidence_id", "proposal_id", "pdf_id", "page_number", "source_type", "quote_text", "anchor_confidence", "evidence_rank").distinct()


def chain(spark: SparkSession, d: str) -> DataFrame:
    return gr.anchor_chain(_evidence(spark, d), passages.chunks(spark, d), quote_id="evidence_id", doc="pdf_id", page="page_number", quote="quote_text", passage_id="chunk_id", passage="display_text", order="reading_order")


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proposals").select("proposal_id", "pdf_id", "column_name", "proposal_status", "evidence_status", "review_bucket", "proposed_value", "field_type", "warning_flags", "needs_more_evidence").distinct()
    return p.withColumn("state", F.expr(STATE)).withColumn("reasons", gr.reason_set("warning_flags"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return gr.support_labels(_proposals(spark, d), _evidence(spark, d), proposal="proposal_id", state="state", value="proposed_value", numeric=NUMERIC, source="source_type", quote="quote_text", evidence_id="evidence_id")


def support(spark: SparkSession, d: str) -> DataFrame:
    """Support label and the evidence status that follows."""
    return _labelled(spark, d).select("proposal_id", "state", "support", "n_evidence", "n_direct", gr.evidence_status().alias("status"))


def buckets(spark: SparkSession, d: str) -> DataFrame:
    """Review bucket by status, evidence and reasons, whether the stored one agrees, and the rule a combination breaks."""
    p = _proposals(spark, d).withColumn("bucket", gr.review_bucket("proposal_status", "evidence_status", "reasons"))
    return p.select("proposal_id", "bucket", F.col("bucket").eqNullSafe(F.col("review_bucket")).alias("agrees"), gr.illegal_combination("proposal_status", "evidence_status", "reasons").alias("broken_rule"))


def persisted(spark: SparkSession, d: str) -> DataFrame:
    """Values of unresolved proposals that say nothing are none."""
    nothing = F.lower(F.trim(F.coalesce("proposed_value", F.lit("")))).isin("", "unclear", "no value proposed", "not_found", "not found")
    return _proposals(spark, d).select("proposal_id", F.when(~((F.col("proposal_status") == "unresolved") & nothing), F.col("proposed_value")).alias("kept_value"))


def tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tier of each piece of evidence; a piece with an anchor of some confidence has an approximate region."""
    return gr.evidence_tiers(_evidence(spark, d), doc="pdf_id", page="page_number", quote="quote_text", source="source_type", approximate="coalesce(anchor_confidence, 0) > 0.5").select("evidence_id", "proposal_id", "evidence_rank", "tier", "tier_status", "tier_bucket", "tier_codes")


def tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Strongest tier of a proposal, and all reason codes as first seen."""
    t = tiers(spark, d).withColumn("place", F.struct(F.coalesce("evidence_rank", F.lit(99)).alias("r"), "evidence_id"))
    return gr.strongest_tier(t, "proposal_id", "tier", "tier_codes", "place").select("proposal_id", "tier", F.array_join("codes", ",").alias("codes"))


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """Status, bucket and flags after derivation codes; calculations and figures among the evidence give the codes."""
    e = _evidence(spark, d).groupBy("proposal_id").agg(F.array_sort(F.collect_set(F.expr("case source_type when 'calculation' then 'calculation' when 'visual_interpretation_figure_evidence' then 'figure_estimate' when 'inferred_reasoning' then 'protocol_inference' end"))).alias("codes"))
    p = _proposals(spark, d).join(e, "proposal_id", "left")
    return gr.derivation_overrides(p, codes="codes", status="evidence_status", bucket="review_bucket", flags="warning_flags").select("proposal_id", "new_status", "new_bucket", F.array_join("new_flags", ",").alias("new_flags"))


def figure_mentions(spark: SparkSession, d: str) -> DataFrame:
    """References to figures in documents with panel and the text around them."""
    return gr.figure_references(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text")


def _figures(chunks: DataFrame) -> DataFrame:
    """Captions that name a figure stand for it; what is nearby is the section they stand in."""
    c = chunks.where("chunk_type = 'caption'").withColumn("figure_no", F.expr(r"try_cast(regexp_extract(display_text, r'(?i)fig(?:ure)?[^0-9]*([0-9]+)', 1) as int)")).where("figure_no is not null")
    return c.select(F.col("pdf_id").alias("doc"), F.col("chunk_id").alias("figure_id"), "figure_no", F.col("display_text").alias("caption"), F.col("section_context").alias("nearby"))


def _figure_scores(spark: SparkSession, d: str) -> DataFrame:
    c = saved(passages.chunks(spark, d), "chunks")  # looked at from several sides
    ranked = passages.bm25(spark, d, c).select("pdf_id", "column_name", "chunk_id", "bm25", "rank")
    ranked = saved(ranked.where("bm25 > 0"), "ranked")
    asked = ranked.select("pdf_id", "column_name").distinct().join(passages.queries_of(spark, d), "column_name").select(F.col("pdf_id").alias("doc"), F.col("column_name").alias("query"), "query_text")
    texts = c.where("chunk_type in ('paragraph', 'caption', 'section')").select(F.col("pdf_id").alias("doc"), "chunk_id", "display_text")
    whole = gr.figure_references(texts, ["doc", "chunk_id"], "display_text").select("doc", F.lit(None).cast("string").alias("query"), "figure_no")
    top = ranked.join(c.select("chunk_id", "display_text"), "chunk_id").select(F.col("pdf_id").alias("doc"), F.col("column_name").alias("query"), "chunk_id", "display_text")
    own = gr.figure_references(top, ["doc", "query", "chunk_id"], "display_text").select("doc", "query", "figure_no")
    got = ranked.join(_figures(c).select(F.col("figure_id").alias("chunk_id"), "figure_no"), "chunk_id").select(F.col("pdf_id").alias("doc"), F.col("column_name").alias("query"), "figure_no")
    return gr.score_figures(_figures(c), asked, whole.unionByName(own), got)


def figure_scores(spark: SparkSession, d: str) -> DataFrame:
    return _figure_scores(spark, d).select("doc", "query", "figure_id", "n_references", "score", "band")


def figure_selection(spark: SparkSession, d: str) -> DataFrame:
    return gr.select_figures(_figure_scores(spark, d)).select("doc", "query", "place", "figure_id", "band")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Everything the triggers and diagnoses of a proposal look at."""
    c = saved(passages.chunks(spark, d), "chunks")
    ranked = saved(passages.bm25(spark, d, c), "ranked")
    retrieved = gr.retrieval_facts(ranked, c, doc="pdf_id", query="column_name", passage="chunk_id", kind="chunk_type", text="display_text")
    e = _evidence(spark, d)
    of = lambda *kinds: F.count_if(F.col("source_type").isin(*kinds))
    counts = e.groupBy("proposal_id").agg(
        of("direct_quote").alias("n_exact"), of("approximate_highlight").alias("n_approximate"), of("quote_plus_page").alias("n_fallback"), of("caption_grounded_figure_evidence", "visual_interpretation_figure_evidence").alias("n_figure"),
        F.bool_or(F.coalesce(F.trim("quote_text") != "", F.lit(False))).alias("has_quote"),
    )
    signals = table(spark, d, "chunks").groupBy("pdf_id").agg(F.lit(True).alias("has_text"), F.coalesce(F.bool_or(F.col("provenance") == "unknown"), F.lit(False)).alias("fallback"), F.coalesce(F.bool_or(F.col("provenance") == "ocr"), F.lit(False)).alias("ocr"))
    p = _labelled(spark, d).withColumn("needs_more", F.coalesce("needs_more_evidence", F.lit(False))).withColumn("missing", F.expr(f"{v.is_empty('proposed_value')}")).withColumn("visual", F.col("column_name").rlike(gr.VISUAL_REQUEST))
    p = saved(p, "labelled")
    full = p.join(retrieved, ["pdf_id", "column_name"], "left").join(counts, "proposal_id", "left").join(gr.numbers_conflict(e, "proposal_id", "quote_text"), "proposal_id", "left").join(signals, "pdf_id", "left")
    both = ranked.join(c.select("chunk_id", F.concat_ws(" ", "display_text", "retrieval_text").alias("both_texts")), "chunk_id").select("pdf_id", "column_name", "chunk_id", "both_texts")
    both = saved(an.plain_words(both, "both_texts"), "both-texts")
    asked = p.where(f"length({v.plain_text('proposed_value')}) >= 4").select("proposal_id", "pdf_id", "column_name", "proposed_value")
    seen = an.contained_quotes(asked, both, keys=["pdf_id", "column_name"], quote_id="proposal_id", quote="proposed_value", passage_id="chunk_id", passage="both_texts", fold=lambda df, column: df if column == "__p" else an.plain_words(df, column)).select("proposal_id").distinct().withColumn("value_seen", F.lit(True))
    quotes = e.join(p.select("proposal_id", "column_name").distinct(), "proposal_id").where(f"length({v.plain_text('quote_text')}) >= 4").select("proposal_id", "pdf_id", "column_name", "quote_text")
    quoted = an.contained_quotes(quotes, both, keys=["pdf_id", "column_name"], quote_id="proposal_id", quote="quote_text", passage_id="chunk_id", passage="both_texts", fold=lambda df, column: df if column == "__p" else an.plain_words(df, column)).select("proposal_id").distinct().withColumn("quote_seen", F.lit(True))
    full = full.join(seen, "proposal_id", "left").join(quoted, "proposal_id", "left")
    zero = ["n_exact", "n_approximate", "n_fallback", "n_figure", "n_retrieved"]
    full = full.na.fill(0, zero).na.fill(False, ["has_quote", "conflict", "has_figure", "promises_figure", "has_text", "fallback", "ocr", "value_seen", "quote_seen"])
    return full.withColumn("parser_signals", gr.codes_when([("parser_fallback_used", "fallback"), ("ocr_used", "ocr")]))


def triggers(spark: SparkSession, d: str) -> DataFrame:
    """Why figures or a second search are asked for."""
    return _facts(spark, d).select("proposal_id", F.array_join(gr.vision_triggers(), ",").alias("vision"), F.array_join(gr.rescue_triggers(), ",").alias("rescue"))


def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    """Diagnosis of the retrieval of each proposal, its signals, and where an unresolved one failed."""
    kind, signals = gr.retrieval_diagnosis()
    return _facts(spark, d).select("proposal_id", kind.alias("diagnosis"), F.array_join(signals, ",").alias("signals"), gr.failure_attribution().alias("attribution"))


QUERIES = {
    "anchor_chain": chain, "support_labels": support, "review_buckets": buckets, "persisted_values": persisted, "evidence_tiers": tiers, "evidence_tier_rollup": tier_rollup, "derivation_overrides": overrides,
    "figure_mentions": figure_mentions, "figure_scores": figure_scores, "figure_selection": figure_selection, "trigger_reasons": triggers, "retrieval_diagnoses": diagnoses,
}

_C = passages._C
_E = "(SELECT DISTINCT evidence_id, proposal_id, pdf_id, page_number, source_type, quote_text, anchor_confidence, evidence_rank FROM evidence)"
_P = f"(SELECT *, {STATE} AS state, list_distinct(list_filter(list_transform(coalesce(warning_flags, []), lambda r: trim(r)), lambda r: r <> '')) AS reasons FROM (SELECT DISTINCT proposal_id, pdf_id, column_name, proposal_status, evidence_status, review_bucket, proposed_value, field_type, warning_flags, needs_more_evidence FROM proposals))"
# NFKD puts a break behind the base letter of an accented one; the same by naming the letters of these tables
_tok = lambda x: rf"trim(regexp_replace({passages.tk.folded(f'coalesce({x}, {chr(39)}{chr(39)})', v.DUCK)}, '[^a-z0-9]+', ' ', 'g'))"
_bag = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
_CHAIN = f"""WITH q AS (SELECT DISTINCT evidence_id, pdf_id, page_number, {_tok('quote_text')} AS t FROM {_E}), c AS (SELECT pdf_id, page_number, chunk_id, reading_order, {_tok('display_text')} AS t FROM {_C} WHERE display_text IS NOT NULL),
  x AS (SELECT q.evidence_id, c.chunk_id, reading_order, contains(c.t, q.t) AS exact, len(list_intersect({_bag('q.t')}, {_bag('c.t')})) / len({_bag('q.t')}) AS share FROM q JOIN c ON q.pdf_id = c.pdf_id AND (q.page_number IS NULL OR q.page_number <= 0 OR q.page_number = c.page_number) WHERE q.t <> ''),
  e AS (SELECT evidence_id, arg_min(chunk_id, (reading_order, chunk_id)) AS chunk_id FROM x WHERE exact GROUP BY 1), n AS (SELECT evidence_id, arg_min(chunk_id, (-share, reading_order, chunk_id)) AS chunk_id, max(share) AS share FROM x WHERE share >= 0.3 GROUP BY 1)
  SELECT i.evidence_id, CASE WHEN e.chunk_id IS NOT NULL THEN 'direct_quote' WHEN n.chunk_id IS NOT NULL THEN 'approximate_highlight' ELSE 'quote_plus_page' END AS source_type, coalesce(e.chunk_id, n.chunk_id) AS chunk_id, {v.round6('(CASE WHEN e.chunk_id IS NOT NULL THEN 1.0 ELSE coalesce(n.share, 0) END)::DOUBLE')} AS confidence FROM (SELECT DISTINCT evidence_id FROM q) i LEFT JOIN e USING (evidence_id) LEFT JOIN n USING (evidence_id)"""
_form = lambda x: rf"trim(regexp_replace({passages.tk.folded(f'coalesce({x}, {chr(39)}{chr(39)})', v.DUCK)}, '[^a-z0-9.%-]+', ' ', 'g'))"
_stems = lambda x: f"list_distinct(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END))"
_LABELS = f"""l AS (SELECT p.*, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_direct, 0) AS n_direct, coalesce(n_inferred, 0) AS n_inferred, coalesce(n_loose, 0) AS n_loose FROM {_P} p LEFT JOIN (SELECT proposal_id, count(*) AS n_evidence,
    count(*) FILTER (WHERE source_type = 'direct_quote' AND a <> '' AND b <> '' AND (contains(a, b) OR len(list_intersect({_stems('a')}, {_stems('b')})) >= CASE WHEN numeric THEN 1 ELSE 0.66 END * len({_stems('b')}))) AS n_direct,
    count(*) FILTER (WHERE source_type IN ('inferred_reasoning', 'calculation')) AS n_inferred, count(*) FILTER (WHERE source_type IN ('quote_plus_page', 'approximate_highlight')) AS n_loose
    FROM (SELECT e.proposal_id, source_type, {_form('quote_text')} AS a, {_form('proposed_value')} AS b, coalesce(field_type IN ('number', 'numeric'), false) AS numeric FROM (SELECT DISTINCT proposal_id, evidence_id, source_type, quote_text FROM evidence) e JOIN (SELECT DISTINCT proposal_id, proposed_value, field_type FROM proposals) x USING (proposal_id)) GROUP BY 1) f USING (proposal_id)),
  s AS (SELECT *, CASE WHEN state = 'error' THEN 'error' WHEN state IN ('blocked', 'skipped', 'unclear') THEN 'blocked' WHEN n_direct > 0 THEN 'direct_evidence' WHEN n_evidence > 0 THEN 'inferred_from_evidence' ELSE 'weak_evidence' END AS support FROM l)"""
_attention = "['anchor_fallback', 'approximate_anchor', 'insufficient_evidence', 'ambiguous_evidence', 'conflicting_evidence']"
_diagnostic = "['retrieval_empty', 'pdf_unmatched', 'row_unmatched', 'duplicate_row_conflict']"
_BUCKETS = f"""SELECT proposal_id, b AS bucket, b IS NOT DISTINCT FROM review_bucket AS agrees, CASE WHEN proposal_status IN ('error', 'not_attempted', 'not_applicable') THEN CASE WHEN evidence_status <> 'not_applicable' THEN proposal_status || ' requires not_applicable' END
  WHEN evidence_status = 'not_applicable' THEN proposal_status || ' cannot be not_applicable' WHEN proposal_status = 'value_proposed' AND evidence_status = 'no_evidence' AND NOT list_contains(reasons, 'insufficient_evidence') THEN 'value without evidence needs insufficient_evidence'
  WHEN proposal_status = 'unresolved' AND evidence_status IN ('direct_strong', 'inferred_strong') AND NOT list_has_any(reasons, ['conflicting_evidence', 'ambiguous_evidence']) THEN 'unresolved with strong evidence needs a conflict' END AS broken_rule FROM (SELECT *, CASE WHEN proposal_status IN ('error', 'not_attempted', 'not_applicable') THEN 'diagnostic'
  WHEN proposal_status = 'unresolved' AND evidence_status = 'no_evidence' AND len(reasons) > 0 AND list_has_all({_diagnostic}, reasons) THEN 'diagnostic' WHEN evidence_status IN ('direct_weak', 'inferred_weak') OR list_has_any(reasons, {_attention}) OR (proposal_status = 'no_data' AND evidence_status = 'no_evidence') OR proposal_status = 'unresolved' THEN 'attention' ELSE 'review' END AS b FROM {_P})"""
_TIER = f"""SELECT evidence_id, proposal_id, evidence_rank, tier, CASE tier WHEN 'A' THEN 'direct_strong' WHEN 'B' THEN 'direct_weak' ELSE 'no_evidence' END AS tier_status, CASE WHEN tier = 'A' THEN 'review' ELSE 'attention' END AS tier_bucket, CASE tier WHEN 'A' THEN []::VARCHAR[] WHEN 'B' THEN ['approximate_anchor'] ELSE ['missing_structured_evidence'] END AS tier_codes
  FROM (SELECT *, CASE WHEN trim(coalesce(pdf_id, '')) <> '' AND page_number > 0 THEN CASE WHEN trim(coalesce(quote_text, '')) <> '' THEN 'A' WHEN anchor_confidence > 0.5 THEN 'B' ELSE 'D' END ELSE 'D' END AS tier FROM {_E})"""
_OVER = f"""SELECT proposal_id, CASE WHEN list_contains(codes, 'protocol_inference') THEN 'inferred_weak' WHEN list_contains(codes, 'figure_estimate') THEN 'direct_weak' WHEN list_contains(codes, 'calculation') THEN CASE WHEN evidence_status = 'direct_strong' THEN 'inferred_strong' ELSE 'inferred_weak' END ELSE evidence_status END AS new_status,
  CASE WHEN list_has_any(codes, ['protocol_inference', 'figure_estimate']) OR (list_contains(codes, 'calculation') AND evidence_status IS DISTINCT FROM 'direct_strong') THEN 'attention' ELSE review_bucket END AS new_bucket, array_to_string(list_concat(coalesce(warning_flags, []), list_filter(['figure_estimate', 'protocol_inference'], lambda c: list_contains(codes, c) AND NOT list_contains(coalesce(warning_flags, []), c))), ',') AS new_flags
  FROM {_P} LEFT JOIN (SELECT proposal_id, list(DISTINCT CASE source_type WHEN 'calculation' THEN 'calculation' WHEN 'visual_interpretation_figure_evidence' THEN 'figure_estimate' WHEN 'inferred_reasoning' THEN 'protocol_inference' END) AS codes FROM evidence GROUP BY 1) USING (proposal_id)"""
_fig = r"(?i)\b(?:fig(?:ure)?\.?\s*)(\d+)([a-z])?(?:\s*[-–]\s*([a-z]))?\b"
_RANKED = f"WITH {passages._SCORED} {passages._top(passages._all('scored', 'bm25'), 'bm25')}"
# Word boundaries of this engine know ASCII only: letters of other scripts stand as underscores while figures are sought
_masked = lambda x: rf"regexp_replace(regexp_replace(coalesce({x}, ''), '[^\PLa-zA-Z]|[^\P{{Nd}}0-9]', '_', 'g'), '\pZ', ' ', 'g')"
_MENTIONS = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all({_masked('text')}, '{_fig}') AS r, regexp_split_to_array({_masked('text')}, '{_fig}') AS g FROM documents), u AS (SELECT doc_id, t, unnest(range(len(r))) AS i, r, g FROM t WHERE len(r) > 0),
  s AS (SELECT doc_id, i, t, r[i + 1] AS ref, coalesce(list_sum(list_transform(g[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(r[1:i], lambda x: length(x))), 0) AS b FROM u)
  SELECT doc_id, i::INTEGER AS ordinal, try_cast(regexp_extract(ref, '{_fig}', 1) AS INTEGER) AS figure_no, CASE WHEN regexp_extract(ref, '{_fig}', 3) <> '' THEN regexp_extract(ref, '{_fig}', 2) || '-' || regexp_extract(ref, '{_fig}', 3) ELSE nullif(regexp_extract(ref, '{_fig}', 2), '') END AS panel, trim(substr(t, (greatest(b - 140, 0) + 1)::BIGINT, (b + length(ref) + 220 - greatest(b - 140, 0))::BIGINT)) AS snippet FROM s"""
_words = lambda x: f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'))"
_refs = lambda x: rf"list_transform(regexp_extract_all({_masked(x)}, '{_fig}'), lambda r: try_cast(regexp_extract(r, '{_fig}', 1) AS INTEGER))"
_FIGURES = rf"""WITH rk AS MATERIALIZED (SELECT * FROM ({_RANKED}) WHERE bm25 > 0), c AS (SELECT * FROM {_C}), f AS (SELECT *, try_cast(regexp_extract(display_text, '(?i)fig(ure)?[^0-9]*([0-9]+)', 2) AS INTEGER) AS figure_no FROM c WHERE chunk_type = 'caption'),
  a AS (SELECT DISTINCT pdf_id, column_name, query_text FROM rk JOIN {passages._Q} USING (column_name)), w AS (SELECT pdf_id, unnest({_refs('display_text')}) AS figure_no FROM c WHERE chunk_type IN ('paragraph', 'caption', 'section') AND display_text IS NOT NULL), wn AS (SELECT pdf_id, figure_no, count(*) AS n FROM w GROUP BY 1, 2),
  o AS (SELECT rk.pdf_id, column_name, unnest({_refs('display_text')}) AS figure_no FROM rk JOIN c USING (chunk_id) WHERE display_text IS NOT NULL), n AS (SELECT pdf_id, column_name, figure_no, count(*) AS n FROM o GROUP BY 1, 2, 3), h AS (SELECT DISTINCT rk.pdf_id, column_name, figure_no FROM rk JOIN f USING (chunk_id) WHERE figure_no IS NOT NULL),
  x AS (SELECT f.pdf_id AS doc, a.column_name AS query, f.chunk_id AS figure_id, f.figure_no, coalesce(wn.n, 0) + coalesce(n.n, 0) AS n_references, {_words('query_text')} AS q, {_words('display_text')} AS cap, {_words('section_context')} AS near, h.figure_no IS NOT NULL AS hit FROM f JOIN a USING (pdf_id) LEFT JOIN wn USING (pdf_id, figure_no) LEFT JOIN n ON n.pdf_id = f.pdf_id AND n.column_name = a.column_name AND n.figure_no = f.figure_no LEFT JOIN h ON h.pdf_id = f.pdf_id AND h.column_name = a.column_name AND h.figure_no = f.figure_no WHERE f.figure_no IS NOT NULL),
  y AS (SELECT *, {v.round6("(CASE WHEN len(q) > 0 THEN 0.35::DOUBLE * len(list_intersect(cap, q)) / len(q) + 0.2::DOUBLE * len(list_intersect(near, q)) / len(q) ELSE 0 END + 0.25::DOUBLE * least(1.0, 0.25 * n_references) + 0.2::DOUBLE * hit::INTEGER)")} AS score FROM x),
  z AS (SELECT *, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM y)"""
_FACTS = rf"""{_LABELS}, rk AS MATERIALIZED ({_RANKED}), c AS (SELECT * FROM {_C}),
  r AS (SELECT rk.pdf_id, column_name, count(*) AS n_retrieved, coalesce(bool_or(rank <= 8 AND coalesce(chunk_type IN ('caption', 'figure'), false)), false) AS has_figure, coalesce(bool_or(rank <= 8 AND (coalesce(chunk_type IN ('caption', 'figure'), false) OR coalesce(regexp_matches({_masked('display_text')}, '(?i)\b(fig(ure)?\.?\s*\d+|panel\s*[a-z]|chart|plot|graph|image|microscopy)\b'), false))), false) AS promises FROM rk JOIN c USING (chunk_id) GROUP BY 1, 2),
  k AS (SELECT proposal_id, count(*) FILTER (WHERE source_type = 'direct_quote') AS n_exact, count(*) FILTER (WHERE source_type = 'approximate_highlight') AS n_near, count(*) FILTER (WHERE source_type = 'quote_plus_page') AS n_loose2, count(*) FILTER (WHERE source_type IN ('caption_grounded_figure_evidence', 'visual_interpretation_figure_evidence')) AS n_figure, bool_or(coalesce(trim(quote_text) <> '', false)) AS has_quote FROM {_E} GROUP BY 1),
  nc AS (SELECT proposal_id, count(DISTINCT n) >= 2 AS conflict FROM (SELECT proposal_id, unnest(regexp_extract_all({_masked('quote_text')}, '\b\d+(?:\.\d+)?%?\b')) AS n FROM {_E}) GROUP BY 1),
  pg AS (SELECT pdf_id, coalesce(bool_or(provenance = 'unknown'), false) AS fallback, coalesce(bool_or(provenance = 'ocr'), false) AS ocr FROM chunks GROUP BY 1),
  tx AS (SELECT rk.pdf_id, column_name, trim(regexp_replace(lower(concat_ws(' ', display_text, retrieval_text)), '[^0-9a-z]+', ' ', 'g')) AS t FROM rk JOIN c USING (chunk_id)),
  vs AS (SELECT DISTINCT s.proposal_id FROM (SELECT *, trim(regexp_replace(lower(proposed_value), '[^0-9a-z]+', ' ', 'g')) AS x FROM s) s JOIN tx USING (pdf_id, column_name) WHERE length(x) >= 4 AND contains(t, x)),
  qs AS (SELECT DISTINCT e.proposal_id FROM (SELECT proposal_id, pdf_id, trim(regexp_replace(lower(quote_text), '[^0-9a-z]+', ' ', 'g')) AS x FROM {_E}) e JOIN (SELECT DISTINCT proposal_id, column_name FROM proposals) USING (proposal_id) JOIN tx USING (pdf_id, column_name) WHERE length(x) >= 4 AND contains(t, x)),
  b AS (SELECT s.*, coalesce(needs_more_evidence, false) AS more, trim(regexp_replace(coalesce(proposed_value, ''), '\s+', ' ', 'g')) = '' AS missing, regexp_matches(column_name, '(?i)\b(figure|fig\.?|panel|plot|chart|graph|schematic|image|microscopy|visual|spatial map|heatmap|umap)\b') AS visual, coalesce(n_retrieved, 0) AS nr, coalesce(has_figure, false) AS hf, coalesce(promises, false) AS pf, coalesce(n_exact, 0) AS nx, coalesce(n_near, 0) AS nn, coalesce(n_loose2, 0) AS nl, coalesce(n_figure, 0) AS nf, coalesce(has_quote, false) AS hq, coalesce(conflict, false) AS cf,
    pg.pdf_id IS NOT NULL AS has_text, list_filter([CASE WHEN coalesce(fallback, false) THEN 'parser_fallback_used' END, CASE WHEN coalesce(ocr, false) THEN 'ocr_used' END], lambda i: i IS NOT NULL) AS ps, vs.proposal_id IS NOT NULL AS vseen, qs.proposal_id IS NOT NULL AS qseen FROM s LEFT JOIN r USING (pdf_id, column_name) LEFT JOIN k USING (proposal_id) LEFT JOIN nc USING (proposal_id) LEFT JOIN pg USING (pdf_id) LEFT JOIN vs USING (proposal_id) LEFT JOIN qs USING (proposal_id))"""
_list = lambda *pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda i: i IS NOT NULL), ',')"
ORACLES = {
    "anchor_chain": _CHAIN,
    "support_labels": f"WITH {_LABELS} SELECT proposal_id, state, support, n_evidence, n_direct, CASE WHEN state IN ('error', 'blocked', 'skipped') OR support = 'error' THEN 'not_applicable' WHEN n_evidence = 0 THEN 'no_evidence' ELSE CASE WHEN support = 'inferred_from_evidence' OR n_inferred > 0 THEN 'inferred' ELSE 'direct' END || CASE WHEN support = 'weak_evidence' OR list_contains(reasons, 'insufficient_evidence') OR n_loose > 0 THEN '_weak' ELSE '_strong' END END AS status FROM s",
    "review_buckets": _BUCKETS,
    "persisted_values": f"SELECT proposal_id, CASE WHEN proposal_status = 'unresolved' AND lower(trim(coalesce(proposed_value, ''))) IN ('', 'unclear', 'no value proposed', 'not_found', 'not found') THEN NULL ELSE proposed_value END AS kept_value FROM {_P}",
    "evidence_tiers": _TIER,
    "evidence_tier_rollup": f"WITH t AS ({_TIER}), u AS (SELECT proposal_id, unnest(tier_codes) AS code, coalesce(evidence_rank, 99) AS r, evidence_id FROM t), f AS (SELECT proposal_id, code, min((r, evidence_id)) AS place FROM u GROUP BY 1, 2), g AS (SELECT proposal_id, string_agg(code, ',' ORDER BY place, code) AS codes FROM f GROUP BY 1) SELECT a.proposal_id, a.tier, coalesce(g.codes, '') AS codes FROM (SELECT proposal_id, min(tier) AS tier FROM t GROUP BY 1) a LEFT JOIN g USING (proposal_id)",
    "derivation_overrides": _OVER,
    "figure_mentions": _MENTIONS,
    "figure_scores": f"{_FIGURES} SELECT doc, query, figure_id, n_references, score, band FROM z",
    "figure_selection": f"{_FIGURES} SELECT doc, query, place, figure_id, band FROM (SELECT *, row_number() OVER w::INTEGER AS place, first_value(score) OVER w AS top FROM z WINDOW w AS (PARTITION BY doc, query ORDER BY score DESC, figure_no, figure_id)) WHERE place = 1 OR (place = 2 AND (top < 0.65 OR score >= top - 0.12))",
    "trigger_reasons": f"WITH {_FACTS} SELECT proposal_id, {_list(('text_unclear', 'state = $$unclear$$'), ('text_weak', 'support = $$weak_evidence$$ OR more'), ('text_contradictory', 'cf'), ('visual_request', 'visual AND pf'), ('direct_figure_context', 'hf AND (state = $$unclear$$ OR support = $$weak_evidence$$ OR more OR cf OR missing OR (visual AND pf))'), ('figure_rescue_candidate', 'missing AND hf'))} AS vision, {_list(('unclear_state', 'state = $$unclear$$'), ('missing_usable_evidence', 'more OR NOT hq'), ('weak_or_inferred_evidence', 'support IN ($$weak_evidence$$, $$inferred_from_evidence$$)'), ('figure_relevant_without_figure_evidence', 'pf AND nf = 0'))} AS rescue FROM b",
    "retrieval_diagnoses": f"WITH {_FACTS} SELECT proposal_id, CASE WHEN state = 'error' THEN 'provider_failure' WHEN state IN ('blocked', 'skipped') THEN 'blocked_upstream' WHEN nr = 0 THEN CASE WHEN len(ps) > 0 THEN 'parser_source_gap' ELSE 'retrieval_miss' END WHEN nx = 0 AND nn + nl > 0 THEN 'evidence_anchoring_gap' WHEN state = 'unclear' OR more OR support = 'weak_evidence' THEN CASE WHEN vseen OR qseen THEN 'reasoning_gap' ELSE 'retrieval_miss' END WHEN len(ps) > 0 AND nx = 0 THEN 'parser_source_gap' ELSE 'not_needed' END AS diagnosis, array_to_string(list_concat(ps, list_filter([CASE WHEN nr = 0 THEN 'no_retrieval_chunks' END, CASE WHEN nn > 0 THEN 'approximate_highlight_only' END, CASE WHEN nl > 0 THEN 'quote_plus_page_fallback' END, CASE WHEN vseen THEN 'proposed_value_seen_in_retrieval' END, CASE WHEN qseen THEN 'quote_seen_in_retrieval' END, CASE WHEN nf > 0 THEN 'figure_evidence_present' END], lambda i: i IS NOT NULL)), ',') AS signals, CASE WHEN state NOT IN ('unclear', 'error', 'blocked') THEN NULL WHEN n_evidence > 0 THEN 'evidence_ambiguity' WHEN nr = 0 THEN 'retrieval_miss' WHEN NOT has_text THEN 'parser_gap' WHEN more OR NOT missing THEN 'evidence_ambiguity' ELSE 'extraction_miss' END AS attribution FROM b",
}
