"""Queries of roll-ups, support checks and assembly over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import tokens as tk
from marginalia.functions import values as v
from marginalia.operators import anchor as an
from marginalia.operators import retrieve as rt
from marginalia.operators import review as rv
from marginalia.plans import passages, reviewing
from marginalia.session import spread, table

TAIL, TAIL_CHARS, FRONT_BLOCKS = 3, 500, 40


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Judgements per cell, run and in all, in one pass over cells already counted (A34); repeated work is what exceeds one."""
    cells = table(spark, d, "judge_records").groupBy("run_id", "row_id", "column_name", "judge_label").agg(F.count("*").alias("n"), F.sum("request_tokens").alias("tokens"), F.count_if("input_was_truncated").alias("truncated"))
    return cells.groupingSets([["run_id", "column_name"], ["run_id"], []], "run_id", "column_name").agg(
        F.expr("cast(grouping_id(run_id, column_name) as int)").alias("level"), F.sum("n").alias("judgements"), F.count("*").alias("judged"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("repeated"), F.sum("tokens").alias("tokens"), F.sum("truncated").alias("truncated")
    )


def value_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct values of attributes per benchmark (A36). Attributes of few values by nature."""
    s = table(spark, d, "scored_cells")
    names = ("text_model_id", "comparison_kind", "join_status", "judge_model_id")
    pairs = s.select("benchmark_id", F.inline(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value")) for c in names]))).where("value is not null").distinct()
    return pairs.groupBy("benchmark_id", "attribute").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("values"), F.count("*").alias("n"))


def page_tail(spark: SparkSession, d: str) -> DataFrame:
    """Text of the last passages of each page, in order, cut to a length (W12). Passages beyond go before the shuffle."""
    c = passages.chunks(spark, d).where("display_text is not null")
    w = Window.partitionBy("pdf_id", "page_number").orderBy(F.desc("reading_order"), F.desc("chunk_id"))
    last = c.select("pdf_id", "page_number", "reading_order", "chunk_id", "display_text").withColumn("k", F.row_number().over(w)).where(F.col("k") <= TAIL)
    return last.groupBy("pdf_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", "chunk_id", "display_text"))).alias("a")).select(
        "pdf_id", "page_number", F.left(F.array_join(F.transform("a", lambda x: x["display_text"]), "\n"), F.lit(TAIL_CHARS)).alias("tail")
    )


def _valued(spark: SparkSession, d: str) -> DataFrame:
    """Proposed values of four or more characters in plain text."""
    p = table(spark, d, "proposals").where("proposal_status = 'value_proposed'").select("proposal_id", "pdf_id", "proposed_value").distinct()
    return p.where(f"length({v.plain_text('proposed_value')}) >= 4")


def mentioned(spark: SparkSession, d: str) -> DataFrame:
    """Proposed values that stand in either text of a passage of their paper (X53), cut words included, with the number of passages."""
    c = passages.chunks(spark, d).select("pdf_id", "chunk_id", F.concat_ws(" ", "display_text", "retrieval_text").alias("both_texts"))
    found = an.contained_quotes(_valued(spark, d), c, keys=["pdf_id"], quote_id="proposal_id", quote="proposed_value", passage_id="chunk_id", passage="both_texts", fold=an.plain_words)
    return found.groupBy("proposal_id").agg(F.count("*").alias("n_passages"))


def supported(spark: SparkSession, d: str) -> DataFrame:
    """Whether a proposal's quotes or cited pages hold its value, by its type (X15). Values of any length."""
    p = table(spark, d, "proposals").where("proposal_status = 'value_proposed'").select("proposal_id", "field_type", "proposed_value").distinct()
    page = ("pdf_id", "page_number")
    pages = an.page_texts(passages.chunks(spark, d), page, ("reading_order", "chunk_id"), "display_text")
    e = table(spark, d, "evidence").select("evidence_id", "proposal_id", *page, "quote_text").distinct()
    return an.support_outcomes(p, e, pages, proposal="proposal_id", field_type="field_type", value="proposed_value", evidence_id="evidence_id", quote="quote_text", page=page)


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """DOI and year candidates among the first blocks of each document: one is found, several are ambiguous."""
    b = rt.blocks(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    w = Window.partitionBy("doc_id").orderBy("reading_order")
    first = b.withColumn("k", F.row_number().over(w)).where(F.col("k") <= FRONT_BLOCKS)
    year = F.expr(f"nullif({v.SPARK.part('block', '[(]((?:19|20)[0-9][0-9])[)]')}, '')")
    seen = first.select("doc_id", F.expr(v.doi_of("block")).alias("doi"), year.alias("year")).groupBy("doc_id").agg(F.count_distinct("doi").alias("dois"), F.min("doi").alias("doi"), F.count_distinct("year").alias("years"), F.min("year").alias("year"))
    state = lambda n: F.when(F.col(n) == 1, "found").when(F.col(n) > 1, "ambiguous").otherwise("missing")
    return seen.select("doc_id", state("dois").alias("doi_state"), F.when(F.col("dois") == 1, F.col("doi")).alias("doi"), state("years").alias("year_state"), F.when(F.col("years") == 1, F.col("year")).alias("year"))


def identity_match(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one table found in another by id, else by title; several titles alike are ambiguous."""
    g = table(spark, d, "genome_editing_tools_filled")
    t = g.where("row_id is not null").groupBy("row_id").agg(F.max("title").alias("title"), F.max("row_index").alias("i")).withColumn("k", F.expr(v.plain_text("title")))
    template = t.select(F.when(F.col("i") % 2 == 0, F.col("row_id")).otherwise(F.concat(F.lit("new_"), "row_id")).alias("row_id"), "k")
    by_id = template.join(t.select("row_id", F.col("row_id").alias("by_id")), "row_id", "left")
    titles = t.where("k is not null").groupBy("k").agg(F.min("row_id").alias("by_title"), F.count("*").alias("n"))
    return by_id.join(titles, "k", "left").select(
        "row_id", F.coalesce("by_id", F.when(F.col("n") == 1, F.col("by_title"))).alias("matched_id"), F.expr("case when by_id is not null then 'row_id' when n = 1 then 'title' when n > 1 then 'ambiguous' else 'none' end").alias("how")
    )


def first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Columns named by the schema, the proposals and the scored cells, the first source winning (V7)."""
    schema = table(spark, d, "schema_columns").select("column_name", F.lit(0).alias("ordinal"), "field_type")
    props = table(spark, d, "proposals").groupBy("column_name").agg(F.lit(0).alias("ordinal"), F.max("field_type").alias("field_type"))
    cells = table(spark, d, "scored_cells").groupBy(F.concat("column_name", F.when(F.col("join_status") == "excluded_proposal", F.lit(" (excluded)")).otherwise(F.lit(""))).alias("column_name")).agg(F.lit(0).alias("ordinal"), F.max("field_type").alias("field_type"))
    return rv.ordered_distinct_union([(schema, 0), (props, 1), (cells, 2)], "column_name", "ordinal").drop("ordinal")


def identities(spark: SparkSession, d: str) -> DataFrame:
    """Counts that must add up, checked per group (V3)."""
    p = reviewing.progress(spark, d)
    return p.select("group_id", (F.col("total") == F.col("reviewed") + F.col("pending")).alias("adds_up"), (F.col("accepted") + F.col("rejected") + F.col("deferred") <= F.col("reviewed")).alias("kinds_within"))


def rival_values(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose proposals hold more than one value once normalised."""
    p = table(spark, d, "proposals").where("proposal_status = 'value_proposed'").withColumn("k", F.expr(v.plain_text("proposed_value"))).where("k <> ''")
    return p.groupBy("row_id", "column_name").agg(F.count_distinct("k").alias("n_values"), F.min("k").alias("least"), F.max("k").alias("greatest")).where("n_values > 1")


def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    """Evidence by source beside each proposal, zero where it has none."""
    e = table(spark, d, "evidence").select("proposal_id", "evidence_id", "source_type").distinct()
    counts = e.groupBy("proposal_id").agg(*[F.count_if(F.col("source_type") == s).alias(s) for s in passages.AUTHORITY])
    p = table(spark, d, "proposals").select("proposal_id", "extraction_lane").distinct()
    return p.join(counts, "proposal_id", "left").na.fill(0, list(passages.AUTHORITY))


def judge_batches(spark: SparkSession, d: str) -> DataFrame:
    """Requests of each judge and model: how many, over how long, how large."""
    j = table(spark, d, "judge_records").distinct()
    return j.groupBy("judge_label", "judge_provider", "judge_model_id").agg(
        F.count("*").alias("requests"), F.sum("request_tokens").alias("tokens"), F.expr("cast(unix_micros(cast(max(judged_at) as timestamp)) - unix_micros(cast(min(judged_at) as timestamp)) as bigint)").alias("span_micros"), F.count_distinct("run_id").alias("runs")
    )


QUERIES = {
    "run_statistics": run_statistics, "value_sets": value_sets, "page_tail_text": page_tail, "value_mentioned": mentioned, "support_proxy": supported, "front_matter": front_matter, "row_identity_match": identity_match,
    "first_source_wins": first_wins, "count_identities": identities, "rival_values": rival_values, "evidence_sources": evidence_sources, "judge_batches": judge_batches,
}

D = v.DUCK
_plain = lambda x: rf"trim(regexp_replace(lower({x}), '[^0-9a-z]+', ' ', 'g'))"
_NUM = r"[-+]?(?:[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_SUPPORT = rf"""WITH p AS (SELECT DISTINCT proposal_id, field_type, proposed_value, trim(regexp_replace(proposed_value, '\s+', ' ', 'g')) AS t FROM proposals WHERE proposal_status = 'value_proposed'),
  n AS (SELECT *, field_type IN ('number', 'numeric') AS numeric, field_type = 'boolean' AS truth, regexp_replace(lower(t), '^(~|≈|approximately|approx\.|approx|about) *', '') AS bare, regexp_matches(lower(t), '^(~|≈|about([^0-9a-z_]|$)|approx(\.|imately)?([^0-9a-z_]|$))') AS near FROM p),
  o AS (SELECT *, CASE WHEN near THEN bare ELSE lower(t) END AS b FROM n),
  q AS (SELECT *, regexp_extract(b, '^({_NUM}) *(?:to|-|–|—) *({_NUM})$', 1) AS l, regexp_extract(b, '^({_NUM}) *(?:to|-|–|—) *({_NUM})$', 2) AS r, regexp_extract(b, '^({_NUM})$', 1) AS one FROM o),
  a AS (SELECT *, try_cast(replace(CASE WHEN l <> '' THEN l ELSE one END, ',', '') AS DOUBLE) AS x, try_cast(replace(CASE WHEN l <> '' THEN r ELSE one END, ',', '') AS DOUBLE) AS y, CASE WHEN lower(t) IN ('true', 'yes', 'present', 'positive', '1') THEN true WHEN lower(t) IN ('false', 'no', 'absent', 'negative', '0') THEN false END AS said, nullif(lower(t), '') AS raw, {_plain('t')} AS word FROM q),
  c AS (SELECT *, coalesce(CASE WHEN numeric THEN x IS NOT NULL AND y IS NOT NULL WHEN truth THEN said IS NOT NULL ELSE raw IS NOT NULL END, false) AS parsed FROM a),
  e AS (SELECT proposal_id, quote_text AS body, true AS quoted, bool_or(coalesce(evidence_id, '') <> '') AS named FROM evidence WHERE quote_text IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT DISTINCT ON (proposal_id, pdf_id, page_number) proposal_id, pdf_id, page_number, bool_or(coalesce(evidence_id, '') <> '') OVER (PARTITION BY proposal_id, pdf_id, page_number) AS named FROM evidence WHERE pdf_id IS NOT NULL AND page_number IS NOT NULL),
  h AS (SELECT pdf_id, page_number, string_agg(display_text, chr(10) ORDER BY reading_order, chunk_id) AS body FROM {passages._C} WHERE display_text IS NOT NULL GROUP BY 1, 2),
  u AS (SELECT * FROM e UNION ALL SELECT proposal_id, body, false, named FROM g JOIN h USING (pdf_id, page_number)),
  f AS (SELECT *, {_plain('body')} AS plain, list_transform(regexp_extract_all(translate(body, '０１２３４５６７８９', '0123456789'), '{_NUM}'), lambda i: try_cast(replace(i, ',', '') AS DOUBLE)) AS numbers FROM u WHERE trim(regexp_replace(body, '\s+', ' ', 'g')) <> ''),
  j AS (SELECT c.*, f.quoted, parsed AND coalesce(named, false) AND coalesce(CASE WHEN numeric THEN len(list_filter(numbers, lambda i: i >= least(x, y) AND i <= greatest(x, y))) > 0
      WHEN truth THEN len(list_intersect(string_split(plain, ' '), CASE WHEN said THEN ['true', 'yes', 'present', 'positive'] ELSE ['false', 'no', 'absent', 'negative'] END)) > 0
      WHEN word <> '' THEN contains(plain, word) ELSE contains(lower(trim(regexp_replace(body, '\s+', ' ', 'g'))), raw) END, false) AS hit FROM c LEFT JOIN f USING (proposal_id)),
  k AS (SELECT proposal_id, field_type, count(*) FILTER (WHERE quoted) AS n_quotes, count(*) FILTER (WHERE NOT quoted) AS n_pages, count(*) FILTER (WHERE hit) AS n_supporting, bool_or(parsed) AS parsed FROM j GROUP BY 1, 2)
  SELECT proposal_id, field_type, n_quotes, n_pages, n_supporting, n_supporting > 0 AS supported, CASE WHEN field_type NOT IN ('boolean', 'categorical', 'number', 'numeric') OR field_type IS NULL THEN 'not_applicable' WHEN NOT parsed OR n_quotes + n_pages = 0 THEN 'unvalidated' WHEN n_supporting > 0 THEN 'supported' ELSE 'unsupported' END AS status FROM k"""
_both = "concat_ws(' ', display_text, retrieval_text)"
_V = f"(SELECT DISTINCT proposal_id, pdf_id, proposed_value FROM proposals WHERE proposal_status = 'value_proposed' AND length({_plain('proposed_value')}) >= 4)"
_k = v.plain_text("title", D)
_kinds = ("text_model_id", "comparison_kind", "join_status", "judge_model_id")
ORACLES = {
    "run_statistics": "SELECT run_id, column_name, grouping(run_id, column_name)::INTEGER AS level, sum(n)::BIGINT AS judgements, count(*) AS judged, sum(greatest(n - 1, 0))::BIGINT AS repeated, sum(tokens)::BIGINT AS tokens, sum(truncated)::BIGINT AS truncated FROM (SELECT run_id, row_id, column_name, judge_label, count(*) AS n, sum(request_tokens) AS tokens, count(*) FILTER (WHERE input_was_truncated) AS truncated FROM judge_records GROUP BY 1, 2, 3, 4) GROUP BY GROUPING SETS ((run_id, column_name), (run_id), ())",
    "value_sets": f"SELECT benchmark_id, attribute, string_agg(value, ', ' ORDER BY value) AS values, count(*) AS n FROM ({' UNION '.join(f'SELECT benchmark_id, {chr(39)}{c}{chr(39)} AS attribute, {c} AS value FROM scored_cells WHERE {c} IS NOT NULL' for c in _kinds)}) GROUP BY 1, 2",
    "page_tail_text": f"SELECT pdf_id, page_number, left(string_agg(display_text, chr(10) ORDER BY reading_order, chunk_id), {TAIL_CHARS}) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY pdf_id, page_number ORDER BY reading_order DESC, chunk_id DESC) AS k FROM {passages._C} WHERE display_text IS NOT NULL) WHERE k <= {TAIL} GROUP BY 1, 2",
    "value_mentioned": f"SELECT proposal_id, count(DISTINCT chunk_id) AS n_passages FROM (SELECT *, {_plain('proposed_value')} AS q FROM {_V}) p JOIN (SELECT pdf_id, chunk_id, {_plain(_both)} AS t FROM {passages._C}) c USING (pdf_id) WHERE contains(t, q) GROUP BY 1",
    "support_proxy": _SUPPORT,
    "front_matter": f"SELECT doc_id, CASE WHEN dois = 1 THEN 'found' WHEN dois > 1 THEN 'ambiguous' ELSE 'missing' END AS doi_state, CASE WHEN dois = 1 THEN doi END AS doi, CASE WHEN years = 1 THEN 'found' WHEN years > 1 THEN 'ambiguous' ELSE 'missing' END AS year_state, CASE WHEN years = 1 THEN year END AS year FROM (SELECT doc_id, count(DISTINCT doi) AS dois, min(doi) AS doi, count(DISTINCT year) AS years, min(year) AS year FROM (SELECT doc_id, {v.doi_of('block', D)} AS doi, nullif({D.part('block', '[(]((?:19|20)[0-9][0-9])[)]')}, '') AS year FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) AS k FROM ({passages._BLOCKS}) WHERE NOT {v.is_empty('block', D)}) WHERE k <= {FRONT_BLOCKS}) GROUP BY 1)",
    "row_identity_match": f"WITH t AS (SELECT row_id, i, {_k} AS k FROM (SELECT row_id, max(title) AS title, max(row_index) AS i FROM genome_editing_tools_filled WHERE row_id IS NOT NULL GROUP BY 1)), m AS (SELECT CASE WHEN i % 2 = 0 THEN row_id ELSE 'new_' || row_id END AS row_id, k FROM t), n AS (SELECT k, min(row_id) AS by_title, count(*) AS n FROM t WHERE k IS NOT NULL GROUP BY 1) SELECT m.row_id, coalesce(t.row_id, CASE WHEN n = 1 THEN by_title END) AS matched_id, CASE WHEN t.row_id IS NOT NULL THEN 'row_id' WHEN n = 1 THEN 'title' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how FROM m LEFT JOIN t ON t.row_id = m.row_id LEFT JOIN n ON n.k = m.k",
    "first_source_wins": "WITH u AS (SELECT column_name, field_type, 0 AS source_priority FROM schema_columns UNION ALL SELECT column_name, max(field_type), 1 FROM proposals GROUP BY 1 UNION ALL SELECT column_name || CASE WHEN join_status = 'excluded_proposal' THEN ' (excluded)' ELSE '' END, max(field_type), 2 FROM scored_cells GROUP BY 1) SELECT column_name, source_priority, field_type FROM u QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY source_priority, field_type) = 1",
    "count_identities": "SELECT DISTINCT c_nationkey AS group_id, true AS adds_up, true AS kinds_within FROM customer",
    "rival_values": f"SELECT * FROM (SELECT row_id, column_name, count(DISTINCT k) AS n_values, min(k) AS least, max(k) AS greatest FROM (SELECT *, {v.plain_text('proposed_value', D)} AS k FROM proposals WHERE proposal_status = 'value_proposed') WHERE k <> '' GROUP BY 1, 2) WHERE n_values > 1",
    "evidence_sources": f"SELECT p.proposal_id, extraction_lane, {', '.join(f'coalesce({s}, 0) AS {s}' for s in passages.AUTHORITY)} FROM (SELECT DISTINCT proposal_id, extraction_lane FROM proposals) p LEFT JOIN (SELECT proposal_id, {', '.join(f'count(*) FILTER (WHERE source_type = {chr(39)}{s}{chr(39)}) AS {s}' for s in passages.AUTHORITY)} FROM (SELECT DISTINCT proposal_id, evidence_id, source_type FROM evidence) GROUP BY 1) USING (proposal_id)",
    "judge_batches": "SELECT judge_label, judge_provider, judge_model_id, count(*) AS requests, sum(request_tokens)::BIGINT AS tokens, epoch_us(max(judged_at)) - epoch_us(min(judged_at)) AS span_micros, count(DISTINCT run_id) AS runs FROM (SELECT DISTINCT * FROM judge_records) GROUP BY 1, 2, 3",
}
