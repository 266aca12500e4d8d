"""Queries of the review ledger, over events as decisions and proposals and filled tables as what is decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import review as rv
from marginalia.session import table

KINDS = ("accepted", "rejected", "deferred")
_DECISION = "case event_type when 'click' then 'accepted' when 'view' then 'rejected' when 'error' then 'deferred' else 'accepted_with_edit' end"
COLUMNS = ("publication_year", "journal", "doi", "editing_modality", "main_improvement_claim")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id as proposal_id", "ts as decided_at", "event_id as seq", f"{_DECISION} as decision", "value")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey as proposal_id", "c_nationkey as group_id")


def latest(spark: SparkSession, d: str) -> DataFrame:
    return rv.latest_decisions(ledger(spark, d), "proposal_id", "decided_at", "seq").drop("value").withColumn("decided_at", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss"))


def progress(spark: SparkSession, d: str) -> DataFrame:
    return rv.progress(items(spark, d), latest(spark, d), "proposal_id", "decision", ["group_id"], KINDS)


def undecided(spark: SparkSession, d: str) -> DataFrame:
    return rv.undecided(items(spark, d), ledger(spark, d), "proposal_id")


def orphans(spark: SparkSession, d: str) -> DataFrame:
    evidence = rv.referential_errors(table(spark, d, "evidence").distinct(), table(spark, d, "proposals").where("proposal_status = 'value_proposed'"), "proposal_id", "proposal_id", "evidence without proposed value")
    decisions = rv.referential_errors(ledger(spark, d).selectExpr("cast(proposal_id as string) as p"), items(spark, d).selectExpr("cast(proposal_id as string) as p"), "p", "p", "decision for unknown proposal")
    return evidence.unionByName(decisions)


def queue(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proposals").select("proposal_id", "pdf_id", "review_bucket").distinct()
    return rv.grouped_queue(p, "pdf_id", F.col("review_bucket") == "attention", "proposal_id").select("proposal_id", "pdf_id", "pending_in_group", "in_group", "group_rank")


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "genome_editing_tools_filled").groupBy("row_id").agg(*[F.max(c).alias(c) for c in COLUMNS])


def cells_long(spark: SparkSession, d: str) -> DataFrame:
    return rv.to_long(_filled(spark, d), ["row_id"], COLUMNS)


def export_wide(spark: SparkSession, d: str) -> DataFrame:
    """Cells with accepted changes in place and new cells added, pivoted back (K4, K7)."""
    long = cells_long(spark, d)
    changes = long.where("column_name = 'journal' and value is null").selectExpr("row_id", "column_name", "'(journal missing)' as value").unionByName(long.where("column_name = 'doi' and value is not null").selectExpr("row_id", "'doi_link' as column_name", "concat('https://doi.org/', value) as value"))
    return rv.to_wide(rv.upsert_cells(long, changes, ["row_id", "column_name"], "value"), "row_id", "column_name", "value", [*COLUMNS, "doi_link"])


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Latest proposed value of each cell beside the value the table holds."""
    p = table(spark, d, "proposals").where("proposal_status = 'value_proposed'").groupBy("row_id", "column_name").agg(F.max(F.struct("created_at", "proposal_id", "proposed_value")).alias("x"), F.count_distinct("proposal_id").alias("n_proposals"))
    s = table(spark, d, "scored_cells").groupBy("row_id", "column_name").agg(F.max("gold_value").alias("held_value"))
    return p.join(s, ["row_id", "column_name"], "left").select("row_id", "column_name", F.col("x.proposal_id").alias("proposal_id"), F.col("x.proposed_value").alias("proposed_value"), "held_value", "n_proposals")


def warning_counts(spark: SparkSession, d: str) -> DataFrame:
    """Proposals by several dimensions at once, list-valued ones exploded."""
    p = table(spark, d, "proposals").select("proposal_id", "proposal_status", "evidence_status", "review_bucket", "warning_flags").distinct()
    pairs = F.array_union(
        F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(c, F.lit("none")).alias("value")) for c in ("proposal_status", "evidence_status", "review_bucket")]),
        F.transform(F.coalesce("warning_flags", F.array()), lambda x: F.struct(F.lit("warning_flag").alias("dimension"), x.alias("value"))),
    )
    return p.select("proposal_id", F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"), F.min("proposal_id").alias("first_id"))


_KIND = "case cast(conv(right(proposal_id, 2), 16, 10) as int) % 6 when 0 then 'accepted' when 1 then 'rejected' when 2 then 'confirmed_no_data' when 3 then 'accepted_with_edit' when 4 then 'deferred' end"


def decided(spark: SparkSession, d: str) -> DataFrame:
    """Proposals with a decision made of their id; one in six has none."""
    p = table(spark, d, "proposals").select("proposal_id", "run_id", "row_id", "column_name", "proposal_status", "evidence_status", "review_bucket", "proposed_value", "warning_flags", "created_at").distinct()
    return p.withColumns({"decision": F.expr(_KIND), "edited_value": F.concat(F.lit("edited "), F.col("column_name")), "reasons": F.expr("case when array_contains(warning_flags, 'low_confidence_proposal') then array('insufficient_evidence') else cast(array() as array<string>) end")})


FILTERS = {"undecided": {"decision": "undecided"}, "open_weak": {"evidence": "weak", "reviewable_only": True}, "fallback": {"evidence": "fallback", "decision": "accepted"}, "species": {"column_name": "Species", "figure": False}, "drawn": {"evidence": "figure_derived"}}


def filters(spark: SparkSession, d: str) -> DataFrame:
    """Proposals each of several filters lets through."""
    p = decided(spark, d)
    parts = [rv.filtered(p, **kw).select(F.lit(name).alias("filter"), "proposal_id") for name, kw in FILTERS.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def categories(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of each proposal."""
    flagged = decided(spark, d).withColumn("flags", F.transform("warning_flags", lambda f: F.when(f == "low_confidence_proposal", F.lit("low_confidence")).otherwise(f)))
    return flagged.select("proposal_id", F.array_join(rv.warning_categories("flags", "reasons", "evidence_status"), ",").alias("categories"), rv.is_fallback("warning_flags", "reasons").alias("fallback"), rv.is_reviewable("review_bucket").alias("reviewable"))


def counted(spark: SparkSession, d: str) -> DataFrame:
    """Progress per run, over all and over what is to be reviewed."""
    return rv.counters(decided(spark, d), ["run_id"])


def shown(spark: SparkSession, d: str) -> DataFrame:
    """What a cell shows, and what would be exported of it."""
    s = table(spark, d, "scored_cells").groupBy("run_id", "row_id", "column_name").agg(F.max("gold_value").alias("held"))
    value, status = rv.display("proposed_value", "edited_value", "held", "proposal_status")
    joined = decided(spark, d).join(s, ["run_id", "row_id", "column_name"], "left")
    export = F.when(F.col("decision") == "accepted", F.col("proposed_value")).when(F.col("decision") == "accepted_with_edit", F.col("edited_value"))
    return joined.select("proposal_id", value.alias("shown"), status.alias("status"), export.alias("export_value"))


def bulk(spark: SparkSession, d: str) -> DataFrame:
    """One decision on a selection, kept from what is decided."""
    p = decided(spark, d)
    chosen = p.where("column_name = 'Species' or review_bucket = 'attention'").select("proposal_id").unionByName(spark.createDataFrame([("nobody",)], "proposal_id string"))
    return rv.bulk_decisions(chosen, p, p.where("decision is not null"), "proposal_id", "rejected")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Rows by columns with latest proposal, decision and primary evidence."""
    rows = table(spark, d, "spatial_transcriptomics_filled").select("row_id").where("row_id is not null").distinct()
    columns = table(spark, d, "schema_columns").where("benchmark_id = 'spatial_transcriptomics'")
    p = decided(spark, d).select("row_id", "column_name", "created_at", "proposal_id", "proposed_value", "decision")
    e = table(spark, d, "evidence").select("proposal_id", "evidence_id", "is_primary", "evidence_rank")
    return rv.review_grid(rows, columns, p, e, row="row_id", column="column_name", at=["created_at", "proposal_id"], proposal="proposal_id").drop("created_at")


def gate(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose decisions can be exported."""
    return rv.export_gate(decided(spark, d), ["run_id"])


QUERIES = {
    "review_latest": latest, "review_progress": progress, "review_undecided": undecided, "referential_errors": orphans, "review_queue_groups": queue,
    "cells_long": cells_long, "export_wide": export_wide, "export_audit": audit, "proposal_breakdown": warning_counts,
    "review_filters": filters, "warning_categories": categories, "review_counters": counted, "review_display": shown, "review_bulk": bulk, "review_grid": grid, "export_gate": gate,
}

_LEDGER = f"(SELECT user_id AS proposal_id, ts AS decided_at, event_id AS seq, {_DECISION} AS decision FROM events)"
_LATEST = f"(SELECT proposal_id, decided_at, seq, decision, n_decisions FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY decided_at DESC, seq DESC) AS rn, count(*) OVER (PARTITION BY proposal_id) AS n_decisions FROM {_LEDGER}) WHERE rn = 1)"
_FILLED = f"(SELECT row_id, {', '.join(f'max({c}) AS {c}' for c in COLUMNS)} FROM genome_editing_tools_filled GROUP BY 1)"
_LONG = " UNION ALL ".join(f"SELECT row_id, '{c}' AS column_name, {c} AS value FROM {_FILLED}" for c in COLUMNS)
_BREAK = "SELECT DISTINCT proposal_id, proposal_status, evidence_status, review_bucket, warning_flags FROM proposals"
_DEC = f"""(SELECT *, 'edited ' || column_name AS edited_value, CASE ('0x' || right(proposal_id, 2))::INTEGER % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'confirmed_no_data' WHEN 3 THEN 'accepted_with_edit' WHEN 4 THEN 'deferred' END AS decision, coalesce(list_contains(warning_flags, 'low_confidence_proposal'), false) AS doubt,
  coalesce(list_contains(warning_flags, 'fallback_evidence_used'), false) AS fb FROM (SELECT DISTINCT proposal_id, run_id, row_id, column_name, proposal_status, evidence_status, review_bucket, proposed_value, warning_flags, created_at FROM proposals))"""
_known = "('accepted', 'accepted_with_edit', 'confirmed_no_data', 'rejected')"
_open = "review_bucket IS DISTINCT FROM 'diagnostic'"
_count = lambda p, c: ", ".join([f"count(*) FILTER (WHERE {c}) AS {p}total", f"count(*) FILTER (WHERE {c} AND decision IN {_known}) AS {p}reviewed", f"count(*) FILTER (WHERE {c} AND (decision IS NULL OR decision NOT IN {_known})) AS {p}pending", *[f"count(*) FILTER (WHERE {c} AND decision = '{k}') AS {p}{k}" for k in ("accepted", "accepted_with_edit", "confirmed_no_data", "rejected")]])
ORACLES = {
    "review_latest": f"SELECT * REPLACE (strftime(decided_at, '%Y-%m-%d %H:%M:%S') AS decided_at) FROM {_LATEST}",
    "review_progress": f"SELECT c_nationkey AS group_id, count(*) AS total, count(decision) AS reviewed, count(*) FILTER (WHERE decision IS NULL) AS pending, {', '.join(f'count(*) FILTER (WHERE decision = {chr(39)}{k}{chr(39)}) AS {k}' for k in KINDS)} FROM customer LEFT JOIN {_LATEST} ON c_custkey = proposal_id GROUP BY 1",
    "review_undecided": "SELECT c_custkey AS proposal_id, c_nationkey AS group_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
    "referential_errors": "SELECT 'evidence without proposed value' AS rule, proposal_id AS ref, count(*) AS n_rows FROM (SELECT DISTINCT * FROM evidence) WHERE proposal_id IS NOT NULL AND proposal_id NOT IN (SELECT proposal_id FROM proposals WHERE proposal_status = 'value_proposed') GROUP BY 2 UNION ALL SELECT 'decision for unknown proposal', cast(user_id AS VARCHAR), count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 2",
    "review_queue_groups": "WITH p AS (SELECT DISTINCT proposal_id, pdf_id, review_bucket FROM proposals), g AS (SELECT pdf_id, count(*) FILTER (WHERE review_bucket = 'attention') AS pending_in_group, count(*) AS in_group FROM p GROUP BY 1), r AS (SELECT *, dense_rank() OVER (ORDER BY pending_in_group DESC, pdf_id)::INTEGER AS group_rank FROM g) SELECT proposal_id, pdf_id, pending_in_group, in_group, group_rank FROM p JOIN r USING (pdf_id)",
    "cells_long": _LONG,
    "export_wide": f"SELECT row_id, publication_year, coalesce(journal, '(journal missing)') AS journal, doi, editing_modality, main_improvement_claim, 'https://doi.org/' || doi AS doi_link FROM {_FILLED}",
    "export_audit": "WITH p AS (SELECT row_id, column_name, proposal_id, proposed_value, row_number() OVER (PARTITION BY row_id, column_name ORDER BY created_at DESC, proposal_id DESC) AS rn FROM (SELECT DISTINCT * FROM proposals WHERE proposal_status = 'value_proposed')), n AS (SELECT row_id, column_name, count(DISTINCT proposal_id) AS n_proposals FROM p GROUP BY 1, 2), s AS (SELECT row_id, column_name, max(gold_value) AS held_value FROM scored_cells GROUP BY 1, 2) SELECT row_id, column_name, proposal_id, proposed_value, held_value, n_proposals FROM p JOIN n USING (row_id, column_name) LEFT JOIN s USING (row_id, column_name) WHERE rn = 1",
    "proposal_breakdown": f"WITH p AS ({_BREAK}), x AS (SELECT proposal_id, 'proposal_status' AS dimension, coalesce(proposal_status, 'none') AS value FROM p UNION ALL SELECT proposal_id, 'evidence_status', coalesce(evidence_status, 'none') FROM p UNION ALL SELECT proposal_id, 'review_bucket', coalesce(review_bucket, 'none') FROM p UNION ALL SELECT proposal_id, 'warning_flag', f FROM (SELECT proposal_id, unnest(list_distinct(warning_flags)) AS f FROM p)) SELECT dimension, value, count(*) AS n, min(proposal_id) AS first_id FROM x GROUP BY 1, 2",
    "review_filters": f"SELECT 'undecided' AS filter, proposal_id FROM {_DEC} WHERE decision IS NULL UNION ALL SELECT 'open_weak', proposal_id FROM {_DEC} WHERE evidence_status IN ('direct_weak', 'inferred_weak') AND {_open} UNION ALL SELECT 'fallback', proposal_id FROM {_DEC} WHERE fb AND decision = 'accepted' UNION ALL SELECT 'species', proposal_id FROM {_DEC} WHERE column_name = 'Species'",
    "warning_categories": f"SELECT proposal_id, array_to_string(list_concat(list_transform(list_filter(coalesce(warning_flags, []), lambda f: f = 'low_confidence_proposal'), lambda f: 'low_confidence_proposal'), CASE WHEN doubt OR evidence_status IN ('direct_weak', 'inferred_weak') THEN ['weak_evidence'] ELSE [] END), ',') AS categories, fb AS fallback, {_open} AS reviewable FROM {_DEC}",
    "review_counters": f"SELECT run_id, {_count('', 'true')}, {_count('open_', _open)} FROM {_DEC} GROUP BY 1",
    "review_display": f"SELECT proposal_id, CASE WHEN decision IS NULL OR decision = 'accepted' THEN proposed_value WHEN decision = 'accepted_with_edit' THEN edited_value ELSE held END AS shown, CASE WHEN decision IS NULL THEN 'pending' WHEN decision = 'deferred' THEN proposal_status ELSE decision END AS status, CASE decision WHEN 'accepted' THEN proposed_value WHEN 'accepted_with_edit' THEN edited_value END AS export_value FROM {_DEC} LEFT JOIN (SELECT run_id, row_id, column_name, max(gold_value) AS held FROM scored_cells GROUP BY 1, 2, 3) USING (run_id, row_id, column_name)",
    "review_bulk": f"SELECT proposal_id, CASE WHEN decision IS NULL THEN 'recorded' ELSE 'skipped' END AS effect, CASE WHEN decision IS NULL THEN 'rejected' END AS decision FROM {_DEC} WHERE column_name = 'Species' OR review_bucket = 'attention' UNION ALL SELECT 'nobody', 'skipped', NULL",
    "review_grid": f"WITH g AS (SELECT row_id, column_name FROM (SELECT DISTINCT row_id FROM spatial_transcriptomics_filled WHERE row_id IS NOT NULL) CROSS JOIN (SELECT DISTINCT column_name FROM schema_columns WHERE benchmark_id = 'spatial_transcriptomics')), p AS (SELECT * FROM {_DEC} QUALIFY row_number() OVER (PARTITION BY row_id, column_name ORDER BY created_at DESC, proposal_id DESC) = 1), e AS (SELECT proposal_id, evidence_id FROM evidence QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY coalesce(is_primary, false) DESC, evidence_rank NULLS LAST, evidence_id) = 1) SELECT proposal_id, row_id, column_name, proposed_value, decision, evidence_id FROM g LEFT JOIN p USING (row_id, column_name) LEFT JOIN e USING (proposal_id)",
    "export_gate": f"SELECT run_id, count(*) FILTER (WHERE {_open} AND decision IS NULL) AS undecided, count(*) FILTER (WHERE decision IN ('accepted', 'accepted_with_edit')) AS to_write, count(*) FILTER (WHERE decision = 'rejected') AS left_out, count(*) FILTER (WHERE decision = 'accepted_with_edit' AND column_name IS NULL) AS edits_without_value, count(*) FILTER (WHERE {_open} AND decision IS NULL) > 0 AS blocked FROM {_DEC} GROUP BY 1",
}
