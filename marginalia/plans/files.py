"""Queries that write tables to the shared folder as other systems keep them, and read them back through the sources."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import sinks
from marginalia.functions import values as v
from marginalia.operators import checks as ck
from marginalia.session import shared_dir, table
from marginalia.sources import tables as tb

COLUMNS = ("row_id", "title", "authors", "publication_year", "journal", "doi")


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spatial_transcriptomics_filled").where("row_id is not null").groupBy("row_id").agg(*[F.max(c).alias(c) for c in COLUMNS[1:]])


def csv(spark: SparkSession, d: str) -> DataFrame:
    """A filled table written and read as CSV: all text, nulls as empty, line breaks and quotes kept."""
    path = _folder(spark, "csv")
    _filled(spark, d).write.options(header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return tb.read_csv(spark, path, indexed=False)


def gold(spark: SparkSession, d: str) -> DataFrame:
    """The same as gold cells: wide to long, ids made."""
    path = _folder(spark, "gold")
    _filled(spark, d).write.options(header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return tb.read_filled(spark, path, "run_x").drop("run_id")


def bundle(spark: SparkSession, d: str) -> DataFrame:
    """Proposals written as a run and read back by its loader, with what it reports."""
    path = _folder(spark, "run")
    p = table(spark, d, "proposals").select("proposal_id", "row_id", "column_name", "cell_id", "proposed_value", "proposal_status").distinct()
    lines = p.select(F.to_json(F.struct(F.lit("all").alias("run_id"), *p.columns)).alias("value"))
    broken = p.where("column_name = 'Species'").select(F.concat(F.lit("{"), "proposal_id").alias("value"))
    lines.unionByName(broken).write.text(f"{path}/proposals/proposals.jsonl")
    sinks.write_json(spark, {"run_id": "all", "artifact_schema_version": "main_run_bundle"}, f"{path}/run.json")
    proposals, errors = tb.read_runs(spark, [path])
    good = proposals.groupBy("column_name").agg(F.count("*").alias("n"), F.count("proposed_value").alias("valued"))
    bad = errors.where("rule = 'malformed line'").agg(F.lit("(malformed)").alias("column_name"), F.count("*").alias("n"), F.lit(0).cast("bigint").alias("valued"))
    return good.unionByName(bad)


def sidecar(spark: SparkSession, d: str) -> DataFrame:
    """Evidence kept beside a run, joined to the proposals that refer to it."""
    path = _folder(spark, "evidence")
    e = table(spark, d, "evidence").where("evidence_id is not null").groupBy("evidence_id").agg(*[F.max(c).alias(c) for c in ("proposal_id", "pdf_id", "page_number", "quote_text")])
    e.select(F.to_json(F.struct(F.lit("main_evidence").alias("evidence_schema_version"), "evidence_id", "proposal_id", "pdf_id", F.col("page_number").cast("int").alias("page_number"), "quote_text")).alias("value")).write.text(f"{path}/evidence/evidence.jsonl")
    kept, _ = tb.read_evidence(spark, [path])
    refs = e.select("proposal_id", "evidence_id")
    embedded = e.where("page_number = 1").select("proposal_id", "evidence_id", F.lit(1).alias("page"))
    out = tb.joined_evidence(embedded, kept.select("evidence_id", "proposal_id", "page", "quote_text"), refs)
    return out.select("proposal_id", "evidence_id", "page", "quote_text", "is_embedded")


def covered(spark: SparkSession, d: str) -> DataFrame:
    """Gold cells of rows that a paper was matched to (F8)."""
    s = table(spark, d, "scored_cells").select("run_id", "row_id", "column_name", "row_index").distinct()
    m = table(spark, d, "genome_editing_tools_filled").selectExpr("cast(row_index as string) as matched_row_index", "case when row_index % 3 = 0 then 'ambiguous' else 'matched' end as outcome", "row_index % 5 = 0 as blocked")
    return ck.covered_rows(s, m, "row_index").groupBy("row_index").agg(F.count("*").alias("n"))


QUERIES = {"source_csv": csv, "source_filled": gold, "source_run_bundle": bundle, "source_side_car": sidecar, "covered_gold": covered}

_F = f"(SELECT row_id, {', '.join(f'max({c}) AS {c}' for c in COLUMNS[1:])} FROM spatial_transcriptomics_filled WHERE row_id IS NOT NULL GROUP BY 1)"
ORACLES = {
    "source_csv": f"SELECT {', '.join(f'coalesce({c}, {chr(39)}{chr(39)}) AS {c}' for c in COLUMNS)} FROM {_F}",
    "source_filled": " UNION ALL ".join(f"SELECT row_id, '{c}' AS column_name, 'cell_' || left(sha256(row_id || '::{c}'), 12) AS cell_id, {c} AS proposed_value, 'value_proposed' AS proposal_status FROM {_F} WHERE NOT {v.is_empty(c, v.DUCK)}" for c in COLUMNS[1:]),
    "source_run_bundle": "WITH p AS (SELECT DISTINCT proposal_id, row_id, column_name, cell_id, proposed_value, proposal_status FROM proposals) SELECT column_name, count(*) AS n, count(proposed_value) AS valued FROM p WHERE row_id IS NOT NULL AND column_name IS NOT NULL GROUP BY 1 UNION ALL SELECT '(malformed)', count(*), 0 FROM p WHERE column_name = 'Species'",
    "source_side_car": "SELECT max(proposal_id) AS proposal_id, evidence_id, max(page_number)::INTEGER AS page, CASE WHEN max(page_number) = 1 THEN NULL ELSE max(quote_text) END AS quote_text, coalesce(max(page_number) = 1, false) AS is_embedded FROM evidence WHERE evidence_id IS NOT NULL GROUP BY evidence_id HAVING max(proposal_id) IS NOT NULL",
    "covered_gold": "SELECT row_index, count(*) AS n FROM (SELECT DISTINCT run_id, row_id, column_name, row_index FROM scored_cells) WHERE row_index IN (SELECT row_index FROM genome_editing_tools_filled WHERE row_index % 3 <> 0 AND row_index % 5 <> 0) GROUP BY 1",
}
