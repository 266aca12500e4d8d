"""The extraction flow end to end with the deterministic default steps: rank, assemble, extract, judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import plug
from marginalia.plans import evaluation, passages
from marginalia.session import table


def contexts(spark: SparkSession, d: str) -> DataFrame:
    blocks = plug.context_blocks(passages.bm25(spark, d), passages.chunks(spark, d), doc="pdf_id", query="column_name", chunk="chunk_id", text="display_text", limit=passages.TOP_K)
    return blocks.withColumn("prompt", plug.render("Find {column} in the passages below.\n{passages}", {"column": F.col("column_name"), "passages": F.col("passages")}))


def extracted(spark: SparkSession, d: str) -> DataFrame:
    return plug.extract_values(contexts(spark, d), keep=["pdf_id", "column_name"])


def judged(spark: SparkSession, d: str) -> DataFrame:
    cells = evaluation.scored(spark, d).where("field_type = 'text'")
    return plug.judge_cells(cells, {"overlap": plug.overlap_judge}, keep=["run_id", "row_id", "column_name"]).groupBy("judge_label", "judge_verdict").agg(F.count("*").alias("n"))


def request_policies(spark: SparkSession, d: str) -> DataFrame:
    policy = plug.first_match(F.col("model_id"), {"-q[0-9]+$": "quantised", "-(long|beta)$": "long_context", "^ormond": "small"}, "standard")
    return table(spark, d, "text_models").select("model_id", policy.alias("policy"))


def grounded(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was extracted stands in the passages it was extracted from."""
    made = contexts(spark, d).select("pdf_id", "column_name", "passages")
    return extracted(spark, d).join(made, ["pdf_id", "column_name"]).select("pdf_id", "column_name", (F.col("proposed_value").isNull() | F.contains(F.col("passages"), F.col("proposed_value"))).alias("grounded"), F.col("extraction_error").isNull().alias("without_error"))


QUERIES = {"extract_cells": extracted, "extract_grounded": grounded, "judge_default": judged, "model_policies": request_policies}
_words = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[0-9a-z]+'))"
ORACLES = {
    "extract_grounded": f"SELECT pdf_id, column_name, true AS grounded, true AS without_error FROM (SELECT DISTINCT pdf_id FROM {passages._C}) CROSS JOIN (SELECT DISTINCT column_name FROM {passages._Q})",
    "judge_default": f"WITH c AS (SELECT {_words('gold_value')} AS g, {_words('proposed_value')} AS p FROM {evaluation.LATEST} WHERE field_type = 'text'), s AS (SELECT CASE WHEN len(list_distinct(list_concat(g, p))) > 0 THEN len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))) ELSE 0 END AS s FROM c) SELECT 'overlap' AS judge_label, CASE WHEN s >= 0.5 THEN 'correct' WHEN s < 0.2 THEN 'incorrect' ELSE 'unclear' END AS judge_verdict, count(*) AS n FROM s GROUP BY 2",
    "model_policies": "SELECT model_id, CASE WHEN regexp_matches(model_id, '-q[0-9]+$') THEN 'quantised' WHEN regexp_matches(model_id, '-(long|beta)$') THEN 'long_context' WHEN regexp_matches(model_id, '^ormond') THEN 'small' ELSE 'standard' END AS policy FROM text_models",
}
