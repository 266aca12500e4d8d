"""Queries of the training-data operators over the test tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.canonical import map_to_list
from marginalia.llm.consensus import consensus
from marginalia.llm.encode import decode_ids, encode_texts
from marginalia.llm.mixture import mix_sources
from marginalia.llm.spam import find_spam
from marginalia.llm.split import split_texts
from marginalia.llm.visual import find_quotes
from marginalia.session import spread, table

CELL = ("run_id", "row_id", "column_name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "proposals").where(
        (F.col("field_type") == "categorical") & (F.col("proposal_status") == "value_proposed") & F.col("proposed_value").rlike(r"(?U)[^\s\p{Z}]")
        & ~F.coalesce(F.array_contains("allowed_values", F.col("proposed_value")), F.lit(False))
    )
    return map_to_list(typed, table(spark, sf_dir, "schema_columns"), value="proposed_value", allowed="allowed_values", list_key="column_name", keep=("proposal_id",)).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_quotes(
        table(spark, sf_dir, "evidence"), table(spark, sf_dir, "chunks"),
        quote_id="evidence_id", quote="quote_text", text_id="chunk_id", text="display_text", keys=("pdf_id", "page_number"),
    )


def _pieces(spark: SparkSession, sf_dir: str, once: bool = False, keep: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    models = table(spark, sf_dir, "text_models").select(F.col("model_id").alias("text_model_id"), "working_context_budget", "piece_overlap")
    chunks = table(spark, sf_dir, "chunks").where(F.col("retrieval_text").isNotNull()).select("chunk_id", "text_model_id", "retrieval_text")
    sized = spread(chunks).join(models.where("working_context_budget is not null").dropDuplicates(["text_model_id"]), "text_model_id")
    oversized = sized.where(F.char_length("retrieval_text") > F.col("working_context_budget"))
    oversized = (oversized.dropDuplicates() if once else oversized).withColumn("text_md5", F.md5("retrieval_text"))
    return split_texts(oversized, "retrieval_text", "working_context_budget", "piece_overlap", keep=keep, only_oversized=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("n_pieces <> 1").select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, once=True)


def p4_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each oversized chunk keep its budget and overlap and give its text back, character for character."""
    keep = ("chunk_id", "working_context_budget", "piece_overlap", "text_md5")
    pieces = _pieces(spark, sf_dir, once=True, keep=keep).withColumn("shared", F.coalesce("piece_overlap", F.lit(0)))
    added = F.struct("piece", "start", "end", F.expr("case when piece = 0 then piece_text else substring(piece_text, shared + 1) end").alias("added"))
    whole = pieces.groupBy(*keep, "shared").agg(F.array_sort(F.collect_list(added)).alias("p"))  # no larger than the chunk itself
    return whole.select(
        "chunk_id", F.expr("forall(p, x -> x.end - x.start <= working_context_budget)").alias("within_budget"),
        F.expr("forall(sequence(2, size(p)), i -> p[i - 1].start = p[i - 2].end - shared)").alias("overlap_kept"),
        (F.md5(F.array_join("p.added", "")) == F.col("text_md5")).alias("text_kept"),
    ).distinct()


def _consensus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return consensus(
        table(spark, sf_dir, "judge_records"), item=CELL, annotator="judge_label", label="judge_verdict", labels=("correct", "incorrect", "unclear"), at="judged_at", consensus_col="consensus_verdict"
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[0].select(*CELL, "consensus_verdict")


def p6_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[0]


def p6_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[1]


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes and agreement of each cell: what of the consensus follows without a model."""
    return _consensus(spark, sf_dir)[0].select(*CELL, "n_votes", F.floor(F.col("agreement") * 1000000 + 0.5).alias("agreement_ppm"))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ids of each text lead back to it, character for character."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = decode_ids(encode_texts(docs, "doc_id", "text"), "doc_id", "ids")
    return docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("own")).join(back.select("doc_id", F.md5("text").alias("back"), F.size("ids").alias("n_ids")), "doc_id").select("doc_id", (F.col("own") == F.col("back")).alias("text_kept"), (F.col("n_ids") == 0).alias("no_ids"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each target source has documents, keeps its repeats, and reaches its share of those that have, to within as
    many of the largest documents as there are sources."""
    mixture, report = _mixture(spark, sf_dir)
    most = mixture.groupBy("source").agg(F.max("n_repeats").alias("most"), F.max("n_tokens").alias("largest"))
    every = Window.partitionBy(F.lit(1))  # one row per target source
    report = report.drop("most_repeats").join(most, "source", "left").withColumns({
        "whole": F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(every), "total": F.sum("tokens").over(every), "largest": F.max("largest").over(every), "sources": F.count("*").over(every),
    })
    off = F.abs(F.col("tokens") - F.when(F.col("tokens") > 0, F.col("target_share") / F.col("whole")).otherwise(F.lit(0.0)) * F.col("total"))
    return report.select(
        "source", (F.col("tokens") > 0).alias("has_documents"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (off <= F.col("sources") * F.coalesce("largest", F.lit(0))).alias("share_met")
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spam(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).where("is_spam").select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_audit": p4_audit, "p6_found": p6_found, "p6_cells": p6_cells, "p6_agreement": p6_agreement, "p7_roundtrip": p7_roundtrip,
    "p6_judges": p6_judges, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_audit": p8_audit, "p9_found": p9_found,
}

_USABLE = "(SELECT run_id, row_id, column_name, judge_label, vd FROM (SELECT *, regexp_replace(lower(judge_verdict), '[^a-z]+', '', 'g') AS vd FROM judge_records) WHERE vd IN ('correct', 'incorrect', 'unclear') QUALIFY row_number() OVER (PARTITION BY run_id, row_id, column_name, judge_label ORDER BY judged_at DESC NULLS LAST, vd = 'unclear' DESC, vd = 'incorrect' DESC) = 1)"
ORACLES = {
    "p6_agreement": f"WITH c AS (SELECT run_id, row_id, column_name, count(*) AS n, count(*) FILTER (WHERE vd = 'correct') AS a, count(*) FILTER (WHERE vd = 'incorrect') AS b, count(*) FILTER (WHERE vd = 'unclear') AS c FROM {_USABLE} GROUP BY 1, 2, 3) SELECT run_id, row_id, column_name, n::INTEGER AS n_votes, CASE WHEN n > 1 THEN floor((a * (a - 1) + b * (b - 1) + c * (c - 1)) / (n * (n - 1))::DOUBLE * 1000000 + 0.5)::BIGINT END AS agreement_ppm FROM c",
    "p7_roundtrip": "SELECT doc_id, true AS text_kept, coalesce(text, '') = '' AS no_ids FROM documents",
    "p8_audit": "SELECT t.source, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0) AS has_documents, true AS within_repeats, true AS share_met FROM mix_targets t",
    "p4_audit": "SELECT DISTINCT c.chunk_id, true AS within_budget, true AS overlap_kept, true AS text_kept FROM chunks c JOIN text_models m ON c.text_model_id = m.model_id WHERE length(c.retrieval_text) > m.working_context_budget",
    "p4_found": "SELECT DISTINCT c.chunk_id FROM chunks c JOIN text_models m ON c.text_model_id = m.model_id WHERE length(c.retrieval_text) > m.working_context_budget",
}
