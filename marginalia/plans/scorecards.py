"""Queries of the whole run summary, over the scored cells and the judgements made on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import values as v
from marginalia.operators import scorecard as sc
from marginalia.plans import evaluation
from marginalia.session import table

KEY = ("run_id", "row_id", "column_name")
MAIN = ("judge_a", "judge_b")


def _judgements(spark: SparkSession, d: str) -> DataFrame:
    """The latest usable verdict of each judge on each cell."""
    j = table(spark, d, "judge_records").withColumn("verdict", F.expr(v.plain_text("judge_verdict"))).where("verdict in ('correct', 'incorrect', 'unclear')")
    latest = j.groupBy(*KEY, "judge_label").agg(F.max(F.struct("judged_at", "verdict", "judge_response_mode", "input_was_truncated")).alias("x"))
    return latest.select(*KEY, "judge_label", F.col("x.verdict").alias("verdict"), F.when(F.col("x.judge_response_mode") != "text", F.col("x.judge_response_mode")).alias("mode"), F.col("x.input_was_truncated").alias("cut"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Scored cells with everything the summary looks at. Columns of the species and of the assay stand in for metadata."""
    facts = sc.judge_facts(_judgements(spark, d), KEY, label="judge_label", verdict="verdict", mode="mode", error="coalesce(cut, false)", main=MAIN)
    s = evaluation.scored(spark, d).join(facts, list(KEY), "left")
    return s.withColumns({
        "gold": F.expr("join_status not in ('unmatched_proposal', 'excluded_proposal')"), "content": F.expr("column_name not in ('Species', 'Primary assay system')"), "scored": F.expr("was_scored and join_status not in ('unmatched_proposal', 'excluded_proposal')"), "correct": F.col("is_correct"),
        "structured": F.col("field_type").isin(*sc.STRUCTURED), "judge": F.expr("field_type = 'text' and n_correct + n_incorrect > 0"), "anchored": F.expr("evidence_outcome = 'validated'"), "unvalidated": F.expr("evidence_outcome = 'unvalidated'"),
        "n_proposals": F.expr("case join_status when 'duplicate_proposals' then 2 when 'missing_proposal' then 0 else case when proposed_value is null then 0 else 1 end end"), "adjudicable": F.expr("length(proposed_value) % 3 = 0"),
        "support": F.expr("case evidence_outcome when 'validated' then 'supported' when 'unvalidated' then 'unsupported' else 'unvalidated' end"),
    }).withColumn("present", F.expr("gold and is_gold_present"))


def card(spark: SparkSession, d: str) -> DataFrame:
    """Every count and rate of a run, and why it has no score."""
    return sc.unscored_reason(sc.scorecard(cells(spark, d), ["run_id"]))


def judges(spark: SparkSession, d: str) -> DataFrame:
    """Correctness by each judge of a run (A3)."""
    return sc.judge_correctness(cells(spark, d), _judgements(spark, d), ["run_id"], KEY, label="judge_label", verdict="verdict")


def delta(spark: SparkSession, d: str) -> DataFrame:
    return sc.judge_delta(judges(spark, d), ["run_id"], label="judge_label", main=MAIN)


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """Totals and failures of metadata fields (A5)."""
    c = cells(spark, d).where("present and not content").withColumn("status", F.expr("case when join_status = 'missing_proposal' then 'missing_proposal' when is_correct then 'found' else 'unclear' end"))
    return sc.metadata_summary(c, ["benchmark_id"], "column_name", "status", "failure_attribution")


def kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of metadata by name and by description."""
    names = table(spark, d, "part").selectExpr("p_partkey as k", "p_name as name", "concat('see ', p_brand, case p_partkey % 4 when 0 then '; metadata_field: pubmed id' when 1 then '; metadata-field:Venue!' when 2 then ' metadata_field:nothing' else ' about the title' end) as description")
    named = names.withColumn("name", F.expr("case k % 9 when 0 then 'Publication  Year' when 1 then 'DOI' when 2 then 'Author-List' when 3 then 'Web address' else name end"))
    return named.select("k", "name", sc.metadata_kind("name", "description").alias("kind"))


QUERIES = {"run_scorecard": card, "judge_correctness": judges, "judge_delta": delta, "metadata_summary": metadata, "metadata_kinds": kinds}

_J = f"(SELECT run_id, row_id, column_name, judge_label, vd, CASE WHEN judge_response_mode <> 'text' THEN judge_response_mode END AS mode, coalesce(input_was_truncated, false) AS cut FROM (SELECT *, trim(regexp_replace(lower(judge_verdict), '[^0-9a-z]+', ' ', 'g')) AS vd FROM judge_records) WHERE vd IN ('correct', 'incorrect', 'unclear') QUALIFY row_number() OVER (PARTITION BY run_id, row_id, column_name, judge_label ORDER BY judged_at DESC, vd DESC, judge_response_mode DESC NULLS LAST, input_was_truncated DESC NULLS LAST) = 1)"
_CELLS = f"""(SELECT s.*, va, vb, coalesce(ha, false) AS ha, coalesce(hb, false) AS hb, coalesce(nc, 0) AS nc, coalesce(ni, 0) AS ni, mode, coalesce(fl, false) AS fl, coalesce(fa, false) AS fa, coalesce(fb, false) AS fb, NOT join_status IN ('unmatched_proposal', 'excluded_proposal') AS gold, NOT column_name IN ('Species', 'Primary assay system') AS content,
  coalesce(field_type = 'text' AND nc + ni > 0, false) AS jt, evidence_outcome = 'validated' AS anc, CASE join_status WHEN 'duplicate_proposals' THEN 2 WHEN 'missing_proposal' THEN 0 ELSE (proposed_value IS NOT NULL)::INTEGER END AS np, coalesce(length(proposed_value) % 3 = 0, false) AS adj, field_type IN ('boolean', 'categorical', 'numeric') AS st
  FROM {evaluation.LATEST} s LEFT JOIN (SELECT run_id, row_id, column_name, max(CASE WHEN judge_label = 'judge_a' THEN vd END) AS va, max(CASE WHEN judge_label = 'judge_b' THEN vd END) AS vb, bool_or(judge_label = 'judge_a') AS ha, bool_or(judge_label = 'judge_b') AS hb, count(*) FILTER (WHERE vd = 'correct') AS nc, count(*) FILTER (WHERE vd = 'incorrect') AS ni,
  arg_min(coalesce(mode, 'none'), (judge_label, coalesce(mode, 'none'))) AS mode, bool_or(cut) AS fl, bool_or(cut AND judge_label = 'judge_a') AS fa, bool_or(cut AND judge_label = 'judge_b') AS fb FROM {_J} GROUP BY 1, 2, 3) USING (run_id, row_id, column_name))"""
_is = {
    "gold_present_cell_count": "p", "content_gold_present_cell_count": "p AND content", "metadata_gold_present_cell_count": "p AND NOT content", "gold_empty_cell_count": "gold AND NOT is_gold_present", "filled_on_gold_empty_count": "gold AND NOT is_gold_present AND np > 0", "scored_cell_count": "sc", "content_scored_cell_count": "sc AND content", "metadata_scored_cell_count": "sc AND NOT content",
    "structured_scored_cell_count": "sc AND st", "boolean_scored_cell_count": "sc AND field_type = 'boolean'", "categorical_scored_cell_count": "sc AND field_type = 'categorical'", "numeric_scored_cell_count": "sc AND field_type = 'numeric'", "text_scored_cell_count": "sc AND field_type = 'text'", "judge_text_scored_cell_count": "sc AND jt", "deterministic_text_scored_cell_count": "sc AND field_type = 'text' AND NOT jt",
    "correct_count": "sc AND is_correct", "content_correct_count": "p AND content AND is_correct", "overall_correct_count": "p AND is_correct", "metadata_correct_count": "p AND NOT content AND is_correct", "content_scored_correct_count": "sc AND content AND is_correct", "metadata_scored_correct_count": "sc AND NOT content AND is_correct", "structured_correct_count": "sc AND st AND is_correct",
    "boolean_correct_count": "sc AND field_type = 'boolean' AND is_correct", "categorical_correct_count": "sc AND field_type = 'categorical' AND is_correct", "numeric_correct_count": "sc AND field_type = 'numeric' AND is_correct", "text_correct_count": "sc AND field_type = 'text' AND is_correct", "structured_deterministic_failure_count": "sc AND st AND NOT is_correct", "structured_adjudication_eligible_count": "sc AND st AND NOT is_correct AND adj",
    "covered_count": "p AND join_status = 'matched' AND np = 1", "content_covered_count": "p AND content AND join_status = 'matched' AND np = 1", "anchor_valid_count": "sc AND anc", "content_anchor_valid_count": "sc AND content AND anc", "correct_and_anchored_count": "sc AND is_correct AND anc", "content_correct_and_anchored_count": "sc AND content AND is_correct AND anc", "evidence_present_but_unvalidated_count": "sc AND evidence_outcome = 'unvalidated'",
    "structured_support_proxy_supported_count": "sc AND st AND anc", "structured_support_proxy_unsupported_count": "sc AND st AND evidence_outcome = 'unvalidated'", "structured_support_proxy_unvalidated_count": "sc AND st AND coalesce(evidence_outcome, '') NOT IN ('validated', 'unvalidated')", "structured_support_proxy_evaluated_count": "sc AND st AND evidence_outcome IN ('validated', 'unvalidated')",
    "unscored_text_cell_count": "p AND field_type = 'text' AND NOT sc", "judge_unclear_text_cell_count": "p AND field_type = 'text' AND judge_verdict = 'unclear'", "judge_json_schema_text_cell_count": "p AND mode = 'json_schema'", "judge_json_object_text_cell_count": "p AND mode = 'json_object'", "judge_prompt_only_text_cell_count": "p AND mode = 'none'", "judge_request_failed_count": "p AND fl", "judge_a_unclear_text_cell_count": "p AND va = 'unclear'",
    "judge_b_unclear_text_cell_count": "p AND vb = 'unclear'", "judge_a_request_failed_count": "p AND fa", "judge_b_request_failed_count": "p AND fb", "dual_judge_cell_count": "p AND content AND ha AND hb", "judge_disagreement_count": "p AND content AND nc > 0 AND ni > 0", "judge_disagreement_evaluable_count": "p AND content AND nc + ni >= 2", "missing_proposal_count": "p AND join_status = 'missing_proposal'",
    "duplicate_proposal_join_count": "p AND join_status = 'duplicate_proposals'", "cell_id_mismatch_count": "p AND join_status = 'cell_id_mismatch'", "unmatched_proposal_count": "join_status = 'unmatched_proposal'", "excluded_proposal_count": "join_status = 'excluded_proposal'", "join_failure_count": "join_status IN ('missing_proposal', 'duplicate_proposals', 'cell_id_mismatch', 'unmatched_proposal')",
    "parser_gap_count": "failure_attribution = 'parser_gap'", "retrieval_miss_count": "failure_attribution = 'retrieval_miss'", "extraction_miss_count": "failure_attribution = 'extraction_miss'", "evidence_ambiguity_count": "failure_attribution = 'evidence_ambiguity'", "judge_failure_count": "failure_attribution = 'judge_failure'", "judge_unclear_count": "failure_attribution = 'judge_unclear'",
}
_of = {
    "content_correctness": ("content_correct_count", "content_gold_present_cell_count"), "overall_correctness": ("overall_correct_count", "gold_present_cell_count"), "overall_correctness_scored_only": ("correct_count", "scored_cell_count"), "metadata_correctness": ("metadata_correct_count", "metadata_gold_present_cell_count"), "metadata_correctness_mean": ("metadata_scored_correct_count", "metadata_scored_cell_count"),
    "structured_accuracy": ("structured_correct_count", "structured_scored_cell_count"), "boolean_accuracy": ("boolean_correct_count", "boolean_scored_cell_count"), "categorical_accuracy": ("categorical_correct_count", "categorical_scored_cell_count"), "numeric_accuracy": ("numeric_correct_count", "numeric_scored_cell_count"), "text_accuracy": ("text_correct_count", "text_scored_cell_count"),
    "structured_adjudication_eligible_rate": ("structured_adjudication_eligible_count", "structured_deterministic_failure_count"), "proposal_coverage_on_content_gold_present": ("content_covered_count", "content_gold_present_cell_count"), "proposal_coverage_on_all_gold_present": ("covered_count", "gold_present_cell_count"), "anchor_valid_rate": ("anchor_valid_count", "scored_cell_count"),
    "content_anchor_valid_rate": ("content_anchor_valid_count", "content_scored_cell_count"), "correct_and_anchored_rate": ("correct_and_anchored_count", "scored_cell_count"), "evidence_grounded_correctness": ("content_correct_and_anchored_count", "content_gold_present_cell_count"), "content_correct_and_anchored_rate": ("content_correct_and_anchored_count", "content_scored_cell_count"),
    "structured_support_proxy_supported_rate": ("structured_support_proxy_supported_count", "structured_support_proxy_evaluated_count"), "judge_disagreement_rate": ("judge_disagreement_count", "judge_disagreement_evaluable_count"),
}
_BASE = f"c AS (SELECT *, gold AND is_gold_present AS p, gold AND was_scored AS sc FROM {_CELLS})"
_JC = f"{_BASE}, o AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE is_correct) AS k FROM c WHERE p AND content AND NOT jt AND sc AND is_correct IS NOT NULL GROUP BY 1), l AS (SELECT DISTINCT run_id, judge_label FROM {_J} JOIN (SELECT run_id, row_id, column_name FROM c WHERE p) USING (run_id, row_id, column_name)), m AS (SELECT run_id, judge_label, count(*) FILTER (WHERE vd <> 'unclear') AS n, count(*) FILTER (WHERE vd = 'correct') AS k FROM {_J} JOIN (SELECT run_id, row_id, column_name FROM c WHERE p AND content AND jt) USING (run_id, row_id, column_name) GROUP BY 1, 2), jc AS (SELECT l.run_id, l.judge_label, {v.ratio('(coalesce(o.k, 0) + coalesce(m.k, 0))', '(coalesce(o.n, 0) + coalesce(m.n, 0))')} AS correctness FROM l LEFT JOIN o ON o.run_id = l.run_id LEFT JOIN m ON m.run_id = l.run_id AND m.judge_label = l.judge_label)"
ORACLES = {
    "run_scorecard": f"WITH {_BASE}, n AS (SELECT run_id, count(*) AS cell_count, {', '.join(f'count(*) FILTER (WHERE {c}) AS {k}' for k, c in _is.items())} FROM c GROUP BY 1) SELECT *, {', '.join(f'CASE WHEN {b} > 0 THEN floor({a}::DOUBLE / {b} * 1000000 + 0.5) / 1000000 END AS {k}' for k, (a, b) in _of.items())}, CASE WHEN scored_cell_count > 0 THEN NULL WHEN gold_present_cell_count = 0 THEN 'missing_required_eval_inputs' WHEN judge_request_failed_count > 0 THEN 'judge_failure' WHEN join_failure_count > 0 THEN 'no_joinable_predictions' ELSE 'missing_required_eval_inputs' END AS unscored_reason FROM n",
    "judge_correctness": f"WITH {_JC} SELECT * FROM jc",
    "judge_delta": f"WITH {_JC}, a AS (SELECT run_id, max(CASE WHEN judge_label = 'judge_a' THEN correctness END) AS x, max(CASE WHEN judge_label = 'judge_b' THEN correctness END) AS y, sum(floor(correctness * 1000000 + 0.5)::BIGINT)::DOUBLE / 1000000 / count(correctness) AS m FROM jc GROUP BY 1) SELECT run_id, x AS correctness_judge_a, y AS correctness_judge_b, floor(m * 1000000 + 0.5) / 1000000 AS correctness_mean, floor(abs(x - y) * 1000000 + 0.5) / 1000000 AS correctness_abs_delta FROM a",
    "metadata_summary": f"WITH {_BASE}, m AS (SELECT *, CASE WHEN join_status = 'missing_proposal' THEN 'missing_proposal' WHEN is_correct THEN 'found' ELSE 'unclear' END AS status FROM c WHERE p AND NOT content), f AS (SELECT benchmark_id, column_name, string_agg(failure_attribution || '=' || n, ',' ORDER BY failure_attribution) AS failures FROM (SELECT benchmark_id, column_name, failure_attribution, count(*) AS n FROM m WHERE failure_attribution IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2), t AS (SELECT benchmark_id, column_name, count(*) AS total, count(*) FILTER (WHERE status = 'found') AS found, count(*) FILTER (WHERE status = 'unclear') AS unclear, count(*) FILTER (WHERE status = 'missing_proposal') AS missing_proposal FROM m GROUP BY 1, 2) SELECT t.*, coalesce(failures, '') AS failures, floor(found::DOUBLE / total * 1000000 + 0.5) / 1000000 AS found_rate, floor(unclear::DOUBLE / total * 1000000 + 0.5) / 1000000 AS unclear_rate, floor(missing_proposal::DOUBLE / total * 1000000 + 0.5) / 1000000 AS missing_proposal_rate FROM t LEFT JOIN f USING (benchmark_id, column_name)",
    "metadata_kinds": "SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'Publication  Year' WHEN 1 THEN 'DOI' WHEN 2 THEN 'Author-List' WHEN 3 THEN 'Web address' ELSE p_name END AS name, CASE p_partkey % 9 WHEN 0 THEN 'year' WHEN 1 THEN 'doi' WHEN 2 THEN 'authors' WHEN 3 THEN 'link' ELSE CASE p_partkey % 4 WHEN 0 THEN 'pmid' WHEN 1 THEN 'journal' END END AS kind FROM part",
}
