"""The whole summary of a run: counts and rates over its scored cells, its judges, its metadata fields, its failures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import values as v

# Columns that describe a paper, and names under which a kind of metadata goes.
METADATA_COLUMNS = ("title", "authors", "author", "journal", "publication", "venue", "year", "publication_year", "doi", "pmid", "url", "link", "abstract")
METADATA_NAMES = {
    "doi": ("doi", "digital object identifier"), "journal": ("journal", "publication venue", "venue", "conference"), "link": ("link", "url", "website", "web address"), "abstract": ("abstract", "summary"),
    "title": ("title", "paper title", "article title"), "authors": ("authors", "author", "author list", "first author"), "year": ("publication year", "year published", "publication date", "year"), "pmid": ("pmid", "pubmed", "pubmed id"),
}
STRUCTURED = ("boolean", "categorical", "numeric")
# Kinds of failure that a person may still settle.
ADJUDICABLE = ("numeric_near_miss", "boolean_unknown_vocabulary", "categorical_list_format_mismatch", "categorical_alias_gap")
FORMATS = ("numeric_plus_minus_format", "numeric_inequality_format", "numeric_unit_or_percent_format", "numeric_range_format", "numeric_list_format", "numeric_parse_failure")
PROBLEMS = ("missing_proposal", "duplicate_proposals", "cell_id_mismatch", "unmatched_proposal")

#: Counts, as conditions over a cell: ``gold`` (a cell of the gold table), ``present``, ``content`` (no metadata), ``scored``, ``correct``, ``judge`` (text scored by judges), ``va`` and ``vb`` (verdicts of the two main judges).
COUNTS: Mapping[str, str] = {
    "gold_present_cell_count": "present", "content_gold_present_cell_count": "present and content", "metadata_gold_present_cell_count": "present and not content", "gold_empty_cell_count": "gold and not is_gold_present",
    "filled_on_gold_empty_count": "gold and not is_gold_present and n_proposals > 0", "scored_cell_count": "scored", "content_scored_cell_count": "scored and content", "metadata_scored_cell_count": "scored and not content",
    "structured_scored_cell_count": "scored and structured", **{f"{t}_scored_cell_count": f"scored and field_type = '{t}'" for t in (*STRUCTURED, "text")}, "judge_text_scored_cell_count": "scored and judge", "deterministic_text_scored_cell_count": "scored and field_type = 'text' and not coalesce(judge, false)",
    "correct_count": "scored and correct", "content_correct_count": "present and content and correct", "overall_correct_count": "present and correct", "metadata_correct_count": "present and not content and correct", "content_scored_correct_count": "scored and content and correct",
    "metadata_scored_correct_count": "scored and not content and correct", "structured_correct_count": "scored and structured and correct", **{f"{t}_correct_count": f"scored and field_type = '{t}' and correct" for t in (*STRUCTURED, "text")},
    "structured_deterministic_failure_count": "scored and structured and is_correct = false", "structured_adjudication_eligible_count": "scored and structured and is_correct = false and adjudicable",
    "covered_count": "present and join_status = 'matched' and n_proposals = 1", "content_covered_count": "present and content and join_status = 'matched' and n_proposals = 1",
    "anchor_valid_count": "scored and anchored", "content_anchor_valid_count": "scored and content and anchored", "correct_and_anchored_count": "scored and correct and anchored", "content_correct_and_anchored_count": "scored and content and correct and anchored", "evidence_present_but_unvalidated_count": "scored and unvalidated",
    "structured_support_proxy_supported_count": "scored and structured and support = 'supported'", "structured_support_proxy_unsupported_count": "scored and structured and support = 'unsupported'", "structured_support_proxy_unvalidated_count": "scored and structured and support = 'unvalidated'",
    "unscored_text_cell_count": "present and field_type = 'text' and not scored", "judge_unclear_text_cell_count": "present and field_type = 'text' and judge_verdict = 'unclear'",
    "judge_json_schema_text_cell_count": "present and mode = 'json_schema'", "judge_json_object_text_cell_count": "present and mode = 'json_object'", "judge_prompt_only_text_cell_count": "present and mode = 'none'", "judge_request_failed_count": "present and failed",
    "judge_a_unclear_text_cell_count": "present and va = 'unclear'", "judge_b_unclear_text_cell_count": "present and vb = 'unclear'", "judge_a_request_failed_count": "present and fa", "judge_b_request_failed_count": "present and fb", "dual_judge_cell_count": "present and content and has_a and has_b",
    "judge_disagreement_count": "present and content and n_correct > 0 and n_incorrect > 0", "judge_disagreement_evaluable_count": "present and content and n_correct + n_incorrect >= 2",
    "missing_proposal_count": "present and join_status = 'missing_proposal'", "duplicate_proposal_join_count": "present and join_status = 'duplicate_proposals'", "cell_id_mismatch_count": "present and join_status = 'cell_id_mismatch'", "unmatched_proposal_count": "join_status = 'unmatched_proposal'",
    "excluded_proposal_count": "join_status = 'excluded_proposal'", "join_failure_count": f"join_status in {PROBLEMS}",
    **{f"{r}_count": f"failure_attribution = '{r}'" for r in ("parser_gap", "retrieval_miss", "extraction_miss", "evidence_ambiguity", "judge_failure", "judge_unclear")},
}

#: Rates, as two counts.
RATES: Mapping[str, tuple[str, str]] = {
    "content_correctness": ("content_correct_count", "content_gold_present_cell_count"), "overall_correctness": ("overall_correct_count", "gold_present_cell_count"), "overall_correctness_scored_only": ("correct_count", "scored_cell_count"), "metadata_correctness": ("metadata_correct_count", "metadata_gold_present_cell_count"),
    "metadata_correctness_mean": ("metadata_scored_correct_count", "metadata_scored_cell_count"), "structured_accuracy": ("structured_correct_count", "structured_scored_cell_count"), **{f"{t}_accuracy": (f"{t}_correct_count", f"{t}_scored_cell_count") for t in (*STRUCTURED, "text")},
    "structured_adjudication_eligible_rate": ("structured_adjudication_eligible_count", "structured_deterministic_failure_count"), "proposal_coverage_on_content_gold_present": ("content_covered_count", "content_gold_present_cell_count"), "proposal_coverage_on_all_gold_present": ("covered_count", "gold_present_cell_count"),
    "anchor_valid_rate": ("anchor_valid_count", "scored_cell_count"), "content_anchor_valid_rate": ("content_anchor_valid_count", "content_scored_cell_count"), "correct_and_anchored_rate": ("correct_and_anchored_count", "scored_cell_count"), "evidence_grounded_correctness": ("content_correct_and_anchored_count", "content_gold_present_cell_count"),
    "content_correct_and_anchored_rate": ("content_correct_and_anchored_count", "content_scored_cell_count"), "structured_support_proxy_supported_rate": ("structured_support_proxy_supported_count", "structured_support_proxy_evaluated_count"), "judge_disagreement_rate": ("judge_disagreement_count", "judge_disagreement_evaluable_count"),
}


def metadata_kind(column: str, description: str | None = None):
    """The kind of metadata a column holds by its name, or by ``metadata_field:<kind>`` in its description; else null."""
    label = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    by_name = lambda c: F.coalesce(*[F.when(c.isin(*names), F.lit(kind)) for kind, names in METADATA_NAMES.items()])
    kind = by_name(label(F.col(column)))
    if description is None:
        return kind
    told = label(F.regexp_extract(F.lower(F.col(description)), r"\bmetadata[_ -]field\s*:\s*([a-z_ -]+)", 1))
    return F.coalesce(kind, by_name(told), *[F.when(told == k, F.lit(k)) for k in METADATA_NAMES])


def adjudicable(failure: str, cue: str):
    """Whether a person may settle a failure: near misses, unknown words, list formats, gaps of aliases; number formats only with a number in them."""
    return F.col(failure).isin(*ADJUDICABLE) | (F.col(failure).isin(*FORMATS) & F.col(cue))


def judge_facts(records: DataFrame, keys: Sequence[str], *, label: str, verdict: str, mode: str, error: str, main: tuple[str, str]) -> DataFrame:
    """Per cell: verdicts of the two main judges, how many said correct and incorrect, mode of the first, failures. One record per judge and cell."""
    of = lambda name, what: F.max(F.when(F.col(label) == name, what))
    a, b = main
    failed = F.expr(error)
    return records.groupBy(*keys).agg(
        of(a, F.col(verdict)).alias("va"), of(b, F.col(verdict)).alias("vb"), F.bool_or(F.col(label) == a).alias("has_a"), F.bool_or(F.col(label) == b).alias("has_b"), F.count_if(F.col(verdict) == "correct").alias("n_correct"), F.count_if(F.col(verdict) == "incorrect").alias("n_incorrect"),
        F.min(F.struct(label, F.coalesce(mode, F.lit("none")).alias("m")))["m"].alias("mode"), F.bool_or(failed).alias("failed"), F.bool_or((F.col(label) == a) & failed).alias("fa"), F.bool_or((F.col(label) == b) & failed).alias("fb"),
    )


def scorecard(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """All counts and rates of :data:`COUNTS` and :data:`RATES` in one pass; a rate over nothing is null.

    ``cells`` has the columns that the conditions name; nulls in them are false. A rate outside [0, 1] cannot come
    out: every numerator's condition implies its denominator's.
    """
    n = cells.groupBy(*by).agg(F.count("*").alias("cell_count"), *[F.count_if(F.expr(f"coalesce({cond}, false)")).alias(name) for name, cond in COUNTS.items()])
    n = n.withColumn("structured_support_proxy_evaluated_count", F.col("structured_support_proxy_supported_count") + F.col("structured_support_proxy_unsupported_count"))
    return n.withColumns({name: F.expr(v.ratio(a, b)) for name, (a, b) in RATES.items()})


def judge_correctness(cells: DataFrame, records: DataFrame, by: Sequence[str], keys: Sequence[str], *, label: str, verdict: str) -> DataFrame:
    """Correctness of each group by each of its judges: cells of text scored by judges count by the verdict of that judge,
    all others alike for every judge. One row per group and judge."""
    content = cells.where("present and content")
    plain = content.where("not coalesce(judge, false) and scored and is_correct is not null").groupBy(*by).agg(F.count("*").alias("n0"), F.count_if("is_correct").alias("c0"))
    labels = records.join(cells.where("present").select(*keys).distinct(), list(keys), "left_semi").select(*by, label).distinct()
    judged = records.join(content.where("judge").select(*keys).distinct(), list(keys), "left_semi").groupBy(*by, label).agg(F.count_if(F.col(verdict).isin("correct", "incorrect")).alias("n1"), F.count_if(F.col(verdict) == "correct").alias("c1"))
    full = labels.join(judged, [*by, label], "left").join(plain, list(by), "left").na.fill(0)
    return full.select(*by, label, F.expr(v.ratio("c0 + c1", "(n0 + n1)")).alias("correctness"))


def judge_delta(per_judge: DataFrame, by: Sequence[str], *, label: str, main: tuple[str, str]) -> DataFrame:
    """Mean correctness over judges, that of the two main ones, and the difference between those (null unless both are there)."""
    of = lambda name: F.max(F.when(F.col(label) == name, F.col("correctness")))
    ppm = F.sum(F.floor(F.col("correctness") * 1000000 + 0.5))
    out = per_judge.groupBy(*by).agg(of(main[0]).alias("correctness_judge_a"), of(main[1]).alias("correctness_judge_b"), ppm.alias("__s"), F.count("correctness").alias("__n"))
    return out.withColumn("correctness_mean", F.expr(v.round6("cast(__s as double) / 1000000 / nullif(__n, 0)"))).withColumn("correctness_abs_delta", F.expr(v.round6("abs(correctness_judge_a - correctness_judge_b)"))).drop("__s", "__n")


def metadata_summary(cells: DataFrame, by: Sequence[str], kind: str, status: str, attribution: str) -> DataFrame:
    """Per metadata field: totals, found, unclear and missing with their rates, and failures by attribution as a sorted map."""
    counts = cells.groupBy(*by, kind).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in ("found", "unclear", "missing_proposal")])
    failures = cells.where(F.col(attribution).isNotNull()).groupBy(*by, kind, attribution).agg(F.count("*").alias("n"))
    listed = failures.groupBy(*by, kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(attribution, "n"))), lambda x: F.concat_ws("=", x[attribution], x["n"].cast("string"))), ",").alias("failures"))
    out = counts.join(listed, [*by, kind], "left").withColumns({f"{s}_rate": F.expr(v.ratio(s, "total")) for s in ("found", "unclear", "missing_proposal")})
    return out.withColumn("failures", F.coalesce("failures", F.lit("")))


def unscored_reason(card: DataFrame, contract_valid: str = "true") -> DataFrame:
    """Why a group has no headline score: ``unscored_reason``; null where it has one."""
    reason = f"""case when scored_cell_count > 0 then null when not ({contract_valid}) then 'invalid_run_bundle_contract' when gold_present_cell_count = 0 then 'missing_required_eval_inputs'
        when judge_request_failed_count > 0 then 'judge_failure' when join_failure_count > 0 then 'no_joinable_predictions' else 'missing_required_eval_inputs' end"""
    return card.withColumn("unscored_reason", F.expr(reason))
