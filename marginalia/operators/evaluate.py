"""Proposed values scored against gold values: joins, typed comparison, failure classes and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import values as v


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` and then by all other columns. Pre-aggregated, so hot keys do no harm."""
    rest = [c for c in df.columns if c not in keys]
    rank = [*order, *(c for c in rest if c not in order and df.schema[c].dataType.typeName() != "map")]
    top = df.groupBy(*keys).agg(F.max(F.struct(*rank)).alias("__top"))
    return top.select(*keys, *[F.col(f"__top.`{c}`").alias(c) for c in rest if c in rank])


def join_status(gold: DataFrame, proposals: DataFrame, keys: Sequence[str], *, gold_value: str, cell_id: str, proposed_value: str, excluded: str | None = None) -> DataFrame:
    """Full outer join of gold and proposals by key, each pair classed by cardinality and identity.

    Proposals are counted per key before the join, so a key proposed many times stays one row. Statuses, in
    order: ``excluded_proposal`` and ``unmatched_proposal`` (no gold), ``gold_empty_diagnostic``,
    ``missing_proposal``, ``duplicate_proposals``, ``cell_id_mismatch``, ``matched``.
    """
    p = proposals.groupBy(*keys).agg(
        F.count("*").alias("n_proposals"), F.max(proposed_value).alias("proposed_value"), F.max(cell_id).alias("p_cell"),
        *([F.max(excluded).alias("p_excluded")] if excluded else []),
    )
    g = gold.select(*keys, F.col(gold_value).alias("gold_value"), F.col(cell_id).alias("g_cell"), F.lit(True).alias("in_gold"))
    status = f"""case when in_gold is null and {'coalesce(p_excluded, false)' if excluded else 'false'} then 'excluded_proposal'
        when in_gold is null then 'unmatched_proposal' when {v.is_empty('gold_value')} then 'gold_empty_diagnostic'
        when n_proposals is null then 'missing_proposal' when n_proposals > 1 then 'duplicate_proposals'
        when not (g_cell <=> p_cell) then 'cell_id_mismatch' else 'matched' end"""
    return g.join(p, list(keys), "full_outer").select(
        *keys, "gold_value", "proposed_value", F.coalesce("n_proposals", F.lit(0)).alias("n_proposals"), F.expr(status).alias("join_status")
    )


def numeric_comparison(gold: str, proposed: str, abs_tol: float, rel_tol: float, d: v.Dialect = v.SPARK) -> dict[str, str]:
    """Expressions of the numeric comparison: scalars within the tolerance, intervals that overlap or lie within it."""
    gl, gu = v.number_bounds(gold, d)
    pl, pu = v.number_bounds(proposed, d)
    return {"gold_lower": gl, "gold_upper": gu, "proposed_lower": pl, "proposed_upper": pu}


NUMERIC_GAP = "greatest(proposed_lower - gold_upper, gold_lower - proposed_upper, 0)"


def numeric_allowed(abs_tol: float, rel_tol: float) -> str:
    return f"greatest({abs_tol}, abs((gold_lower + gold_upper) / 2) * {rel_tol})"


def numeric_failure(abs_tol: float, rel_tol: float, gold: str, proposed: str, d: v.Dialect = v.SPARK) -> str:
    """Class of a failed numeric comparison, null for a right one; over the columns of :func:`numeric_comparison`."""
    g, p = v.number_format(gold, d), v.number_format(proposed, d)
    either = lambda *flags: " or ".join(f"{x[f]}" for f in flags for x in (g, p))
    near = f"greatest({numeric_allowed(abs_tol, rel_tol)} * 2.0, {abs_tol} * 2.0, abs((gold_lower + gold_upper) / 2) * {max(rel_tol * 2, 0.05)}, 1e-12)"
    return f"""case when gold_lower is null or proposed_lower is null then
          case when {either('has_plus_minus')} then 'numeric_plus_minus_format' when {either('has_inequality')} then 'numeric_inequality_format'
               when {either('has_percent', 'has_unit')} then 'numeric_unit_or_percent_format' when {either('range_like')} then 'numeric_range_format'
               when {either('list_like')} then 'numeric_list_format' else 'numeric_parse_failure' end
        when {NUMERIC_GAP} <= {numeric_allowed(abs_tol, rel_tol)} then null
        when {NUMERIC_GAP} <= {near} then 'numeric_near_miss' else 'numeric_hard_mismatch' end"""


def compare_numbers(df: DataFrame, gold: str, proposed: str, abs_tol: float = 0.0, rel_tol: float = 0.0) -> DataFrame:
    """Adds bounds of both values, ``is_correct`` and ``failure_class``. What is no number is wrong, not an error."""
    bounds = numeric_comparison(gold, proposed, abs_tol, rel_tol)
    out = df.withColumns({k: F.expr(x) for k, x in bounds.items()})
    out = out.withColumn("failure_class", F.expr(numeric_failure(abs_tol, rel_tol, gold, proposed)))
    return out.withColumn("is_correct", F.col("failure_class").isNull())


def boolean_failure(gold: str, proposed: str, d: v.Dialect = v.SPARK) -> str:
    g, p = v.boolean_value(gold, d), v.boolean_value(proposed, d)
    return f"""case when {g} = {p} then null when {g} is not null and {p} is not null then 'boolean_contradiction'
        when {v.boolean_cue(gold, d)} or {v.boolean_cue(proposed, d)} then 'boolean_unknown_vocabulary' else 'boolean_parse_failure' end"""


def compare_booleans(df: DataFrame, gold: str, proposed: str) -> DataFrame:
    return df.withColumn("failure_class", F.expr(boolean_failure(gold, proposed))).withColumn("is_correct", F.col("failure_class").isNull())


def compare_categories(df: DataFrame, schema: DataFrame, gold: str, proposed: str, *, column: str = "column_name") -> DataFrame:
    """Canonical equality through aliases and allowed values of ``schema``; adds ``is_correct`` and ``failure_class``.

    Both values go through the alias table (one small row per alias, joined by column and canonical text), so a
    schema of any size is joined, not looped over.
    """
    alias = schema.select(F.col(column), F.explode("aliases").alias("a", "target")).select(column, F.expr(v.plain_text("a")).alias("a"), F.expr(v.plain_text("target")).alias("target"))
    alias = alias.groupBy(column, "a").agg(F.min("target").alias("target"))
    allowed = schema.select(column, F.explode("allowed_values").alias("x")).groupBy(column).agg(F.collect_set(F.expr(v.plain_text("x"))).alias("allowed"))
    out = df.withColumn("g0", F.expr(v.plain_text(gold))).withColumn("p0", F.expr(v.plain_text(proposed)))
    for c in ("g", "p"):
        side = alias.select(F.col(column), F.col("a").alias(f"{c}0"), F.col("target").alias(f"{c}_target"))
        out = out.join(side, [column, f"{c}0"], "left").withColumn(c, F.coalesce(f"{c}_target", f"{c}0"))
    out = out.join(allowed, column, "left")
    failure = f"""case when g = p then null when {v.list_cue(gold)} or {v.list_cue(proposed)} then 'categorical_list_format_mismatch'
        when array_contains(allowed, g) and array_contains(allowed, p) then 'categorical_allowed_value_mismatch' else 'categorical_alias_gap' end"""
    return out.withColumn("failure_class", F.expr(failure)).withColumn("is_correct", F.col("failure_class").isNull()).drop("g0", "p0", "g_target", "p_target", "allowed")


def overlap_of(gold: str, proposed: str, d: v.Dialect = v.SPARK) -> dict[str, str]:
    """Token overlap of two texts: exact match after normalising, counts, and Jaccard ratio."""
    g, p = f"coalesce({v.plain_text(gold, d)}, '')", f"coalesce({v.plain_text(proposed, d)}, '')"
    gs, ps = d.distinct(d.words(g)), d.distinct(d.words(p))
    common = d.size(d.both(gs, ps))
    return {
        "exact": f"({g} <> '' and {g} = {p})", "gold_tokens": d.size(d.words(g)), "proposed_tokens": d.size(d.words(p)), "common_tokens": common,
        "overlap": v.ratio(common, f"({d.size(gs)} + {d.size(ps)} - {common})"),
    }


def text_overlap(df: DataFrame, gold: str, proposed: str) -> DataFrame:
    return df.withColumns({k: F.expr(x) for k, x in overlap_of(gold, proposed).items()})


def run_summary(scored: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """All counts and rates of scored cells in one pass per group; a cell without a verdict counts as wrong in ``content_correctness``."""
    n = lambda cond: F.count_if(F.expr(cond))
    statuses = ("matched", "missing_proposal", "duplicate_proposals", "cell_id_mismatch", "gold_empty_diagnostic", "excluded_proposal", "unmatched_proposal")
    counts = scored.groupBy(*by).agg(
        F.count("*").alias("cells"), n("is_gold_present").alias("gold_present"), n("was_scored").alias("scored"), n("is_correct").alias("correct"),
        n("is_gold_present and is_correct").alias("gold_correct"), n("evidence_outcome = 'validated'").alias("evidence_valid"),
        F.sum(F.floor(F.col("judge_score_mean") * 1000000 + 0.5)).alias("judge_ppm"), F.count("judge_score_mean").alias("judged"),
        *[n(f"join_status = '{s}'").alias(s) for s in statuses], *[n(f"field_type = '{t}' and is_correct").alias(f"{t}_correct") for t in ("numeric", "categorical", "text")],
        *[n(f"field_type = '{t}' and was_scored").alias(f"{t}_scored") for t in ("numeric", "categorical", "text")],
    )
    rates = {
        "content_correctness": v.ratio("gold_correct", "gold_present"), "scored_only_correctness": v.ratio("correct", "scored"), "coverage": v.ratio("scored", "gold_present"),
        "evidence_rate": v.ratio("evidence_valid", "cells"), "mean_judge_score": v.round6("cast(judge_ppm as double) / 1000000 / nullif(judged, 0)"),
        **{f"{t}_accuracy": v.ratio(f"{t}_correct", f"{t}_scored") for t in ("numeric", "categorical", "text")},
    }
    return counts.withColumns({k: F.expr(x) for k, x in rates.items()}).drop("judge_ppm")


def failure_counts(scored: DataFrame) -> DataFrame:
    """Counts by (benchmark, column, join status, failure attribution), and their share within the column."""
    g = scored.groupBy("benchmark_id", "column_name", "join_status", F.coalesce("failure_attribution", F.lit("none")).alias("attribution")).agg(F.count("*").alias("n"))
    total = scored.groupBy("benchmark_id", "column_name").agg(F.count("*").alias("total"))
    return g.join(total, ["benchmark_id", "column_name"]).withColumn("share", F.expr(v.ratio("n", "total")))


def difficulty(scored: DataFrame) -> DataFrame:
    """Column difficulty at two levels in one pass: per (benchmark, column), and that per candidate."""
    correct = "count_if(coalesce(is_correct, false))"
    return scored.groupingSets([["benchmark_id", "column_name"], ["benchmark_id", "column_name", "candidate_id"]], "benchmark_id", "column_name", "candidate_id").agg(
        F.count("*").alias("cells"), F.expr(correct).alias("correct"), F.expr("count_if(join_status = 'missing_proposal')").alias("missing"),
        F.expr("count_if(join_status in ('duplicate_proposal', 'duplicate_proposals'))").alias("duplicates"),
        F.count_distinct("run_id").alias("runs"), F.expr("grouping(candidate_id) = 1").alias("over_candidates"), F.expr(v.ratio(correct, "count(*)")).alias("correctness"),
    )
