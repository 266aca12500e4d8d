"""Replicated measurements compared: moments, weighted suites, rankings, rounds, lineages and grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import values as v
from marginalia.operators.order import numbered


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation (null below two) and standard error of ``value`` per group."""
    agg = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.min(value).alias("least"), F.max(value).alias("most"))
    return agg.select(*by, "n", F.expr(v.round6("m")).alias("mean"), F.expr(v.round6("s")).alias("sd"), F.expr(v.round6("s / sqrt(n)")).alias("sem"), "least", "most")


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weights: Mapping[str, float], member: str) -> DataFrame:
    """Mean of ``value`` over members weighted by ``weights``, nulls left out; coverage is the share of the weight that has a value."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(member)]
    return df.groupBy(*by).agg(
        F.sum(F.col(value) * w).alias("__s"), F.sum(F.when(F.col(value).isNotNull(), w)).alias("__w"), F.count(value).alias("members")
    ).select(*by, F.expr(v.round6("__s / __w")).alias("weighted_mean"), F.expr(v.round6(f"__w / {sum(weights.values())}")).alias("coverage"), "members")


def leaderboard(df: DataFrame, score: str, tie: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rank by score (nulls last) and then by ``tie``, with the gap to the next. One row per candidate is ranked."""
    w = Window.partitionBy(*within).orderBy(F.desc_nulls_last(score), *tie)
    ranked = df.withColumn("__n", F.lead(score).over(w)).withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("gap_to_next", F.expr(v.round6(f"{score} - __n"))).drop("__n")


def best_by_round(df: DataFrame, round_: str, score: str, within: Sequence[str]) -> DataFrame:
    """Best score of each round, the best before it, and the change."""
    best = df.groupBy(*within, round_).agg(F.max(score).alias("best"))
    before = F.max("best").over(Window.partitionBy(*within).orderBy(round_).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("best_before", before).withColumn("delta", F.expr(v.round6("best - best_before")))


def unique_labels(df: DataFrame, label: str, key: str) -> DataFrame:
    """Labels that several keys share get the key behind them."""
    shared = df.groupBy(label).agg(F.count_distinct(key).alias("n"))
    return df.select(label, key).distinct().join(shared, label).select(key, F.when(F.col("n") > 1, F.concat(label, F.lit(" ("), F.col(key).cast("string"), F.lit(")"))).otherwise(F.col(label)).alias("display_label"))


def lineage(spark, view: str, child: str, parent: str, start: str) -> DataFrame:
    """The chain of parents of ``start``, root last, with its depth."""
    return spark.sql(f"""WITH RECURSIVE up(node, parent, depth) AS (SELECT {child}, {parent}, 0 FROM {view} WHERE {child} = {start}
        UNION ALL SELECT c.{child}, c.{parent}, up.depth + 1 FROM {view} c JOIN up ON c.{child} = up.parent AND c.{child} <> up.node) SELECT node, depth FROM up""")


def grid(spark, axes: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the values of small axes (a chain of explodes, no join)."""
    out = spark.range(1)
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in dict.fromkeys(values)])))
    return out.drop("id")


def outer_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key; where both have a column the right value counts unless it is missing."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    l, r = left.select(key, *[F.col(c).alias(f"l_{c}") for c in left.columns if c != key]), right.select(key, *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    cols = [F.coalesce(f"r_{c}", f"l_{c}").alias(c) for c in shared] + [F.col(f"l_{c}").alias(c) for c in left.columns if c not in (*shared, key)] + [F.col(f"r_{c}").alias(c) for c in right.columns if c not in (*shared, key)]
    return l.join(r, key, "full_outer").select(key, *cols)


def switches(df: DataFrame, by: str, order: Sequence[str], what: str) -> DataFrame:
    """How often ``what`` changes along the order of each group, and the number of runs of equal values."""
    before = F.lag(what).over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("__b", before).groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("__b").isNotNull() & (F.col("__b") != F.col(what))).alias("switches"))


# What makes the results of a candidate less sure, by name.
CAVEATS = (
    ("degraded_replicates_visible", "n_degraded > 0"), ("failed_replicates_visible", "n_failed > 0"), ("invalid_contract_observed", "n_invalid > 0"), ("judge_instability_observed", "n_disagreeing > 0"),
    ("missing_evidence_observed", "n_disagreeing = 0 and n_without_evidence > 0"), ("single_replicate_no_variance_estimate", "planned = 1"), ("unscored_replicates_visible", "n_unscored > 0"),
)


def replicate_summary(results: DataFrame, by: Sequence[str], planned: int) -> DataFrame:
    """Replicates of each group: moments of the scored values and of the runtimes, counts by status, cells, caveats in order.

    ``results``: ``status`` (scored, scored_degraded, unscored, failed), ``completed``, ``score``, ``runtime``, ``cells``,
    ``disagreement``, ``missing_evidence``, ``contract_valid``. A replicate with a null score counts as unscored.
    """
    n = lambda cond: F.count_if(F.expr(f"coalesce({cond}, false)"))
    valued = F.when(F.col("status").isin("scored", "scored_degraded"), F.col("score"))
    agg = results.groupBy(*by).agg(
        F.count("*").alias("n_total"), F.count(valued).alias("n_scored"), n("status = 'failed' or not completed").alias("n_failed"), n("status = 'unscored' or score is null").alias("n_unscored"), n("status = 'scored_degraded'").alias("n_degraded"),
        F.avg(valued).alias("m"), F.stddev_samp(valued).alias("s"), F.avg("runtime").alias("rm"), F.stddev_samp("runtime").alias("rs"), F.sum("runtime").alias("runtime_total"), F.sum(F.when(F.col("cells") > 0, F.col("cells"))).alias("cells_total"),
        n("contract_valid = false").alias("n_invalid"), n("disagreement > 0").alias("n_disagreeing"), n("missing_evidence > 0").alias("n_without_evidence"),
    ).withColumn("planned", F.lit(planned))
    caveats = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in CAVEATS]))
    return agg.select(
        *by, "n_total", "n_scored", "n_failed", "n_unscored", "n_degraded", F.expr(v.round6("m")).alias("mean"), F.expr(v.round6("s")).alias("sd"), F.expr(v.round6("s / sqrt(n_scored)")).alias("sem"), F.expr(v.round6("rm")).alias("runtime_mean"), F.expr(v.round6("rs")).alias("runtime_sd"),
        "runtime_total", "cells_total", F.expr(v.round6("runtime_total / cells_total")).alias("runtime_per_cell"), caveats.alias("caveats"),
    )


def suite_summary(per_benchmark: DataFrame, by: Sequence[str], weights: Mapping[str, float], member: str) -> DataFrame:
    """Weighted mean over benchmarks with coverage, benchmarks with failures and with degraded replicates, and all caveats."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(member)]
    agg = per_benchmark.groupBy(*by).agg(
        F.sum(F.col("mean") * w).alias("s"), F.sum(F.when(F.col("mean").isNotNull(), w)).alias("w"), F.count("mean").alias("covered"), F.count_if(F.expr("n_scored = 0 or n_failed > 0")).alias("failed_benchmarks"), F.count_if(F.col("n_degraded") > 0).alias("degraded_benchmarks"),
        F.sum("runtime_total").alias("runtime_total"), F.sum("cells_total").alias("cells_total"), F.array_distinct(F.flatten(F.collect_list("caveats"))).alias("c"),
    )
    lost = F.when(F.col("covered") < len(weights), F.array(F.lit("benchmark_coverage_loss"))).otherwise(F.array().cast("array<string>"))
    return agg.select(*by, F.expr(v.round6("s / w")).alias("weighted_mean"), "covered", "failed_benchmarks", "degraded_benchmarks", "runtime_total", "cells_total", F.array_sort(F.array_union("c", lost)).alias("caveats"))


def best_by_field(results: DataFrame, field: str, score: str, completed: str) -> DataFrame:
    """Candidates, completed ones and the best score per value of a field; a null value is the empty one."""
    return results.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("")).alias(field)).agg(F.count("*").alias("candidates"), F.count_if(completed).alias("completed"), F.max(F.when(F.col(completed), F.col(score))).alias("best"))


def attempt_failures(attempts: DataFrame, by: Sequence[str], *, phase: str, outcome: str, reason: str, mode: str, duration: str) -> DataFrame:
    """Retries, malformed and structurally wrong answers, and the time lost on answers of structured modes that failed."""
    lost = F.col(mode).isin("json_schema", "json_object", "none") & ~F.coalesce(F.col(outcome) == "success", F.lit(False))
    return attempts.groupBy(*by).agg(F.count_if(F.col(phase) == "retry").alias("retries"), F.count_if(F.col(reason) == "malformed_json").alias("malformed"), F.count_if(F.col(outcome) == "structured_output_error").alias("wrong_structure"), F.sum(F.when(lost, F.coalesce(duration, F.lit(0))).otherwise(0)).alias("lost_ms"))


# Order in which candidates are listed by status.
STATUS_ORDER = ("scored", "scored_degraded", "unscored", "failed")


def listed(candidates: DataFrame, status: str, score: str, runtime: str, key: str) -> DataFrame:
    """Candidates in the order they are shown: by status, score (nulls last), runtime (nulls last) and id."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col(status)), F.lit(0)), F.lit(10))
    return numbered(candidates.withColumn("__o", place), F.asc("__o"), F.desc_nulls_last(score), F.asc_nulls_last(runtime), F.asc(key), number="place", start=1).drop("__o")


def study_variant(candidates: DataFrame, retrieval: Sequence[str], prompt: str, model: str) -> DataFrame:
    """What a comparison varies: retrieval, prompts, models, or nothing of these; and candidates by status."""
    distinct = candidates.agg(*[F.count_distinct(c).alias(f"__{c}") for c in (*retrieval, prompt, model)])
    varied = " or ".join(f"__{c} > 1" for c in retrieval)
    return distinct.select(F.expr(f"case when {varied} then 'retrieval_compare' when __{prompt} > 1 then 'prompt_compare' when __{model} > 1 then 'model_compare' else 'compare' end").alias("variant"))


def is_control(candidate: str, prompt: str, model: str):
    """Results of other tools and made-up controls: shown, but never ranked."""
    c, p, m = (F.coalesce(F.col(x), F.lit("")) for x in (candidate, prompt, model))
    return c.startswith("ext_") | c.startswith("external_") | (p == "external_result") | m.startswith("external_")


def with_runtimes(results: DataFrame, runtimes: DataFrame, *, key: Sequence[str], runtime: str = "runtime") -> DataFrame:
    """Runtimes recorded beside the results, where these have none; one per replicate of the whole suite counts once.

    ``runtimes``: the key, ``recorded``, ``scope``. Of a scope ``suite_replicate`` only the first benchmark of a
    replicate takes the time, so sums over benchmarks are right. Repeated records: the least.
    """
    r = runtimes.groupBy(*key).agg(F.min("recorded").alias("recorded"), F.min("scope").alias("scope"))
    first = results.groupBy(*key).agg(F.min("benchmark_id").alias("__first"))
    joined = results.join(r, list(key), "left").join(first, list(key))
    counts = (F.coalesce("scope", F.lit("benchmark_replicate")) != "suite_replicate") | (F.col("benchmark_id") == F.col("__first"))
    return joined.withColumn(runtime, F.coalesce(runtime, F.when(counts, F.col("recorded")))).drop("recorded", "__first")


def cell_reviews(cells: DataFrame, proposals: DataFrame, key: Sequence[str], value: str, order: str) -> DataFrame:
    """Cells beside their proposals: how many, all values in order, and the one chosen: of the cell's own value, else the first."""
    p = proposals.select(*key, F.col(order).alias("__o"), F.col(value).alias("__v"))
    per = p.groupBy(*key).agg(F.count("*").alias("n_proposals"), F.array_sort(F.collect_list(F.struct("__o", "__v"))).alias("__all"))  # the proposals of one cell are few
    joined = cells.join(per, list(key), "left")
    own = F.element_at(F.filter("__all", lambda x: F.coalesce(x["__v"], F.lit("")) == F.col(value)), 1)
    chosen = F.when(F.coalesce(F.col(value), F.lit("")) != "", F.coalesce(F.when(F.exists("__all", lambda x: F.coalesce(x["__v"], F.lit("")) == F.col(value)), own["__o"]), F.col("__all")[0]["__o"])).otherwise(F.col("__all")[0]["__o"])
    return joined.select(*[cells[c] for c in cells.columns if c not in key], *key, F.coalesce("n_proposals", F.lit(0)).alias("n_proposals"), F.transform("__all", lambda x: F.coalesce(x["__v"], F.lit(""))).alias("all_values"), chosen.alias("chosen"))


def metric_groups(metrics: DataFrame, groups: Mapping[str, Sequence[str]], name: str, value: str) -> DataFrame:
    """Metrics of each named group; without any group all of them are primary."""
    if not groups:
        return metrics.where(F.col(value).isNotNull()).select(F.lit("primary").alias("group"), name, value)
    pairs = [(g, m) for g, ms in groups.items() for m in ms]
    of = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(m).alias("m")) for g, m in pairs])
    return metrics.where(F.col(value).isNotNull()).select(name, value, F.inline(F.filter(of, lambda x: x["m"] == F.col(name)))).select("group", name, value)


def shown_runtime(seconds: str):
    """Seconds as people read them; 'not recorded' for null."""
    s = F.col(seconds)
    return F.when(s.isNull(), "not recorded").when(s >= 3600, F.concat(F.format_string("%.2f", s / 3600), F.lit(" h"))).when(s >= 60, F.concat(F.format_string("%.1f", s / 60), F.lit(" min"))).otherwise(F.concat(F.format_string("%.1f", s), F.lit(" s")))


def first_present(*columns: str):
    """The first of several columns that is neither null nor a word for nothing."""
    return F.coalesce(*[F.when(~F.trim(F.col(c).cast("string")).isin("", "None", "null", "nan"), F.col(c)) for c in columns])


def deep_merged(base: str, overlay: str):
    """Two maps from dotted keys to values: keys of the overlay win; a key that one side has as a value and the other as a section is the overlay's."""
    b, o = F.col(base), F.col(overlay)
    clash = lambda k: F.exists(F.map_keys(o), lambda x: (x == k) | F.startswith(x, F.concat(k, F.lit("."))) | F.startswith(k, F.concat(x, F.lit("."))))
    return F.map_concat(F.map_filter(F.coalesce(b, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(clash(k), F.lit(False))), F.coalesce(o, F.create_map().cast("map<string,string>")))


def steps(least: float, most: float, step: float) -> list[float]:
    """Values from ``least`` to ``most`` by ``step``, both ends included where they are met; a step of 0 or against the direction raises ``ValueError``."""
    if step <= 0 or most < least:
        raise ValueError("a range needs a positive step and ends in order")
    return [round(least + i * step, 10) for i in range(int((most - least) / step + 1e-9) + 1)]
