"""Queries of replicated measurements, over line items as results and scored cells as candidates' cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import values as v
from marginalia.operators import study as st
from marginalia.session import table

WEIGHTS = {"A": 2.0, "N": 1.0, "R": 1.0}
_RESULTS = (
    "concat('cand_', l_suppkey % 11) as candidate_id", "l_returnflag as benchmark_id", "l_linenumber as replicate_index",
    "case when l_orderkey % 10 <> 0 then cast(l_discount * 100 + 0.5 as int) end as score", "cast(l_quantity as int) as runtime",
)


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*_RESULTS)


def benchmark_moments(spark: SparkSession, d: str) -> DataFrame:
    return st.moments(results(spark, d), ["candidate_id", "benchmark_id"], "score")


def suite(spark: SparkSession, d: str) -> DataFrame:
    per = results(spark, d).groupBy("candidate_id", "benchmark_id").agg(F.avg("score").alias("score"))
    return st.weighted_mean(per, ["candidate_id"], "score", WEIGHTS, "benchmark_id")


def board(spark: SparkSession, d: str) -> DataFrame:
    totals = results(spark, d).groupBy("benchmark_id", "candidate_id").agg(F.expr(v.round6("sum(score) / count(score)")).alias("mean_score"), F.sum("runtime").alias("runtime"))
    return st.leaderboard(totals, "mean_score", ["runtime", "candidate_id"], ["benchmark_id"])


def rounds(spark: SparkSession, d: str) -> DataFrame:
    per = results(spark, d).groupBy("candidate_id", F.col("replicate_index").alias("round")).agg(F.expr(v.round6("sum(score) / count(score)")).alias("score"))
    return st.best_by_round(per, "round", "score", ["candidate_id"])


def labels(spark: SparkSession, d: str) -> DataFrame:
    return st.unique_labels(table(spark, d, "scored_cells").where("candidate_id is not null").select(F.coalesce("candidate_label", F.lit("?")).alias("label"), "candidate_id"), "label", "candidate_id")


def chain(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").selectExpr("p_partkey as node", "case when p_partkey > 1 then cast(floor(p_partkey / 2) as bigint) end as parent")
    nodes.createOrReplaceTempView("marginalia_nodes")
    return st.lineage(spark, "marginalia_nodes", "node", "parent", "(SELECT max(node) FROM marginalia_nodes)")


def knobs(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of knob values but for the one in use."""
    models = table(spark, d, "text_models").select("model_id", F.coalesce("temperature", F.lit(0.0)).alias("temperature"))
    grid = st.grid(spark, {"top_k": (6, 8, 10, 12), "mode": ("lexical", "hybrid"), "window": (0, 1)})
    return models.withColumn("knobs", F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in grid.columns]) for r in grid.collect()]))).select("model_id", "knobs.*").where("not (top_k = 12 and mode = 'lexical' and window = 1)")


def categories(spark: SparkSession, d: str) -> DataFrame:
    """Best and mean result per category of each attribute."""
    r = results(spark, d).where("score is not null")
    pairs = F.array(F.struct(F.lit("candidate").alias("attribute"), F.col("candidate_id").alias("category")), F.struct(F.lit("benchmark").alias("attribute"), F.col("benchmark_id").alias("category")))
    return r.select("score", F.inline(pairs)).groupBy("attribute", "category").agg(F.max("score").alias("best"), F.expr(v.round6("sum(score) / count(*)")).alias("mean_score"), F.count("*").alias("n"))


def judge_switches(spark: SparkSession, d: str) -> DataFrame:
    return st.switches(table(spark, d, "judge_records").select("run_id", "judged_at", "judge_label", "cell_id").distinct(), "run_id", ["judged_at", "judge_label", "cell_id"], "judge_label")


def merged(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "scored_cells").where("was_scored").groupBy("candidate_id").agg(F.max("candidate_label").alias("label"), F.count("*").alias("cells")).where("candidate_id is not null")
    b = table(spark, d, "scored_cells_export").where("is_correct").groupBy("candidate_id").agg(F.min("candidate_label").alias("label"), F.count("*").alias("correct_cells")).where("candidate_id is not null")
    return st.outer_merge(a, b, "candidate_id")


def stages(spark: SparkSession, d: str) -> DataFrame:
    """Winner of each month of orders by priority, and the change from the month before."""
    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("stage"), F.col("o_orderpriority").alias("candidate")).agg(F.count("*").alias("score"))
    best = m.groupBy("stage").agg(F.max(F.struct("score", "candidate")).alias("x")).select("stage", F.col("x.candidate").alias("winner"), F.col("x.score").alias("score"))
    from pyspark.sql.window import Window

    w = Window.orderBy("stage")  # one row per stage
    return best.withColumn("delta", F.coalesce(F.col("score") - F.lag("score").over(w), F.lit(0))).withColumn("winner_changed", F.coalesce(F.col("winner") != F.lag("winner").over(w), F.lit(False)))


_REPLICATES = (
    "concat(case when l_suppkey % 11 = 3 then 'ext_' else 'cand_' end, l_suppkey % 11) as candidate_id", "l_returnflag as benchmark_id", "l_linenumber as replicate_index", "concat('bundle_', l_suppkey % 3) as prompt", "concat('model_', l_suppkey % 4) as model",
    "case when l_orderkey % 10 = 0 then 'unscored' when l_orderkey % 17 = 0 then 'failed' when l_orderkey % 13 = 0 then 'scored_degraded' else 'scored' end as status", "l_orderkey % 17 <> 0 as completed",
    "case when l_orderkey % 10 <> 0 and l_orderkey % 17 <> 0 then cast(l_discount * 100 + 0.5 as int) end as score", "case when l_partkey % 5 <> 0 then cast(l_quantity as int) end as runtime", "cast(l_tax * 100 + 0.5 as int) as cells",
    "l_suppkey % 7 as disagreement", "l_suppkey % 2 as missing_evidence", "l_partkey % 50 <> 0 as contract_valid", "l_orderkey as o", "l_quantity as q",
)


def replicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*_REPLICATES)


def _per_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return st.replicate_summary(replicates(spark, d), ["candidate_id", "benchmark_id"], 3)


def replicate_summary(spark: SparkSession, d: str) -> DataFrame:
    """Moments, counts and caveats per candidate and benchmark."""
    return _per_benchmark(spark, d).withColumn("caveats", F.array_join("caveats", ","))


def suite_summary(spark: SparkSession, d: str) -> DataFrame:
    """Weighted suite with failures and caveats."""
    return st.suite_summary(_per_benchmark(spark, d), ["candidate_id"], WEIGHTS, "benchmark_id").withColumn("caveats", F.array_join("caveats", ","))


def fields(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and the best of them by prompt, without controls; and why the others are not scored."""
    r = replicates(spark, d).where(~st.is_control("candidate_id", "prompt", "model"))
    best = st.best_by_field(r, "prompt", "score", "completed").selectExpr("'prompt' as what", "prompt as value", "candidates as n", "completed", "best")
    statuses = r.groupBy("status").agg(F.count("*").alias("n"), F.count_if("completed").alias("completed"), F.max(F.when(F.col("completed"), F.col("score"))).alias("best")).selectExpr("'status' as what", "status as value", "n", "completed", "best")
    return best.unionByName(statuses)


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Retries, malformed answers and time lost, judgements as attempts."""
    j = table(spark, d, "judge_records").distinct().selectExpr("judge_label", "judge_response_mode as mode", "case when input_was_truncated then 'retry' else 'first' end as phase", "case when judge_verdict is null then 'structured_output_error' else 'success' end as outcome", "case when trim(judge_verdict) = '' then 'malformed_json' end as reason", "cast(request_tokens as bigint) as ms")
    return st.attempt_failures(j, ["judge_label"], phase="phase", outcome="outcome", reason="reason", mode="mode", duration="ms")


def order(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in the order they are listed, with their runtime as shown."""
    c = replicates(spark, d).groupBy("candidate_id").agg(F.max("status").alias("status"), F.expr(v.round6("sum(score) / count(score)")).alias("score"), (F.sum("runtime") / 8).alias("runtime"))
    return st.listed(c, "status", "score", "runtime", "candidate_id").select("candidate_id", "place", st.shown_runtime("runtime").alias("shown"))


def difficulty_order(spark: SparkSession, d: str) -> DataFrame:
    """Columns from the hardest: by benchmark, correctness (unknown last), missing proposals, name."""
    from marginalia.operators.order import numbered

    c = table(spark, d, "scored_cells").where("is_gold_present").groupBy("benchmark_id", "column_name").agg(F.expr(v.ratio("count_if(is_correct)", "count_if(was_scored)")).alias("correctness"), F.count_if(F.col("join_status") == "missing_proposal").alias("missing"))
    return numbered(c.withColumn("k", F.coalesce("correctness", F.lit(2.0))), F.asc("benchmark_id"), F.asc("k"), F.desc("missing"), F.asc("column_name"), number="place", start=1).drop("k")


def variant(spark: SparkSession, d: str) -> DataFrame:
    """What the comparison varies, and candidates by status."""
    r = replicates(spark, d)
    return st.study_variant(r.withColumn("mode", F.lit("lexical")), ["mode"], "prompt", "model")


def runtimes(spark: SparkSession, d: str) -> DataFrame:
    """Runtimes kept beside the results, joined where these have none."""
    inside = replicates(spark, d).where("candidate_id not like 'ext%'").selectExpr("candidate_id", "benchmark_id", "replicate_index", "runtime", "'internal' as source")
    outside = replicates(spark, d).where("candidate_id like 'ext%'").selectExpr("candidate_id", "benchmark_id", "replicate_index", "cast(null as int) as runtime", "'external' as source")
    per = inside.unionByName(outside).groupBy("candidate_id", "benchmark_id", "replicate_index", "source").agg(F.sum("runtime").alias("runtime"))
    kept = table(spark, d, "supplier").selectExpr("concat(case when s_suppkey % 11 = 3 then 'ext_' else 'cand_' end, s_suppkey % 11) as candidate_id", "cast(s_suppkey % 7 + 1 as int) as replicate_index", "s_suppkey * 10 as recorded", "case when s_suppkey % 2 = 0 then 'suite_replicate' else 'benchmark_replicate' end as scope")
    return st.with_runtimes(per, kept, key=["candidate_id", "replicate_index"])


def cell_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Scored cells beside the proposals of their cell."""
    s = table(spark, d, "scored_cells").groupBy("run_id", "row_id", "column_name").agg(F.max(F.struct("written_at", "proposed_value"))["proposed_value"].alias("proposed_value"))
    p = table(spark, d, "proposals").select("run_id", "row_id", "column_name", "proposal_id", "proposed_value").distinct()
    return st.cell_reviews(s, p, ["run_id", "row_id", "column_name"], "proposed_value", "proposal_id").withColumn("all_values", F.array_join("all_values", "|"))


QUERIES = {
    "study_benchmark_moments": benchmark_moments, "study_suite_mean": suite, "study_leaderboard": board, "study_best_by_round": rounds, "study_unique_labels": labels, "study_lineage": chain,
    "study_knob_grid": knobs, "study_category_scores": categories, "judge_switches": judge_switches, "study_outer_merge": merged, "study_stage_changes": stages, "study_replicates": replicate_summary, "study_suite": suite_summary, "study_fields": fields, "attempt_failures": attempts, "study_order": order,
    "difficulty_order": difficulty_order, "study_variant": variant, "study_runtimes": runtimes, "cell_reviews": cell_reviews,
}

_R = f"(SELECT concat('cand_', l_suppkey % 11) AS candidate_id, l_returnflag AS benchmark_id, l_linenumber AS replicate_index, CASE WHEN l_orderkey % 10 <> 0 THEN cast(trunc(l_discount * 100 + 0.5) AS INTEGER) END AS score, cast(trunc(l_quantity) AS INTEGER) AS runtime FROM lineitem)"
_w = "CASE benchmark_id " + " ".join(f"WHEN '{k}' THEN {x}::DOUBLE" for k, x in WEIGHTS.items()) + " END"
_mean = v.round6("cast(sum(score) AS DOUBLE) / count(score)")
_RP = """(SELECT concat(CASE WHEN l_suppkey % 11 = 3 THEN 'ext_' ELSE 'cand_' END, l_suppkey % 11) AS candidate_id, l_returnflag AS benchmark_id, l_linenumber AS replicate_index, 'bundle_' || (l_suppkey % 3) AS prompt, CASE WHEN l_orderkey % 10 = 0 THEN 'unscored' WHEN l_orderkey % 17 = 0 THEN 'failed' WHEN l_orderkey % 13 = 0 THEN 'scored_degraded' ELSE 'scored' END AS status,
  l_orderkey % 17 <> 0 AS completed, CASE WHEN l_orderkey % 10 <> 0 AND l_orderkey % 17 <> 0 THEN trunc(l_discount * 100 + 0.5)::INTEGER END AS score, CASE WHEN l_partkey % 5 <> 0 THEN trunc(l_quantity)::INTEGER END AS runtime, trunc(l_tax * 100 + 0.5)::INTEGER AS cells, l_suppkey % 7 AS disagreement, l_suppkey % 2 AS missing_evidence, l_partkey % 50 <> 0 AS contract_valid FROM lineitem)"""
_PB = f"""(SELECT candidate_id, benchmark_id, count(*) AS n_total, count(score) AS n_scored, count(*) FILTER (WHERE status = 'failed' OR NOT completed) AS n_failed, count(*) FILTER (WHERE status = 'unscored' OR score IS NULL) AS n_unscored, count(*) FILTER (WHERE status = 'scored_degraded') AS n_degraded, {v.round6('avg(score)')} AS mean, {v.round6('stddev_samp(score)')} AS sd, {v.round6('stddev_samp(score) / sqrt(count(score))')} AS sem,
  {v.round6('avg(runtime)')} AS runtime_mean, {v.round6('stddev_samp(runtime)')} AS runtime_sd, sum(runtime)::BIGINT AS runtime_total, sum(cells) FILTER (WHERE cells > 0)::BIGINT AS cells_total, {v.round6('sum(runtime)::DOUBLE / sum(cells) FILTER (WHERE cells > 0)')} AS runtime_per_cell,
  list_filter([CASE WHEN count(*) FILTER (WHERE status = 'scored_degraded') > 0 THEN 'degraded_replicates_visible' END, CASE WHEN count(*) FILTER (WHERE NOT completed OR status = 'failed') > 0 THEN 'failed_replicates_visible' END, CASE WHEN bool_or(NOT contract_valid) THEN 'invalid_contract_observed' END, CASE WHEN max(disagreement) > 0 THEN 'judge_instability_observed' WHEN max(missing_evidence) > 0 THEN 'missing_evidence_observed' END,
  CASE WHEN count(*) > count(score) THEN 'unscored_replicates_visible' END], lambda c: c IS NOT NULL) AS caveats FROM {_RP} GROUP BY 1, 2)"""
ORACLES = {
    "study_benchmark_moments": f"SELECT candidate_id, benchmark_id, count(score) AS n, {v.round6('avg(score)')} AS mean, {v.round6('stddev_samp(score)')} AS sd, {v.round6('stddev_samp(score) / sqrt(count(score))')} AS sem, min(score) AS least, max(score) AS most FROM {_R} GROUP BY 1, 2",
    "study_suite_mean": f"SELECT candidate_id, {v.round6(f'sum(s * {_w}) / sum({_w}) FILTER (WHERE s IS NOT NULL)')} AS weighted_mean, {v.round6(f'sum({_w}) FILTER (WHERE s IS NOT NULL) / {sum(WEIGHTS.values())}::DOUBLE')} AS coverage, count(s) AS members FROM (SELECT candidate_id, benchmark_id, avg(score) AS s FROM {_R} GROUP BY 1, 2) GROUP BY 1",
    "study_leaderboard": f"SELECT *, {v.round6('mean_score - lead(mean_score) OVER w')} AS gap_to_next, row_number() OVER w::INTEGER AS rank FROM (SELECT benchmark_id, candidate_id, {_mean} AS mean_score, sum(runtime)::BIGINT AS runtime FROM {_R} GROUP BY 1, 2) WINDOW w AS (PARTITION BY benchmark_id ORDER BY mean_score DESC NULLS LAST, runtime, candidate_id)",
    "study_best_by_round": f"SELECT *, {v.round6('best - best_before')} AS delta FROM (SELECT candidate_id, replicate_index AS round, {_mean} AS best, max({_mean}) OVER (PARTITION BY candidate_id ORDER BY replicate_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM {_R} GROUP BY 1, 2)",
    "study_unique_labels": "WITH l AS (SELECT DISTINCT coalesce(candidate_label, '?') AS label, candidate_id FROM scored_cells WHERE candidate_id IS NOT NULL) SELECT candidate_id, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || ' (' || candidate_id || ')' ELSE label END AS display_label FROM l",
    "study_lineage": "WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), up AS (SELECT node, parent, 0 AS depth FROM n WHERE node = (SELECT max(node) FROM n) UNION ALL SELECT n.node, n.parent, up.depth + 1 FROM n JOIN up ON n.node = up.parent) SELECT node, depth FROM up",
    "study_knob_grid": "SELECT model_id, top_k, mode, \"window\" FROM text_models, (SELECT unnest([6, 8, 10, 12]) AS top_k), (SELECT unnest(['lexical', 'hybrid']) AS mode), (SELECT unnest([0, 1]) AS \"window\") WHERE NOT (top_k = 12 AND mode = 'lexical' AND \"window\" = 1)",
    "study_category_scores": f"SELECT attribute, category, max(score) AS best, {v.round6('cast(sum(score) AS DOUBLE) / count(*)')} AS mean_score, count(*) AS n FROM (SELECT 'candidate' AS attribute, candidate_id AS category, score FROM {_R} UNION ALL SELECT 'benchmark', benchmark_id, score FROM {_R}) WHERE score IS NOT NULL GROUP BY 1, 2",
    "judge_switches": "SELECT run_id, count(*) AS n, count(*) FILTER (WHERE b <> judge_label) AS switches FROM (SELECT *, lag(judge_label) OVER (PARTITION BY run_id ORDER BY judged_at, judge_label, cell_id) AS b FROM (SELECT DISTINCT run_id, judged_at, judge_label, cell_id FROM judge_records)) GROUP BY 1",
    "study_outer_merge": "WITH a AS (SELECT candidate_id, max(candidate_label) AS label, count(*) AS cells FROM scored_cells WHERE was_scored AND candidate_id IS NOT NULL GROUP BY 1), b AS (SELECT candidate_id, min(candidate_label) AS label, count(*) AS correct_cells FROM scored_cells_export WHERE is_correct AND candidate_id IS NOT NULL GROUP BY 1) SELECT candidate_id, coalesce(b.label, a.label) AS label, cells, correct_cells FROM a FULL JOIN b USING (candidate_id)",
    "study_stage_changes": "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS stage, o_orderpriority AS candidate, count(*) AS score FROM orders GROUP BY 1, 2), b AS (SELECT stage, candidate AS winner, score FROM m QUALIFY row_number() OVER (PARTITION BY stage ORDER BY score DESC, candidate DESC) = 1) SELECT *, coalesce(score - lag(score) OVER w, 0) AS delta, coalesce(winner <> lag(winner) OVER w, false) AS winner_changed FROM b WINDOW w AS (ORDER BY stage)",
    "study_replicates": f"SELECT * REPLACE (array_to_string(caveats, ',') AS caveats) FROM {_PB}",
    "study_suite": f"SELECT candidate_id, {v.round6('sum(mean * w) / sum(w) FILTER (WHERE mean IS NOT NULL)')} AS weighted_mean, count(mean) AS covered, count(*) FILTER (WHERE n_scored = 0 OR n_failed > 0) AS failed_benchmarks, count(*) FILTER (WHERE n_degraded > 0) AS degraded_benchmarks, sum(runtime_total)::BIGINT AS runtime_total, sum(cells_total)::BIGINT AS cells_total, array_to_string(list_sort(list_distinct(list_concat(flatten(list(caveats)), CASE WHEN count(mean) < 3 THEN ['benchmark_coverage_loss'] ELSE [] END))), ',') AS caveats FROM (SELECT *, {_w} AS w FROM {_PB}) GROUP BY 1",
    "study_fields": f"SELECT 'prompt' AS what, prompt AS value, count(*) AS n, count(*) FILTER (WHERE completed) AS completed, max(score) FILTER (WHERE completed) AS best FROM {_RP} WHERE candidate_id NOT LIKE 'ext%' GROUP BY 2 UNION ALL SELECT 'status', status, count(*), count(*) FILTER (WHERE completed), max(score) FILTER (WHERE completed) FROM {_RP} WHERE candidate_id NOT LIKE 'ext%' GROUP BY 2",
    "attempt_failures": "SELECT judge_label, count(*) FILTER (WHERE input_was_truncated) AS retries, count(*) FILTER (WHERE trim(judge_verdict) = '') AS malformed, count(*) FILTER (WHERE judge_verdict IS NULL) AS wrong_structure, coalesce(sum(request_tokens) FILTER (WHERE judge_response_mode IN ('json_schema', 'json_object') AND judge_verdict IS NULL), 0)::BIGINT AS lost_ms FROM (SELECT DISTINCT * FROM judge_records) GROUP BY 1",
    "study_order": f"WITH c AS (SELECT candidate_id, max(status) AS status, {v.round6('sum(score)::DOUBLE / count(score)')} AS score, sum(runtime) / 8 AS runtime FROM {_RP} GROUP BY 1) SELECT candidate_id, row_number() OVER (ORDER BY CASE status WHEN 'scored' THEN 1 WHEN 'scored_degraded' THEN 2 WHEN 'unscored' THEN 3 WHEN 'failed' THEN 4 ELSE 10 END, score DESC NULLS LAST, runtime NULLS LAST, candidate_id) AS place, CASE WHEN runtime IS NULL THEN 'not recorded' WHEN runtime >= 3600 THEN printf('%.2f h', runtime / 3600) WHEN runtime >= 60 THEN printf('%.1f min', runtime / 60) ELSE printf('%.1f s', runtime) END AS shown FROM c",
    "difficulty_order": f"WITH c AS (SELECT benchmark_id, column_name, CASE WHEN count(*) FILTER (WHERE was_scored) > 0 THEN floor(count(*) FILTER (WHERE is_correct)::DOUBLE / count(*) FILTER (WHERE was_scored) * 1000000 + 0.5) / 1000000 END AS correctness, count(*) FILTER (WHERE join_status = 'missing_proposal') AS missing FROM scored_cells WHERE is_gold_present GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY benchmark_id, coalesce(correctness, 2), missing DESC, column_name) AS place FROM c",
    "study_variant": "SELECT CASE WHEN count(DISTINCT l_suppkey % 3) > 1 THEN 'prompt_compare' WHEN count(DISTINCT l_suppkey % 4) > 1 THEN 'model_compare' ELSE 'compare' END AS variant FROM lineitem",
    "study_runtimes": f"WITH p AS (SELECT candidate_id, benchmark_id, replicate_index, CASE WHEN candidate_id LIKE 'ext%' THEN 'external' ELSE 'internal' END AS source, CASE WHEN candidate_id NOT LIKE 'ext%' THEN sum(runtime)::BIGINT END AS runtime FROM {_RP} GROUP BY 1, 2, 3), k AS (SELECT concat(CASE WHEN s_suppkey % 11 = 3 THEN 'ext_' ELSE 'cand_' END, s_suppkey % 11) AS candidate_id, (s_suppkey % 7 + 1)::INTEGER AS replicate_index, min(s_suppkey * 10) AS recorded, min(CASE WHEN s_suppkey % 2 = 0 THEN 'suite_replicate' ELSE 'benchmark_replicate' END) AS scope FROM supplier GROUP BY 1, 2) SELECT candidate_id, benchmark_id, replicate_index, source, scope, coalesce(runtime, CASE WHEN coalesce(scope, 'benchmark_replicate') <> 'suite_replicate' OR benchmark_id = min(benchmark_id) OVER (PARTITION BY candidate_id, replicate_index) THEN recorded END) AS runtime FROM p LEFT JOIN k USING (candidate_id, replicate_index)",
    "cell_reviews": "WITH s AS (SELECT run_id, row_id, column_name, arg_max(coalesce(proposed_value, chr(0)), (written_at, coalesce(proposed_value, ''))) AS x FROM scored_cells GROUP BY 1, 2, 3), c AS (SELECT run_id, row_id, column_name, nullif(x, chr(0)) AS proposed_value FROM s), p AS (SELECT DISTINCT run_id, row_id, column_name, proposal_id, coalesce(proposed_value, '') AS v FROM proposals), g AS (SELECT run_id, row_id, column_name, count(*) AS n, string_agg(v, '|' ORDER BY proposal_id) AS all_values, min(proposal_id) AS first_id FROM p GROUP BY 1, 2, 3), m AS (SELECT c.run_id, c.row_id, c.column_name, min(proposal_id) AS own_id FROM c JOIN p USING (run_id, row_id, column_name) WHERE c.proposed_value <> '' AND v = c.proposed_value GROUP BY 1, 2, 3) SELECT c.*, coalesce(n, 0) AS n_proposals, all_values, coalesce(own_id, first_id) AS chosen FROM c LEFT JOIN g USING (run_id, row_id, column_name) LEFT JOIN m USING (run_id, row_id, column_name)",
}
