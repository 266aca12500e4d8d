import pytest
from pyspark.sql import functions as F

from marginalia import plug, sinks
from marginalia.operators import assemble as am
from marginalia.operators import checks as ck
from marginalia.operators import retrieve as rt
from marginalia.operators import review as rv
from marginalia.operators import scorecard as sc
from marginalia.operators import study as st
from marginalia.operators.order import numbered
from marginalia.plans import building


def test_rows_are_numbered_in_a_global_order(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 as v")
    out = numbered(df, "v", number="n", start=10)
    assert out.count() == 5000 and out.where("n <> v + 10").count() == 0
    assert numbered(df.limit(0), "v").collect() == []


def test_inputs_warn_of_what_is_missing(spark):
    cells = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "b"), (None, "c")], "row string, col string")
    matches = spark.createDataFrame([("r1", "d1", "matched"), ("r1", "d1", "matched"), ("r2", "d2", "ambiguous"), ("r3", "d3", "matched")], "row string, doc string, outcome string")
    docs = spark.createDataFrame([("d1", "text"), ("d3", None)], "doc string, text string")
    schema = spark.createDataFrame([("a", "told"), ("b", " ")], "col string, description string")
    out = am.extraction_inputs(cells, matches, docs, schema, row="row", doc="doc", column="col").collect()
    assert {(r.row, r.doc, tuple(r.warnings)) for r in out} == {("r1", "d1", ()), ("r2", None, ("row_without_paper",)), ("r3", "d3", ("paper_without_text", "column_without_description")), (None, None, ("row_without_paper", "column_without_description"))}


def test_metadata_comes_from_the_first_sure_source(spark):
    rows = [("d1", "2020", "front"), ("d1", "2021", "parser"), ("d2", "2020", "parser"), ("d2", "2021", "parser"), ("d2", "2019", "text"), ("d3", "1", "parser"), ("d3", "2", "parser"), ("d4", " ", "parser"), ("d5", "A", "parser"), ("d5", "a ", "parser")]
    df = spark.createDataFrame([(d, "f", x, s) for d, x, s in rows], "d string, f string, x string, s string")
    out = {r.d: (r.x, r.s, r.state) for r in am.resolved_metadata(df, "d", "f", "x", "s", ["parser", "front", "text"]).collect()}
    assert out == {"d1": ("2021", "parser", "found"), "d2": ("2019", "text", "found"), "d3": (None, None, "ambiguous"), "d4": (None, None, "missing"), "d5": ("A", "parser", "found")}


@pytest.mark.parametrize(
    "raw,json,error",
    [
        ('{"state": "Present!", "amount": " 7 ", "notes": [1, "b"], "sure": true}', '{"amount": 7, "notes": ["1", "b"], "state": "found", "sure": true}', None), ('{"state": "proposed", "amount": "n/a"}', None, "$.amount: expected integer, null"),
        ('{"state": "propose"}', '{"amount": null, "notes": [], "state": "unclear", "sure": false}', None), ('{"notes": "x", "state": "found"}', None, "$.notes: expected array"), ('{"state": null, "proposed_value": ["a", "b"]}', '{"amount": null, "notes": [], "proposed_value": "a\\nb", "state": "found", "sure": false}', None),
        ("[1]", None, "$: expected object"), ("nope", None, "no json"), (None, None, "no json"), ('{"sure": 1, "state": "found"}', None, "$.sure: expected boolean"), ("[" * 100_000, None, "no json"),
    ],
)
def test_answers_are_coerced_and_checked(spark, raw, json, error):
    df = spark.createDataFrame([(1, raw, "kept")], "i int, raw string, json string")
    r = ck.validated_json(df, "raw", building.ANSWER).first()
    assert (r.json, r.error, r.i) == (json, error, 1)


def test_schema_rows_generic_texts_types_and_preflight(spark):
    s = spark.createDataFrame([("a", "d", "number", None), (" ", None, "colour", ["x"]), ("c", "d", None, ["x"]), ("e", "d", "categorical", ["x"])], "c string, d string, t string, v array<string>")
    assert [r[0] for r in s.select(ck.schema_errors("c", "d", "t", "v")).collect()] == [[], ["missing column_name", "missing description", "invalid field_type", "allowed_values need categorical"], ["allowed_values need categorical"], []]
    g = spark.createDataFrame([("Supported by the\n provided evidence.",), ("it is recorded because the cited page",), ("",), (None,), ("The table gives 5.",)], "x string")
    assert [r[0] for r in g.select(ck.is_generic("x")).collect()] == [True, True, False, False, False]
    t = spark.createDataFrame([("1", "2", None, None), ("yes", "0", None, None), ("1", "0", None, None), ("a", "b", None, ["a"]), ("1", "2", "text", None), (None, "2", None, None)], "g string, p string, d string, a array<string>")
    assert [r[0] for r in t.select(ck.inferred_type("g", "p", "d", "a")).collect()] == ["numeric", "boolean", "numeric", "categorical", "text", "text"]
    assert ck.preflight(["row_id", "x", "x__cell_id", "z"], ["x"], 5, 4) == ["missing join column: row_index", "columns absent from schema: z", "table has 4 rows, gold 5"] and ck.preflight(["row_id", "row_index"], [], 2, 0) == ["table has no rows"]
    assert ck.missing_columns(["Title"]) == ["Authors", "Publication Year"]


def test_index_is_reused_by_fingerprint(spark):
    now = spark.createDataFrame([("a", "c1", "x"), ("a", "c2", None), ("b", "c3", "y"), ("c", "c4", "z")], "d string, c string, t string")
    old = spark.createDataFrame([("a", "c2", None), ("a", "c1", "x"), ("b", "c3", "Y"), ("gone", "c9", "z")], "d string, c string, t string")
    plan = rt.index_plan(rt.fingerprints(now, "d", "c", "t"), rt.fingerprints(old, "d", "c", "t"), "d")
    assert {r.d: r.action for r in plan.collect()} == {"a": "reuse", "b": "build", "c": "build", "gone": "drop"}


def test_expansion_and_passages(spark):
    q = rt.expanded_queries(spark.createDataFrame([("# of pairs", "tested"), ("Species", None)], "c string, d string"), "c", "d").collect()
    assert q[0].tags == ["count_like", "variant_or_sequence"] and q[0].hint_terms[:3] == ["count", "total", "number"] and len(set(q[0].hint_terms)) == len(q[0].hint_terms) and q[1].query_text == "Species:"
    b = spark.createDataFrame([("d", 0, "Methods", "section_heading", "Methods"), ("d", 1, " We cut. ", "paragraph", "Methods"), ("d", 2, " ", "paragraph", "Methods"), ("d", 3, "t", "table_region", None)], "d string, o int, t string, k string, s string")
    got = [(r.chunk_type, r.retrieval_text) for r in rt.passages_of_blocks(b, "d", "o", "t", "k", "s").orderBy("o").collect()]
    assert got == [("section", "[Chunk type: section] [Section: Methods] Methods"), ("paragraph", "[Chunk type: paragraph] [Section: Methods] [Section: Methods] We cut."), ("table_region", "[Chunk type: table_region] [Table] t")]
    f = spark.createDataFrame([("d", "f1", None, 7, "near"), ("d", None, None, None, None), ("d", None, "own", 7, None)], "d string, figure_id string, caption_text string, caption_block_id int, nearby_text string")
    c = spark.createDataFrame([("d", 7, "of the block")], "d string, block_id int, text string")
    assert {(r.figure_ref, r.display_text) for r in rt.figure_passages(f, c, "d").collect()} == {("f1", "of the block"), (None, "own")}


def test_review_rules(spark):
    p = spark.createDataFrame([("p1", "review", ["low_confidence"], [], "direct_strong", None), ("p2", "diagnostic", None, ["provider_error"], "direct_weak", "rejected"), ("p3", None, ["needs_more_evidence", "fallback_evidence"], ["anchor_fallback"], None, "accepted")], "id string, review_bucket string, warning_flags array<string>, reasons array<string>, evidence_status string, decision string")
    cats = {r.id: r.c for r in p.select("id", rv.warning_categories("warning_flags", "reasons", "evidence_status").alias("c")).collect()}
    assert cats == {"p1": ["low_confidence_proposal"], "p2": ["weak_evidence"], "p3": ["weak_evidence"]}
    ids = lambda **kw: {r.id for r in rv.filtered(p, **kw).collect()}
    assert ids() == {"p1", "p2", "p3"} and ids(reviewable_only=True) == {"p1", "p3"} and ids(decision="undecided") == {"p1"} and ids(evidence="weak") == {"p2"} and ids(evidence="fallback") == {"p3"} and ids(figure=True) == set() and ids(id="p1", decision="accepted") == set()
    effects = rv.bulk_decisions(spark.createDataFrame([("p1",), ("p1",), ("p2",), ("x",)], "id string"), p, p.where("decision is not null"), "id", "accepted").collect()
    assert {(r.id, r.effect) for r in effects} == {("p1", "recorded"), ("p2", "skipped"), ("x", "skipped")}
    assert {r.effect for r in rv.bulk_decisions(p.select("id"), p, p, "id", "accepted", replace=True).collect()} == {"recorded"}
    with pytest.raises(ValueError):
        rv.bulk_decisions(p, p, p, "id", "accepted_with_edit")


def test_study_helpers(spark):
    assert st.steps(0, 1, 0.25) == [0, 0.25, 0.5, 0.75, 1.0] and st.steps(1, 2, 0.3) == [1, 1.3, 1.6, 1.9]
    with pytest.raises(ValueError):
        st.steps(0, 1, 0)
    df = spark.createDataFrame([(30.0,), (90.0,), (7200.0,), (None,)], "s double")
    assert [r[0] for r in df.select(st.shown_runtime("s")).collect()] == ["30.0 s", "1.5 min", "2.00 h", "not recorded"]
    m = spark.createDataFrame([({"a.b": "1", "c": "2"}, {"a": "x", "d": "3"}), ({"a": "1"}, None), (None, {"z": "1"})], "b map<string,string>, o map<string,string>")
    assert [dict(r[0]) for r in m.select(st.deep_merged("b", "o")).collect()] == [{"c": "2", "a": "x", "d": "3"}, {"a": "1"}, {"z": "1"}]
    f = spark.createDataFrame([(None, " null", "x"), ("nan", "", None)], "a string, b string, c string")
    assert [r[0] for r in f.select(st.first_present("a", "b", "c")).collect()] == ["x", None]
    metrics = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "n string, v double")
    assert {(r.group, r.n) for r in st.metric_groups(metrics, {"primary": ["a"], "guardrail": ["a", "c"]}, "n", "v").collect()} == {("primary", "a"), ("guardrail", "a")}
    assert {(r.group, r.n) for r in st.metric_groups(metrics, {}, "n", "v").collect()} == {("primary", "a"), ("primary", "b")}


def test_scorecard_of_nothing_has_no_rates(spark):
    schema = "run string, gold boolean, is_gold_present boolean, present boolean, content boolean, scored boolean, correct boolean, is_correct boolean, structured boolean, field_type string, judge boolean, adjudicable boolean, join_status string, n_proposals int, anchored boolean, unvalidated boolean, support string, judge_verdict string, mode string, failed boolean, va string, vb string, fa boolean, fb boolean, has_a boolean, has_b boolean, n_correct int, n_incorrect int, failure_attribution string"
    row = ("r", True, False, False, True, False, None, None, False, "text", None, None, "missing_proposal", 0, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)
    out = sc.unscored_reason(sc.scorecard(spark.createDataFrame([row], schema), ["run"])).first()
    assert out.content_correctness is None and out.gold_empty_cell_count == 1 and out.unscored_reason == "missing_required_eval_inputs"
    assert sc.scorecard(spark.createDataFrame([], schema), ["run"]).collect() == []
    bad = spark.createDataFrame([("numeric_near_miss", False), ("numeric_hard_mismatch", True), ("numeric_list_format", True), ("numeric_parse_failure", False), ("boolean_contradiction", True), (None, True)], "f string, cue boolean")
    assert [bool(r[0]) for r in bad.select(sc.adjudicable("f", "cue")).collect()] == [True, False, True, False, False, False]


def test_retries_and_probes():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("down")
        return x

    assert plug.with_retries(flaky)(5) == 5 and len(calls) == 3
    with pytest.raises(RuntimeError, match="after 2 attempts: down"):
        calls.clear()
        plug.with_retries(flaky, attempts=2)(5)
    with pytest.raises(RuntimeError, match="cannot be used"):
        plug.with_retries(flaky, probe=lambda: False)(5)


def test_small_files_and_snapshots(spark, tmp_path):
    for payload in ({"a": 1}, {"a": "ü"}):
        sinks.write_json(spark, payload, str(tmp_path / "x.json"))
    assert '"ü"' in (tmp_path / "x.json").read_text(encoding="utf-8") and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.json"]
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    one, two = sinks.write_snapshot(df, str(tmp_path / "s1")), sinks.write_snapshot(df.orderBy(F.desc("i")), str(tmp_path / "s2"))
    assert one["content_hash"] == two["content_hash"] and one["rows"] == 2 and sinks.write_snapshot(df.limit(1), str(tmp_path / "s3"))["content_hash"] != one["content_hash"]
    sinks.append_experiment({"cells": df}, str(tmp_path / "e"), "x")
    sinks.append_experiment({"cells": df.withColumn("more", F.array("s"))}, str(tmp_path / "e"), "y")
    sinks.append_experiment({"cells": df}, str(tmp_path / "e"), "x")
    back = sinks.read_experiments(spark, str(tmp_path / "e"), "cells")
    assert back.count() == 4 and set(back.columns) == {"i", "s", "more", "experiment"}
    sinks.write_evaluation(df, df, df, str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev" / "errors")).count() == 2


def test_package_rules_and_one_record(spark):
    p = spark.createDataFrame([("p1", "r1", "c", "ok"), ("p1", "r1", "c", "ok"), ("p2", "r9", "x", "odd"), ("p2", "r1", "c", "ok"), (None, None, None, None)], "proposal_id string, row_id string, column_name string, proposal_status string")
    e = spark.createDataFrame([("e1", "p1", 1), ("e2", "gone", 0), ("e3", None, None)], "evidence_id string, proposal_id string, page_number int")
    rows, columns = spark.createDataFrame([("r1",)], "row_id string"), spark.createDataFrame([("c",)], "column_name string")
    got = {(r.rule, r.key) for r in ck.package_errors(p, e, rows, columns, {"proposal_status": ["ok"]}).collect()}
    assert got == {("unknown row", "p2"), ("unknown row", None), ("unknown column", "p2"), ("unknown column", None), ("id used twice", "p2"), ("unknown proposal_status", "p2"), ("evidence of unknown proposal", "e2"), ("evidence of unknown proposal", "e3"), ("evidence on no page", "e2"), ("evidence on no page", "e3")}
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 1), (1.0, 0.0, 0.0, 1.0, 1), (0.0, 0.0, float("nan"), 1.0, 1), (0.0, 0.0, 1.0, 1.0, 0), (None, 0.0, 1.0, 1.0, 1)], "a double, b double, c double, d double, p int")
    assert [r[0] for r in boxes.select(ck.valid_region("a", "b", "c", "d", "p")).collect()] == [True, False, False, False, False]
    ledger = spark.createDataFrame([("p1", 2, "x"), ("p1", 1, "y"), ("p1", 1, "y")], "proposal_id string, at int, decision string")
    r = rv.record_of(p, ledger, e, "proposal_id", "p1", at=["at"], rank="page_number").first()
    assert [h.decision for h in r.history] == ["y", "x"] and [x.evidence_id for x in r.evidence] == ["e1"] and rv.record_of(p, ledger, e, "proposal_id", "no", at=["at"], rank="page_number").count() == 0
