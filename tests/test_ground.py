import pytest
from pyspark.sql import functions as F

from marginalia.operators import anchor as an
from marginalia.operators import ground as gr
from marginalia.plans import passages


def test_anchor_chain(spark):
    p = [("d", 1, "c1", 1, "Many small edits were made in the café."), ("d", 1, "c2", 2, "small edits again"), ("d", 2, "c3", 3, "old kidney sections were fixed"), ("d", 2, "c4", 4, None), ("e", 1, "c5", 1, "small edits")]
    q = [
        ("exact", "d", 1, "Small EDITS", "direct_quote", "c1", 1.0), ("cut", "d", 1, "mall edits were ma", "direct_quote", "c1", 1.0), ("other_page", "d", 2, "small edits", "quote_plus_page", None, 0.0), ("no_page", "d", None, "kidney sections", "direct_quote", "c3", 1.0),
        ("near", "d", 2, "old kidney slices we fixed", "approximate_highlight", "c3", 0.6), ("far", "d", 2, "one two three fixed", "quote_plus_page", None, 0.0), ("blank", "d", 1, " ", "quote_plus_page", None, 0.0), ("null", None, 1, "small", "quote_plus_page", None, 0.0), ("script", "d", 1, "мышь", "quote_plus_page", None, 0.0),
    ]
    quotes = spark.createDataFrame([x[:4] for x in q] + [q[0][:4]], "id string, doc string, page int, quote string").withColumn("tokens", F.lit(1))
    texts = spark.createDataFrame(p, "doc string, page int, pid string, ord int, text string")
    names = {"quote_id": "id", "doc": "doc", "page": "page", "quote": "quote", "passage_id": "pid", "passage": "text", "order": "ord"}
    assert {tuple(r) for r in gr.anchor_chain(quotes, texts, **names).collect()} == {(x[0], *x[4:]) for x in q}
    assert gr.anchor_chain(quotes.limit(0), texts, **names).collect() == []


def test_authority_of_sources(spark):
    order = ["direct_quote", "calculation", "caption_grounded_figure_evidence", "inferred_reasoning", "visual_interpretation_figure_evidence", "approximate_highlight", "quote_plus_page", "unknown"]
    e = spark.createDataFrame([("p", f"e{i}", s, 1) for i, s in enumerate(reversed(order))], "p string, e string, s string, r int")
    out = an.rank_evidence(e, "p", "s", "r", "e", passages.AUTHORITY).orderBy("new_rank").collect()
    assert [r.s for r in out] == order and out[0].is_first


@pytest.mark.parametrize(
    "quote,value,numeric,expected",
    [("a count of 5.5 % in all", "5.5 %", True, True), ("5 cells of 12", "12 of 5", True, True), ("5 cells", "5 of 12", True, False), ("mice and rats", "mouse rat", False, False), ("two gene editors", "gene editor", False, True), ("large old kidney", "old large kidneys new", False, True), ("", "x", False, False), (None, "x", False, False), ("x", None, False, False)],
)
def test_quotes_support_values(spark, quote, value, numeric, expected):
    df = spark.createDataFrame([(quote, value, numeric)], "q string, v string, n boolean")
    assert df.select(gr.supports_value("q", "v", "n")).first()[0] is expected


def test_status_lattice(spark):
    rows = [("error", "error", 1, 0, 0, [], "not_applicable"), ("found", "direct_evidence", 1, 0, 0, [], "direct_strong"), ("found", "direct_evidence", 1, 0, 1, [], "direct_weak"), ("found", "inferred_from_evidence", 1, 1, 0, [], "inferred_strong"), ("found", "direct_evidence", 2, 1, 0, ["insufficient_evidence"], "inferred_weak"), ("unclear", "blocked", 0, 0, 0, [], "no_evidence"), ("skipped", "blocked", 3, 0, 0, [], "not_applicable")]
    df = spark.createDataFrame([r[:6] for r in rows], "state string, support string, n_evidence int, n_inferred int, n_loose int, reasons array<string>")
    assert [r[0] for r in df.select(gr.evidence_status()).collect()] == [r[6] for r in rows]


def test_review_buckets_and_illegal_combinations(spark):
    rows = [
        ("value_proposed", "direct_strong", [], "review", True), ("value_proposed", "direct_weak", [], "attention", True), ("value_proposed", "no_evidence", [], "review", False), ("value_proposed", "no_evidence", ["insufficient_evidence"], "attention", True), ("error", "not_applicable", [], "diagnostic", True), ("error", "no_evidence", [], "diagnostic", False),
        ("unresolved", "no_evidence", ["retrieval_empty"], "diagnostic", True), ("unresolved", "no_evidence", ["retrieval_empty", "other"], "attention", True), ("unresolved", "direct_strong", [], "attention", False), ("unresolved", "direct_strong", ["conflicting_evidence"], "attention", True), ("no_data", "no_evidence", [], "attention", True), ("no_data", "not_applicable", [], "review", False), ("not_applicable", "not_applicable", [], "diagnostic", True),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "s string, e string, r array<string>")
    out = df.select(gr.review_bucket("s", "e", "r").alias("b"), gr.illegal_combination("s", "e", "r").isNull().alias("ok")).collect()
    assert [(r.b, r.ok) for r in out] == [r[3:] for r in rows]


def test_figure_references(spark):
    text = "As in Fig. 3a-c and figure 12, not figured 4; see FIG 2B."
    got = gr.figure_references(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), ["id"], "t").orderBy("ordinal").collect()
    assert [(r.figure_no, r.panel) for r in got] == [(3, "a-c"), (12, None), (2, "B")] and all(r.snippet == text for r in got)
    long = gr.figure_references(spark.createDataFrame([(1, "x" * 500 + " Figure 7 " + "y" * 500)], "id int, t string"), ["id"], "t").first()
    assert long.figure_no == 7 and len(long.snippet) <= 140 + 8 + 220 and "Figure 7" in long.snippet


def test_figures_are_scored_and_chosen(spark):
    f = spark.createDataFrame([("d", f"f{i}", i, c, n) for i, c, n in ((1, "spatial map of genes", "spatial map"), (2, "spatial map", None), (3, "other", None))], "doc string, figure_id string, figure_no int, caption string, nearby string")
    q = spark.createDataFrame([("d", "q", "Spatial map")], "doc string, query string, query_text string")
    refs = spark.createDataFrame([("d", None, 1)] * 5 + [("d", "q", 2)], "doc string, query string, figure_no int")
    got = spark.createDataFrame([("d", "q", 1)], "doc string, query string, figure_no int")
    scored = gr.score_figures(f, q, refs, got)
    assert {r.figure_id: (r.score, r.band) for r in scored.collect()} == {"f1": (1.0, "high"), "f2": (0.4125, "medium"), "f3": (0.0, "low")}
    assert [r.figure_id for r in gr.select_figures(scored).collect()] == ["f1"]
    assert [r.figure_id for r in gr.select_figures(scored.where("figure_id <> 'f1'")).orderBy("place").collect()] == ["f2", "f3"]


def test_tiers_and_overrides(spark):
    e = spark.createDataFrame([("e1", "p", "d", 1, "text", False), ("e2", "p", "d", 1, " ", True), ("e3", "p", "d", 0, "text", True), ("e4", "q", None, 1, "text", False), ("e5", "q", "d", 1, None, False)], "e string, p string, doc string, page int, quote string, near boolean")
    tiers = gr.evidence_tiers(e, doc="doc", page="page", quote="quote", source="quote", approximate="near", reasoning="case when e = 'e5' then 'argued' end")
    assert {r.e: (r.tier, r.tier_status, r.tier_bucket) for r in tiers.collect()} == {"e1": ("A", "direct_strong", "review"), "e2": ("B", "direct_weak", "attention"), "e3": ("D", "no_evidence", "attention"), "e4": ("D", "no_evidence", "attention"), "e5": ("C", "inferred_weak", "attention")}
    rolled = {r.p: (r.tier, r.codes) for r in gr.strongest_tier(tiers, "p", "tier", "tier_codes", "e").collect()}
    assert rolled == {"p": ("A", ["approximate_anchor", "missing_structured_evidence"]), "q": ("C", ["missing_structured_evidence", "page_only_evidence"])}
    rows = [(["calculation"], "direct_strong", "review", "inferred_strong", "review", []), (["calculation"], "direct_weak", "review", "inferred_weak", "attention", []), (["calculation", "figure_estimate"], "direct_strong", "review", "direct_weak", "attention", ["figure_estimate"]), (["absence_inference"], "direct_strong", "review", "inferred_weak", "attention", ["absence_inference"]), (None, "direct_strong", "review", "direct_strong", "review", [])]
    df = spark.createDataFrame([r[:3] for r in rows], "c array<string>, s string, b string").withColumn("f", F.lit(None).cast("array<string>"))
    assert [(r.new_status, r.new_bucket, r.new_flags) for r in gr.derivation_overrides(df, codes="c", status="s", bucket="b", flags="f").collect()] == [r[3:] for r in rows]
