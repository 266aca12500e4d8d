import time

import pytest
from pyspark.sql import functions as F

from marginalia.operators import anchor as an
from marginalia.operators import evaluate as ev
from marginalia.operators import ingest as ig
from marginalia.operators import match as mt
from marginalia.operators import retrieve as rt
from marginalia.operators import review as rv
from marginalia.operators import study as st
from marginalia.plans import intake, summaries
from marginalia.session import saved


def test_numeric_comparison_classes(spark):
    rows = [("10", "10.05", None), ("10", "10.3", "numeric_near_miss"), ("10", "20", "numeric_hard_mismatch"), ("3-5", "4", None), ("10", "12%", "numeric_unit_or_percent_format"), ("10", "x", "numeric_parse_failure"), ("10", "≤3", "numeric_inequality_format"), (None, "1", "numeric_parse_failure")]
    df = spark.createDataFrame([(i, g, p) for i, (g, p, _) in enumerate(rows)], "i int, g string, p string")
    got = [r.failure_class for r in ev.compare_numbers(df, "g", "p", 0.1, 0.0).orderBy("i").collect()]
    assert got == [e for _, _, e in rows]


def test_join_statuses(spark):
    gold = spark.createDataFrame([("r", c, x, f"cell_{c}") for c, x in (("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", " "))], "row string, col string, gold string, cell string")
    props = spark.createDataFrame([("r", "a", "1", "cell_a"), ("r", "b", "1", "cell_b"), ("r", "b", "2", "cell_b"), ("r", "c", "1", "other"), ("r", "e", "1", "cell_e"), ("r", "f", "1", "cell_f")], "row string, col string, val string, cell string")
    out = ev.join_status(gold, props, ["row", "col"], gold_value="gold", cell_id="cell", proposed_value="val").collect()
    assert {r.col: r.join_status for r in out} == {"a": "matched", "b": "duplicate_proposals", "c": "cell_id_mismatch", "d": "missing_proposal", "e": "gold_empty_diagnostic", "f": "unmatched_proposal"}


def test_bm25_equals_brute_force(spark):
    import math
    from collections import Counter

    texts = {"a": "alpha beta beta gamma", "b": "beta delta", "c": "epsilon"}
    query = ["beta", "gamma", "beta"]
    docs = {k: t.split() for k, t in texts.items()}
    avg = sum(map(len, docs.values())) / 3
    idf = {t: math.log((3 - n + 0.5) / (n + 0.5) + 1) for t in query for n in [sum(t in d for d in docs.values())]}
    want = {k: sum(idf[t] * Counter(d)[t] * 2.5 / (Counter(d)[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query) for k, d in docs.items()}
    chunks = spark.createDataFrame([("p", k, t) for k, t in texts.items()], "doc string, chunk string, text string")
    q = spark.createDataFrame([("q", " ".join(query))], "query string, qt string")
    got = {r.chunk: r for r in rt.score_passages(chunks, q, doc="doc", chunk="chunk", text="text", query="query", query_text="qt").collect()}
    assert set(got) == {"a", "b"} and all(abs(got[k].bm25 - want[k]) < 1e-6 for k in got) and got["a"].coverage == 1.0


def test_neighbours_blocks_and_captions(spark):
    chunks = spark.createDataFrame([("p", f"c{i}", i) for i in range(6)], "doc string, chunk string, ord int")
    near = rt.neighbours(chunks, chunks.where("chunk = 'c2'"), "doc", "chunk", "ord").collect()
    assert {(r.chunk, r.is_neighbour) for r in near} == {("c1", True), ("c2", False), ("c3", True)}
    docs = spark.createDataFrame([(1, "Methods\r\nWe cut the sections. They were fixed.\n\nFigure 2. A map\n- item"), (2, None), (3, "")], "doc int, text string")
    got = rt.blocks(docs, "doc", "text").orderBy("reading_order").collect()
    assert [(r.block_type, r.section) for r in got] == [("section_heading", "Methods"), ("paragraph", "Methods"), ("caption", "Methods"), ("paragraph", "Methods")]
    kinds = {"RESULTS": "heading", "4. DISCUSSION": "section_heading", "2 Cell culture": "section_heading", "REFERENCES": "heading", "references (cont.)": "heading", "Abstract: we cut": "abstract", "figure 3 shows": "caption", "TABLE 2. Genes": "caption", "Figures of it.": "paragraph", "PCR-1": "paragraph"}
    typed = spark.createDataFrame([(k,) for k in kinds], "block string").select("block", rt.block_type("block").alias("kind"))
    assert {r.block: r.kind for r in typed.collect()} == kinds
    items = spark.createDataFrame([("p", 0, False, True), ("p", 1, True, False), ("p", 2, False, True), ("p", 3, False, True), ("p", 4, True, False)], "doc string, ord int, fig boolean, cap boolean")
    got = rt.attach_captions(items, "doc", "ord", F.col("fig"), F.col("cap")).collect()
    assert {(r.figure_order, r.caption_order) for r in got} == {(1, 2), (4, None)}


def test_quotes_are_located_as_whole_words(spark):
    quotes = spark.createDataFrame([("q1", 1, "small Edits"), ("q2", 1, "mall edits"), ("q3", 2, "small edits"), ("q4", 1, None), ("q5", 1, "!?")], "q string, page int, text string")
    passages = spark.createDataFrame([("t1", 1, "Many small\nedits."), ("t1", 1, "Many small\nedits."), ("t2", 1, None)], "t string, page int, body string")
    out = an.locate_quotes(quotes, passages, keys=["page"], quote_id="q", quote="text", passage_id="t", passage="body")
    assert [(r.q, r.t) for r in out.collect()] == [("q1", "t1")]


def test_matching_outcomes(spark):
    schema = "id string, title string, authors string, year string, doi string"
    rows = spark.createDataFrame([("r1", "a map of the kidney cortex", "Lee, Ann", "2020", "10.1000/a"), ("r2", "a map of the liver lobule", "Ray, Bo", "2021", None), ("r3", "unrelated", None, None, None)], schema)
    papers = spark.createDataFrame([("p1", "A map of the kidney cortex", "Ann Lee", "2020", "doi:10.1000/A."), ("p2", "a map of the kidney cortex!", "X", None, "10.1000/a"), ("p3", "nothing alike here at all", None, None, None), ("p4", "A Map of the Liver Lobule", "Bo Ray", "2022", None)], schema)
    p, r = mt.features(papers, "id", "title", "authors", "year", "doi", "p"), mt.features(rows, "id", "title", "authors", "year", "doi", "r")
    out = {x.p_id: (x.r_id, x.outcome) for x in mt.outcomes(p, r).collect()}
    assert out == {"p1": ("r1", "conflict"), "p2": ("r1", "conflict"), "p3": (None, "unmatched"), "p4": ("r2", "matched")}
    assert [x.row_index for x in mt.append_unmatched(mt.outcomes(p, r), 7).collect()] == [8]


@pytest.mark.parametrize(
    "paper,row,score",
    [
        (("a map of the kidney", "Lee, Ann", "2020", None), ("a map of the kidney", None, None, None), 0.62),  # same title alone
        (("a map of the kidney", "Lee, Ann", "2020", None), ("a map of the kidney", None, "2021", None), 0.66), (("a map of the kidney", "X", "2020", None), ("a map of the kidney", "Y", "2020", None), 0.70),
        (("a map of the kidney", "Ann Lee", "2020", None), ("a map of the kidney", "Lee, Ann; Ray, Bo", "2020", None), 0.8),  # 0.30 + 0.15 + 0.15 + 0.10 + 0.10
        (("one two", "X", "2020", "10.1000/a"), ("one two three four", "Y", "2019", "https://doi.org/10.1000/A."), 0.95), (("alpha beta gamma", None, None, "10.1000/a"), ("one two three", None, None, "10.1000/a"), 0.45),  # titles contradict the DOI
        (("a b c d e f g", None, None, None), ("a b c d e f g h i j k", None, None, None), 0.68), (("a b c d", None, "2020", None), ("a b c d e", None, "2020", None), 0.60), (("a b c d", None, None, None), ("a b c e", None, None, None), 0.18),
    ],
)
def test_matching_score(spark, paper, row, score):
    schema = "id string, title string, authors string, year string, doi string"
    p = mt.features(spark.createDataFrame([("p", *paper)], schema), "id", "title", "authors", "year", "doi", "p")
    r = mt.features(spark.createDataFrame([("r", *row)], schema), "id", "title", "authors", "year", "doi", "r")
    assert [x.score for x in mt.score_pairs(p, r).collect()] == [score]


SIDE = "id string, title string, authors string, year string, doi string"


def _forms(spark, records, p):
    return mt.features(spark.createDataFrame(records, SIDE), "id", "title", "authors", "year", "doi", p)


def _templates(spark):
    """Titles of one template, so that every paper meets every row by words that all titles have."""
    made = [[(f"{x}{i:04}", f"{x}tool{i} maps the target {i % 40} in kidney and liver at scale", None, None, None) for i in range(2000)] for x in "pr"]
    return saved(_forms(spark, made[0], "p")), saved(_forms(spark, made[1], "r"))


def test_pairs_of_template_titles_are_counted_not_joined(spark):  # F5
    p, r = _templates(spark)
    began = time.time()
    got = mt.score_pairs(p, r).agg(F.count("*").alias("n"), F.count_if(F.col("score") == 0.68).alias("near"), F.sum("r_n").alias("rows")).first()
    assert (got.n, got.near, got.rows) == (4_000_000, 100_000, 4_000_000) and time.time() - began < 30


def test_best_rows_leave_their_tile_alone(spark, monkeypatch):  # F4
    """Of 4 million pairs only the best five of each paper in a tile reach the shuffle, with the number of all."""
    p, r = _templates(spark)
    monkeypatch.setattr(mt, "TILE_ROWS", 700)
    got = saved(mt.score_pairs(p, r, best=5))
    assert got.count() == 2000 * 5 * 3 and got.agg(F.sum("n")).first()[0] == 4_000_000
    ranks = mt.best_candidates(got).where("p_id = 'p0007'").orderBy("rank").collect()
    assert [(x["rank"], x.r_id, x.score) for x in ranks] == [(i + 1, f"r{7 + 40 * i:04}", 0.68) for i in range(5)]


def test_outcomes_of_template_titles(spark):  # F2
    p, r = _templates(spark)
    began = time.time()
    out = {(x.p_id, x.r_id, x.score, x.gap, x.n_candidates, x.outcome) for x in mt.outcomes(p, r).collect()}
    assert time.time() - began < 40
    assert out == {(f"p{i:04}", f"r{i % 40:04}", 0.68, 0.0, 2000, "ambiguous") for i in range(2000)}


def _template_table(spark, path):
    """A filled table of one template of titles, without other fields; every seventh paper has its title reversed."""
    df = spark.range(1, 2001).selectExpr("concat('r', lpad(id, 4, '0')) as row_id", "id as row_index", "concat('tool', id, ' maps the target ', id % 40, ' in kidney and liver at scale') as title")
    df.select("*", *[F.lit(None).cast("string").alias(c) for c in (*intake.META, *intake.TARGETS) if c != "title"]).write.parquet(f"{path}/genome_editing_tools_filled.parquet")
    return str(path)


def test_summary_of_template_titles(spark, tmp_path):  # F3
    d = _template_table(spark, tmp_path)
    began = time.time()
    got = {(x.outcome, x.n, x.with_row) for x in intake.outcome_counts(spark, d).collect()}
    assert time.time() - began < 60
    assert got == {("unmatched", 285, 0), ("ambiguous", 1715, 1715)}


def test_papers_of_template_titles_are_appended(spark, tmp_path):  # F1
    d = _template_table(spark, tmp_path)
    began = time.time()
    got = [(x.p_id, x.row_index) for x in intake.appended(spark, d).orderBy("row_index").collect()]
    assert time.time() - began < 60
    assert got == [(f"r{7 * i:04}", 2000 + i) for i in range(1, 286)]


def _mixed_table(spark, path):
    """Papers and rows alike, near, and without fields, so that every outcome comes up, conflicts and papers of one form included."""
    df = spark.range(0, 420).selectExpr(
        "concat('r', lpad(id, 4, '0')) as row_id", "id as row_index", "case when id % 11 <> 0 then concat('tool', id div 3, ' maps gene', id % 17, ' in kidney', if(id % 2 = 0, ' at scale', '')) end as title",
        "case when id % 4 <> 0 then concat('Lee', id % 9, ', A; Ray, B') end as authors", "cast(2015 + id % 6 as string) as publication_year", "case when id % 5 <> 0 then concat('10.1000/', id div 2) end as doi",
    )
    df = df.unionByName(df.where("row_index % 14 = 0").selectExpr("concat('s', row_id) as row_id", "row_index", "title", "authors", "publication_year", "doi"))
    df.select("*", *[F.lit(None).cast("string").alias(c) for c in (*intake.META, *intake.TARGETS) if c not in df.columns]).write.parquet(f"{path}/genome_editing_tools_filled.parquet")
    return str(path)


def test_appended_seeks_only_papers_without_a_known_doi_or_title(spark, tmp_path, monkeypatch):  # F1
    d = _mixed_table(spark, tmp_path)
    want = [x.p_id for x in intake.outcomes(spark, d).where("outcome = 'unmatched'").orderBy("p_id").collect()]
    sought, meetings = [], mt._meetings
    monkeypatch.setattr(mt, "_meetings", lambda p, r, best=None: sought.append((p.count(), best)) or meetings(p, r, best))
    monkeypatch.setattr(mt, "TILE_ROWS", 100)
    got = [(x.p_id, x.row_index) for x in intake.appended(spark, d).orderBy("row_index").collect()]
    assert len(want) > 20 and got == [(p, 420 + i) for i, p in enumerate(want)]
    papers, rows = intake._sides(spark, d)
    dois, titles = ({x[0] for x in rows.select(c).collect() if x[0]} for c in ("r_doi", "r_norm"))
    left = [x for x in mt.distinct_forms(papers, "p").collect() if x.p_doi not in dois and x.p_norm not in titles]
    assert sought == [(len(left), 1)] and len(left) < 200


def test_summary_counts_forms(spark, tmp_path, monkeypatch):  # F3
    d = _mixed_table(spark, tmp_path)
    want = {(x.outcome, x.n, x.with_row) for x in intake.outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"), F.count("r_id").alias("with_row")).collect()}
    stored = []
    monkeypatch.setattr(mt, "saved", lambda df, label: stored.append(label) or saved(df, label))
    monkeypatch.setattr(mt, "TILE_ROWS", 100)
    got = {(x.outcome, x.n, x.with_row) for x in intake.outcome_counts(spark, d).collect()}
    assert got == want and {x[0] for x in got} == {"matched", "conflict", "ambiguous", "unmatched"}
    assert sorted(stored) == ["match-forms", "paper-forms", "row-forms"]  # neither papers nor their pairs


def test_pairs_equal_brute_force_over_several_tiles(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    long = " ".join(f"w{i}" for i in range(300))

    def side(x):
        some = lambda values: rnd.choice(values)
        made = [(f"{x}{i}", some([None, "", *(" ".join(rnd.sample("abcdefgh", rnd.randint(1, 8))) for _ in range(8))]), some([None, "Lee, A", "Ray, B; Lee, A", "Poe, C; Ray, B"]), some([None, "2019", "2020", "2021", "2023"]), some([None, None, f"10.1000/{rnd.randint(1, 9)}"])) for i in range(60)]
        return [*made, (f"{x}60", long, None, None, None), (f"{x}61", long + " more", None, None, None)]

    p, r = _forms(spark, side("p"), "p").cache(), _forms(spark, side("r"), "r").cache()
    forms = {k: mt.distinct_forms(df, k).collect() for k, df in (("p", p), ("r", r))}
    want = set()
    for a in forms["p"]:
        for b in forms["r"]:
            common, whole = len({*a.p_title} & {*b.r_title}), len({*a.p_title} | {*b.r_title})
            near = None not in (a.p_year, b.r_year) and abs(a.p_year - b.r_year) <= 1 and bool({*a.p_names} & {*b.r_names})
            if near or (a.p_doi is not None and a.p_doi == b.r_doi) or (common and common / whole >= 1 / 3):
                want.add((a.p_id, b.r_id, b.r_n))
    monkeypatch.setattr(mt, "TILE_ROWS", 20)
    monkeypatch.setattr(mt, "TILE_PAPERS", 25)
    got = mt.score_pairs(p, r).collect()
    assert len(got) == len(want) and {(x.p_id, x.r_id, x.r_n) for x in got} == want and {("p60", "r60", 1), ("p61", "r60", 1)} <= want


def test_papers_without_fields_meet_nothing(spark):
    blank = spark.createDataFrame([(i, None, None, None, None) for i in range(50)], "id int, title string, authors string, year string, doi string")
    p, r = (mt.features(blank, "id", "title", "authors", "year", "doi", x) for x in "pr")
    assert mt.candidate_pairs(p, r).count() == 0 and {x.outcome for x in mt.outcomes(p, r).collect()} == {"unmatched"}


def test_rows_alike_are_no_rivals_but_near_ones_are(spark):
    schema = "id string, title string, authors string, year string, doi string"
    rows = [("r1", "a map of the kidney cortex", "Lee, Ann", "2020", None), ("r2", "a map of the kidney cortex", "Lee, Ann", "2020", None), ("r3", "two kinds of liver", None, None, None), ("r4", "two kinds of liver cell", None, None, None)]
    papers = [("p1", "a map of the kidney cortex", "Lee, Ann", "2020", None), ("p2", "two kinds of liver cells", None, None, None)]
    p, r = mt.features(spark.createDataFrame(papers, schema), "id", "title", "authors", "year", "doi", "p"), mt.features(spark.createDataFrame(rows, schema), "id", "title", "authors", "year", "doi", "r")
    assert {x.p_id: (x.r_id, x.outcome) for x in mt.outcomes(p, r).collect()} == {"p1": ("r1", "matched"), "p2": (None, "unmatched")}


def test_derangement_moves_every_value(spark):
    cells = [(f"r{i}", c, x) for i in range(20) for c, x in (("a", f"v{i % 5}"), ("b", "same"), ("c", None), ("d", " "))]
    df = spark.createDataFrame(cells, "id string, col string, val string")
    out = ig.deranged(df.where("col <> 'b' or id < 'r14'"), "col", "id", "val", 3).collect()
    assert out and not any(r.unchanged for r in out) and sorted(r.val for r in out) == sorted(r.control_value for r in out) and {r.col for r in out} == {"a", "b"}
    most = ig.deranged(df.where("col = 'b'"), "col", "id", "val", 3).collect()
    assert len(most) == 20 and all(r.unchanged for r in most)
    assert ig.deranged(df.limit(0), "col", "id", "val").collect() == []


def test_full_ranking_and_boosts(spark):
    chunks = spark.createDataFrame([("p", "c1", "paragraph", "the length was 5 mm", ""), ("p", "c2", "caption", "a picture", ""), ("p", "c3", "abstract", "nothing here", ""), ("p", "c4", "table_region", "ABC-1 only", "")], "doc string, chunk string, kind string, show string, text string")
    queries = spark.createDataFrame([("num", "the length"), ("fig", "which figure"), ("id", "vector name"), ("none", "tissue")], "query string, query_text string")
    scored = spark.createDataFrame([("p", "num", "c3", 0.05)], "doc string, query string, chunk string, s double")
    signs = rt.passage_signs(chunks, "doc", "chunk", "kind", "show", "text")
    got = {(r.query, r["rank"]): (r.chunk, r.boosted) for r in rt.ranking(scored, signs, queries, doc="doc", query="query", chunk="chunk", score="s", k=2, boosted=True).collect()}
    assert got[("num", 1)] == ("c4", 0.22) and got[("num", 2)] == ("c1", 0.12) and got[("fig", 1)] == ("c2", 0.1) and got[("id", 1)] == ("c1", 0.05) and got[("none", 1)] == ("c1", 0.0)
    plain = [r.chunk for r in rt.ranking(scored, signs, queries, doc="doc", query="query", chunk="chunk", score="s", k=6).where("query = 'num'").orderBy("rank").collect()]
    assert plain == ["c3", "c1", "c2", "c4"]


def test_first_balanced_object_is_taken(spark):
    cases = {'x {"a": {"b": "}"}} {"c": 1}': '{"a": {"b": "}"}}', '{"a": "\\\\"} {"b": 2}': '{"a": "\\\\"}', '{"a": 1': None, '{"q": "say \\"}\\" now"} tail}': '{"q": "say \\"}\\" now"}'}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", F.expr(ig.repaired_json("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases


def test_controls_keep_the_values(spark):
    long = spark.createDataFrame([(f"r{i}", "c", f"w{i} x y z") for i in range(50)], "row string, col string, val string")
    shuffled = long.selectExpr("val", f"{ig.shuffled_words('val', '3')} as new").collect()
    assert all(sorted(r.val.split()) == sorted(r.new.split()) and r.val != r.new for r in shuffled)
    out = ig.deranged(long, "col", "row", "val").collect()
    assert sorted(r.control_value for r in out) == sorted(r.val for r in out) and not any(r.unchanged for r in out)


def test_ledger_and_tables(spark):
    ledger = spark.createDataFrame([("p", 1, 1, "a"), ("p", 1, 2, "b"), ("q", 2, 3, "a")], "id string, at int, seq int, decision string")
    assert {r.id: r.decision for r in rv.latest_decisions(ledger, "id", "at", "seq").collect()} == {"p": "b", "q": "a"}
    long = spark.createDataFrame([("r", "a", "1"), ("r", "b", None)], "row string, col string, val string")
    changes = spark.createDataFrame([("r", "b", ""), ("s", "a", "9")], "row string, col string, val string")
    wide = rv.to_wide(rv.upsert_cells(long, changes, ["row", "col"], "val"), "row", "col", "val", ["a", "b"]).collect()
    assert {r.row: (r.a, r.b) for r in wide} == {"r": ("1", ""), "s": ("9", None)}
    first = rv.ordered_distinct_union([(ledger.selectExpr("id", "seq", "decision"), 0), (ledger.selectExpr("'z' as id", "9 as seq", "'c' as decision"), 1)], "id", "seq").collect()
    assert {(r.id, r.source_priority, r.seq) for r in first} == {("p", 0, 1), ("q", 0, 3), ("z", 1, 9)}


def test_json_repair(spark):
    cases = ['```json\n{"a": 1,}\n```', "<think>{no}</think>{\"a\": 1}", 'So: {"a": [1, 2,]} ok', "nothing", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string").orderBy("i")
    assert [r.y is not None for r in df.selectExpr(f"{ig.repaired_json('x')} as y").collect()] == [True, True, True, False, False]


def test_grid_and_weighted_mean(spark):
    assert st.grid(spark, {"a": (1, 2, 2), "b": ("x", "y")}).count() == 4
    df = spark.createDataFrame([("c", "A", 1.0), ("c", "B", None), ("d", "B", 3.0)], "c string, b string, s double")
    assert {r.c: (r.weighted_mean, r.coverage) for r in st.weighted_mean(df, ["c"], "s", {"A": 3.0, "B": 1.0}, "b").collect()} == {"c": (1.0, 0.75), "d": (3.0, 0.25)}


@pytest.mark.parametrize("empty", [True])
def test_empty_tables(spark, empty):
    e = spark.createDataFrame([], "doc string, chunk string, text string, ord int")
    assert rt.term_statistics(e, "doc", "chunk", "text").collect() == []
    assert rt.blocks(e, "doc", "text").collect() == []
    assert st.moments(spark.createDataFrame([], "a string, x double"), ["a"], "x").collect() == []


def test_support_is_typed_and_reads_quotes_and_pages(spark):
    rows = [
        ("short", "number", "5", "a count of 5 cells", "supported"), ("thousands", "number", "1,234", "in all 1234 cells", "supported"), ("range", "number", "22-34", "at 30 degrees", "supported"), ("part", "number", "5", "in 2015", "unsupported"),
        ("wide", "number", "about 84", "only ８４ carried it", "supported"), ("page", "number", "74", "no number", "supported"), ("unparsed", "number", "12 of 5", "12 of 5", "unvalidated"), ("yes", "boolean", "yes", "it was present", "supported"), ("no", "boolean", "no", "it was noted", "unsupported"),
        ("kind", "categorical", "Mouse", "mouse-derived", "supported"), ("script", "categorical", "мышь", "это Мышь", "supported"), ("strange", "categorical", "мышь", "a cat", "unsupported"), ("free", "text", "words", "words", "not_applicable"), ("none", "number", "7", None, "unvalidated"),
    ]
    values = spark.createDataFrame([(p, k, x) for p, k, x, _, _ in rows], "p string, k string, x string")
    evidence = spark.createDataFrame([(f"e{p}", p, "pdf", 2 if p == "page" else 1, q) for p, _, _, q, _ in rows if q], "e string, p string, pdf string, page int, q string")
    pages = an.page_texts(spark.createDataFrame([("pdf", 2, 1, "until 74 hours"), ("pdf", 2, 0, "stored")], "pdf string, page int, o int, t string"), ("pdf", "page"), ("o",), "t")
    out = an.support_outcomes(values, evidence, pages, proposal="p", field_type="k", value="x", evidence_id="e", quote="q", page=("pdf", "page")).collect()
    assert {r.p: r.status for r in out} == {p: s for p, _, _, _, s in rows}


def test_quotes_of_any_script_and_cut_words_are_contained(spark):
    texts = {"t1": "Many small\n edits were made in the old kidney.", "t2": "Сигнал гена исчезал через 21 ч после обработки.", "t3": "该差异可能与切片质量有关，仍需进一步验证。组织切片", "t4": "Η ΟΔΟΣ της Straße", "t5": None}
    quotes = {
        "cut": ("all  Edits were ma", {"t1"}), "one": ("mall", {"t1"}), "ru": ("гена ИСЧЕЗАЛ через", {"t2"}), "ru_cut": ("гнал гена исч", {"t2"}), "zh": ("切片质量有关，仍需进一步", {"t3"}), "zh_short": ("切片", {"t3"}), "el": ("οδος ΤΗΣ strasse", {"t4"}),
        "gap": ("small were", set()), "no": ("старый ген и", set()), "marks": ("small-edits", set()), "blank": (" \n", set()), "null": (None, set()),
    }
    q = spark.createDataFrame([(i, 1, x) for i, (x, _) in quotes.items()], "q string, page int, text string")
    p = spark.createDataFrame([(i, n, x) for i, x in texts.items() for n in ((1,) if i != "t5" else (1, 2))], "t string, page int, body string")
    for small in (64, 0):
        out = an.contained_quotes(q, p, keys=["page"], quote_id="q", quote="text", passage_id="t", passage="body", small=small).collect()
        assert sorted((r.q, r.t) for r in out) == sorted((i, t) for i, (_, found) in quotes.items() for t in found)


def test_values_are_mentioned_in_either_text_and_inside_words(spark, tmp_path):
    props = [("display", "mouse", "v"), ("retrieval", "kidney", "v"), ("inside", "cortic", "v"), ("short", "map", "v"), ("absent", "human", "v")]
    rows = [(i, "pdf", x, "value_proposed") for i, x, _ in props]
    spark.createDataFrame(rows, "proposal_id string, pdf_id string, proposed_value string, proposal_status string").write.parquet(f"{tmp_path}/proposals.parquet")
    chunk = [("c1", "pdf", "p", 1, 1, "A map of Mouse tissue", "kidney: subcortical", None)]
    spark.createDataFrame(chunk, "chunk_id string, pdf_id string, chunk_type string, page_number int, reading_order int, display_text string, retrieval_text string, section_context string").write.parquet(f"{tmp_path}/chunks.parquet")
    out = summaries.mentioned(spark, str(tmp_path)).collect()
    assert {r.proposal_id: r.n_passages for r in out} == {"display": 1, "retrieval": 1, "inside": 1}
