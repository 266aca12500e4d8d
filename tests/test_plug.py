from pyspark.sql import functions as F

from marginalia import plug


def test_judges_record_what_they_raise(spark):
    def broken(g, p):
        raise RuntimeError("no model")

    cells = spark.createDataFrame([("a", "the big map", "big map"), ("b", None, None), ("c", "x", "y")], "id string, gold_value string, proposed_value string")
    rows = plug.judge_cells(cells, {"o": plug.overlap_judge, "b": broken}, keep=["id"]).collect()
    got = {(r.id, r.judge_label): (r.judge_verdict, r.judge_error) for r in rows}
    assert got["a", "o"] == ("correct", None) and got["c", "o"] == ("incorrect", None) and got["b", "b"] == (None, "no model") and len(rows) == 6
    assert plug.judge_cells(cells.limit(0), {"o": plug.overlap_judge}, keep=["id"]).collect() == []


def test_contexts_prompts_and_extraction(spark):
    ranked = spark.createDataFrame([("p", "Species used", "c2", 1), ("p", "Species used", "c1", 2), ("p", "Species used", "c3", 3)], "doc string, col string, chunk string, rank int")
    chunks = spark.createDataFrame([("c1", "Nothing. The species was mouse."), ("c2", None), ("c3", "late")], "chunk string, text string")
    blocks = plug.context_blocks(ranked, chunks, doc="doc", query="col", chunk="chunk", text="text", limit=2)
    assert blocks.first().passages == "[1] \n[2] Nothing. The species was mouse."
    asked = blocks.withColumn("prompt", plug.render("Q: {col}? {other}", {"col": F.col("col")}))
    assert asked.first().prompt == "Q: Species used? {other}"
    out = plug.extract_values(asked, keep=["doc"], column="col").first()
    assert out.proposed_value == "The species was mouse." and out.extraction_error is None


def test_first_matching_policy(spark):
    df = spark.createDataFrame([("a-q4",), ("b",), (None,)], "m string")
    assert [r.p for r in df.select(plug.first_match(F.col("m"), {"-q4$": "x", "b": "y"}, "z").alias("p")).collect()] == ["x", "y", "z"]


def test_judges_see_whole_texts(spark):
    seen = lambda g, p: (str(len(g)), float(len(p)))
    cells = spark.createDataFrame([("a", "x" * 5000, "y" * 4001)], "id string, gold_value string, proposed_value string")
    row = plug.judge_cells(cells, {"n": seen}, keep=["id"]).first()
    assert (row.judge_verdict, row.judge_score) == ("5000", 4001.0)
