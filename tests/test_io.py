import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import sinks
from marginalia.sources import documents as dc
from marginalia.sources import tables as tb
from marginalia.streaming import ledger as lg


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_csv_of_unsure_encoding(spark, tmp_path):
    text = 'Title,Note\n"Größe – ""x""","two\nlines"\nb,\n'
    for name, data in (("a", text.encode()), ("b", b"\xef\xbb\xbf" + text.encode()), ("c", text.encode("cp1252"))):
        rows = tb.read_csv(spark, write(tmp_path / f"{name}.csv", data)).orderBy("row_index").collect()
        assert [(r.Title, r.Note, r.row_index) for r in rows] == [('Größe – "x"', "two\nlines", 0), ("b", "", 1)], name


def test_rows_are_numbered_in_order_over_partitions(spark):
    df = tb.with_row_index(spark.range(0, 1000, 1, 7).withColumnRenamed("id", "v"))
    assert df.where("v <> row_index").count() == 0 and df.count() == 1000


def test_description_row_and_schema(spark, tmp_path):
    df = tb.read_csv(spark, write(tmp_path / "t.csv", "Species,Tissue\nthe species of the animal,the tissue it came from\nmouse,liver\n"))
    data, described = tb.split_description_row(df)
    assert [r.Species for r in data.collect()] == ["mouse"] and described["Tissue"] == "the tissue it came from"
    inline = tb.inline_schema(spark, described).collect()
    assert {(r.column_name, r.description, r.field_type) for r in inline} == {("Species", "the species of the animal", None), ("Tissue", "the tissue it came from", None)}
    schema = tb.read_schema(spark, write(tmp_path / "s.csv", 'column_name,description,improved_description,field_type,allowed_values\na,,better,Number,\nb,plain,,,"[""x"", ""y, z""]"\nc,d,,text,u|v\n')).collect()
    assert [(r.column_name, r.description, r.field_type, r.allowed_values) for r in schema] == [("a", "better", "numeric", []), ("b", "plain", None, ["x", "y, z"]), ("c", "d", "text", ["u", "v"])]


def test_encoding_is_told_by_every_byte_of_every_file(spark, tmp_path):
    write(tmp_path / "mixed" / "a.csv", ("Note\n" + "plain line\n" * 20_000 + "Größe –\n").encode("cp1252"))
    write(tmp_path / "mixed" / "b.csv", "Note\nGröße – b\n".encode())
    rows = {r.Note for r in tb.read_csv(spark, str(tmp_path / "mixed")).collect()}
    assert rows == {"plain line", "Größe –", "Größe – b"}
    plain, western, quoted = tb.file_facts(spark, str(tmp_path / "mixed"))
    assert len(plain) == len(western) == 1 and not quoted
    assert tb.file_facts(spark, write(tmp_path / "q.csv", 'a\n"x\ny"\n'))[2]


def test_json_lines_and_runs(spark, tmp_path):
    line = lambda **kw: json.dumps({"run_id": "r1", "row_id": "a", "column_name": "c"} | kw) + "\n"
    for name, version, mode in (("r1", "main_run_bundle", "normal"), ("r2", "9", "normal"), ("r3", "main_run_bundle", "eval"), ("r4", "main_run_bundle", "eval")):
        run = tmp_path / "runs" / name
        more = {"eval": {"gold_table_hash": "h", "gold_snapshot_path": "p"}, "masked_table_hash": "m", "masked_table_snapshot_path": "s"} if name == "r4" else {}
        write(run / "run.json", json.dumps({"run_id": name, "artifact_schema_version": version, "run_mode": mode} | more))
        write(run / "proposals" / "proposals.jsonl", line(run_id=name, proposed_value="v") + ("{broken\n" + line(row_id=None) if name == "r1" else ""))
    write(tmp_path / "runs" / "no_run" / "x.txt", "x")
    found = tb.run_directories(spark, root=str(tmp_path / "runs"))
    proposals, errors = tb.read_runs(spark, found)
    assert len(found) == 4 and {r.run_id for r in proposals.collect()} == {"r1", "r4"}
    rules = [r.rule for r in errors.collect()]
    assert {x: rules.count(x) for x in set(rules)} == {"optional file missing": 16, "unknown version": 1, "provenance missing": 1, "join field missing": 1, "malformed line": 1}
    with pytest.raises(ValueError):
        tb.run_directories(spark, ["x"], "y")
    with pytest.raises(FileNotFoundError):
        tb.run_directories(spark, [str(tmp_path / "nowhere")])
    lost, why = tb.read_runs(spark, [str(tmp_path / "runs" / "no_run")])
    assert lost.count() == 0 and why.where("rule = 'required file missing'").count() == 2


def test_side_cars(spark, tmp_path):
    run = tmp_path / "runs" / "r1"
    e = {"evidence_schema_version": "main_evidence"}
    write(run / "evidence" / "evidence.jsonl", "\n".join(json.dumps(e | x) for x in ({"evidence_id": "e1", "quote": "a", "page_number": 2}, {"id": "e2", "page": 1, "source_text": "whole"}, {"page": 3})) + "\n{bad\n" + json.dumps({"evidence_id": "e3"}))
    write(run / "evidence" / "evidence.json", json.dumps([e | {"evidence_id": "e1", "quote_text": "listed", "page": 4}]))
    write(run / "evidence" / "page_text.json", json.dumps({"1": "first", "2": " ", "x": "no"}))
    write(run / "run_summary.json", json.dumps({"metrics": {"a": 1, "b": [1, 2]}, "run_id": "r1", "none": None}))
    evidence, bad = tb.read_evidence(spark, [str(run)])
    assert {(r.evidence_id, r.page, r.quote_text, r.page_text) for r in evidence.collect()} == {("e1", 4, "listed", None), ("e2", 1, None, "whole")}
    assert sorted(r.rule for r in bad.collect()) == ["malformed record", "no id", "unknown version"]
    assert [(r.page, r.page_text) for r in tb.read_page_texts(spark, [str(run)]).collect()] == [(1, "first")]
    assert {(r.key, r.value) for r in tb.read_summaries(spark, str(tmp_path / "runs")).collect()} == {("metrics.a", "1"), ("metrics.b", "[1, 2]"), ("run_id", "r1")}
    embedded = spark.createDataFrame([("p", "e1", 9)], "proposal_id string, evidence_id string, page int")
    refs = spark.createDataFrame([("p", "e1"), ("p", "e2"), ("p", "e2"), ("q", "e1"), ("q", "gone")], "proposal_id string, evidence_id string")
    got = tb.joined_evidence(embedded, evidence, refs).collect()
    assert {(r.proposal_id, r.evidence_id, r.page, r.is_embedded) for r in got} == {("p", "e1", 9, True), ("p", "e2", 1, False), ("q", "e1", 4, False)}
    write(tmp_path / "runtimes.json", "{}")
    assert tb.find_upwards(spark, str(run), "runtimes.json") == str(tmp_path / "runtimes.json") and tb.find_upwards(spark, str(run), "other.json") is None and tb.find_upwards(spark, str(run), "x", explicit=str(run)) == str(run)
    write(tmp_path / "deep" / "er" / "a_filled.csv", "x\n1\n")
    assert [p.rsplit("/", 1)[1] for p in tb.find_tables(spark, str(tmp_path))] == ["a_filled.csv"]


def test_evaluator_schema(spark, tmp_path):
    listed = {"columns": [{"name": "score", "field_type": "Number", "numeric_tolerance": {"abs": 0.5}}, {"name": "kind", "field_type": "categorical", "aliases": {"a": "b"}, "allowed_values": ["b"]}], "global_numeric_tolerance": {"abs_tol": 0.1}, "excluded_columns": ["notes"]}
    table, settings = tb.read_eval_schema(spark, write(tmp_path / "s.json", json.dumps(listed)))
    assert {(r.column_name, r.field_type, r.abs_tol) for r in table.collect()} == {("score", "numeric", 0.5), ("kind", "categorical", None)} and settings["abs_tol"] == 0.1 and settings["excluded"][-1] == "notes"
    names = spark.createDataFrame([("notes",), ("Title",), ("score",)], "c string")
    assert [r.c for r in names.where(tb.is_scored(F.col("c"), settings)).collect()] == ["score"]
    keyed, settings = tb.read_eval_schema(spark, write(tmp_path / "k.json", json.dumps({"columns": {"score": {}}, "target_columns": ["Title"]})))
    assert [r.column_name for r in keyed.collect()] == ["score"] and [r.c for r in names.where(tb.is_scored(F.col("c"), settings)).collect()] == ["Title"]
    assert tb.read_eval_schema(spark, None)[0].count() == 0
    for bad in ([{"name": " "}], [{"name": "x", "field_type": "colour"}]):
        with pytest.raises(ValueError):
            tb.read_eval_schema(spark, write(tmp_path / "b.json", json.dumps({"columns": bad})))


def test_gold_wide_and_long(spark, tmp_path):
    wide = tb.read_gold(spark, write(tmp_path / "w.csv", "row_id,score,score__cell_id\nr1,5,c9\nr2,,\n")).collect()
    assert {(r.row_id, r.column_name, r.gold_value) for r in wide} == {("r1", "score", "5"), ("r2", "score", "")} and {r.cell_id for r in wide if r.row_id == "r1"} == {"c9"}
    long = tb.read_gold(spark, write(tmp_path / "l.csv", "row_id,column_name,gold_value\nr1,a,1\n"), columns=["a"]).collect()
    assert len(long) == 1 and long[0].cell_id.startswith("cell_")
    assert tb.read_filled(spark, write(tmp_path / "f.csv", "Title,x\nA,1\nB,\n"), "run").count() == 3


def test_documents_with_fallback_and_cache(spark, tmp_path):
    for i in range(3):
        write(tmp_path / "docs" / f"d{i}.txt", f"text {i} " * 40)
    write(tmp_path / "docs" / "short.txt", "x")

    def fails(path, content):
        raise ValueError("no layout")

    dc.register("layout", fails)
    dc.register("ocr", lambda path, content: "recognised " * 20)
    files = dc.read_files(spark, str(tmp_path / "docs"))
    out = {os.path.basename(r.path): r for r in dc.parse(files, "layout", ocr="ocr").collect()}
    assert out["d0.txt"].parser == "text" and "no layout" in out["d0.txt"].error and out["short.txt"].parser == "ocr" and out["short.txt"].needs_ocr
    cache = spark.createDataFrame(dc.parse(files, "text").where(F.col("path").endswith("d1.txt")).collect(), dc.PARSED).withColumn("text", F.lit("cached"))
    again = {os.path.basename(r.path): r.text for r in dc.parse_cached(files, cache, "text").collect()}
    assert again["d1.txt"] == "cached" and again["d0.txt"].startswith("text 0") and len(again) == 4
    assert dc.label_kind("Section-header") == "heading" and dc.label_kind(None) == "paragraph"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "x"), (2, None, "y")], "i int, tags array<string>, outcome string")
    sinks.write_comparison(df, str(tmp_path / "cmp"))
    assert spark.read.option("header", True).csv(str(tmp_path / "cmp/csv")).count() == 2
    for part in (df.select("i"), df.select("outcome")):
        sinks.append_results(part, str(tmp_path / "res"))
    assert sorted(sinks.read_results(spark, str(tmp_path / "res")).columns) == ["i", "outcome"]
    assert sinks.write_outcomes(df, str(tmp_path / "m")).count() == 2
    sinks.append_json_lines(df, str(tmp_path / "led"))
    sinks.append_json_lines(df, str(tmp_path / "led"))
    assert spark.read.json(str(tmp_path / "led")).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("v", T.StringType()), T.StructField("amount", T.LongType())])
    t0 = dt.datetime(2025, 1, 1)
    rows = [(f"k{i % 5}", t0 + dt.timedelta(minutes=7 * i), i, f"v{i}", i) for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lg.events_stream(spark, str(tmp_path / "in"), "*.parquet", schema)
    got = {r.k: r.v for r in lg.run_to_table(lg.latest_by_key(stream, "k", "at", "seq", "v"), "complete").collect()}
    assert got == {f"k{k}": f"v{55 + k}" for k in range(5)}
    counts = lg.run_to_table(lg.windowed_counts(stream, "at", "1 day", "1 hour", None), "complete")
    assert counts.agg(F.sum("n")).first()[0] == 60
    assert lg.run_to_table(lg.deduplicated(stream, "k", "at", "10 days"), "append").count() == 5
    assert lg.run_to_table(lg.sessions(stream, "at", "1 day", "1 hour", "k"), "complete").agg(F.sum("n")).first()[0] == 60
