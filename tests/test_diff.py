import datetime as dt

from marginalia.operators.diff import difference_summary, row_differences

SCHEMA = "run string, cell string, gold string, status string, kind string, at timestamp, side string, k0 int"
T0, T1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)


def rows(spark, *values):
    return spark.createDataFrame([(*v, "x", 1) for v in values], SCHEMA)


def run(a, b):
    out = row_differences(a, b, ["run", "cell"], ["gold", "status"], version="at", type_field="kind", left_name="a", right_name="b")
    return sorted((r.run or "", r.cell or "", r.diff_kind) for r in out.collect())


def test_missing_rows_changed_fields_and_older_versions(spark):
    a = rows(spark, ("r", "1", "x", "ok", "text", T0), ("r", "2", "new", "ok", "text", T1), ("r", "2", "old", "ok", "text", T0), ("r", "4", "x", "y", None, None), ("r", "1", "x", "ok", "text", T0))
    b = rows(spark, ("r", "2", "new", "bad", "text", T0), ("r", "3", "x", "ok", "text", T0), ("r", "4", "X", "z", None, None))
    assert run(a, b) == [("r", "1", "missing_in_b"), ("r", "2", "status"), ("r", "3", "missing_in_a"), ("r", "4", "gold"), ("r", "4", "status")]


def test_what_makes_no_difference(spark):
    cases = [("text", " a\r\nb ", "a\nb"), ("text", None, "  "), ("text", "a ", "a"), ("numeric", "1,234.50", "+1234.5"), ("numeric", "007", "7"), ("numeric", "-0", "0"), ("numeric", ".5", "0.5"), ("numeric", "123456789012345678901234567890.10", "123456789012345678901234567890.1")]
    a = rows(spark, *[("r", str(i), x, "s", k, T0) for i, (k, x, _) in enumerate(cases)])
    b = rows(spark, *[("r", str(i), y, "s", k, T0) for i, (k, _, y) in enumerate(cases)])
    assert run(a, b) == []


def test_what_makes_a_difference(spark):
    cases = [("text", "1,234", "1234"), ("numeric", "1234", "1235"), ("numeric", "12 %", "12"), ("numeric", "1,23", "123"), ("text", "a  b", "a b"), ("text", "A", "a"), ("numeric", "-1", "1"), ("numeric", "1e3", "1000"), ("text", "", "x")]
    a = rows(spark, *[("r", str(i), x, "s", k, T0) for i, (k, x, _) in enumerate(cases)])
    b = rows(spark, *[("r", str(i), y, "s", k, T0) for i, (k, _, y) in enumerate(cases)])
    assert len(run(a, b)) == len(cases)


def test_null_keys_empty_sides_and_long_values(spark):
    a = rows(spark, (None, "1", "x" * 100_000, "s", "text", T0), ("r", None, "y", "s", "text", None))
    assert run(a, a) == []
    assert run(a, a.limit(0)) == [("", "1", "missing_in_b"), ("r", "", "missing_in_b")]
    assert run(a.limit(0), a.limit(0)) == []
    out = row_differences(a, a.limit(0), ["run", "cell"], ["gold"])
    assert [r.n for r in difference_summary(out).collect()] == [2]
