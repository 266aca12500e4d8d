import math

import pytest

from marginalia.functions import tokens as tk
from marginalia.functions import values as v


def evaluate(spark, cases, sql):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string").selectExpr("i", f"{sql} as y")
    return [r.y for r in df.orderBy("i").collect()]


def test_numbers_and_intervals(spark):
    cases = ["1,234.5", "~5", "approx. 5", "about 3", "3-5", "5 to 3", "-5", ".5", "1e3", "12%", "5 µm", "≤3", "3±1", "1, 2", "", None, "approximately 7–9", "aboutface 3"]
    low, high = v.number_bounds("x")
    expected = [(1234.5, 1234.5), (5, 5), (5, 5), (3, 3), (3, 5), (3, 5), (-5, -5), (0.5, 0.5), (1000, 1000)] + [(None, None)] * 7 + [(7, 9), (None, None)]
    assert list(zip(evaluate(spark, cases, low), evaluate(spark, cases, high))) == expected
    assert evaluate(spark, ["~5", "5", "ABOUT 5"], v.is_approximate("x")) == [True, False, True]


def test_formats(spark):
    flags = v.number_format("x")
    assert evaluate(spark, ["12%", "5 µm", "3±1"], flags["has_unit"]) == [False, True, False]
    assert evaluate(spark, ["1, 2", "1-2", "49; 500, 150"], flags["list_like"]) == [True, False, True]


def test_booleans(spark):
    assert evaluate(spark, ["Yes", " absent", "1", "0", "y", "+", "not reported", None], v.boolean_value("x")) == [True, False, True, False, None, None, None, None]
    assert evaluate(spark, ["y", "+", "maybe", "not reported"], v.boolean_cue("x")) == [True, True, False, True]


def test_texts(spark):
    assert evaluate(spark, ["  A,b\n C ", "", None, "…"], v.plain_text("x")) == ["a b c", None, None, ""]
    assert evaluate(spark, ["https://doi.org/10.1000/ABC).", "none", None], v.doi_of("x")) == ["10.1000/abc", None, None]
    assert evaluate(spark, ["Lee, Ann; Ray, Bo", "Ann B. Lee & Bo Ray", "Ann Lee Jr.", ""], v.first_surname("x")) == ["Lee", "Lee", "Lee", None]
    assert evaluate(spark, ["café au lait", "évian", "x²", None, "ＡＢ1"], f"array_join({tk.tokens('x')}, ' ')") == ["cafe au lait", "e vian", "x2", "", "ab1"]


def test_ids_and_rounding(spark):
    import hashlib

    digest = hashlib.sha256(b"7::A title").hexdigest()[:12]
    assert evaluate(spark, ["A title"], v.stable_id("row", "7", "x")) == [f"row_{digest}"]
    assert evaluate(spark, ["a"], v.round6("1.0D - 0.3D")) == [0.7]
    assert math.isclose(evaluate(spark, ["a"], v.ratio("1", "3"))[0], 0.333333)
    assert evaluate(spark, ["a"], v.ratio("1", "0")) == [None]


@pytest.mark.parametrize("bad", ["'", '"', "\\", "a'b\\c"])
def test_quotes_in_values_do_no_harm(spark, bad):
    assert len(evaluate(spark, [bad], v.plain_text("x"))) == 1
