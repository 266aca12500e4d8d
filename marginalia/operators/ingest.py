"""Wide tables turned into typed target cells, masked, profiled, and controls made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import values as v
from marginalia.operators.order import numbered

# Cell texts that stand for nothing.
PLACEHOLDERS = ("n/a", "na", "tbd", "tba", "unknown", "-", "--", "none", "?")


def listed_values(x: str, d: v.Dialect = v.SPARK) -> str:
    """Array of the values of a cell: a JSON array, else parted by bars, else semicolons, else commas; trimmed, empty ones gone."""
    if d.name == "spark":
        plain = rf"split({x}, case when contains({x}, '|') then r'\|' when contains({x}, ';') then ';' else ',' end)"
        return f"filter(transform(case when startswith(trim({x}), '[') then coalesce(from_json({x}, 'array<string>'), {plain}) else {plain} end, i -> trim(i)), i -> i <> '')"
    plain = f"string_split({x}, CASE WHEN contains({x}, '|') THEN '|' WHEN contains({x}, ';') THEN ';' ELSE ',' END)"
    return f"list_filter(list_transform(CASE WHEN starts_with(trim({x}), '[') THEN coalesce(try_cast(try_cast({x} AS JSON) AS VARCHAR[]), {plain}) ELSE {plain} END, lambda i: trim(i)), lambda i: i <> '')"


def eligibility_sql(x: str, d: v.Dialect = v.SPARK) -> str:
    text = f"lower({v.tidy(x, d)})"
    return f"case when {v.is_empty(x, d)} then 'blank' when {text} in ({', '.join(repr(p) for p in PLACEHOLDERS)}) then 'placeholder' else 'filled' end"


def target_cells(wide: DataFrame, ids: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One row per target cell with the class of its content."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("current_value")) for c in targets])
    long = wide.select(*ids, F.inline(pairs))
    return long.withColumn("eligibility", F.expr(eligibility_sql("current_value")))


def masked(wide: DataFrame, targets: Sequence[str]) -> DataFrame:
    """The table with its target columns blanked, and how many filled cells of the row were hidden."""
    hidden = sum((F.expr(f"cast(not {v.is_empty(c)} as int)") for c in targets), F.lit(0))
    return wide.withColumn("n_masked", hidden).withColumns({c: F.lit("") for c in targets})


def column_profiles(long: DataFrame, column: str, value: str) -> DataFrame:
    """Per column: filled cells, distinct values, share of numbers, mean length and its class."""
    number = f"({v.number_bounds(value)[0]}) is not null"
    filled = long.where(~F.expr(v.is_empty(value)))
    p = filled.groupBy(column).agg(F.count("*").alias("filled"), F.count_distinct(value).alias("distinct_values"), F.count_if(F.expr(number)).alias("numbers"), F.sum(F.length(value)).alias("chars"))
    return p.select(
        column, "filled", "distinct_values", F.expr(v.ratio("numbers", "filled")).alias("number_share"), F.expr(v.ratio("chars", "filled")).alias("mean_length"),
        F.expr("case when numbers >= 0.6 * filled then 'numeric' when chars <= 20 * filled then 'short' when chars <= 80 * filled then 'phrase' else 'long' end").alias("profile"),
    )


def shuffled_words(x: str, seed: str, d: v.Dialect = v.SPARK) -> str:
    """The words of a text in the order of their seeded hashes, turned by one if that is the order they had."""
    if d.name == "spark":
        w = f"filter(split({v.tidy(x, d)}, ' '), i -> i <> '')"
        keyed = f"array_sort(transform({w}, (t, i) -> concat(substr(sha2(concat('{seed}', '|', i, '|', t), 256), 1, 16), '|', t)))"
        new = f"transform({keyed}, t -> substr(t, 18))"
        return f"case when size({w}) < 2 then array_join({w}, ' ') when array_join({new}, ' ') = array_join({w}, ' ') then array_join(concat(slice({w}, 2, size({w})), slice({w}, 1, 1)), ' ') else array_join({new}, ' ') end"
    w = f"list_filter(string_split({v.tidy(x, d)}, ' '), lambda i: i <> '')"
    keyed = f"list_sort(list_transform({w}, lambda t, i: concat(substr(sha256(concat('{seed}', '|', i - 1, '|', t)), 1, 16), '|', t)))"
    new = f"list_transform({keyed}, lambda t: substr(t, 18))"
    return f"CASE WHEN len({w}) < 2 THEN array_to_string({w}, ' ') WHEN array_to_string({new}, ' ') = array_to_string({w}, ' ') THEN array_to_string(list_concat({w}[2:], {w}[1:1]), ' ') ELSE array_to_string({new}, ' ') END"


def deranged(long: DataFrame, column: str, key: str, value: str, seed: int = 0) -> DataFrame:
    """The non-blank values of all cells, whatever their columns, moved so that every cell gets another value.

    Cells are put in the order of their values, equal ones together and in a seeded order, and each takes the value
    as many places ahead, in a circle, as the most frequent value has cells: equal values are so few places apart
    that none meets its like. If one value holds more than half of the cells no derangement exists; then every
    cell is given and those that keep their value are flagged ``unchanged``. Blank cells take no part.
    """
    cells = long.where(~F.expr(v.is_empty(value))).withColumn("__v", F.trim(F.col(value)))
    cells = cells.withColumn("__h", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key), F.col(column)), 256))
    counts = cells.groupBy("__v").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    most, total = counts["most"] or 0, counts["all"] or 0
    placed = numbered(cells.select(key, column, value, "__v", "__h"), "__v", "__h", number="__place")
    ahead = F.pmod(F.col("__place") - F.lit(most), F.lit(max(total, 1)))
    given = placed.select(ahead.alias("__place"), F.col(value).alias("control_value"), F.col("__v").alias("__given"))
    return placed.join(given, "__place").select(key, column, value, "control_value", (F.col("__given") == F.col("__v")).alias("unchanged"))


def blank_columns(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns whose every cell is blank, in one pass."""
    row = wide.agg(*[F.count_if(~F.expr(v.is_empty(c))).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column_name", "filled").where("filled = 0").select("column_name")


def repaired_json(x: str) -> str:
    """Model output as JSON: thinking and fences cut, the first balanced object taken, trailing commas dropped; null if
    that is none. Braces inside strings do not count, escaped quotes do not end a string."""
    clean = rf"regexp_replace(regexp_replace({x}, r'(?s)<think>.*?</think>', ''), r'```[a-z]*', '')"
    tail = f"substr({clean}, instr({clean}, '{{'))"
    # Depth of braces after each character, outside of strings; the object ends where it first is 0
    step = (
        "named_struct('i', s.i + 1, 'depth', case when s.quoted or s.done > 0 then s.depth when c = '{' then s.depth + 1 when c = '}' then s.depth - 1 else s.depth end, "
        "'quoted', case when s.escaped then s.quoted when c = '\"' then not s.quoted else s.quoted end, 'escaped', s.quoted and not s.escaped and c = chr(92), "
        "'done', case when s.done = 0 and not s.quoted and c = '}' and s.depth = 1 then s.i + 1 else s.done end)"
    )
    start = "named_struct('i', 0, 'depth', 0, 'quoted', false, 'escaped', false, 'done', 0)"
    body = f"aggregate(filter(split({tail}, ''), z -> z <> ''), {start}, (s, c) -> {step}, s -> case when s.done > 0 then substr({tail}, 1, s.done) end)"
    fixed = rf"regexp_replace(case when instr({clean}, '{{') > 0 then {body} end, r',\s*([}}\]])', '$1')"
    return f"case when get_json_object({fixed}, '$') is not null then {fixed} end"
