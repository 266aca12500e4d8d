"""Differences between two copies of a table, field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN_NUMBER = r"^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)?(\\.[0-9]+)?$"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def tidy_sql(x: str) -> str:
    """SQL for a value as it is compared: one kind of line break, no white space at the ends, blank as null."""
    lines = f"regexp_replace({x}, '\\\\r\\\\n|[\\\\r\\\\x85\\\\u2028\\\\u2029]', '\\n')"
    return f"nullif(regexp_replace({lines}, '^[\\\\s\\\\p{{Z}}]+|[\\\\s\\\\p{{Z}}]+$', ''), '')"


def number_sql(x: str) -> str:
    """SQL for the exact decimal of a plain number (digits, sign, thousands commas, decimals), else null.

    Sign, leading and trailing zeros are normalised as text, so no digit is lost however long the number is.
    """
    bare = f"regexp_replace({x}, ',', '')"
    digits = f"regexp_replace({bare}, '^[+-]', '')"
    whole = f"regexp_replace(regexp_extract({digits}, '^([0-9]*)', 1), '^0+', '')"
    part = f"regexp_replace(regexp_extract({digits}, '\\\\.([0-9]*)$', 1), '0+$', '')"
    size = f"concat({whole}, '.', {part})"
    plain = f"({x} rlike '{PLAIN_NUMBER}' and {x} rlike '[0-9]')"
    return f"case when {plain} then if({size} <> '.' and startswith({x}, '-'), concat('-', {size}), {size}) end"


def row_differences(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    *,
    version: str | None = None,
    type_field: str | None = None,
    numeric_types: Sequence[str] = ("numeric", "number"),
    left_name: str = "left",
    right_name: str = "right",
    kind_col: str = "diff_kind",
) -> DataFrame:
    """One row per difference: keys, ``kind``, ``left_value``, ``right_value``.

    The sides are tagged and united, grouped once by the key, and one struct per side (the row with the
    greatest ``version``; ties by the greatest struct of field values) is compared field by field by a
    generated higher-order expression. ``kind`` is ``missing_in_<side>`` or the name of the field.

    Values are compared as text after white space at the ends and kinds of line break are set aside; null,
    empty and blank are one value; where ``type_field`` of either side is one of ``numeric_types`` and both
    values are plain numbers they are compared as exact numbers. Null keys are keys like any other and meet
    null keys. Repeated rows count once. Extra columns of either table are ignored, whatever their names; an
    empty side makes every row of the other one missing. Nothing is gathered per key but one struct a side,
    and partial aggregation on the map side absorbs keys that repeat without bound.
    """

    def side(df: DataFrame, tag: int) -> DataFrame:
        picked = [df[_quoted(k)].alias(f"k{i}") for i, k in enumerate(keys)]
        body = [
            (df[_quoted(version)] if version else F.lit(0)).alias("v"),
            *(df[_quoted(f)].cast("string").alias(f"f{i}") for i, f in enumerate(fields)),
            (df[_quoted(type_field)].cast("string") if type_field else F.lit(None).cast("string")).alias("t"),
        ]
        return df.select(*picked, F.lit(tag).alias("side"), F.struct(*body).alias("row"))

    both = side(left, 0).unionByName(side(right, 1))
    grouped = both.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(
        F.max(F.when(F.col("side") == 0, F.col("row"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("row"))).alias("b"),
    )
    types = ", ".join("'" + t.replace("'", "\\'") + "'" for t in numeric_types)
    pairs = ", ".join(
        f"named_struct('kind', '{f}', 'x', {tidy_sql(f'a.f{i}')}, 'y', {tidy_sql(f'b.f{i}')})" for i, f in enumerate(fields)
    )
    numeric = f"(coalesce(a.t in ({types}), false) or coalesce(b.t in ({types}), false))"
    differs = f"not (d.x <=> d.y) and not ({numeric} and coalesce({number_sql('d.x')} = {number_sql('d.y')}, false))"
    missing = "array(named_struct('kind', '{}', 'x', cast(null as string), 'y', cast(null as string)))"
    changes: Column = F.expr(
        f"case when a is null then {missing.format('missing_in_' + left_name)} "
        f"when b is null then {missing.format('missing_in_' + right_name)} "
        f"else filter(array({pairs}), d -> {differs}) end"
    )
    return grouped.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.explode(changes).alias("d")).select(
        *[F.col(_quoted(k)) for k in keys], F.col("d.kind").alias(kind_col), F.col("d.x").alias("left_value"), F.col("d.y").alias("right_value")
    )


def difference_summary(differences: DataFrame, kind_col: str = "diff_kind", by: Mapping[str, Column] | None = None) -> DataFrame:
    """Number of differences of each kind, optionally by further columns."""
    extra = [c.alias(n) for n, c in (by or {}).items()]
    return differences.groupBy(*extra, F.col(kind_col)).agg(F.count("*").alias("n"))
