"""Queries of the general corpus problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.operators.diff import difference_summary, row_differences
from marginalia.operators.unpack import unpack_values
from marginalia.session import spread, table

KEYS, FIELDS = ("run_id", "row_id", "column_name"), ("gold_value", "proposed_value", "join_status")


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_differences(
        table(spark, sf_dir, "scored_cells"), table(spark, sf_dir, "scored_cells_export"), KEYS, FIELDS,
        version="written_at", type_field="field_type", left_name="scored", right_name="export",
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(spark, sf_dir).select(*KEYS, "diff_kind")


def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference_summary(differences(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "genome_editing_tools_filled").select("row_id", "authors").unionByName(table(spark, sf_dir, "spatial_transcriptomics_filled").select("row_id", "authors"))
    return unpack_values(spread(cells), "authors", keep=("row_id",), pos_col="author_pos", value_col="author").distinct()


QUERIES = {"p2_found": p2_found, "p2_summary": p2_summary, "p5_found": p5_found}

_TIDY = r"nullif(regexp_replace(regexp_replace({x}, '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '')"
_PLAIN = r"^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)?(\.[0-9]+)?$"


def _side(table: str) -> str:
    fields = ", ".join(f"{_TIDY.format(x=f)} AS {f}" for f in FIELDS)
    return (
        f"SELECT run_id, row_id, column_name, field_type, {fields}, 1 AS here FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY run_id, row_id, column_name ORDER BY written_at DESC, gold_value DESC NULLS LAST, proposed_value DESC NULLS LAST, join_status DESC NULLS LAST) AS rn FROM {table}) WHERE rn = 1"
    )


def _differs(f: str) -> str:
    number = lambda x: f"try_cast(replace({x}, ',', '') AS DECIMAL(38, 12))"
    plain = lambda x: f"regexp_matches({x}, '{_PLAIN}') AND regexp_matches({x}, '[0-9]')"
    same = f"coalesce((coalesce(a.field_type, '') = 'numeric' OR coalesce(b.field_type, '') = 'numeric') AND {plain('a.' + f)} AND {plain('b.' + f)} AND {number('a.' + f)} = {number('b.' + f)}, false)"
    return f"SELECT a.run_id, a.row_id, a.column_name, '{f}' AS diff_kind FROM a JOIN b USING (run_id, row_id, column_name) WHERE a.{f} IS DISTINCT FROM b.{f} AND NOT {same}"


_ALL = f"WITH a AS ({_side('scored_cells')}), b AS ({_side('scored_cells_export')}) " + " UNION ALL ".join(
    [
        "SELECT run_id, row_id, column_name, 'missing_in_export' AS diff_kind FROM a ANTI JOIN b USING (run_id, row_id, column_name)",
        "SELECT run_id, row_id, column_name, 'missing_in_scored' AS diff_kind FROM b ANTI JOIN a USING (run_id, row_id, column_name)",
        *map(_differs, FIELDS),
    ]
)
ORACLES = {"p2_found": _ALL, "p2_summary": f"SELECT diff_kind, count(*) AS n FROM ({_ALL}) GROUP BY diff_kind"}
