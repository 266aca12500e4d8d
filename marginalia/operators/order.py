"""Rows numbered in a global order without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.session import saved


def numbered(df: DataFrame, *order, number: str = "n", start: int = 0) -> DataFrame:
    """``df`` with its place in the order, from ``start`` on.

    Rows are parted by ranges of the order and numbered within each; one count per range reaches the driver.
    """
    placed = saved(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    base, bases = start, [F.lit(start).cast("long")]
    for part in range(max(sizes, default=0)):
        base += sizes.get(part, 0)
        bases.append(F.lit(base).cast("long"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return placed.withColumn("__in", F.row_number().over(inside)).withColumn(number, F.get(F.array(*bases), F.col("__part")) + F.col("__in") - 1).drop("__part", "__in")
