"""Tables written for people and for later runs."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_json_lines(df: DataFrame, path: str) -> None:
    """Records added to a ledger; the committer makes each append whole or nothing."""
    df.write.mode("append").json(path)


def stringified(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that every format can hold the table."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_comparison(df: DataFrame, path: str) -> None:
    """The same table as CSV and Parquet."""
    flat = stringified(df)
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    flat.write.mode("overwrite").parquet(f"{path}/parquet")


def append_results(df: DataFrame, path: str) -> None:
    """Results appended; columns grow by union, read back with :func:`read_results`."""
    df.write.mode("append").parquet(path)


def read_results(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_split(df: DataFrame, path: str, by: str) -> None:
    """One folder per value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_outcomes(matches: DataFrame, path: str, outcome: str = "outcome") -> DataFrame:
    """Matches split by outcome, and the counts of each."""
    write_split(matches, f"{path}/by_outcome", outcome)
    counts = matches.groupBy(outcome).agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").json(f"{path}/summary")
    return counts


def write_json(spark, payload: object, path: str) -> None:
    """A small JSON file, whole or not at all: written beside its place and then moved there, on any file system."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(json.dumps(payload, ensure_ascii=False, indent=1, sort_keys=True).encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(beside, to):
        raise OSError(f"cannot move {beside.toString()} to {path}")


def write_snapshot(df: DataFrame, path: str) -> dict[str, object]:
    """A table kept as it is now, with its number of rows and a hash of their contents in any order."""
    df.write.mode("overwrite").parquet(path)
    kept = df.sparkSession.read.parquet(path)
    h = F.xxhash64(F.to_json(F.struct(*kept.columns)))
    r = kept.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return {"path": path, "rows": r["n"], "content_hash": hashlib.sha256(f"{r['n']}|{r['x']}|{r['s']}|{kept.columns}".encode()).hexdigest()}


def write_evaluation(run: DataFrame, cells: DataFrame, errors: DataFrame, path: str) -> None:
    """What an evaluation leaves: the summary of its runs, their scored cells, and what went wrong."""
    write_comparison(run, f"{path}/summary")
    stringified(cells).write.mode("overwrite").json(f"{path}/scored_cells")
    errors.write.mode("overwrite").json(f"{path}/errors")


def append_experiment(tables: dict[str, DataFrame], path: str, experiment: str) -> None:
    """Long tables of one experiment, each below its own name and parted by experiment; one run again replaces its own part."""
    for name, df in tables.items():
        stringified(df).write.mode("overwrite").parquet(f"{path}/{name}/experiment={experiment}")


def read_experiments(spark, path: str, name: str) -> DataFrame:
    """One of the tables of all experiments; columns grow by union."""
    return spark.read.option("mergeSchema", True).parquet(f"{path}/{name}")
