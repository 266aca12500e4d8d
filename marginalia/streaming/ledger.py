"""The review ledger and other events as streams."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import shared_dir


def events_stream(spark: SparkSession, directory: str, glob: str, schema, *, per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream, some per trigger."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(directory)


def latest_by_key(stream: DataFrame, key: str, at: str, seq: str, *values: str) -> DataFrame:
    """Last record of each key as a stateful upsert: one struct per key is the state."""
    return stream.groupBy(key).agg(F.max(F.struct(at, seq, *values)).alias("x"), F.count("*").alias("n_records")).select(key, *[F.col(f"x.{c}").alias(c) for c in (at, seq, *values)], "n_records")


def deduplicated(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """First record of each key within the watermark; the state forgets keys older than that."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, late: str, width: str, slide: str | None, *by: str) -> DataFrame:
    """Counts and integer sums per event-time window, tumbling or sliding; records later than ``late`` are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).select(F.col("w.start").alias("window_start"), *by, "n", "amount")


def sessions(stream: DataFrame, at: str, late: str, gap: str, key: str) -> DataFrame:
    """Sessions of each key, closed by a pause of ``gap``."""
    s = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_table(stream: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """All input there is now, run through the stream into files of the shared folder; the result as a batch table.

    ``append``: every row is written once. ``update``: each batch writes only the rows it changed, and of each of
    ``keys`` the row of the last batch counts, so a batch costs what it changes. ``complete``: the last batch counts.
    Checkpoint and output live in the shared folder, so a lost executor costs a retry, and a batch that is run again
    replaces itself.
    """
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    out = f"{base}/out"
    if mode == "update" and not keys:
        raise ValueError("updates need the keys by which they replace each other")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    table = spark.read.option("basePath", out).schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*[F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in stream.columns])
    if mode == "complete":
        last = table.agg(F.max("batch")).first()[0]
        table = table.where(F.col("batch") == F.lit(last))
    return table.drop("batch")


def split_by_time(table: DataFrame, at: str, parts: int) -> str:
    """The rows written as files in the order of their time, one after the other, as they would come in; the folder they are in."""
    base = os.path.join(shared_dir(table.sparkSession), f"arrivals-{uuid.uuid4().hex}")
    cuts = table.agg(F.percentile_approx(F.unix_micros(F.col(at).cast("timestamp")), [i / parts for i in range(1, parts)])).first()[0] or []
    place = F.coalesce(F.aggregate(F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>"), F.lit(0), lambda n, c: n + F.when(F.unix_micros(F.col(at).cast("timestamp")) > c, 1).otherwise(0)), F.lit(0))
    for i in range(len(cuts) + 1):
        table.where(place == i).coalesce(1).write.mode("append").parquet(base)
    return base
