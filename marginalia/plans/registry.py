"""All queries of the core library, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans import assembling, building, evaluation, extraction, files, grounding, intake, passages, problems, reviewing, scorecards, streams, studies, summaries

MODULES = (problems, evaluation, reviewing, studies, passages, intake, streams, extraction, summaries, grounding, scorecards, building, files, assembling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(spark, sf_dir)
