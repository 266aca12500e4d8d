"""Steps that call something outside the engine, each with a deterministic default.

A plugged step is a function over a batch of rows. What it raises is recorded with the row and fails no job;
how many calls run at once is the number of partitions the caller gives the input.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (gold, proposed) to (verdict, score).
Judge = Callable[[str, str], tuple[str, float]]
#: (column, passages, prompt) to the proposed value, or None.
Extractor = Callable[[str, str, str], str | None]


def overlap_judge(gold: str, proposed: str) -> tuple[str, float]:
    """Correct at half of the words in common (Jaccard), incorrect below a fifth, else unclear."""
    a, b = (set(re.findall(r"[0-9a-z]+", x.lower())) for x in (gold, proposed))
    score = len(a & b) / len(a | b) if a | b else 0.0
    return ("correct" if score >= 0.5 else "incorrect" if score < 0.2 else "unclear"), round(score, 6)


def first_sentence(column: str, passages: str, prompt: str) -> str | None:
    """The first sentence of the passages that holds a word of the column's name."""
    words = set(re.findall(r"[0-9a-z]{4,}", column.lower()))
    for s in re.split(r"(?<=[.!?])\s+|\n", passages):
        if words & set(re.findall(r"[0-9a-z]{4,}", s.lower())):
            return s.strip()
    return None


def judge_cells(cells: DataFrame, judges: Mapping[str, Judge], *, keep: list[str], gold: str = "gold_value", proposed: str = "proposed_value") -> DataFrame:
    """One row per cell and judge: ``judge_label``, ``judge_verdict``, ``judge_score``, ``judge_error``. Null texts are judged as empty ones."""
    chosen = dict(judges)
    fields = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                values = list(record)
                g, p = ("" if x is None else str(x) for x in values[len(keep) :])
                for label, judge in chosen.items():
                    try:
                        verdict, score, error = *judge(g, p), None
                    except Exception as e:  # noqa: BLE001 - recorded with the row
                        verdict, score, error = None, None, str(e)
                    rows.append((*values[: len(keep)], label, verdict, score, error))
            yield pd.DataFrame(rows, columns=[*keep, "judge_label", "judge_verdict", "judge_score", "judge_error"])

    return cells.select(*keep, F.col(gold).alias("__g"), F.col(proposed).alias("__p")).mapInPandas(run, f"{fields}, judge_label string, judge_verdict string, judge_score double, judge_error string")


def extract_values(contexts: DataFrame, extractor: Extractor = first_sentence, *, keep: list[str], column: str = "column_name", passages: str = "passages", prompt: str = "prompt") -> DataFrame:
    """Adds ``proposed_value`` and ``extraction_error``."""
    fields = ", ".join(f"`{c}` {contexts.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                values = list(record)
                try:
                    value, error = extractor(*("" if x is None else str(x) for x in values[len(keep) :])), None
                except Exception as e:  # noqa: BLE001 - recorded with the row
                    value, error = None, str(e)
                rows.append((*values[: len(keep)], value, error))
            yield pd.DataFrame(rows, columns=[*keep, "proposed_value", "extraction_error"])

    return contexts.select(*keep, F.col(column).alias("__c"), F.col(passages).alias("__t"), F.col(prompt).alias("__q")).mapInPandas(run, f"{fields}, proposed_value string, extraction_error string")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """``template`` with every ``{name}`` replaced by the value of that column, null as nothing; unknown names stay."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if i % 2 == 0 else F.coalesce(values[x].cast("string"), F.lit("")) if x in values else F.lit("{" + x + "}") for i, x in enumerate(parts)])


def context_blocks(ranked: DataFrame, chunks: DataFrame, *, doc: str, query: str, chunk: str, text: str, rank: str = "rank", limit: int = 12) -> DataFrame:
    """The ranked passages of each (document, query) joined in order, at most ``limit`` of them."""
    best = ranked.where(F.col(rank) <= limit).join(chunks.select(chunk, F.col(text).alias("__text")), chunk)
    ordered = F.array_sort(F.collect_list(F.struct(rank, "__text")))
    return best.groupBy(doc, query).agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("["), x[rank].cast("string"), F.lit("] "), F.coalesce(x["__text"], F.lit("")))), "\n").alias("passages"))


def first_match(col: Column, policies: Mapping[str, str], default: str) -> Column:
    """The policy of the first pattern that the value matches."""
    out = F.lit(default)
    for pattern, policy in reversed(list(policies.items())):
        out = F.when(col.rlike(pattern), F.lit(policy)).otherwise(out)
    return out


def with_retries(step: Callable, *, attempts: int = 3, retry_on: tuple[type[Exception], ...] = (Exception,), wait: float = 0.0, probe: Callable[[], bool] | None = None) -> Callable:
    """A step tried again when it raises; ``probe`` is asked once per worker whether the service can be used at all.

    What the last attempt raises is raised with the number of attempts, and recorded with the row like any error.
    """
    state: dict[str, bool] = {}

    def run(*args):
        if probe is not None and "usable" not in state:
            state["usable"] = bool(probe())
        if not state.get("usable", True):
            raise RuntimeError("the service cannot be used")
        for i in range(attempts):
            try:
                return step(*args)
            except retry_on as e:
                if i + 1 == attempts:
                    raise RuntimeError(f"after {attempts} attempts: {e}") from e
                time.sleep(wait * 2**i)
        raise ValueError("at least one attempt")

    return run
