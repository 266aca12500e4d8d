"""Consensus of annotators who disagree: a mixture of competence and spamming, fitted by expectation-maximisation.

Each label is either truthful (with the annotator's competence) or drawn from the annotator's personal guess
distribution. The fit runs over distinct vote patterns with their counts. One round is one distributed pass
that returns expected counts per annotator and label; only these parameters, whose number is that of the
annotators times the labels, come to the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import saved

#: Pseudo-count of each outcome in the maximisation, rounds at most, and the change of a parameter at which the fit ends.
SMOOTHING, ROUNDS, TOLERANCE = 0.1, 80, 5e-4
#: Over-relaxation: each round goes so many times as far as plain maximisation would (under 2 it still converges).
STEP, EDGE = 1.6, 1e-5
#: Bound of the parameters held by the driver: annotators times labels.
MOST_PARAMETERS = 5_000_000


def usable_label(label: Column, labels: Sequence[str]) -> Column:
    """The label of ``labels`` that ``label`` spells, case, white space and punctuation aside; else null."""
    plain = F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "")
    return F.coalesce(*[F.when(plain == "".join(c for c in x.lower() if c.isalnum()), F.lit(x)) for x in labels])


class Model:
    """Competence of each annotator, their guess distributions, and the shares of the labels."""

    def __init__(self, annotators: Sequence[str], labels: Sequence[str]):
        self.annotators, self.labels = list(annotators), list(labels)
        k = len(self.labels)
        self.competence = np.full(len(self.annotators), 0.7)
        self.guess = np.full((len(self.annotators), k), 1 / k)
        self.prior = np.full(k, 1 / k)
        self.converged = True

    def expect(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posterior of the true label of each item, probability that each vote is truthful, log evidence of each item).

        ``codes`` are annotator * number of labels + label, item after item; ``sizes`` the votes of each item.
        """
        k = len(self.labels)
        who, said = codes // k, codes % k
        random = (1 - self.competence[who]) * self.guess[who, said]
        true = self.competence[who] + random
        item = np.repeat(np.arange(len(sizes)), sizes)
        logs = np.zeros((len(sizes), k))
        other = np.bincount(item, weights=np.log(np.maximum(random, 1e-300)), minlength=len(sizes))
        gain = np.log(np.maximum(true, 1e-300)) - np.log(np.maximum(random, 1e-300))
        for label in range(k):
            hit = said == label
            logs[:, label] = np.bincount(item[hit], weights=gain[hit], minlength=len(sizes))
        logs += other[:, None] + np.log(np.maximum(self.prior, 1e-300))
        top = logs.max(axis=1, keepdims=True)
        post = np.exp(logs - top)
        total = post.sum(axis=1, keepdims=True)
        post /= total
        truthful = post[item, said] * self.competence[who] / np.maximum(true, 1e-300)
        return post, truthful, (np.log(total) + top)[:, 0]

    def maximise(self, truthful: np.ndarray, votes: np.ndarray, shares: np.ndarray) -> float:
        """New parameters from the expected truthful votes and all votes by annotator and label; the largest change."""
        spam = votes - truthful + SMOOTHING
        n = votes.sum(axis=1)
        competence = (truthful.sum(axis=1) + SMOOTHING) / (n + 2 * SMOOTHING)
        guess = spam / spam.sum(axis=1, keepdims=True)
        prior = (shares + SMOOTHING) / (shares + SMOOTHING).sum()
        change = max(np.abs(competence - self.competence).max(initial=0), np.abs(prior - self.prior).max(initial=0))
        self.competence = np.clip(self.competence + STEP * (competence - self.competence), EDGE, 1 - EDGE)
        for name, new in (("guess", guess), ("prior", prior)):
            moved = np.maximum(getattr(self, name) + STEP * (new - getattr(self, name)), EDGE)
            setattr(self, name, moved / moved.sum(axis=-1, keepdims=True))
        return float(change)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64)


def fit(patterns: DataFrame, annotators: Sequence[str], labels: Sequence[str], rounds: int = ROUNDS) -> Model:
    """The model of ``patterns`` (``codes`` ARRAY<INT>, ``n`` BIGINT)."""
    model = Model(annotators, labels)
    k = len(labels)
    schema = "code int, truthful double, votes double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.annotators) * k
        truthful, votes, shares = np.zeros(width), np.zeros(width), np.zeros(k)
        for batch in batches:
            codes, sizes = _flat(batch.column(0))
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            post, true, _ = model.expect(codes, sizes)
            weight = np.repeat(n, sizes)
            truthful += np.bincount(codes, weights=true * weight, minlength=width)
            votes += np.bincount(codes, weights=weight, minlength=width)
            shares += (post * n[:, None]).sum(axis=0)
        at = np.flatnonzero(votes)
        code = np.concatenate([at, -1 - np.arange(k)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(code, pa.int32()), pa.array(np.concatenate([truthful[at], shares])), pa.array(np.concatenate([votes[at], np.zeros(k)]))],
            names=["code", "truthful", "votes"],
        )

    model.converged = False
    for _ in range(rounds):
        rows = patterns.select("codes", "n").mapInArrow(sums, schema).groupBy("code").agg(F.sum("truthful"), F.sum("votes")).toPandas().to_numpy(float)
        rows = rows[np.argsort(rows[:, 0])] if len(rows) else np.zeros((0, 3))
        code = rows[:, 0].astype(int)
        truthful, votes = np.zeros(len(annotators) * k), np.zeros(len(annotators) * k)
        truthful[code[code >= 0]], votes[code[code >= 0]] = rows[code >= 0, 1], rows[code >= 0, 2]
        shares = np.zeros(k)
        shares[-1 - code[code < 0]] = rows[code < 0, 1]
        if not votes.any() or model.maximise(truthful.reshape(-1, k), votes.reshape(-1, k), shares) < TOLERANCE:
            model.converged = True
            break
    if not model.converged:
        warnings.warn(f"the fit still changed by more than {TOLERANCE} after {rounds} rounds", stacklevel=2)
    return model


def consensus(
    votes: DataFrame, *, item: Sequence[str], annotator: str, label: str, labels: Sequence[str], at: str, consensus_col: str = "consensus"
) -> tuple[DataFrame, DataFrame]:
    """(per item: ``item``, ``consensus``, ``confidence``, ``agreement``, ``n_votes``; per annotator: ``annotator``,
    ``reliability``, ``n_votes``, ``agreement_with_consensus``, ``converged``, and a guess share per label).

    ``converged`` is false for all annotators, and a warning is given, if the fit still moved after ``ROUNDS`` rounds.

    Of one annotator on one item the usable label with the latest ``at`` counts (null is earliest; ties go to the
    label that is later in ``labels``); labels that spell none of ``labels`` are no votes, and an item without a
    vote gives no row. ``agreement`` is the share of agreeing pairs of votes, null for a single vote. A null
    annotator is one annotator of its own, null item keys are keys. Ties of the posterior go to the earlier
    label. Repeated rows count once, an empty table gives empty results. Votes are reduced to one per annotator
    and item before anything is grouped by item, so no group is larger than the number of annotators.
    """
    k = len(labels)
    usable = votes.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(item)],
        F.coalesce(F.col(f"`{annotator}`").cast("string"), F.lit("")).alias("who"),
        F.array_position(F.array(*[F.lit(x) for x in labels]), usable_label(F.col(f"`{label}`"), labels)).cast("int").alias("said"),
        F.col(f"`{at}`").alias("at"),
    ).where("said > 0")
    ks = [f"k{i}" for i in range(len(item))]
    latest = usable.groupBy(*ks, "who").agg(F.max(F.struct("at", "said"))["said"].alias("said"))
    latest = saved(latest, "votes")
    most = MOST_PARAMETERS // k
    names = sorted(r.who for r in latest.select("who").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} annotators with {k} labels are more parameters than the driver holds")
    index = latest.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "who string, code int")
    coded = latest.join(index, "who")
    cells = coded.groupBy(*ks).agg(F.array_sort(F.collect_list((F.col("code") * k + F.col("said") - 1).cast("int"))).alias("codes"))
    cells = saved(cells, "cells")
    model = fit(saved(cells.groupBy("codes").agg(F.count("*").alias("n")), "patterns"), names, labels)
    fields = [*cells.drop("codes").schema.fields, T.StructField("said", T.IntegerType()), T.StructField("confidence", T.DoubleType())]
    fields += [T.StructField("agreement", T.DoubleType()), T.StructField("n_votes", T.IntegerType()), T.StructField("codes", T.ArrayType(T.IntegerType()))]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(ks))
            codes, sizes = _flat(column)
            post, _, _ = model.expect(codes, sizes)
            best = (post > post.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)
            per = np.zeros((len(sizes), k))
            np.add.at(per, (np.repeat(np.arange(len(sizes)), sizes), codes % k), 1)
            pairs = sizes * (sizes - 1)
            agreement = pa.array((per * (per - 1)).sum(axis=1) / np.maximum(pairs, 1), mask=pairs == 0)
            cols = [pa.array(best + 1, pa.int32()), pa.array(post.max(axis=1)), agreement, pa.array(sizes, pa.int32()), column]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ks)], *cols], names=[f.name for f in fields])

    decided = cells.select(*ks, "codes").mapInArrow(decide, T.StructType(fields))
    text = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("said"))
    items = decided.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(item)], text.alias(consensus_col), "confidence", "agreement", "n_votes")
    params = index.sparkSession.createDataFrame(
        [(x, i, float(c), model.converged, *map(float, g)) for i, (x, c, g) in enumerate(zip(names, model.competence, model.guess))],
        T.StructType(
            [T.StructField("annotator", T.StringType()), T.StructField("code", T.IntegerType()), T.StructField("reliability", T.DoubleType()), T.StructField("converged", T.BooleanType())]
            + [T.StructField(f"guess_{x}", T.DoubleType()) for x in labels]
        ),
    )
    with_consensus = (
        decided.select("said", F.explode("codes").alias("c"))
        .groupBy(F.floor(F.col("c") / k).cast("int").alias("code"))
        .agg(F.count("*").alias("n_votes"), F.avg((F.col("c") % k + 1 == F.col("said")).cast("double")).alias("agreement_with_consensus"))
    )
    return items, params.join(with_consensus, "code").drop("code")
