"""Records put together from several sources: chained joins with warnings, fallbacks of context and metadata, resumed work, rolled-up counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def extraction_inputs(cells: DataFrame, matches: DataFrame, documents: DataFrame, schema: DataFrame, *, row: str, doc: str, column: str) -> DataFrame:
    """Cells with their paper, its text and the column they fill; ``warnings`` name the sides that are missing, in order.

    ``matches``: row, doc, outcome; only matched rows lead to a paper. ``documents``: doc, text. ``schema``: column, description.
    Nothing is dropped; repeated rows of a side count once.
    """
    m = matches.where("outcome = 'matched'").groupBy(row).agg(F.min(doc).alias(doc))
    t = documents.groupBy(doc).agg(F.max(F.col("text").isNotNull()).alias("__text"))
    s = schema.groupBy(column).agg(F.max("description").alias("description"))
    joined = cells.join(m, row, "left").join(t, doc, "left").join(s, column, "left")
    warnings = F.array_compact(F.array(
        F.when(F.col(doc).isNull(), "row_without_paper"), F.when(F.col(doc).isNotNull() & ~F.coalesce("__text", F.lit(False)), "paper_without_text"), F.when(F.trim(F.coalesce("description", F.lit(""))) == "", "column_without_description"),
    ))
    return joined.withColumn("warnings", warnings).drop("__text")


def with_context(items: DataFrame, rows: DataFrame, papers: DataFrame, *, row: str, doc: str, fields: Sequence[str]) -> DataFrame:
    """Items with the context of their row, else of their paper, field by field; ``context_source`` tells which one gave any."""
    a = rows.groupBy(row).agg(*[F.max(c).alias(f"__r_{c}") for c in fields])
    b = papers.groupBy(doc).agg(*[F.max(c).alias(f"__p_{c}") for c in fields])
    some = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    joined = items.join(a, row, "left").join(b, doc, "left")
    of_row, of_paper = (F.coalesce(*[some(f"__{x}_{c}") for c in fields]).isNotNull() for x in "rp")
    source = F.when(of_row, "row").when(of_paper, "paper").otherwise("none")
    return joined.select(*[items[c] if c not in (row, doc) else F.col(c) for c in items.columns], *[F.coalesce(some(f"__r_{c}"), some(f"__p_{c}")).alias(c) for c in fields], source.alias("context_source"))


def resolved_metadata(candidates: DataFrame, doc: str, field: str, value: str, source: str, precedence: Sequence[str]) -> DataFrame:
    """One value per document and field: of the first source that has exactly one; several values of a source make it
    ambiguous, and the next source is asked. ``state`` is found, ambiguous (some source had several, none had one) or missing."""
    order = F.array_position(F.array(*map(F.lit, precedence)), F.col(source))
    per = candidates.where((order > 0) & (F.trim(value) != "")).groupBy(doc, field, order.alias("__o")).agg(F.count_distinct(F.lower(F.trim(value))).alias("n"), F.min(F.trim(value)).alias("v"))
    best = per.groupBy(doc, field).agg(F.min(F.when(F.col("n") == 1, F.struct("__o", "v"))).alias("b"), F.max("n").alias("most"))
    fields = candidates.select(doc, field).distinct()
    out = fields.join(best, [doc, field], "left")
    at = F.coalesce(*[F.when(F.col("b.__o") == i, F.lit(name)) for i, name in enumerate(precedence, 1)])
    return out.select(doc, field, F.col("b.v").alias(value), at.alias(source), F.when(F.col("b").isNotNull(), "found").when(F.col("most") > 1, "ambiguous").otherwise("missing").alias("state"))


def chosen_figures(targets: DataFrame, figures: DataFrame, *, doc: str, ids: str, figure: str) -> DataFrame:
    """Figures a plan names, in the order it names them; unknown ids are left out, repeats count once."""
    asked = targets.select(doc, F.posexplode(F.array_distinct(ids)).alias("ordinal", figure))
    known = figures.dropDuplicates([doc, figure])
    return asked.join(known, [doc, figure])


def synthetic_proposals(cells: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Proposals of cells that were never tried, by the reason: status, evidence and bucket follow from it."""
    skipped = F.col(reason).isin("schema_not_applicable", "cell_not_targeted", "column_excluded")
    return cells.where(F.col(reason).isNotNull()).select(
        *keys, F.when(F.col(reason) == "schema_not_applicable", "not_applicable").when(skipped, "not_attempted").otherwise("unresolved").alias("proposal_status"), F.when(skipped, "not_applicable").otherwise("no_evidence").alias("evidence_status"),
        F.lit("diagnostic").alias("review_bucket"), F.array(reason).alias("reason_codes"), F.lit(None).cast("string").alias("proposed_value"),
    )


def remaining(candidates: DataFrame, results: DataFrame, key: str, done: Column, fits: Column | None = None) -> DataFrame:
    """Candidates a resumed study still has to run: not done before, and fit to run at all."""
    left = candidates.join(results.where(done).select(key).distinct(), key, "left_anti")
    return left.where(fits) if fits is not None else left


def next_batch(grid: DataFrame, taken: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """The first ``size`` combinations, in the order of their keys, that were not taken. Only a batch leaves the sort."""
    return grid.join(taken.select(*keys).distinct(), list(keys), "left_anti").orderBy(*keys).limit(size)


def stage_times(events: DataFrame, by: Sequence[str], stage: str, ms: str) -> DataFrame:
    """Time spent per stage, and its share of the group."""
    per = events.groupBy(*by, stage).agg(F.sum(ms).alias("ms"), F.count("*").alias("runs"))
    total = F.sum("ms").over(Window.partitionBy(*by))  # one row per stage
    return per.withColumn("share", F.when(total > 0, F.floor(F.col("ms") / total * 1000000 + 0.5) / 1000000))


def rolled_up(cells: DataFrame, by: Sequence[str], counters: str) -> DataFrame:
    """Counter maps of cells summed per group, key by key; keys that no cell has are not there."""
    return cells.select(*by, F.explode(counters).alias("counter", "__n")).groupBy(*by, "counter").agg(F.sum("__n").alias("n"), F.count_if(F.col("__n") > 0).alias("cells"))


def first_blocks(blocks: DataFrame, doc: str, page: str, order: str, text: str, *, pages: int = 2, most: int = 40) -> DataFrame:
    """The first blocks of the first pages of each document that are not blank."""
    w = Window.partitionBy(doc).orderBy(page, order)
    some = blocks.where((F.col(page) <= pages) & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
    return some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def bulleted(text: str) -> Column:
    """A reason as a list: its lines, or else its sentences, each behind a bullet, bullets and numbers of its own taken off; null if blank."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, r"\r\n|\r|\n")
    parts = F.when(F.size(lines) > 1, lines).otherwise(F.split(t, r"(?<=[.!?;])\s+"))
    bare = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: x != "")
    return F.when(F.size(bare) > 0, F.array_join(F.transform(bare, lambda x: F.concat(F.lit("- "), x)), "\n"))


def handoff_counts(proposals: DataFrame, evidence: DataFrame, by: Sequence[str]) -> DataFrame:
    """What a hand-over holds: proposals, those with a value, those of them without evidence, and evidence of no proposal."""
    e = evidence.groupBy("proposal_id").agg(F.count("*").alias("n_evidence"))
    valued = F.col("proposal_status") == "value_proposed"
    return proposals.join(e, "proposal_id", "left").groupBy(*by).agg(
        F.count("*").alias("proposals"), F.count_if(valued).alias("valued"), F.count_if(valued & F.col("n_evidence").isNull()).alias("valued_without_evidence"), F.coalesce(F.sum("n_evidence"), F.lit(0)).alias("evidence")
    ).withColumn("warned", F.col("valued_without_evidence") > 0)


def shown_board(candidates: DataFrame, control: Column, score: str, tie: Sequence[str]) -> DataFrame:
    """A board that shows controls but never ranks them: rank among the others, and the winner."""
    w = Window.partitionBy("is_control").orderBy(F.desc_nulls_last(score), *tie)  # one row per candidate
    ranked = candidates.withColumn("is_control", control).withColumn("__r", F.row_number().over(w))
    rank = F.when(~F.col("is_control") & F.col(score).isNotNull(), F.col("__r"))
    return ranked.withColumn("rank", rank).withColumn("is_winner", F.coalesce(rank == 1, F.lit(False))).drop("__r")
