"""An append-only ledger of decisions and the tables it is applied to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.order import numbered


def latest_decisions(ledger: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """The last decision of each key, by time and then by sequence. One struct per key is aggregated, nothing sorted."""
    rest = [c for c in ledger.columns if c not in (key, at, seq)]
    return ledger.groupBy(key).agg(F.max(F.struct(at, seq, *rest)).alias("x"), F.count("*").alias("n_decisions")).select(
        key, F.col(f"x.{at}").alias(at), F.col(f"x.{seq}").alias(seq), *[F.col(f"x.{c}").alias(c) for c in rest], "n_decisions"
    )


def progress(items: DataFrame, latest: DataFrame, key: str, decision: str, by: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Items per group by their latest decision, undecided ones included."""
    joined = items.join(latest.select(key, F.col(decision).alias("__d")), key, "left")
    return joined.groupBy(*by).agg(
        F.count("*").alias("total"), F.count("__d").alias("reviewed"), F.count_if(F.col("__d").isNull()).alias("pending"), *[F.count_if(F.col("__d") == k).alias(k) for k in kinds]
    )


def undecided(items: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Items no decision names yet."""
    return items.join(ledger.select(key).distinct(), key, "left_anti")


def referential_errors(rows: DataFrame, targets: DataFrame, ref: str, key: str, rule: str) -> DataFrame:
    """References that lead nowhere, with the number of rows that hold them."""
    held = rows.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("ref")).agg(F.count("*").alias("n_rows"))
    return held.join(targets.select(F.col(key).alias("ref")).distinct(), "ref", "left_anti").select(F.lit(rule).alias("rule"), "ref", "n_rows")


def upsert_cells(long: DataFrame, changes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Cells of a long table with changed values put in place and new cells added."""
    c = changes.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    return long.join(c, list(keys), "full_outer").select(*keys, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value)).alias(value), F.coalesce("__hit", F.lit(False)).alias("changed"))


def to_wide(long: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``row``, one column per listed name; the list is given, so no job looks for it."""
    return long.groupBy(row).pivot(column, list(columns)).agg(F.max(value))


def to_long(wide: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return wide.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(list(ids), list(columns), "column_name", "value")


def grouped_queue(items: DataFrame, group: str, pending: Column, order: str) -> DataFrame:
    """Items with the pending count of their group; groups are ranked by it. Counts are joined, no group is gathered."""
    totals = items.groupBy(group).agg(F.count_if(pending).alias("pending_in_group"), F.count("*").alias("in_group"))
    ranked = numbered(totals, F.desc("pending_in_group"), F.asc(group), number="group_rank", start=1).withColumn("group_rank", F.col("group_rank").cast("int"))
    return items.join(ranked, group)


def ordered_distinct_union(parts: Sequence[tuple[DataFrame, int]], key: str, ordinal: str) -> DataFrame:
    """Rows of several sources united; of one key the first source wins, then the lowest ordinal, order kept."""
    tagged = [d.withColumn("__p", F.lit(p)) for d, p in parts]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "__p", ordinal)]
    best = out.groupBy(key).agg(F.min(F.struct("__p", ordinal, *rest)).alias("x"))
    return best.select(key, F.col("x.__p").alias("source_priority"), F.col(f"x.{ordinal}").alias(ordinal), *[F.col(f"x.{c}").alias(c) for c in rest])


# Flags and reason codes by which a proposal gets a warning, and the decisions there are.
WARNINGS = {"provider_error": "provider_unreachable", "needs_more_evidence": "weak_evidence", "low_confidence": "low_confidence_proposal"}
WARNING_REASONS = ("ambiguous_evidence", "conflicting_evidence", "insufficient_evidence", "invalid_model_output", "provider_error", "parser_error", "evidence_missing_for_value")
DECISIONS = ("accepted", "accepted_with_edit", "confirmed_no_data", "rejected")
WEAK = ("direct_weak", "inferred_weak")


def _has(array: str, *codes: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(array), F.array(*map(F.lit, codes))), F.lit(False))


def warning_categories(flags: str, reasons: str, evidence: str) -> Column:
    """Warnings of a proposal: by its flags in their order, then weak evidence by its reasons or status."""
    by_flag = F.array_compact(F.transform(F.coalesce(F.col(flags), F.array().cast("array<string>")), lambda f: F.create_map(*[F.lit(x) for kv in WARNINGS.items() for x in kv])[f]))
    weak = _has(reasons, *WARNING_REASONS) | F.coalesce(F.col(evidence).isin(*WEAK), F.lit(False))
    return F.when(weak & ~F.array_contains(by_flag, "weak_evidence"), F.array_append(by_flag, "weak_evidence")).otherwise(by_flag)


def is_fallback(flags: str, reasons: str) -> Column:
    return _has(reasons, "anchor_fallback") | _has(flags, "fallback_evidence_used", "fallback_evidence")


def is_reviewable(bucket: str) -> Column:
    return ~F.coalesce(F.col(bucket) == "diagnostic", F.lit(False))


def filtered(proposals: DataFrame, *, decision: str | None = None, evidence: str | None = None, figure: bool | None = None, reviewable_only: bool = False, figure_flag: str = "figure_derived", flags: str = "warning_flags", reasons: str = "reasons", **equal: str) -> DataFrame:
    """Proposals that meet every condition given; those not given are skipped. ``proposals`` has its latest ``decision`` (null: none).

    ``decision`` may be ``undecided``; ``evidence`` is ``figure_derived``, ``fallback`` or ``weak``; ``equal`` compares columns.
    """
    drawn = _has(flags, figure_flag)
    kept = proposals
    for column, value in equal.items():
        kept = kept.where(F.col(column) == value)
    if reviewable_only:
        kept = kept.where(is_reviewable("review_bucket"))
    if evidence:
        kept = kept.where({"figure_derived": drawn, "fallback": is_fallback(flags, reasons), "weak": F.coalesce(F.col("evidence_status").isin(*WEAK), F.lit(False))}[evidence])
    if figure is not None:
        kept = kept.where(drawn if figure else ~drawn)
    if decision:
        kept = kept.where(F.col("decision").isNull() if decision == "undecided" else F.col("decision") == decision)
    return kept


def counters(proposals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Progress of each group by latest decision, over all proposals and over those to be reviewed (``open_``)."""
    one = lambda p, cond: [F.count_if(F.expr(cond)).alias(f"{p}total"), F.count_if(F.expr(f"{cond} and coalesce(decision in {DECISIONS}, false)")).alias(f"{p}reviewed"), F.count_if(F.expr(f"{cond} and not coalesce(decision in {DECISIONS}, false)")).alias(f"{p}pending"), *[F.count_if(F.expr(f"{cond} and decision = '{d}'")).alias(f"{p}{d}") for d in DECISIONS]]
    return proposals.groupBy(*by).agg(*one("", "true"), *one("open_", "coalesce(review_bucket <> 'diagnostic', true)"))


def display(proposed: str, edited: str, original: str, status: str) -> tuple[Column, Column]:
    """(value, status) a cell shows under its latest ``decision``."""
    d = F.col("decision")
    value = F.when(d.isNull() | (d == "accepted"), F.col(proposed)).when(d == "accepted_with_edit", F.col(edited)).otherwise(F.col(original))
    return value, F.when(d.isNull(), "pending").when(d.isin(*DECISIONS), d).otherwise(F.col(status))


def bulk_decisions(selected: DataFrame, proposals: DataFrame, decided: DataFrame, key: str, decision: str, *, replace: bool = False) -> DataFrame:
    """What one decision on a selection does to each of its keys: ``recorded`` or ``skipped`` (unknown, or decided before unless ``replace``).

    A decision that needs a value per cell is refused. Repeated keys count once.
    """
    if decision == "accepted_with_edit":
        raise ValueError("one decision cannot give every cell its own value")
    known = proposals.select(key).distinct().withColumn("__known", F.lit(True))
    before = decided.select(key).distinct().withColumn("__before", F.lit(True))
    ids = selected.select(key).distinct().join(known, key, "left").join(before, key, "left")
    blocked = F.col("__known").isNull() | (F.col("__before").isNotNull() & F.lit(not replace))
    return ids.select(key, F.when(blocked, "skipped").otherwise("recorded").alias("effect"), F.when(~blocked, F.lit(decision)).alias("decision"))


def review_grid(rows: DataFrame, columns: DataFrame, proposals: DataFrame, evidence: DataFrame, *, row: str, column: str, at: Sequence[str], proposal: str) -> DataFrame:
    """Every row and target column with its latest proposal, decision and primary evidence; null where there is none.

    ``columns`` are those of a schema, so they are exploded onto the rows from a list. Primary is the evidence marked
    so, else the first by rank; one struct per cell and per proposal is aggregated.
    """
    names = sorted(r[0] for r in columns.select(column).distinct().collect())
    grid = rows.select(row, F.explode(F.lit(names)).alias(column))
    rest = [c for c in proposals.columns if c not in (row, column)]
    last = proposals.groupBy(row, column).agg(F.max(F.struct(*at, *[c for c in rest if c not in at])).alias("p"))
    first = evidence.groupBy(proposal).agg(F.min(F.struct(F.when(F.col("is_primary"), 0).otherwise(1).alias("o"), F.coalesce("evidence_rank", F.lit(1 << 30)).alias("r"), "evidence_id"))["evidence_id"].alias("evidence_id"))
    return grid.join(last, [row, column], "left").select(row, column, *[F.col(f"p.{c}").alias(c) for c in rest]).join(first, proposal, "left")


def export_gate(proposals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Whether the decisions of a group can be exported: ``blocked`` while a proposal to be reviewed is undecided; counts of what would be written."""
    n = lambda cond: F.count_if(F.expr(cond))
    out = proposals.groupBy(*by).agg(n("coalesce(review_bucket <> 'diagnostic', true) and decision is null").alias("undecided"), n("decision in ('accepted', 'accepted_with_edit')").alias("to_write"), n("decision = 'rejected'").alias("left_out"), n("decision = 'accepted_with_edit' and trim(coalesce(edited_value, '')) = ''").alias("edits_without_value"))
    return out.withColumn("blocked", F.col("undecided") > 0)


def record_of(proposals: DataFrame, ledger: DataFrame, evidence: DataFrame, key: str, value: str, *, at: Sequence[str], rank: str) -> DataFrame:
    """One proposal with its whole history of decisions, oldest first, and its evidence by rank. Filters come before the joins."""
    one = lambda df: df.where(F.col(key) == value)
    listed = lambda df, order, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in (key, *order)]))).alias(name))
    found = one(proposals).limit(1)
    return found.join(listed(one(ledger).distinct(), list(at), "history"), key, "left").join(listed(one(evidence).distinct(), [rank], "evidence"), key, "left")
