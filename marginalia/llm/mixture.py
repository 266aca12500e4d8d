"""Sources mixed to target weights by a min-cost flow over membership patterns.

A text may lie in several sources. The documents of a text, one per source, are one item; items are aggregated by
the set of sources that hold them; the flow routes the token capacity of each pattern to the quotas of its sources,
where every further use of the same tokens costs more than the one before. The graph has one node per pattern and
source, whatever the number of texts, and is held as matrices. The documents that carry the flow are then selected by
a seeded order along a distributed running sum of tokens.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.encode import count_tokens
from marginalia.session import saved

#: Items that one range of the seeded order holds on average; running sums are taken within ranges, then over them.
RANGE_ITEMS = 4096
#: Bounds of what the driver holds: sources with a target, and cells of the matrix of patterns and sources.
MOST_SOURCES, MOST_CELLS = 1000, 2_500_000


def _cheapest_flow(tokens: np.ndarray, room: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Tokens of each pattern (row) used for each source (column): the quotas in full, within ``room``, at least cost.

    The r-th use of the tokens of a pattern costs r squared, the same for all patterns, so cheapest paths use up
    the first use of every pattern before the second: the flow is grown to its maximum at each number of uses in
    turn. What is grown never gives back a use of a pattern, only shifts it between sources. Paths lead over
    sources: one takes over tokens of a pattern from another, which takes fresh tokens instead; all patterns
    between two sources are one arc.
    """
    patterns, sources = room.shape
    x = np.zeros_like(room)
    uses = 0
    while (short := quota - x.sum(axis=0)).sum() > 0:
        uses += 1
        spare = tokens * uses - x.sum(axis=1)
        for s in np.argsort(np.count_nonzero(room, axis=0)):  # direct use first; sources of few patterns choose first
            x[:, s] += (give := _fill(np.minimum(spare, room[:, s] - x[:, s]), short[s]))
            spare -= give
            short[s] -= give.sum()
        left = room - x
        fresh = np.minimum(spare[:, None], left).sum(axis=0)
        arcs = np.stack([np.minimum(x[:, [s]], left).sum(axis=0) for s in range(sources)])  # [s, t]: s can cede so much to t
        np.fill_diagonal(arcs, 0)
        while True:
            path = _shortest(fresh > 0, arcs > 0, short > 0)
            if path is None:
                break
            push = min(fresh[path[0]], short[path[-1]], *(arcs[s, t] for s, t in zip(path, path[1:])))
            for s, t in reversed(list(zip(path, path[1:]))):
                give = _fill(np.minimum(x[:, s], room[:, t] - x[:, t]), push)
                x[:, s] -= give
                x[:, t] += give
            give = _fill(np.minimum(spare, room[:, path[0]] - x[:, path[0]]), push)
            x[:, path[0]] += give
            spare -= give
            short[path[-1]] -= push
            left = room - x
            fresh = np.minimum(spare[:, None], left).sum(axis=0)
            for s in path:
                arcs[s] = np.minimum(x[:, [s]], left).sum(axis=0)
                arcs[:, s] = np.minimum(x, left[:, [s]]).sum(axis=0)
                arcs[s, s] = 0
    return x


def _fill(most: np.ndarray, amount: int) -> np.ndarray:
    """Up to ``amount``, from the first entries of ``most`` on."""
    before = np.cumsum(most) - most
    return np.clip(amount - before, 0, most)


def _shortest(start: np.ndarray, arcs: np.ndarray, end: np.ndarray) -> list[int] | None:
    """A shortest path from any node of ``start`` to any of ``end``."""
    seen, front = start.copy(), np.flatnonzero(start)
    via = np.full(len(start), -1)
    while len(front):
        if end[front].any():
            path = [int(front[end[front]][0])]
            while via[path[-1]] >= 0:
                path.append(int(via[path[-1]]))
            return path[::-1]
        reach = arcs[front] & ~seen
        new = np.flatnonzero(reach.any(axis=0))
        via[new] = front[reach[:, new].argmax(axis=0)]
        seen[new] = True
        front = new
    return None


def route(
    patterns: Sequence[tuple[tuple[str, ...], int]], shares: Mapping[str, float], repeats: Mapping[str, int], total: int | None = None
) -> tuple[dict[tuple[int, str], int], int]:
    """(tokens of pattern i used for source s, total): the total is the largest up to ``total`` that keeps the shares.

    A pattern serves each of its sources up to that source's ``repeats``, so the total is bound by each source for
    itself. Sources without tokens, or with no share, get nothing; the shares of the others keep their proportions.
    """
    held = {s for sources, n in patterns if n > 0 for s in sources}
    names = sorted(s for s in shares if s in held and (shares[s] or 0) > 0 and (repeats.get(s) or 0) > 0)
    if not names:
        return {}, 0
    whole = sum(shares[s] for s in names)
    column = {s: j for j, s in enumerate(names)}
    if len(patterns) * len(names) > MOST_CELLS:
        raise ValueError(f"{len(patterns)} patterns of {len(names)} sources are more than {MOST_CELLS} cells")
    tokens = np.array([max(0, n) for _, n in patterns], np.int64)
    room = np.zeros((len(patterns), len(names)), np.int64)
    for i, (sources, _) in enumerate(patterns):
        for s in sources:
            if s in column:
                room[i, column[s]] = tokens[i] * repeats[s]
    most = room.sum(axis=0)
    quotas = lambda size: np.array([int(size * shares[s] / whole) for s in names], np.int64)
    low, high = 0, int(most.sum()) if total is None else min(int(most.sum()), total)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if (quotas(mid) <= most).all() else (low, mid - 1)
    x = _cheapest_flow(tokens, room, quotas(low))
    return {(int(i), names[j]): int(x[i, j]) for i, j in zip(*np.nonzero(x))}, low


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: str = "target_share",
    repeats: str = "max_repeats",
    total: int | None = None,
    seed: int = 0,
    vocabulary: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mixture: ``source``, ``key``, ``n_tokens``, ``n_repeats``; report: one row per target source with its share reached).

    Each document is used at most ``repeats`` times for its source. Documents of one text in several sources (one
    of each source, of least ``key``) are one item, so the flow spares texts that other sources use; further copies
    within a source are items of their own. The total is the largest (up to ``total`` tokens) that gives every
    source that has tokens its share, to within one document per pattern and source. Rows repeated in key, source
    and text count once. Texts without tokens, null sources and sources without a target take no part; a target
    without texts reaches 0 and the others share its part in proportion. Repeated targets: the first by share.
    Extra columns are ignored. The driver holds one cell per pattern and source, ``MOST_CELLS`` at most (more raise
    ``ValueError``).
    """
    rows = targets.groupBy(F.col(f"`{source}`").alias("s")).agg(F.max(F.struct(F.col(f"`{share}`").alias("w"), F.col(f"`{repeats}`").alias("r"))).alias("x"))
    plan = [(r.s, float(r.x.w or 0), int(r.x.r or 0)) for r in rows.where("s is not null").select("s", "x").limit(MOST_SOURCES + 1).collect()]
    if len(plan) > MOST_SOURCES:
        raise ValueError("too many target sources")
    shares, most = {s: w for s, w, _ in plan}, {s: r for s, _, r in plan}
    listed = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("src"), F.md5(F.col(f"`{text}`").cast("binary")).alias("tid"), F.col(f"`{text}`").alias("text")
    ).where(F.col("src").isin([s for s, _, _ in plan]) & (F.length("text") > 0) if plan else F.lit(False))
    sized = count_tokens(listed, "text", vocabulary)
    once = sized.where("n_tokens > 0").groupBy("tid", "src", "key").agg(F.max("n_tokens").alias("n_tokens"))
    once = saved(once, "mixture-documents")  # used twice below: texts are encoded once
    first = once.groupBy("tid", "src").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key"))["key"].alias("first"), F.max("n_tokens").alias("n_tokens"))
    shared = first.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("src", F.col("first").alias("key")))).alias("held"), F.max("n_tokens").alias("n_tokens"))
    more = once.join(first.drop("n_tokens"), ["tid", "src"]).where(~F.col("key").eqNullSafe(F.col("first")))
    copies = more.select(F.md5(F.concat_ws("|", "tid", "src", F.col("key").cast("string"))).alias("tid"), F.array(F.struct("src", "key")).alias("held"), "n_tokens")
    items = shared.unionByName(copies).withColumn("pattern", F.col("held.src")).withColumn("order", F.xxhash64(F.lit(seed), "tid"))
    items = saved(items, "mixture-items")
    most_patterns = MOST_CELLS // max(1, len(plan))
    sums = items.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).limit(most_patterns + 1).collect()
    if len(sums) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns of {len(plan)} sources")
    patterns = sorted((tuple(r.pattern), int(r.tokens)) for r in sums)
    bits = max(4, (sum(r.n for r in sums) // RANGE_ITEMS).bit_length())
    items = items.withColumn("part", F.shiftrightunsigned("order", 64 - bits))
    flow, _ = route(patterns, shares, most, total)
    spark = docs.sparkSession
    routes, used = [], {}
    for (i, s), n in sorted(flow.items()):
        tokens = patterns[i][1]
        full, rest = divmod(n, tokens)
        begin = used.get(i, 0) % tokens  # the next source goes on where the last one stopped
        used[i] = begin + rest
        routes.append((list(patterns[i][0]), s, full, begin, rest, tokens))
    routed = spark.createDataFrame(routes, "pattern array<string>, src string, full long, begin long, rest long, tokens long")
    ranges = items.groupBy("pattern", "part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("pattern", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("pattern", "part").orderBy("order", "tid").rowsBetween(Window.unboundedPreceding, -1)
    placed = items.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(ranges, ["pattern", "part"])
    offset = F.pmod(F.col("base") + F.col("inside") - F.col("begin"), F.col("tokens"))
    chosen = placed.join(routed, "pattern").select(
        F.col("src"), F.expr("element_at(filter(held, h -> h.src = src), 1).key").alias("key"), "n_tokens", (F.col("full") + (offset < F.col("rest")).cast("long")).cast("int").alias("n_repeats")
    )
    mixture = chosen.where("n_repeats > 0").select(F.col("src").alias(source), F.col("key").alias(key), "n_tokens", "n_repeats")
    got = mixture.groupBy(F.col(f"`{source}`").alias("s")).agg(
        F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("n_repeats").alias("most_repeats")
    )
    goals = spark.createDataFrame([(s, w, r) for s, w, r in plan], "s string, target_share double, max_repeats int")
    joined = goals.join(got, "s", "left")
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per target source
    report = joined.select(
        F.col("s").alias(source), "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("reached_share"), "max_repeats",
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )
    return mixture, report
