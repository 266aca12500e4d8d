"""Oversized texts cut into overlapping pieces at natural boundaries, by dynamic programming.

The states are the number of pieces so far and the end of the last. The cost of a division is the sum over its
pieces of the penalty of the cut (the rank of the boundary) and of a term for the imbalance of size. Among the
divisions within the maximum length, with the specified overlap and the fewest possible pieces or one more, the
one of least cost is taken, and among equals the one of fewer pieces. All boundaries of all ranks are weighed
together. A piece may end only within the limit of the end before it, and the imbalance is convex, so the best
predecessors of the ends of a layer lie in order: a layer of m ends is solved in m log m steps and linear memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Penalties of a cut: after a paragraph, a line, a sentence, a clause, a word, and inside a word.
PENALTY = (0.0, 1.0, 2.0, 8.0, 16.0, 64.0)
#: Weight of the squared difference between a piece's share of the limit and the even share.
BALANCE = 6.0
#: Layers with at most so many pairs of ends are solved by one matrix.
DENSE = 1 << 16

PARAGRAPH = re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*")
LINE = re.compile("\r\n?|[\n\x0b\x0c\x85  ]")
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？｡][”’」』）]*\s*")
CLAUSE = re.compile(r"[,;:]\s+|[，；：、]\s*|\t|\s[–—-]\s+")
UNCUTTABLE = re.compile("(?<=\r)\n|(?<=‍).|[̀-ͯ᪰-᫿⃐-⃿︀-️‍\U0001f3fb-\U0001f3ff]", re.S)


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(code points that are white space, that are of words) of the patterns above."""
    every = np.arange(0x110000, dtype=np.uint32)
    every[0xD800:0xE000] = 0x2E
    every = every.tobytes().decode("utf-32-le")
    tables = []
    for kind in (r"\s", r"\w"):
        table = np.zeros(0x110000, bool)
        for m in re.finditer(f"{kind}+", every):
            table[m.start() : m.end()] = True
        tables.append(table)
    return tables[0], tables[1]


def boundaries(text: str, rank: int) -> np.ndarray:
    """Places behind which a cut of ``rank`` may be made; of words: behind white space, a slash, a hyphen within a word."""
    if rank < 4:
        pattern = (PARAGRAPH, LINE, SENTENCE, CLAUSE)[rank]
        return np.array([m.end() for m in pattern.finditer(text)], np.int64)
    space, word = _classes()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = space[points]
    cut = blank & ~np.append(blank[1:], False) | (points == 0x2F)
    inner = np.flatnonzero(points[1:-1] == 0x2D) + 1
    cut[inner[word[points[inner - 1]] & word[points[inner + 1]]]] = True
    return np.flatnonzero(cut) + 1


def candidates(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of cuts, their penalties), in order: the boundaries of every rank, each at its best; and every place
    between clusters in stretches without a boundary that are longer than half of what a piece adds."""
    n = len(text)
    penalty = np.full(n + 1, np.inf)
    for rank in reversed(range(len(PENALTY) - 1)):
        penalty[boundaries(text, rank)] = PENALTY[rank]
    penalty[[0, n]] = 0.0
    natural = np.flatnonzero(np.isfinite(penalty))
    longest = max(1, (limit - overlap) // 2)
    wide = np.flatnonzero(np.diff(natural) > longest)
    if len(wide):
        for a, b in zip(natural[wide].tolist(), natural[wide + 1].tolist()):
            penalty[a + 1 : b] = PENALTY[-1]
            for m in UNCUTTABLE.finditer(text, a, b):
                penalty[m.start()] = np.inf
    penalty[: overlap + 1] = penalty[n] = np.inf
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def _fewest(n: int, limit: int, overlap: int, at: np.ndarray) -> int | None:
    """The least number of pieces with cuts among ``at``: each reaches as far as it can. None: no division."""
    end, pieces = limit, 1
    while end < n:
        i = int(np.searchsorted(at, end, side="right")) - 1
        reached = int(at[i]) if i >= 0 else 0
        if pieces > 1 and reached <= last or reached <= overlap:
            return None
        last, end, pieces = reached, reached + limit - overlap, pieces + 1
    return pieces


def _dense(value: np.ndarray, a: np.ndarray, b: np.ndarray, shift: float, scale: float, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cost = value[None, :] + scale * (b[:, None] - a[None, :] + shift) ** 2
    j = np.arange(len(a))
    cost[(j < lo[:, None]) | (j >= hi[:, None])] = np.inf
    back = cost.argmin(axis=1)
    return back, cost[np.arange(len(b)), back]


def _ordered(value: np.ndarray, a: np.ndarray, b: np.ndarray, shift: float, scale: float, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same where the first best predecessor never moves back: rows are solved from coarse to fine, each between
    the predecessors of its solved neighbours, so a level looks at no more pairs than there are rows and columns."""
    m = len(b)
    back, best = np.zeros(m, np.int64), np.zeros(m)
    step = 1 << max(0, m.bit_length() - 1)
    while step:
        rows = np.arange(step - 1, m, 2 * step)
        left = np.where(rows >= step, back[np.maximum(rows - step, 0)], 0)
        right = np.where(rows + step < m, back[np.minimum(rows + step, m - 1)] + 1, len(a))
        left, right = np.maximum(left, lo[rows]), np.minimum(right, hi[rows])
        size = np.maximum(right - left, 1)
        first = np.cumsum(size) - size
        j = np.arange(int(size.sum())) - np.repeat(first - left, size)
        cost = value[j] + scale * (np.repeat(b[rows], size) - a[j] + shift) ** 2
        least = np.minimum.reduceat(cost, first)
        hit = np.flatnonzero(cost == np.repeat(least, size))
        back[rows], best[rows] = j[hit[np.searchsorted(hit, first)]], least
        step >>= 1
    return back, best


def _divide(n: int, limit: int, overlap: int, at: np.ndarray, cost: np.ndarray, pieces: int) -> tuple[float, list[int]]:
    """Least cost, and the ends, of a division into ``pieces`` with cuts among ``at``. One layer of states per piece."""
    new = limit - overlap
    even = (n - overlap) / pieces + overlap
    layers, best = [], np.zeros(1)
    ends = np.array([overlap])  # so that the first piece is as long as its end
    for k in range(1, pieces + 1):
        if k == pieces:
            here, price = np.array([n]), np.zeros(1)
        else:
            a, b = np.searchsorted(at, [n - (pieces - k) * new, overlap + k * new + 1])
            here, price = at[a:b], cost[a:b]
        lo, hi = np.searchsorted(ends, here - new), np.searchsorted(ends, here)
        some = lo < hi
        if not some.any():
            return np.inf, []
        here, price, lo, hi = here[some], price[some], lo[some], hi[some]
        solve = _dense if len(here) * len(ends) <= DENSE else _ordered
        back, value = solve(best, ends, here, overlap - even, BALANCE / limit**2, lo, hi)
        layers.append((here, back))
        best, ends = value + price, here
    out, i = [], 0
    for here, back in reversed(layers):
        out.append(int(here[i]))
        i = int(back[i])
    return float(best[0]), out[::-1]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of the pieces of ``text``: each within ``limit`` code points, each but the first starting
    ``overlap`` before the end of the one before it.

    A text within the limit is one piece, an empty one none; a negative overlap is 0. Clusters are cut only where
    they are too long to be kept. An overlap that is not below the limit, or a limit under 1, allows no division of
    a longer text and raises ``ValueError``.
    """
    n, overlap = len(text), max(0, overlap)
    if n <= max(limit, 0):
        return [(0, n)] if n else []
    if limit < 1 or overlap >= limit:
        raise ValueError(f"no pieces of {limit} can share {overlap}")
    at, cost = candidates(text, limit, overlap)
    if (fewest := _fewest(n, limit, overlap, at)) is None:  # clusters longer than what a piece may add
        at = np.arange(overlap + 1, n)
        cost = np.full(len(at), PENALTY[-1])
        fewest = _fewest(n, limit, overlap, at)
    _, found = min((_divide(n, limit, overlap, at, cost, k) for k in (fewest, fewest + 1)), key=lambda x: x[0])
    starts = [0, *(e - overlap for e in found[:-1])]
    return list(zip(starts, found))


def split_texts(
    df: DataFrame, text: str, limit: str, overlap: str, *, keep: tuple[str, ...] = (), only_oversized: bool = False
) -> DataFrame:
    """One row per piece: the columns ``keep``, ``piece`` (from 0), ``n_pieces``, ``start``, ``end``, ``piece_text``.

    ``limit`` and ``overlap`` name columns in code points (see :func:`split_text`); a null overlap is 0. Null or
    empty texts give no row; a null limit sets none, so the text is one piece. A text over a limit that its overlap
    makes impossible gives one row with ``n_pieces`` 0 and null ``piece``, ``start``, ``end`` and ``piece_text``.
    With ``only_oversized`` texts within their limit give no row. Repeated rows give repeated pieces. A map without
    shuffle; a text is handled whole, whatever its length, in memory in proportion to it.
    """
    fields = [*(df.schema[c] for c in keep)]
    fields += [T.StructField(c, T.IntegerType()) for c in ("piece", "n_pieces")]
    fields += [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("piece_text", T.StringType())]
    schema = T.StructType(fields)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = ([], [], [], [], [], [])
            size = 0
            for i, (x, most, shared) in enumerate(zip(*(batch.column(k + j).to_pylist() for j in range(3)))):
                if not x:
                    continue
                try:
                    ranges = [(0, len(x))] if most is None else split_text(x, most, shared or 0)
                except ValueError:
                    ranges = []
                    for c, v in zip(cols, (i, None, 0, None, None, None)):
                        c.append(v)
                for p, (a, b) in enumerate(ranges):
                    for c, v in zip(cols, (i, p, len(ranges), a, b, x[a:b])):
                        c.append(v)
                size += len(x)
                if size > 8_000_000:  # pieces go on before they grow large
                    yield _batch(batch, cols, k, schema)
                    cols, size = ([], [], [], [], [], []), 0
            yield _batch(batch, cols, k, schema)

    picked = df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"`{text}`").cast("string").alias("__text"), F.col(f"`{limit}`").cast("long").alias("__limit"), F.col(f"`{overlap}`").cast("long").alias("__overlap"),
    )
    if only_oversized:
        picked = picked.where(F.char_length("__text") > F.col("__limit"))
    return picked.mapInArrow(run, schema)


def _batch(batch: pa.RecordBatch, cols, k: int, schema: T.StructType) -> pa.RecordBatch:
    index = pa.array(cols[0], pa.int64())
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [*(batch.column(j).take(index) for j in range(k)), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], names=schema.names
    )
