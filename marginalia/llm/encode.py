"""Encoding of a corpus with a public byte-level BPE tokenizer, without a regular expression.

Pre-tokenisation works on whole batches. The texts become one array of code points with a separator after
each; a table turns code points into classes (letter, number, white space, other, separator). The splitting
rule of the tokenizer is an automaton whose state after a character is fixed by the classes of that character
and its neighbours: composing its transition functions is associative and ends, after two characters, in a
constant function, so the scan over the batch reduces to shifted comparisons of the class array. The slices
between boundaries are hashed together (64 bits), each distinct one of a batch is looked up once in a memo of
merged pieces, and pieces not seen before are merged by rank.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTER, NUMBER, SPACE, OTHER, SEP = 0, 1, 2, 3, 4
# The Unicode property White_Space, and the endings the tokenizer cuts off after an apostrophe, in its order.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The memo starts anew at this many pieces, or eight times as many ids: memory stays bounded.
MEMO_SIZE = 1_000_000
#: Texts are taken in groups of about this many characters, longer ones alone.
GROUP_CHARS = 2_000_000

_classes: np.ndarray | None = None
_mixed: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[list(WHITE_SPACE)] = SPACE
        _classes = table
    return _classes


def boundaries(points: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Start of every piece in an array of code points whose ``separators`` (positions) end the texts."""
    c = classes()[points]
    c[separators] = SEP
    n = len(c)
    change = np.empty(n, bool)
    change[:1] = True
    np.not_equal(c[1:], c[:-1], out=change[1:])
    change[separators] = True
    space = c == SPACE
    follows = np.zeros(n, bool)  # a piece of letters, numbers or others follows
    follows[:-1] = c[1:] < SEP
    follows[:-1] &= c[1:] != SPACE
    last = space & follows  # the last white space before such a piece starts a piece of its own ...
    start = change | last
    blank = last & (points == 0x20)  # ... and if it is a blank, the piece behind it belongs to it
    start[1:] &= ~blank[:-1]
    mark = np.flatnonzero((points == 0x27) & start)
    mark = mark[mark + 1 < n]
    mark = mark[c[mark + 1] == LETTER]
    if len(mark):
        a = points[mark + 1]
        b = points[np.minimum(mark + 2, n - 1)]
        cut = np.zeros(len(mark), np.int64)
        for e in reversed(ENDINGS):
            hit = a == ord(e[0])
            if len(e) == 2:
                hit &= b == ord(e[1])
            cut[hit] = len(e)
        mark, cut = mark[cut > 0], cut[cut > 0]
        start[mark + 1] = False
        after = mark + 1 + cut
        ok = after < n
        start[after[ok]] = True
    return np.flatnonzero(start)


def piece_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of every piece: the sum of a random value of each code point times a power of an odd number for its place."""
    global _mixed
    if _mixed is None:
        _mixed = np.random.default_rng(20240229).integers(0, 1 << 63, 0x110000, np.uint64) * np.uint64(2) + np.uint64(1)
    size = np.diff(np.append(starts, len(points)))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(len(points)) - np.repeat(starts, size)
        sums = np.add.reduceat(_mixed[points] * powers[place], starts)
        return (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)


class Encoder:
    """Byte-level BPE read from a file of ``base64(piece) rank`` lines."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[int, int] = {}
        self.odd: dict[str, int] = {}  # pieces whose hash another piece has
        self.flat, self.where, self.size, self.word = [], [], [], []

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of least rank is joined, the leftmost first, until none is known."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i] if part[i] is not None else n
            if j >= n or len(part[i]) + len(part[j]) != len(both) or part[i] + part[j] != both:
                continue  # one of the two was merged meanwhile
            part[i], part[j] = both, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(both + part[k])) is not None:
                    heapq.heappush(heap, (r, i, both + part[k]))
            h = left[i]
            if h >= 0 and (r := ranks.get(part[h] + both)) is not None:
                heapq.heappush(heap, (r, h, part[h] + both))
        return [ranks[p] for p in part if p is not None]

    def _slot(self, word: str) -> int:
        ids = self.merge(word.encode("utf-8", "surrogatepass"))
        slot = len(self.where)
        self.where.append(len(self.flat))
        self.size.append(len(ids))
        self.word.append(word)
        self.flat.extend(ids)
        return slot

    def _slots(self, joined: str, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The remembered encoding of each piece. Pieces meet by their hashes, but are compared letter for letter."""
        keys, at, inverse = np.unique(piece_hashes(points, starts), return_index=True, return_inverse=True)
        memo, word = self.memo, self.word
        known = np.empty(len(keys), np.int64)
        for i, (key, a, b) in enumerate(zip(keys.tolist(), starts[at].tolist(), stops[at].tolist())):
            piece = joined[a:b]
            slot = memo.get(key)
            if slot is None:
                slot = memo[key] = self._slot(piece)
            elif word[slot] != piece:
                slot = self._odd(piece)
            known[i] = slot
        slots = known[inverse]
        size = stops - starts
        first = starts[at][inverse]
        same = np.minimum(np.arange(len(points)) + np.repeat(first - starts, size), len(points) - 1)
        differs = np.add.reduceat((points[same] != points).astype(np.int32), starts) > 0
        for i in np.flatnonzero(differs | (size != (stops[at] - starts[at])[inverse])).tolist():
            slots[i] = self._odd(joined[starts[i] : stops[i]])
        return slots

    def _odd(self, piece: str) -> int:
        if piece not in self.odd:
            self.odd[piece] = self._slot(piece)
        return self.odd[piece]

    def encode_batch(self, texts: list[str], want_ids: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text, code points up to the end of the piece of each id).

        A text longer than a group is encoded in parts, cut where a blank follows a character that is none: a
        piece always starts there, whatever stands around it.
        """
        if len(texts) == 1 and len(texts[0]) > GROUP_CHARS:
            parts, shift = parts_of(texts[0]), 0
            if len(parts) > 1:
                ids, counts, ends = [], 0, []
                for part in parts:
                    i, c, e = self.encode_batch([part], want_ids)
                    ids.append(i)
                    ends.append(e + shift)
                    counts += c
                    shift += len(part)
                return np.concatenate(ids), counts, np.concatenate(ends)
        if len(self.word) > MEMO_SIZE or len(self.flat) > 8 * MEMO_SIZE:
            self._reset()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        separators = np.cumsum(lengths + 1) - 1
        starts = boundaries(points, separators)
        stops = np.append(starts[1:], len(points))
        slots = self._slots(joined, points, starts, stops)
        size = np.array(self.size, np.int64)[slots]
        is_sep = np.zeros(len(points), bool)
        is_sep[separators] = True
        real = ~is_sep[starts]
        size[~real] = 0
        text_of = np.searchsorted(separators, starts)
        counts = np.bincount(text_of, weights=size, minlength=len(texts)).astype(np.int64)
        if not want_ids:
            return np.zeros(0, np.int32), counts, np.zeros(0, np.int64)
        total = int(size.sum())
        first = np.cumsum(size) - size
        at = np.arange(total) - np.repeat(first, size) + np.repeat(np.array(self.where, np.int64)[slots], size)
        ids = np.array(self.flat, np.int32)[at]
        ends = np.repeat(stops - (separators - lengths)[text_of], size)
        return ids, counts, ends

    def decode(self, ids) -> str:
        return b"".join(self.pieces[int(i)] for i in ids).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def parts_of(text: str) -> list[str]:
    """Parts of a very long text, each about ``GROUP_CHARS`` long, cut where pieces always part."""
    spaces = {chr(c) for c in WHITE_SPACE}
    cuts, at = [0], GROUP_CHARS // 2
    while 0 <= (at := text.find(" ", at)):
        if text[at - 1] in spaces:
            at += 1
            continue
        cuts.append(at)
        at += GROUP_CHARS // 2
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def groups_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about ``GROUP_CHARS`` characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str | None = None, *, offsets: bool = False) -> DataFrame:
    """``key``, ``ids`` (and with ``offsets`` ``ends``) of each text by the tokenizer, without special tokens.

    ``ends`` has, for each id, the number of code points up to the end of its piece, so any run of ids that
    ends a piece leads back to its stretch of the text. Null and empty texts have an empty list, never null;
    strings that look like special tokens are ordinary text. Every row of the input gives one row, repeated
    ones too. A map over the rows: no shuffle, whole texts, memory bounded by one group of texts.
    """
    path = vocabulary or default_vocabulary()
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    if offsets:
        fields.append(T.StructField("ends", T.ArrayType(T.LongType(), False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            for a, b in groups_of(texts):
                ids, counts, ends = enc.encode_batch(texts[a:b])
                cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                cols = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32()))]
                if offsets:
                    cols.append(pa.ListArray.from_arrays(cuts, pa.array(ends, pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, T.StructType(fields))


def decode_ids(df: DataFrame, key: str, ids: str, vocabulary: str | None = None, *, text_col: str = "text") -> DataFrame:
    """``key``, ``ids`` and the text they stand for; null ids give null. Bytes that are no UTF-8 become replacement characters."""
    path = vocabulary or default_vocabulary()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(ids, df.schema[ids].dataType), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=schema.names)

    return df.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, vocabulary: str | None = None, *, count_col: str = "n_tokens") -> DataFrame:
    """``df`` without ``text``, with the number of tokens of each text (0 for null and empty)."""
    path = vocabulary or default_vocabulary()
    rest = [c for c in df.columns if c not in (text, count_col)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(count_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(len(rest)), "").to_pylist()
            n = [enc.encode_batch(texts[a:b], want_ids=False)[1] for a, b in groups_of(texts)]
            counts = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], counts], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)
