"""One form for texts that look the same, and quotes found in the texts they were taken from.

The mapping is compiled once from rules over all of Unicode: widths, ligatures and font variants lose their
compatibility tag, kinds of space become a blank, invisible characters vanish, hyphens and look-alike letters
take one member of their family, base letters and their marks are composed. The compiler checks that no rule
contradicts another and that every output is stable. Texts are then rewritten in one pass over grapheme
clusters, longest match first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Families of letters drawn alike; the first member of a family stands for it.
LOOK_ALIKES = (
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "QԚ", "SЅ", "TТΤ", "WԜ", "XХΧ", "YΥҮ", "ZΖ",
    "aа", "cсϲⲥ", "dԁ", "eе", "gɡց", "hһհ", "iі", "jјϳ", "nո", "oоοօⲟ", "pрⲣ", "qԛզ", "sѕ", "uս", "wԝ", "xх", "yу", "ГΓ", "ПΠ", "ФΦ",
)
# Capitals of other scripts drawn as Latin ones (Cherokee, Lisu, Coptic).
MORE_ALIKES = (
    "AᎪꓮⲀ", "BᏴꓐⲂ", "CᏟꓚⲤ", "DᎠꓓ", "EᎬꓰⲈ", "FꓝϜ", "GᏀꓖ", "HᎻꓧⲎ", "IꓲⲒ", "JᎫꓙ", "KᏦꓗⲔ", "LᏞꓡ", "MᎷꓟⲘ", "NꓠⲚ", "OꓳⲞՕ", "PᏢꓑⲢ", "RᏒꓣ", "SᏚꓢ", "TᎢꓔⲦ", "UꓴՍ", "VᏙꓦ",
    "WᎳꓪ", "XꓫⲬ", "YꓬⲨ", "ZᏃꓜ",
)
# The same short stroke under several numbers.
HYPHENS = "-‐‑﹣－"
#: Tags of compatibility mappings that change nothing of what is read. Raised, lowered, circled and fraction forms do.
ALIKE_TAGS = ("<wide>", "<narrow>", "<font>", "<small>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
INVISIBLE = frozenset((0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x1810), *range(0xE0100, 0xE01F0)))
#: Vowels and final consonants of conjoining Hangul go with the letter before them, as marks do.
HANGUL_TAILS = frozenset((*range(0x1161, 0x11A8), *range(0x11A8, 0x1200)))
#: Single Hangul letters stand for themselves: taken as conjoining ones they would merge with their neighbours.
HANGUL_LETTERS = range(0x3131, 0x318F)
BLANKS = frozenset((*range(0x09, 0x0E), 0x85))

#: Texts are taken together up to this many characters.
GROUP_CHARS = 4_000_000

PLAIN, ONE, BLANK, UNSEEN, MANY, MARK = range(6)


class Transducer:
    """The compiled mapping: tables for whole batches and a matcher for clusters."""

    def __init__(self) -> None:
        family: dict[str, str] = {}
        for letters in (*LOOK_ALIKES, *MORE_ALIKES):
            for x in letters[1:]:
                if family.setdefault(x, letters[0]) != letters[0]:
                    raise ValueError(f"{x!r} belongs to two families")
        if chained := [x for x in family.values() if x in family]:
            raise ValueError(f"chained families: {chained}")
        self.family = family
        self.kind = np.zeros(0x110000, np.uint8)
        self.to = np.arange(0x110000, dtype=np.uint32)
        self.many: dict[str, str] = {}
        for i in (*range(0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200)):
            c = chr(i)
            cat = unicodedata.category(c)
            if cat[0] == "Z" or i in BLANKS:
                self.kind[i], self.to[i] = BLANK, 0x20
            elif cat in ("Cc", "Cf") or i in INVISIBLE:
                self.kind[i] = UNSEEN
            elif cat[0] == "M" or i in HANGUL_TAILS:
                self.kind[i] = MARK
            elif (c in family or c in HYPHENS or unicodedata.decomposition(c)) and (out := self.letters(c)) != c:
                if all(unicodedata.category(x)[0] == "M" for x in out):
                    self.kind[i] = MARK
                elif len(out) == 1:
                    self.kind[i], self.to[i] = ONE, ord(out)
                else:
                    self.kind[i], self.many[c] = MANY, out
        group = lambda *kinds: "".join(
            f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _ranges(np.flatnonzero(np.isin(self.kind, kinds)))
        )
        hidden, blank, marks = group(UNSEEN), group(BLANK), group(MARK)
        self.pattern = re.compile(f"[^{hidden}{blank}{marks}](?:[{hidden}]*[{marks}])+|[{hidden}{blank}]+|[{group(ONE, MANY)}]")
        self._compile_pairs()
        self.memo: dict[str, str] = {}
        for c, out in [*self.many.items(), *((chr(i), chr(self.to[i])) for i in np.flatnonzero(self.kind == ONE))]:
            if self.fold(out) != out:
                raise ValueError(f"{c!r} leads to {out!r}, which is not stable")

    def _compile_pairs(self) -> None:
        """Tables of what whole batches do with clusters of one letter and one mark, and with letters of several images.

        A letter without marks of its own and a mark that stands for itself become the letter they compose, or stay.
        """
        pairs: dict[int, int] = {}
        for i in (*range(0xC0, 0xD800), *range(0xF900, 0x32400)):
            parts = unicodedata.decomposition(chr(i))
            if parts and parts[0] != "<" and " " in parts:
                a, b = (int(x, 16) for x in parts.split())
                out = self.letters(chr(a) + chr(b))
                if self.kind[b] == MARK and len(out) == 1:
                    pairs[int(self.to[a]) << 21 | b] = ord(out)
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in self.pair.tolist()], np.uint32)
        # Hangul composes by rule, of up to three letters; decomposed letters and marks would need reordering
        self.simple = np.ones(0x110000, bool)
        for i in (*range(0xA0, 0xD800), *range(0xE000, 0x32400)):
            if unicodedata.decomposition(chr(i)) or 0x1100 <= i < 0x1200 or 0xAC00 <= i < 0xD7A4:
                self.simple[i] = False
        several = sorted(self.many)
        self.many_at = np.array([ord(c) for c in several], np.uint32)
        self.many_flat = np.array([ord(x) for c in several for x in self.many[c]], np.uint32)
        self.many_size = np.array([len(self.many[c]) for c in several], np.int64)

    def letters(self, text: str) -> str:
        """The mapping of one letter or cluster without blanks."""
        out = []
        for c in unicodedata.normalize("NFD", text):
            tag, _, rest = unicodedata.decomposition(c).partition(" ")
            alike = tag in ALIKE_TAGS or tag == "<compat>" and ord(c) not in HANGUL_LETTERS and unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Nl") and c != "ſ"
            if c in HYPHENS:
                out.append("-")
            elif alike and (parts := "".join(chr(int(x, 16)) for x in rest.split())) != c and not parts.startswith(" "):
                out.append(self.letters(parts))
            else:
                out.append(self.family.get(c, c))
        return unicodedata.normalize("NFC", "".join(out))

    def cluster(self, text: str) -> str:
        seen = "".join(c for c in text if self.kind[ord(c)] != UNSEEN)
        return " " if any(self.kind[ord(c)] == BLANK for c in seen) else self.letters(seen)

    def _replace(self, m: re.Match) -> str:
        x = m.group()
        if (y := self.memo.get(x)) is None:
            y = self.cluster(x)
            if len(self.memo) < 100_000:
                self.memo[x] = y
        return y

    def fold(self, text: str) -> str:
        """The one form of ``text``, cluster by cluster."""
        return self.pattern.sub(self._replace, text)

    def fold_all(self, texts: list[str]) -> list[str]:
        """The one form of each text, in groups of bounded size; a text too long for a group goes cluster by cluster."""
        out: list[str] = []
        begin = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > GROUP_CHARS:
                out += self._fold_group(texts[begin:i])
                begin, size = i, 0
            size += len(t)
        return out + self._fold_group(texts[begin:])

    def _fold_group(self, texts: list[str]) -> list[str]:
        """Texts are taken together by the compiled tables, longest cluster first; those with clusters of several marks,
        or of marks that reorder, go cluster by cluster."""
        if not texts:
            return []
        if len(texts) == 1 and len(texts[0]) > GROUP_CHARS:
            return [self.fold(texts[0])]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[points]
        keep = kind != UNSEEN
        owner = np.repeat(np.arange(len(texts)), lengths)[keep]
        points, kind = points[keep], kind[keep]
        image = self.to[points]
        hard = np.zeros(len(texts), bool)
        mark = kind == MARK
        if mark.any():
            at = np.flatnonzero(mark)
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, len(points) - 1)
            alone = (at > 0) & (owner[before] == owner[at]) & (kind[before] <= ONE) & ~((after > at) & mark[after] & (owner[after] == owner[at]))
            plain = alone & self.simple[image[before]] & self.simple[points[at]]
            hard[owner[at[~plain]]] = True
            at, before = at[plain], before[plain]
            key = image[before].astype(np.int64) << 21 | points[at]
            entry = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = self.pair[entry] == key
            image[before[hit]] = self.pair_to[entry[hit]]
            left = np.ones(len(points), bool)
            left[at[hit]] = False
            owner, kind, image, points = owner[left], kind[left], image[left], points[left]
        many = np.flatnonzero(kind == MANY)
        if len(many):
            entry = np.searchsorted(self.many_at, points[many])
            size = np.ones(len(points), np.int64)
            size[many] = self.many_size[entry]
            start = np.cumsum(size) - size
            first = (np.cumsum(self.many_size) - self.many_size)[entry]
            inner = np.arange(int(size[many].sum())) - np.repeat(np.cumsum(size[many]) - size[many], size[many])
            image, owner = np.repeat(image, size), np.repeat(owner, size)
            image[np.repeat(start[many], size[many]) + inner] = self.many_flat[np.repeat(first, size[many]) + inner]
        blank = image == 0x20
        again = blank.copy()
        again[:1] = False
        again[1:] &= blank[:-1] & (owner[1:] == owner[:-1])
        image, owner = image[~again], owner[~again]
        joined = image.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(np.bincount(owner, minlength=len(texts))).tolist()
        begins = [0, *ends[:-1]]
        return [self.fold(t) if h else joined[a:b] for t, h, a, b in zip(texts, hard.tolist(), begins, ends)]


def _ranges(points: np.ndarray) -> list[tuple[int, int]]:
    if not len(points):
        return []
    cut = np.flatnonzero(np.diff(points) > 1)
    return list(zip(points[np.append(0, cut + 1)].tolist(), points[np.append(cut, len(points) - 1)].tolist()))


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def fold_texts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with, for each item ``source: target`` of ``columns``, the one form of ``source`` in ``target``.

    Null stays null, the empty text empty; whole texts, no shuffle. A target of the same name as an existing
    column replaces it; other columns pass unchanged, whatever their names.
    """

    @F.pandas_udf(T.StringType())
    def form(texts):
        values = texts.tolist()
        real = [i for i, t in enumerate(values) if t is not None]
        out: list[str | None] = [None] * len(values)
        for i, t in zip(real, transducer().fold_all([values[i] for i in real])):
            out[i] = t
        return type(texts)(out, dtype=object)

    return df.withColumns({target: form(F.col(f"`{source}`").cast("string")) for source, target in columns.items()})


#: Bits of the filter of quote anchors that a task holds: what it lets pass is joined, so its size changes no result.
FILTER_BITS = 24
#: Length of quotes from which a tier holds, length of its grams, number of neighbouring grams of which the least is kept.
TIERS = ((48, 16, 33), (24, 12, 13), (12, 8, 5))


def tier_of(length: int) -> int:
    """0 to 2: a tier of grams; 3 and more: short quotes, whole, by their length."""
    for i, (least, _, _) in enumerate(TIERS):
        if length >= least:
            return i
    return 3 + (TIERS[-1][0] - 1 - length)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    if len(points) < k:
        return np.zeros(0, np.int64)
    h = np.zeros(len(points) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + points[i : i + len(h)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def anchors(text: str, tier: int) -> np.ndarray:
    """Grams of a folded text kept in ``tier``: the least of every run of neighbours, so a quote of the tier's
    length shares all its anchors with every text it is a stretch of."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if tier >= 3:
        return np.unique(gram_hashes(points, TIERS[-1][0] - 1 - (tier - 3)))
    _, k, w = TIERS[tier]
    h = gram_hashes(points, k)
    if len(h) < w:
        return np.zeros(0, np.int64)
    least, span = h, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(h) - w + 1], least[w - span :])
    return np.unique(least)


def reads_in(quote: str, text: str) -> bool:
    """The folded quote is a stretch of the folded text that ends with a whole letter, marks included."""
    at = text.find(quote)
    kind = transducer().kind
    while at >= 0:
        end = at + len(quote)
        if end == len(text) or kind[ord(text[end])] != MARK:
            return True
        at = text.find(quote, at + 1)
    return False


def _verify(quotes: list[str], texts: list[str]) -> list[bool]:
    """For each pair: reads the same, but is not there code point for code point."""
    t = transducer()
    own = {x: y for x, y in zip(set(quotes), t.fold_all(list(set(quotes))))} if quotes else {}
    whole = {x: y for x, y in zip(set(texts), t.fold_all(list(set(texts))))} if texts else {}
    return [bool(q := own[a].strip()) and reads_in(q, whole[b]) and a not in b for a, b in zip(quotes, texts)]


def find_quotes(
    quotes: DataFrame,
    texts: DataFrame,
    *,
    quote_id: str,
    quote: str,
    text_id: str,
    text: str,
    keys: tuple[str, ...],
    most_per_group: int = 64,
) -> DataFrame:
    """Distinct pairs (``quote_id``, ``text_id``) of equal, non-null ``keys`` where the non-blank quote reads the
    same as a stretch of the text but is not in it code point for code point.

    Groups of up to ``most_per_group`` distinct quotes travel as one bounded list to each text of the group,
    which is folded once and searched for all of them. Larger groups take the other way, without limit: quotes
    and texts meet by the anchors of :func:`anchors`, each quote by the one rarest in its group, and only those
    pairs are verified. Null or blank quotes, null texts and null keys meet nothing; repeated rows count once;
    equal ids with different quotes count as several. Extra columns are ignored.
    """
    k = list(keys)
    some = lambda c: F.col(f"`{c}`")
    q = quotes.select(*[some(c).alias(f"k{i}") for i, c in enumerate(k)], some(quote_id).alias("qid"), some(quote).cast("string").alias("quote"))
    t = texts.select(*[some(c).alias(f"k{i}") for i, c in enumerate(k)], some(text_id).alias("tid"), some(text).cast("string").alias("body"))
    ks = [f"k{i}" for i in range(len(k))]
    # Only null and ASCII-blank quotes go here; what else is blank folds to nothing and is dropped when verified
    q = q.dropna(subset=[*ks, "quote"]).where(F.trim("quote") != "").distinct()
    t = t.dropna(subset=[*ks, "body"])
    result = T.StructType([T.StructField(quote_id, quotes.schema[quote_id].dataType), T.StructField(text_id, texts.schema[text_id].dataType)])
    large = q.groupBy(*ks).count().where(F.col("count") > most_per_group).select(*ks)
    lists = q.join(large, ks, "left_anti").groupBy(*ks).agg(F.collect_list("qid").alias("qids"), F.collect_list("quote").alias("quotes"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = transducer().fold_all(batch.column(1).to_pylist())
            bodies = batch.column(1).to_pylist()
            ids, own = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            flat = list({x for xs in own for x in xs})
            form = dict(zip(flat, transducer().fold_all(flat)))
            rows, hits = [], []
            for i, (raw, whole) in enumerate(zip(bodies, folded)):
                for qid, x in zip(ids[i], own[i]):
                    if (y := form[x].strip()) and reads_in(y, whole) and x not in raw:
                        rows.append(qid)
                        hits.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, batch.schema.field(2).type.value_type), batch.column(0).take(pa.array(hits, pa.int64()))], names=result.names
            )

    found = t.join(lists, ks).select("tid", "body", "qids", "quotes").mapInArrow(search, result)
    if not large.isEmpty():
        found = found.unionByName(_find_by_anchor(q.join(large, ks, "left_semi"), t.join(large, ks, "left_semi"), ks, result))
    return found.distinct()


def _find_by_anchor(q: DataFrame, t: DataFrame, ks: list[str], result: T.StructType) -> DataFrame:
    """The way for groups of any size: see :func:`find_quotes`."""
    from marginalia.session import saved

    key_fields = [q.schema[c] for c in ks]
    anchor_fields = [T.StructField("tier", T.IntegerType()), T.StructField("gram", T.LongType())]
    q = q.withColumn("qh", F.xxhash64("quote"))  # equal ids may have several quotes

    def of_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = transducer().fold_all(batch.column("quote").to_pylist())
            at, tiers, grams = [], [], []
            for i, x in enumerate(folded):
                if x := x.strip():
                    tier = tier_of(len(x))
                    own = anchors(x, tier)
                    at.extend([i] * len(own))
                    tiers.extend([tier] * len(own))
                    grams.append(own)
            index = pa.array(at, pa.int64())
            cols = [batch.column(c).take(index) for c in (*ks, "qid", "qh")]
            cols += [pa.array(tiers, pa.int32()), pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*ks, "qid", "qh", "tier", "gram"])

    fields = [*key_fields, q.schema["qid"], T.StructField("qh", T.LongType()), *anchor_fields]
    quote_anchors = saved(q.select(*ks, "qid", "qh", "quote").mapInArrow(of_quotes, T.StructType(fields)).distinct(), "quote-anchors")
    tiers = quote_anchors.groupBy(*ks).agg(F.array_sort(F.collect_set("tier")).alias("tiers"))  # at most 14 numbers
    known = _filter(quote_anchors)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = transducer().fold_all(batch.column("body").to_pylist())
            at, at_tier, grams = [], [], []
            for i, (x, wanted) in enumerate(zip(folded, batch.column("tiers").to_pylist())):
                for tier in wanted:
                    own = anchors(x, tier)
                    own = own[known[_places(own)]]
                    at.append(np.full(len(own), i))
                    at_tier.append(np.full(len(own), tier, np.int32))
                    grams.append(own)
            index = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64), pa.int64())
            cols = [batch.column(c).take(index) for c in (*ks, "tid")]
            cols += [pa.array(np.concatenate(at_tier) if at else np.zeros(0, np.int32), pa.int32()), pa.array(np.concatenate(grams) if at else np.zeros(0, np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*ks, "tid", "tier", "gram"])

    text_anchors = t.join(tiers, ks).select(*ks, "tid", "body", "tiers").mapInArrow(of_texts, T.StructType([*key_fields, t.schema["tid"], *anchor_fields]))
    on = [*ks, "tier", "gram"]
    text_anchors = saved(text_anchors.join(quote_anchors.select(*on).distinct(), on, "left_semi"), "text-anchors")
    counts = text_anchors.groupBy(*on).count()
    chosen = (
        quote_anchors.join(counts, on)
        .groupBy(*ks, "qid", "qh")
        .agg(F.min(F.struct("count", "tier", "gram")).alias("a"))
        .select(*ks, "qid", "qh", F.col("a.tier").alias("tier"), F.col("a.gram").alias("gram"))
    )
    pairs = text_anchors.join(chosen, on).select(*ks, "qid", "qh", "tid").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _verify(batch.column("quote").to_pylist(), batch.column("body").to_pylist())
            kept = pa.array(np.flatnonzero(ok), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("qid").take(kept), batch.column("tid").take(kept)], names=result.names)

    whole = pairs.join(q, [*ks, "qid", "qh"]).join(t.distinct(), [*ks, "tid"]).select("qid", "tid", "quote", "body")
    return whole.mapInArrow(verify, result)


def _places(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(quote_anchors: DataFrame) -> np.ndarray:
    """Which places of the filter any quote anchor has. At most 2 ** FILTER_BITS bits reach the driver, in words of 32."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            seen[_places(batch.column(0).to_numpy(zero_copy_only=False))] = True
        packed = np.packbits(seen).view(np.uint32)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at].astype(np.int64))], names=["word", "bits"])

    rows = quote_anchors.select("gram").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    packed = np.zeros((1 << FILTER_BITS) // 32, np.uint32)
    packed[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return np.unpackbits(packed.view(np.uint8)).astype(bool)
