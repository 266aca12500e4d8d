"""Pages made for search engines: keyword stuffing, link lists and product tags instead of sentences.

Each text is parted, in one vectorised pass over code points, into its sentences, its sentences that string words
together, and its blocks of what is no sentence. Each part is measured: share of function words, of digits, of
links, of hash marks, of words that recur, and entropy. The prose of a language gives a robust centre (medians),
scale (median deviations) and correlation (of the parts within three deviations in every feature). A part far from
the prose of its language by robust Mahalanobis distance, in a direction that leads to spam, is flagged. A text is
spam if its flagged parts are more than half of what counts in it: they outweigh its sentences.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.encode import classes, groups_of, piece_hashes
from marginalia.llm.visual import ONE, transducer
from marginalia.session import saved

# Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and in to a is was were for with by on at that from as be are it this not or which an we our has have but than only its their they these those can may would should could been if into there where when between both each other such no do does did so i you your my me who what how all every any because while after before during over under near more most less few".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wurden ob dies diese dieser jede je kaum keine gegen zwischen unter wir".split(),
    "fr": "le la les de des et en un une du que est pour qui dans ce il au sur se ne pas par plus ont été aux ou cette avec on si chez ces son sa ses leur être sont était aucune chaque entre mais comme nous après près même".split(),
    "es": "el la los las de y en del se con por una un su para que es al lo como más o pero sus le ha fue no si cada entre sin sobre también muy ya son está este esta aún aunque otros después nos".split(),
    "ru": "и в не на что с по как это из у за от то о к для при во ко но мы был была были или а же ли бы до под после из-за через между лишь ещё уже каждой каждая этот эта эти которых".split(),
    "el": "ο η το οι τα του της των τον την τους τις και σε στο στη στην στον στα στις με για από που δεν να θα είναι ήταν ως αν ή μια ένα ένας κατά μετά πριν κάθε ανάμεσα ήδη".split(),
    "zh": list("的了在是和与有为其这于及之以但个中对每约该"),
    "ja": [chr(i) for i in range(0x3041, 0x3097)],
}
#: Share of function words and least words of a sentence; share of repeated content words that makes a sentence stuffed.
SENTENCE_FUNCTION, SENTENCE_WORDS, STUFFED_REPEAT = 0.1, 4, 0.25
#: A sentence is also stuffed if so large a share of its content words recurs within so many words, so large a share of
#: them before another word than last time, and so many commas part them.
NEAR, CHURN_NEAR, CHURN_FRESH, CHURN_COMMAS = 40, 0.4, 0.15, 2
#: Least words or characters of a part that is measured; shorter ones (menus, captions, headings) count for neither side.
PART_WORDS, PART_CHARS = 10, 80
#: Quantile 0.999 of the chi-square distribution with as many degrees of freedom as there are features.
FAR = 22.46
#: Direction of spam in deviations of each feature, and least scale of each feature.
FEATURES = {"function": (-1.0, 0.05), "digits": (-1.0, 0.04), "repetition": (1.0, 0.1), "entropy": (-1.0, 0.04), "links": (0.5, 0.03), "marks": (0.5, 0.05)}
#: For the direction deviations are cut at so many; least component of the distance in the direction of spam.
MOST_DEVIATIONS, TOWARDS = 15.0, 2.5
#: Languages with fewer measured parts of prose, and texts of no known language, are held against all prose together.
LEAST_GROUP = 100
#: Least flagged share of a spam text; beyond it the flagged parts must outweigh the sentences.
LEAST_STUFFED = 0.35
BLOCK, STRINGING, PROSE = range(3)


class _Tables:
    def __init__(self) -> None:
        c = classes()
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x1E944):
            if not 0xD800 <= i < 0xE000 and len(x := chr(i).lower()) == 1:
                self.lower[i] = ord(x)
        self.word = c <= 1
        for i in np.flatnonzero(c == 3).tolist():
            if i < 0x1E000 and unicodedata.category(chr(i)) in ("Mn", "Mc"):
                self.word[i] = True
        self.digit = c == 1
        self.upper = self.lower != np.arange(0x110000, dtype=np.uint32)
        self.upper[0xFFFD] = True
        self.cjk = np.zeros(0x110000, bool)
        for a, b in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32400)):
            self.cjk[a:b] = True
        self.space = c == 2
        hidden = [i for i in (*range(0x20), *range(0x7F, 0xA0), 0xAD, *range(0x600, 0x606), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF)]
        self.space[hidden] = True  # controls and invisible marks part words and sentences as blanks do
        # Wide forms and look-alike letters are read as the letters they look like, in texts and function words alike
        fold = transducer()
        self.plain = np.where(fold.kind == ONE, fold.to, np.arange(0x110000, dtype=np.uint32))
        # One sorted table of known words; a bit for each language in which the word is a function word
        bits: dict[int, int] = {}
        for k, listed in enumerate(FUNCTION_WORDS.values()):
            for h in self._hashes(listed).tolist():
                bits[h] = bits.get(h, 0) | 1 << k
        self.known = np.array(sorted(bits), np.uint64)
        self.bits = np.array([bits[h] for h in sorted(bits)], np.int64)

    def _hashes(self, words) -> np.ndarray:
        points = [self.lower[self.plain[[ord(c) for c in w]]] for w in words]
        starts = np.cumsum([0, *map(len, points[:-1])])
        return np.unique(piece_hashes(np.concatenate(points), starts))


_tables: _Tables | None = None


def _occurrences(group: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the same word before in the same group, or -1; first places of the words; how often each occurs).

    One sort of numbers that hold 40 bits of the hash of group and word above the place.
    """
    n = len(hashes)
    with np.errstate(over="ignore"):
        keys = (hashes ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0x94D049BB133111EB)
    keys ^= keys >> np.uint64(32)
    low = np.uint64((1 << 24) - 1)
    both = np.sort((keys & ~low) | np.arange(n, dtype=np.uint64))
    place = (both & low).astype(np.int64)
    same = (both[1:] >> np.uint64(24)) == (both[:-1] >> np.uint64(24))
    before = np.full(n, -1)
    before[place[1:][same]] = place[:-1][same]
    head = np.flatnonzero(np.append(True, ~same)) if n else np.zeros(0, np.int64)
    return before, place[head], np.diff(np.append(head, n))


def measure(texts: list[str]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(``language`` by function words and script, and ``chars`` of each text; ``text``, ``kind``, ``chars``, ``words``
    and the features of each part, text by text)."""
    global _tables
    if _tables is None:
        _tables = _Tables()
    t = _tables
    d = len(texts)
    points = t.plain[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, d) + 1)
    word, cjk = t.word[points], t.cjk[points]
    before = np.append(False, word[:-1])
    start = word & (~before | cjk | np.append(False, cjk[:-1]))
    edge = start | (~word & before)
    edge[0] = True
    edges = np.flatnonzero(edge)
    hashes = piece_hashes(t.lower[points], edges)
    is_word = word[edges]
    size = np.diff(np.append(edges, len(points)))
    digits = np.add.reduceat(t.digit[points].astype(np.int32), edges)
    at, hashes, size, digits = edges[is_word], hashes[is_word], size[is_word], digits[is_word] > 0
    entry = np.minimum(np.searchsorted(t.known, hashes), len(t.known) - 1)
    bits = np.where(t.known[entry] == hashes, t.bits[entry], 0)
    top = len(FUNCTION_WORDS)
    function, chinese = bits > 0, cjk[at]
    # Chinese is written without blanks: each character counts half a word, and what may recur is its pair with the next one
    weight = np.where(chinese, 0.5, 1.0)
    paired = np.zeros(len(at), bool)
    paired[:-1] = chinese[:-1] & chinese[1:] & (at[1:] == at[:-1] + size[:-1])
    joined = np.append(False, paired[:-1])[: len(at)]
    content = ~function & (paired | ~joined)
    if paired.any():
        head = np.flatnonzero(paired)
        content[head] &= ~function[head + 1]
        pair = hashes.copy()
        with np.errstate(over="ignore"):
            pair[head] = hashes[head] * np.uint64(0x9E3779B97F4A7C15) + hashes[head + 1]
        hashes = pair
    # Segments end at line breaks and behind the marks that end sentences
    after_space = np.append(t.space[points[1:]], True)
    after_space[:-1] |= (points[1:] == 0xFFFD) | t.upper[points[1:]] & (points[:-1] == 0x2E) & np.append(False, word[:-2])
    stop = ((points == 0x2E) | (points == 0x21) | (points == 0x3F)) & after_space
    one_letter = np.zeros(len(points), bool)  # the initial 'A.' ends no sentence
    initial = at[(size == 1) & t.upper[points[at]] & (at > 0)]
    initial = initial[t.space[points[initial - 1]] | np.isin(points[initial - 1], (0x2E, 0x2D))]
    one_letter[initial + 1] = True
    stop &= ~(one_letter & (points == 0x2E))
    stop |= np.isin(points, (0x3002, 0xFF01, 0xFF1F))
    line = np.isin(points, (0x0A, 0x0D, 0x0B, 0x0C, 0x85, 0x2028, 0x2029))
    bound = stop | line
    segment_of = np.cumsum(bound) - bound  # of every position
    stops = np.append(stop[bound], False)
    raw = segment_of[at]
    used, seg = np.unique(raw, return_inverse=True)
    n = len(used)
    doc_of_seg = np.searchsorted(ends, at[np.unique(seg, return_index=True)[1]], side="right") if n else np.zeros(0, np.int64)
    count = lambda group, what, m: np.bincount(group, weights=what, minlength=m)
    words_in = count(seg, weight, n)
    sentence = stops[used] & (words_in >= SENTENCE_WORDS) & (count(seg, function, n) >= SENTENCE_FUNCTION * words_in)
    content_in = count(seg, content * weight, n)
    prev, first, times = _occurrences(doc_of_seg[seg], hashes)
    again = content & (prev >= 0)
    # A repeated word is stale if the same word follows as last time: then it is the sentence that is repeated
    follower = np.zeros(len(at), np.uint64)
    if len(at):
        behind = np.arange(1, len(at) + 1) + paired
        follows = np.flatnonzero((behind < len(at)) & (seg[behind.clip(max=len(at) - 1)] == seg))
        behind = behind[follows]
        follower[follows] = np.where(digits[behind], np.uint64(7), hashes[behind])
    fresh_use = again & (follower != follower[prev])
    place = np.cumsum(weight)
    near = again & (place - place[prev] <= NEAR)
    near[prev[near]] = True
    inside = again & (seg[prev] == seg) if n else again
    repeats = count(seg, inside * weight, n)
    commas = np.bincount(np.searchsorted(used, segment_of[(points == 0x2C) | (points == 0x3001) | (points == 0xFF0C)]).clip(max=max(n - 1, 0)), minlength=n) if n else np.zeros(0)
    stuffed = (repeats >= np.maximum(2, STUFFED_REPEAT * content_in)) & (count(seg, (inside & fresh_use) * weight, n) >= 0.2 * repeats)
    stuffed |= (count(seg, (near & content) * weight, n) >= CHURN_NEAR * content_in) & (count(seg, (near & fresh_use) * weight, n) >= CHURN_FRESH * content_in) & (content_in >= 4) & (commas >= CHURN_COMMAS)
    stuffed &= sentence
    # Blocks: runs of segments that are no sentences, each sentence by itself
    fresh = np.ones(n, bool)
    fresh[1:] = sentence[1:] | sentence[:-1] | (doc_of_seg[1:] != doc_of_seg[:-1])
    block = np.cumsum(fresh) - 1
    m = int(block[-1]) + 1 if n else 0
    wb = block[seg] if n else np.zeros(0, np.int64)
    # Links: a dot between two words of two letters or more, the first of its chain; hash marks before a word
    dot = np.flatnonzero(points == 0x2E)
    dot = dot[(dot > 1) & (dot + 2 < len(points))]
    dot = dot[word[dot - 1] & word[dot - 2] & word[dot + 1] & word[dot + 2] & ~t.digit[points[dot - 1]] & ~t.digit[points[dot + 1]] & ~cjk[dot - 1]]
    left = np.searchsorted(at, dot) - 1
    chained = np.append(False, left[1:] == left[:-1] + 1) if len(dot) else np.zeros(0, bool)
    link_word = left[~chained]
    mark = np.flatnonzero((points[:-1] == 0x23) & word[1:])
    hash_word = np.searchsorted(at, mark)
    links, marks = np.zeros(len(at)), np.zeros(len(at))
    links[link_word] = 1
    if len(mark):  # a mark holds for all the characters written together behind it
        run = np.cumsum(~joined) - 1
        marks[hash_word] = count(run, weight, int(run[-1]) + 1)[run[hash_word]] if chinese.any() else 1
        marks[hash_word[~chinese[hash_word]]] = 1
    # Parts: each block; the sentences of a text that string words together; its other sentences
    kind = np.where(sentence, np.where(stuffed, STRINGING, PROSE), BLOCK)
    label = np.where(kind == BLOCK, doc_of_seg * (m + 2) + 2 + block, doc_of_seg * (m + 2) + kind - 1)
    _, head, part = np.unique(label, return_index=True, return_inverse=True)
    parts = len(head)
    # Of what strings no words together, a sentence that stands there once more, word for word, tells nothing new
    order = np.arange(len(at)) - np.searchsorted(seg, seg) if n else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = hashes * (2 * order.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        whole = np.add.reduceat(mixed, np.searchsorted(seg, np.arange(n))) if n else np.zeros(0, np.uint64)
    copied = (_occurrences(doc_of_seg, whole)[0] >= 0) & stops[used] & (words_in >= SENTENCE_WORDS) & ~stuffed if n else np.zeros(0, bool)
    seen = np.flatnonzero(~copied[seg]) if n else np.zeros(0, np.int64)
    of, wt = part[seg[seen]], weight[seen]
    back, first, times = _occurrences(of, hashes[seen])
    twice = back >= 0
    twice[back[twice]] = True
    words_p = count(of, wt, parts)
    share = lambda what: count(of, what[seen] * wt, parts) / np.maximum(words_p, 1)
    total = count(of, None, parts)
    spread = np.log(np.maximum(total, 2)) - np.bincount(of[first], weights=times * np.log(np.maximum(times, 1)), minlength=parts) / np.maximum(total, 1)
    recurs = np.zeros(len(at), bool)
    recurs[seen] = twice
    inside_p = {
        "text": doc_of_seg[head], "kind": kind[head], "chars": count(part[seg], size, parts) if n else np.zeros(0), "words": words_p,
        "function": share(function), "digits": share(digits), "repetition": share(recurs & content & ~digits),
        "entropy": np.where(total > 1, spread / np.log(np.maximum(total, 2)), 1.0),
        "links": count(of, links[seen], parts) / np.maximum(words_p, 1), "marks": count(of, marks[seen], parts) / np.maximum(words_p, 1),
    }
    doc = doc_of_seg[seg] if n else np.zeros(0, np.int64)
    total = count(doc, None, d)
    marked = np.flatnonzero(function)
    hits = np.stack([count(doc[marked], (bits[marked] >> k) & 1, d) for k in range(top)])
    language = np.where(hits.max(axis=0) >= 0.02 * np.maximum(total, 1), hits.argmax(axis=0), top).astype(np.int32)
    language[total == 0] = top
    return {"language": language, "chars": count(doc, size, d)}, inside_p


_PART = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("chars", T.DoubleType()), T.StructField("words", T.DoubleType()), *(T.StructField(f, T.DoubleType()) for f in FEATURES)]
)


def page_parts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``language`` and the measured ``parts`` of each text, one row per row; texts without a word have none."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("language", T.StringType()), T.StructField("parts", T.ArrayType(_PART))])
    languages = np.array([*FUNCTION_WORDS, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            for a, b in groups_of(texts):
                whole, parts = measure(texts[a:b])
                cuts = np.searchsorted(parts["text"], np.arange(b - a + 1)).astype(np.int32)
                fields = [pa.array(parts["kind"].astype(np.int32)), *(pa.array(parts[f.name].astype(float)) for f in _PART.fields[1:])]
                nested = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(fields, names=_PART.names))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(languages[whole["language"]].tolist(), pa.string()), nested], names=schema.names)

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


class Shape:
    """Centre, scale and inverse correlation of the prose of a language."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, inverse: np.ndarray):
        self.centre, self.scale, self.inverse = centre, scale, inverse

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared Mahalanobis distance, component of the distance in the direction of spam) of each row of features."""
        z = (x - self.centre) / self.scale
        w = np.array([w for w, _ in FEATURES.values()])
        towards = np.clip(z, -MOST_DEVIATIONS, MOST_DEVIATIONS) @ self.inverse @ w / np.sqrt(w @ self.inverse @ w)
        return np.einsum("ij,jk,ik->i", z, self.inverse, z), towards


def _inverse(n: int, mean: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Inverse of the correlation of the features, shrunk towards the identity so that it exists."""
    p = len(mean)
    c = np.eye(p)
    if n > 10 * p:
        c = product - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(c), 0.05))  # a feature that hardly varies keeps its least scale
        c = 0.5 * c / np.outer(scale, scale) + 0.5 * np.eye(p)
    return np.linalg.inv(c)


def prose_shapes(pages: DataFrame) -> dict[str, Shape]:
    """The shape of the prose of each language, and of all as ``all``: two distributed passes over the measured parts,
    of which one small row per language reaches the driver."""
    names = list(FEATURES)
    p = len(names)
    prose = pages.select("language", F.explode("parts").alias("part")).where((F.col("part.kind") == PROSE) & (F.col("part.words") >= PART_WORDS))
    grouped = prose.select(F.explode(F.array("language", F.lit("all"))).alias("group"), *[F.col(f"part.{f}").alias(f) for f in names])
    medians = {r.group: r for r in grouped.groupBy("group").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 1000).alias(f) for f in names]).collect()}
    kept = [g for g, r in medians.items() if g == "all" or g != "und" and r.n >= LEAST_GROUP]
    if not kept:
        return {}

    def of(values: dict[str, float]) -> Column:  # one branch per language of a fixed list
        return F.coalesce(*[F.when(F.col("group") == g, F.lit(float(x))) for g, x in values.items()])

    grouped = grouped.where(F.col("group").isin(kept))
    off = grouped.select("group", *[(F.col(f) - of({g: medians[g][f] for g in kept})).alias(f) for f in names])
    spreads = {r.group: r for r in off.groupBy("group").agg(*[F.percentile_approx(F.abs(f), 0.5, 1000).alias(f) for f in names]).collect()}
    scale = {g: np.array([max(1.4826 * spreads[g][f], least) for f, (_, least) in FEATURES.items()]) for g in kept}
    z = off.select("group", *[(F.col(f) / of({g: scale[g][i] for g in kept})).alias(f"z{i}") for i, f in enumerate(names)])
    inner = z.where(" and ".join(f"abs(z{i}) <= 3" for i in range(p)))
    products = [F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    moments = {r.group: r for r in inner.groupBy("group").agg(F.count("*").alias("n"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(p)], *products).collect()}
    shapes = {}
    for g in kept:
        inverse = np.eye(p)
        if g in moments:
            r = moments[g]
            product = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
            inverse = _inverse(r.n, np.array([r[f"m{i}"] for i in range(p)]), product)
        shapes[g] = Shape(np.array([medians[g][f] for f in names]), scale[g], inverse)
    return shapes


def judge_pages(language: list[str], parts: dict[str, np.ndarray], texts: np.ndarray, shapes: dict[str, Shape], far: float = FAR, towards: float = TOWARDS) -> dict[str, np.ndarray]:
    """``distance`` and ``direction`` of the largest measured part of each text, shares ``stuffed`` and ``prose``, ``is_spam``.

    ``texts`` numbers the text of each part. Flagged is a block or a part of stringing sentences, long enough, beyond
    ``far`` with more than ``towards`` in the direction of spam; ordinary sentences tell something, however plain.
    """
    d = len(language)
    x = np.stack([parts[f] for f in FEATURES], axis=1) if len(texts) else np.zeros((0, len(FEATURES)))
    distance, direction = np.zeros(len(texts)), np.zeros(len(texts))
    group = np.array([g if g in shapes else "all" for g in language], object)[texts] if len(texts) else np.zeros(0, object)
    for g in set(group.tolist()) & set(shapes):
        rows = np.flatnonzero(group == g)
        distance[rows], direction[rows] = shapes[g].place(x[rows])
    measured = ((parts["words"] >= PART_WORDS) | (parts["chars"] >= PART_CHARS)) & (parts["kind"] != PROSE)
    flagged = measured & (distance > far) & (direction > towards)
    chars = np.bincount(texts, weights=parts["chars"], minlength=d)
    of = lambda which: np.bincount(texts[which], weights=parts["chars"][which], minlength=d) / np.maximum(chars, 1)
    stuffed, prose = of(flagged), of((parts["kind"] != BLOCK) & ~flagged)
    largest = np.lexsort((np.where(measured, parts["chars"], -1), texts))
    out = {"distance": np.zeros(d), "direction": np.zeros(d)}
    for name, value in (("distance", distance), ("direction", direction)):
        out[name][texts[largest]] = value[largest]  # the last write of a text is its largest part
    return {**out, "stuffed": stuffed, "prose": prose, "is_spam": stuffed > np.maximum(LEAST_STUFFED, prose)}


def find_spam(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``language``, ``distance`` (squared) and ``direction`` of the largest measured part of every text, the
    shares ``stuffed`` (flagged parts) and ``prose`` (sentences) of its characters, and ``is_spam``.

    Null, empty and blank texts and texts of no words are never spam, nor is any text of a corpus without prose:
    there is nothing to be far from. Centre, scale and correlation come from all texts of a language (of all
    texts for small or unknown ones), by distributed aggregation; one small row per language reaches the driver.
    Keys may repeat: each row is measured by itself. Extra columns are ignored. No row is shuffled.
    """
    pages = saved(page_parts(df, key, text), "page-parts")
    shapes = prose_shapes(pages)
    outputs = {"distance": T.DoubleType(), "direction": T.DoubleType(), "stuffed": T.DoubleType(), "prose": T.DoubleType(), "is_spam": T.BooleanType()}
    schema = T.StructType([*pages.schema.fields[:2], *(T.StructField(f, t) for f, t in outputs.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nested = batch.column(2)
            sizes = pc.list_value_length(nested).to_numpy(zero_copy_only=False)
            flat = nested.flatten()
            parts = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(_PART.fields)}
            got = judge_pages(batch.column(1).to_pylist(), parts, np.repeat(np.arange(len(sizes)), sizes), shapes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[f]) for f in outputs)], names=schema.names)

    return pages.mapInArrow(run, schema)
