"""Freely typed values mapped to the entries of a reference list.

Names and aliases of a list form one automaton. It finds the names a value mentions; of overlapping mentions
the longest wins. Values that mention none go to a token-set similarity: the weighted share of common words, for
which a name must be covered whole, in any order. What is left may be a name but for initials, abbreviation, lost
word breaks, truncation or a few slips of the keyboard, but not for another word. Every likeness has an index of
its own, so a value meets only the names that can be like it.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.visual import transducer

#: Slips allowed in a name of so many letters, the least share of a name a truncated value must keep, and its least letters.
SLIPS = ((4, 0), (6, 1), (1 << 30, 2))
KEEPS, KEEPS_LETTERS = 0.5, 5
#: Least letters of an abbreviated word ('convers.').
ABBREVIATED = 3
#: Least similarity of the words of a value to those of a name it covers: twice the common weight over both weights.
ALIKE = 0.6
#: Names sent to every task at most; larger reference lists travel to the rows of their key instead.
MOST_NAMES = 100_000
#: Values and row lists remembered by a task.
REMEMBERED, REMEMBERED_LISTS = 20_000, 256


def words(text: str) -> tuple[str, ...]:
    """Lower-case runs of letters and digits of the folded text."""
    folded = transducer().fold(text).casefold()
    return tuple("".join(c if c.isalnum() else " " for c in folded).split())


def slips(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours from ``a`` to ``b``; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def allowed_slips(n: int) -> int:
    return next(k for top, k in SLIPS if n <= top)


class Lexicon:
    """Names and aliases of one reference list, indexed for every likeness."""

    def __init__(self, entries: Sequence[str], aliases: Sequence[tuple[str, str]] = ()):
        self.entries = set(entries)
        self.names: dict[tuple[str, ...], str] = {}
        for name, entry in [*((e, e) for e in entries), *aliases]:
            if name and entry and (key := words(name)):
                self.names.setdefault(key, entry)
        self.automaton = ahocorasick.Automaton()
        for key in self.names:
            self.automaton.add_word(f" {' '.join(key)} ", key)
        if self.names:
            self.automaton.make_automaton()
        self.bare, self.solid, self.initials = defaultdict(set), defaultdict(set), defaultdict(set)
        self.cut, self.parts, self.rarest = defaultdict(list), defaultdict(list), defaultdict(list)
        for key in self.names:
            solid = "".join(key)
            self.bare[tuple(sorted(map(_singular, key)))].add(key)
            self.solid[solid].add(key)
            self.initials["".join(w[0] for w in key)].add(key)
            self.cut[len(key), key[0][:ABBREVIATED]].append(key)
            for j, (start, part) in enumerate(_segments(solid)):
                self.parts[len(solid), j, part].append((key, solid))
        self.solids = sorted(self.solid)
        self.holders = Counter(w for key in self.names for w in {_singular(w) for w in key})
        for key in self.names:
            own = {_singular(w) for w in key}
            self.rarest[min(own, key=lambda w: (self.holders[w], w))].append((key, own))
        self.seen: dict[str, str | None] = {}

    def weight(self, word: str) -> float:
        """What a word tells: the more the fewer names hold it; a word of no name as much as one of a single name."""
        return math.log(1 + len(self.names) / max(1, self.holders[word]))

    def spans(self, own: tuple[str, ...]) -> list[tuple[int, int, str]]:
        """(begin, end, entry) of every name in the words, overlapping ones too."""
        if not self.names:
            return []
        text = f" {' '.join(own)} "
        return [(end - len(" ".join(key)) - 1, end, self.names[key]) for end, key in self.automaton.iter(text)]

    def same_set(self, own: tuple[str, ...], value: str) -> dict[str, float]:
        """The same words in another order, number or spacing."""
        solid = "".join(own)
        keys = self.bare.get(tuple(sorted(map(_singular, own))), set()) | self.solid.get(solid, set())
        if solid.endswith("s"):
            keys = keys | self.solid.get(solid[:-1], set())
        return {self.names[k]: 1.0 for k in keys}

    def token_set(self, own: tuple[str, ...], value: str) -> dict[str, float]:
        """Names whose words all are in the value, in any order, by the weighted share of common words."""
        bag = {_singular(w) for w in own}
        all_words = sum(map(self.weight, bag))
        found: dict[str, float] = {}
        for w in bag:
            for key, name in self.rarest.get(w, ()):
                if name <= bag:
                    common = sum(map(self.weight, name))
                    if (score := 2 * common / (common + all_words)) >= ALIKE:
                        found[self.names[key]] = max(score, found.get(self.names[key], 0.0))
        return found

    def first_letters(self, own: tuple[str, ...], value: str) -> dict[str, float]:
        """The first letters of the words of a name, three or more."""
        solid = "".join(own)
        if len(solid) < 3 or len(own) not in (1, len(solid)):
            return {}
        return {self.names[k]: 1.0 for k in self.initials.get(solid, ())}

    def abbreviated(self, own: tuple[str, ...], value: str) -> dict[str, float]:
        """Every word of the name is there, in order, whole or cut short."""
        found = {}
        for key in self.cut.get((len(own), own[0][:ABBREVIATED]), ()):
            if own != key and all(k == w or len(w) >= ABBREVIATED and k.startswith(w) for k, w in zip(key, own)):
                if "." in value or sum(map(len, own)) >= KEEPS * sum(map(len, key)):
                    found[self.names[key]] = 1.0
        return found

    def slipped(self, own: tuple[str, ...], value: str) -> dict[str, float]:
        """The name but for a few slips, fewest first; a short word replaced by another is no slip."""
        solid = "".join(own)
        near = {}
        most = SLIPS[-1][1]
        for n in range(max(1, len(solid) - most), len(solid) + most + 1):
            for j, (start, size) in enumerate(_cuts(n)):
                for at in range(max(0, start - most), min(start + most, len(solid) - size) + 1):
                    part = solid[at : at + size]
                    # a swap over the end of the part touches two parts; taken back, this one is whole again
                    swapped = (part[:-1] + solid[at + size],) if at + size < len(solid) else ()
                    for x in (part, *swapped):
                        for key, name in self.parts.get((n, j, x), ()):
                            near[key] = name
        scored: dict[str, float] = {}
        for key, name in near.items():
            allowed = allowed_slips(len(name))
            d = slips(solid, name, allowed)
            if d <= allowed and not _other_word(own, key):
                entry = self.names[key]
                scored[entry] = max(-d, scored.get(entry, -99))
        return scored

    def truncated(self, own: tuple[str, ...], value: str) -> dict[str, float]:
        """The beginning of one name only."""
        solid = "".join(own)
        if len(solid) < KEEPS_LETTERS:
            return {}
        found: dict[str, float] = {}
        for i in range(bisect.bisect_left(self.solids, solid), len(self.solids)):
            name = self.solids[i]
            if not name.startswith(solid) or len(found) > 1:
                break
            for key in self.solid[name]:
                if len(solid) >= KEEPS * len(name) and key[: len(own) - 1] == own[:-1]:
                    found[self.names[key]] = 1.0
        return found


#: The likenesses in the order in which they are sought: each only decides if one entry has it best.
LIKENESSES = ("same_set", "token_set", "first_letters", "abbreviated", "slipped", "truncated")


def find(value: str, lexicons: Sequence[Lexicon]) -> str | None:
    """The entry of any of the lexicons that ``value`` stands for, or None if it is none or as like to one as to another."""
    own = words(value)
    if not own:
        return None
    taken: list[tuple[int, int, str]] = []
    for a, b, entry in sorted((s for x in lexicons for s in x.spans(own)), key=lambda s: (s[0] - s[1], s[0])):
        if all(b <= c or a >= d for c, d, _ in taken):
            taken.append((a, b, entry))
    if taken:
        return taken[0][2] if len({entry for _, _, entry in taken}) == 1 else None
    for likeness in LIKENESSES:
        scores: dict[str, float] = {}
        for x in lexicons:
            for entry, score in getattr(x, likeness)(own, value).items():
                scores[entry] = max(score, scores.get(entry, -math.inf))
        if scores:
            top = max(scores.values())
            best = [e for e, score in scores.items() if score > top - 1e-9]
            return best[0] if len(best) == 1 else None
    return None


def _cuts(n: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of a name of ``n`` letters: one more than its slips."""
    parts = min(n, allowed_slips(n) + 1)
    edges = [i * n // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segments(solid: str) -> list[tuple[int, str]]:
    return [(a, solid[a : a + size]) for a, size in _cuts(len(solid))]


def _singular(w: str) -> str:
    return w[:-1] if len(w) > 3 and w.endswith("s") else w


def _other_word(own: tuple[str, ...], key: tuple[str, ...]) -> bool:
    """Word for word alike but for one that shares at most half of its letters with what it replaces."""
    if len(own) != len(key):
        return False
    off = [(w, k) for w, k in zip(own, key) if w != k]
    return len(off) == 1 and slips(*off[0], 3) * 2 > max(map(len, off[0])) and min(map(len, off[0])) <= 3


@lru_cache(REMEMBERED_LISTS)
def _of_row(entries: tuple[str, ...]) -> Lexicon:
    return Lexicon(entries)


def entry_of(value: str, allowed: Sequence[str | None] | None, lexicon: Lexicon) -> str:
    """The entry of ``allowed`` that ``value`` means, else ''. It is sought among all entries of ``lexicon`` and of the
    row, so that a value that means an entry missing from ``allowed`` is not drawn to another one that is near."""
    own = [a for a in allowed or () if a]
    if value in own:
        return value
    more = tuple(sorted({a for a in own if a not in lexicon.entries}))
    if more:
        found = find(value, (lexicon, _of_row(more)))
    else:
        if value not in lexicon.seen:
            if len(lexicon.seen) >= REMEMBERED:
                lexicon.seen.clear()
            lexicon.seen[value] = find(value, (lexicon,))
        found = lexicon.seen[value]
    if found is None or found in own:
        return found or ""
    key = words(found)
    return next((a for a in own if words(a) == key), "")


@lru_cache(64)
def _of_list(entries: tuple[str, ...], aliases: tuple[tuple[str, str], ...]) -> Lexicon:
    return Lexicon(entries, aliases)


def canonical_of(value: str, allowed: Sequence[str | None] | None, entries: tuple[str, ...], aliases: tuple[tuple[str, str], ...]) -> str:
    """:func:`entry_of` for a list given as its entries and aliases."""
    return entry_of(value, allowed, _of_list(entries, aliases))


def map_to_list(
    df: DataFrame,
    reference: DataFrame,
    *,
    value: str,
    allowed: str,
    list_key: str,
    keep: Sequence[str],
    reference_allowed: str = "allowed_values",
    reference_aliases: str = "aliases",
    canonical_col: str = "canonical_value",
) -> DataFrame:
    """``keep`` and the entry of the row's own ``allowed`` list that ``value`` stands for; '' if none.

    ``reference`` holds, per ``list_key``, all entries known and their aliases (other name to entry); several
    rows of one key are united. Null and blank values mean nothing, as does every value of a row without a
    list; a value that mentions several entries, or is as like to one as to another, means none. Rows whose key
    the reference lacks use their own list alone. Repeated rows give repeated results. No shuffle while the
    reference has at most ``MOST_NAMES`` names. A larger one is never joined to the rows: rows are parted by key
    and a salt, the names of a key are sent once to each of its salts, ahead of the rows, and a task holds the
    names of one key at a time.
    """
    some = lambda c: F.col(f"`{c}`")
    spark = df.sparkSession
    listed = reference.select(some(list_key).alias("__key"), F.explode(F.coalesce(some(reference_allowed), F.array())).alias("__name")).select("__key", "__name", F.col("__name").alias("__entry"), F.lit(0).alias("__kind"))
    named = reference.select(some(list_key).alias("__key"), F.explode(some(reference_aliases)).alias("__name", "__entry")).withColumn("__kind", F.lit(1))
    names = listed.unionByName(named).where("__name <> '' and __entry <> ''").distinct()
    few = names.limit(MOST_NAMES + 1).collect()
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(canonical_col, T.StringType())])
    k = len(keep)
    picked = df.select(*[some(c).alias(f"__k{i}") for i, c in enumerate(keep)], some(value).cast("string").alias("__value"), some(allowed).alias("__allowed"), some(list_key).alias("__key"))
    if len(few) > MOST_NAMES:
        return _map_by_key(picked, names, k, schema, spark)
    lists: dict = defaultdict(lambda: ([], []))
    for r in sorted(few, key=lambda r: (str(r["__key"]), r["__kind"], r["__name"], r["__entry"])):
        lists[r["__key"]][r["__kind"]].append(r["__name"] if r["__kind"] == 0 else (r["__name"], r["__entry"]))
    lists = dict(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict = {}
        for batch in batches:
            out = []
            for v, own, key in zip(*(batch.column(k + j).to_pylist() for j in range(3))):
                if key not in built:
                    built[key] = Lexicon(*lists.get(key, ()) or ((),))
                out.append(entry_of(v, own, built[key]) if v and v.strip() else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(out, pa.string())], names=schema.names)

    return picked.mapInArrow(run, schema)


def _map_by_key(picked: DataFrame, names: DataFrame, k: int, schema: T.StructType, spark) -> DataFrame:
    """The way for a reference of any size: see :func:`map_to_list`. The rows of a key without names come to a
    task of their own key and salt too, and use their own lists alone."""
    salts = max(1, spark.sparkContext.defaultParallelism)
    rows = picked.withColumn("__salt", F.pmod(F.xxhash64("__value"), F.lit(salts)).cast("int")).withColumn("__kind", F.lit(2))
    sent = names.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<int>")))
    both = rows.unionByName(sent, allowMissingColumns=True)
    parted = both.repartition("__key", "__salt").sortWithinPartitions("__key", "__salt", "__kind", "__name", "__entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lexicon, entries, aliases = None, None, [], []
        for batch in batches:
            at = {n: batch.column(n).to_pylist() for n in ("__value", "__allowed", "__key", "__salt", "__kind", "__name", "__entry")}
            kept, out = [], []
            for i, (key, salt, kind) in enumerate(zip(at["__key"], at["__salt"], at["__kind"])):
                if (key, salt) != current:
                    current, lexicon, entries, aliases = (key, salt), None, [], []
                if kind == 0:
                    entries.append(at["__name"][i])
                elif kind == 1:
                    aliases.append((at["__name"][i], at["__entry"][i]))
                else:
                    if lexicon is None:
                        lexicon = Lexicon(entries, aliases)
                    v = at["__value"][i]
                    kept.append(i)
                    out.append(entry_of(v, at["__allowed"][i], lexicon) if v and v.strip() else "")
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__k{j}").take(pa.array(kept, pa.int64())) for j in range(k)), pa.array(out, pa.string())], names=schema.names)

    return parted.mapInArrow(run, schema)
