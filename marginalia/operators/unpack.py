"""Several values packed in one field: one row per value, with its place in the field.

The work is done on Arrow string buffers. Quote parity and delimiter masks are computed for all bytes of a
batch at once, the positions that cut become offsets into the same buffer (no copy), and the list array made
of them is flattened with the ordinals of the parents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entries that name nobody, suffixes that belong to the name before the comma.
SENTINELS = (
    "-", "--", "–", "—", "?", ".", "n/a", "na", "n.a.", "n.a", "none", "null", "nan", "nil", "not_found", "not found", "not available",
    "not reported", "not given", "not stated", "unknown", "unspecified", "anonymous", "anon", "anon.", "tbd", "missing", "no authors",
    "no author", "no authors listed", "no author listed", "[no authors listed]",
)
OTHERS = r"(?i)^(and |& )?(et\.?\s+al\.?|and others|others|u\. ?a\.|and colleagues|among others|\.\.\.|…)[\s.,]*$"
SUFFIX = r"(?i)^(jr|sr|ii|iii|iv|v|phd|ph\.d|md|m\.d|dphil|msc|frs|esq)\.?$"
INITIALS = r"^(\p{Lu}\p{M}*\.?[\s-]?){1,4}$"
PARTICLES = r"(?i)^((van|von|de|der|den|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ter|ten|zu|zur|zum|af|av|st\.?)\s+)+"
GROUP = r"(?i)\b(group|network|consortium|team|collaboration|committee|initiative|society|institute|project|program|programme|centre|center|investigators|association)\b"

STRONG_BYTES = (b";", b"|", b"\n", b"\r", b"\t")
STRONG_PARTS = ("•".encode(), " · ".encode(), " / ".encode())


def _found(data: np.ndarray, word: bytes) -> np.ndarray:
    """Start positions of ``word`` in ``data``."""
    n = len(data) - len(word) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = data[:n] == word[0]
    for i in range(1, len(word)):
        hit &= data[i : i + n] == word[i]
    return np.flatnonzero(hit)


def _split_at(arr: pa.StringArray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of ``arr`` between the cuts [start, end) of ``rows``, and the row of each piece.

    Edges of rows and cuts, sorted, are the offsets of an array over the same bytes whose elements are in
    turn piece and delimiter; the delimiters are then left out. The cuts come in order and do not overlap.
    """
    offsets = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64)
    at = np.arange(len(arr))
    lows = np.concatenate([offsets[:-1], ends])
    highs = np.concatenate([offsets[1:], starts])
    owner_low, owner_high = np.concatenate([at, rows]), np.concatenate([at, rows])
    a, b = np.lexsort((lows, owner_low)), np.lexsort((highs, owner_high))
    edges = np.empty(2 * len(a), np.int64)
    edges[0::2], edges[1::2] = lows[a], highs[b]
    pieces = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), arr.buffers()[2]) if len(edges) else arr
    return pieces.take(pa.array(np.arange(0, len(edges), 2))), owner_low[a]


def _merge(pieces: pa.Array, rows: np.ndarray, joins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces with every piece flagged in ``joins`` put behind the one before it, by a comma."""
    if not joins.any():
        return pieces, rows
    head = np.flatnonzero(~joins)
    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(pieces)).astype(np.int32)), pieces)
    return pc.binary_join(lists, ", "), rows[head]


def _matches(arr: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(arr, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _plain(arr: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """Entries of cells in which nothing but commas, 'and' or '&' can part them; a name's own comma stays."""
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64)
    comma = _found(data, b",")
    last = [(_found(data, w), len(w)) for w in (b" and ", b" & ")]
    word_at = np.concatenate([p for p, _ in last])
    word_len = np.concatenate([np.full(len(p), n) for p, n in last])
    row_of = lambda p: np.searchsorted(offsets, p, side="right") - 1
    inside = lambda p: (p >= offsets[0]) & (p < offsets[-1])
    comma = comma[inside(comma)]
    keep = inside(word_at)
    word_at, word_len = word_at[keep], word_len[keep]
    order = np.argsort(word_at, kind="stable")
    word_at, word_len = word_at[order], word_len[order]
    after_comma = (word_at > 0) & np.isin(word_at - 1, comma)  # ', and ' cuts once
    starts, ends = word_at - after_comma, word_at + word_len
    comma = comma[~np.isin(comma, starts[after_comma])]
    parts, part_row = _split_at(arr, starts, ends, row_of(starts))
    parts = pc.utf8_trim_whitespace(parts)
    n_rows = len(arr)
    n_words = np.bincount(row_of(starts), minlength=n_rows)
    commas_in = pc.count_substring(parts, ",").to_numpy(zero_copy_only=False)
    # 'Family, Given and Family, Given': every part between the words holds just one comma
    odd = np.bincount(part_row, weights=commas_in != 1, minlength=n_rows)
    inverted = (n_words > 0) & (odd == 0)
    suffixed = np.bincount(part_row, weights=_matches(parts, r"(?i),\s*(jr|sr|ii|iii|iv|phd|md)\.?$"), minlength=n_rows) > 0
    inverted &= ~suffixed
    cut_comma = ~inverted[row_of(comma)]
    all_at = np.concatenate([starts, comma[cut_comma]])
    all_end = np.concatenate([ends, comma[cut_comma] + 1])
    order = np.argsort(all_at, kind="stable")
    pieces, rows = _split_at(arr, all_at[order], all_end[order], row_of(all_at[order]))
    pieces = pc.utf8_trim_whitespace(pieces)
    suffix = _matches(pieces, SUFFIX)
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    pieces, rows = _merge(pieces, rows, suffix & ~first & (pc.utf8_length(pieces).to_numpy(zero_copy_only=False) > 0) & ~_roman_initial(pieces, rows))
    # 'Family, I. J., Family, I.': every second field is initials, or a single pair of bare family name and given name
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    begin = np.flatnonzero(first)
    place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
    real = ~_matches(pieces, OTHERS) & (pc.utf8_length(pieces).to_numpy(zero_copy_only=False) > 0)
    count = np.bincount(rows, weights=real, minlength=n_rows)
    odd_place = place % 2 == 1
    initials = _matches(pieces, INITIALS)
    bare = pc.replace_substring_regex(pieces, PARTICLES, "")
    one_word = ~_matches(bare, r"\s") & ~_matches(bare, GROUP)
    given = _matches(pieces, r"^[^\s]+(\s+(\p{Lu}\p{M}*\.?\s*)+)?$")
    even_total = (count % 2 == 0) & (count > 0)
    bad_initials = np.bincount(rows, weights=real & np.where(odd_place, ~initials, ~one_word & ~_matches(pieces, r"(?i)\b(jr|sr|ii|iii)\.?$") & initials), minlength=n_rows)
    bad_pair = np.bincount(rows, weights=real & np.where(odd_place, ~given, ~one_word | initials), minlength=n_rows)
    pairs = even_total & ~inverted & ((bad_initials == 0) | (bad_pair == 0))
    return _merge(pieces, rows, pairs[rows] & odd_place & real)


def _roman_initial(pieces: pa.Array, rows: np.ndarray) -> np.ndarray:
    """A lone 'V.' in a list of initials is an initial, no suffix."""
    return _matches(pieces, r"^V\.?$")


def unpack_strings(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(index of the cell, place in the cell from 1, value) of all entries of an Arrow string array."""
    arr = pc.fill_null(arr.cast(pa.string()) if arr.type != pa.string() else arr, "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pa.concat_arrays([pc.utf8_trim_whitespace(arr)])
    n = len(arr)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(arr.buffers()[1], np.int32, n + 1, arr.offset * 4).astype(np.int64)
    # JSON arrays are parsed as such; a cell that only looks like one is read as plain text
    as_json: dict[int, list[str]] = {}
    for i in np.flatnonzero(_matches(arr, r"^\[[\s\S]*\]$")):
        try:
            values = json.loads(arr[int(i)].as_py())
            as_json[int(i)] = [v for v in values if isinstance(v, str)]
        except ValueError:
            pass
    # Quote parity, counted from the start of the cell; a cell with an odd number of quotes has none
    total = np.concatenate([[0], np.cumsum(data == ord('"'))])
    per_cell = total[offsets[1:]] - total[offsets[:-1]]
    quoted = (per_cell > 0) & (per_cell % 2 == 0)
    row_of = lambda p: np.searchsorted(offsets, p, side="right") - 1

    def outside(p: np.ndarray) -> np.ndarray:
        r = row_of(p)
        return ~quoted[r] | ((total[p] - total[offsets[r]]) % 2 == 0)

    at, size = [], []
    for word in (*STRONG_BYTES, *STRONG_PARTS):
        p = _found(data, word)
        p = p[outside(p)] if len(p) else p
        at.append(p)
        size.append(np.full(len(p), len(word)))
    at, size = np.concatenate(at), np.concatenate(size)
    strong = np.zeros(n, bool)
    strong[row_of(at)] = True
    comma = _found(data, b",")
    comma = comma[outside(comma)] if len(comma) else comma
    comma = comma[(quoted & ~strong)[row_of(comma)]] if len(comma) else comma  # '"A, B","C, D"': commas outside the quotes part
    at, size = np.concatenate([at, comma]), np.concatenate([size, np.ones(len(comma), np.int64)])
    order = np.argsort(at, kind="stable")
    at, size = at[order], size[order]
    plain = ~strong & ~quoted
    plain[list(as_json)] = False
    pieces, rows = _split_at(arr, at, at + size, row_of(at))
    keep = ~plain[rows] & ~np.isin(rows, list(as_json))
    pieces, rows = pieces.filter(pa.array(keep)), rows[keep]
    index = np.flatnonzero(plain)
    more, more_rows = _plain(pa.concat_arrays([arr.take(pa.array(index))])) if len(index) else (pa.array([], pa.string()), np.zeros(0, np.int64))
    json_rows = [i for i, v in as_json.items() for _ in v]
    values = pa.concat_arrays([pieces, more.cast(pa.string()), pa.array([x for v in as_json.values() for x in v], pa.string())])
    parents = np.concatenate([rows, index[more_rows] if len(more_rows) else more_rows, np.array(json_rows, np.int64)]).astype(np.int64)
    values = pc.utf8_trim_whitespace(values)
    from_json = np.arange(len(values)) >= len(values) - len(json_rows)
    wrapped = _matches(values, r'^"[\s\S]*"$') & ~from_json & (pc.binary_length(values).to_numpy(zero_copy_only=False) > 1)
    inner = pc.replace_substring(pc.replace_substring_regex(values, r'^"|"$', ""), '""', '"')
    values = pc.utf8_trim_whitespace(pc.if_else(pa.array(wrapped), inner, values))
    nobody = pc.is_in(pc.utf8_lower(values), pa.array([*SENTINELS, ""])).to_numpy(zero_copy_only=False) | _matches(values, OTHERS)
    values, parents = values.filter(pa.array(~nobody)), parents[~nobody]
    order = np.argsort(parents, kind="stable")
    values, parents = values.take(pa.array(order)), parents[order]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(parents, np.arange(n + 1)).astype(np.int32)), values)
    owner = pc.list_parent_indices(lists).to_numpy()
    starts = lists.offsets.to_numpy()
    return owner, (np.arange(len(values)) - starts[owner] + 1).astype(np.int32), lists.flatten()


def unpack_values(df: DataFrame, column: str, *, keep: Sequence[str] = (), pos_col: str = "pos", value_col: str = "value") -> DataFrame:
    """One row per entry of ``column``: the columns ``keep``, the entry's place from 1, and the entry.

    Cells may be JSON arrays, quoted lists (doubled quotes inside), or entries parted by semicolons, bars,
    line breaks, tabs, bullets, slashes between spaces, commas, 'and' or '&', also mixed. The comma of a
    name ('Family, Given', 'Family, I. J.', a suffix) stays in it. Null, empty and sentinel cells, empty
    entries and 'et al.' give no row; an odd number of quotes means the quotes are ordinary text. Repeated
    cells give repeated rows. A map without shuffle or gathering; extra columns are dropped unless kept.
    """
    from pyspark.sql import types as T

    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(pos_col, T.IntegerType()), T.StructField(value_col, T.StringType())])
    names = [*keep, pos_col, value_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, values = unpack_strings(batch.column(batch.num_columns - 1))
            rest = [batch.column(i).take(pa.array(owner)) for i in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(place, pa.int32()), values], names=names)

    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").cast("string").alias("__cell"))
    return picked.mapInArrow(run, schema)
