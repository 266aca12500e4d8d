import re
import time
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import split as sp


@settings(max_examples=300, deadline=None)
@given(st.text("ab .\n,é́中。", max_size=90), st.integers(-2, 30), st.integers(-2, 30))
def test_pieces_cover_the_text_within_the_limit_and_share_the_overlap(text, limit, overlap):
    shared = max(0, overlap)
    if text and len(text) > limit and (limit < 1 or shared >= limit):
        with pytest.raises(ValueError):
            sp.split_text(text, limit, overlap)
        return
    ranges = sp.split_text(text, limit, overlap)
    if not text:
        assert ranges == []
        return
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in ranges)
    assert all(c == b - shared and d > b for (_, b), (c, d) in zip(ranges, ranges[1:]))


def cheapest(text, limit, overlap):
    """Least cost of all divisions into the fewest pieces or one more, by trying every choice of cuts."""
    n = len(text)
    at, cost = sp.candidates(text, limit, overlap)
    found = {}
    for k in range(1, len(at) + 2):
        even = (n - overlap) / k + overlap
        for chosen in combinations(range(len(at)), k - 1):
            stops = [*at[list(chosen)], n]
            sizes = [b - a + (overlap if i else 0) for i, (a, b) in enumerate(zip([0, *stops], stops))]
            if max(sizes) <= limit:
                found[k] = min(found.get(k, np.inf), sum(cost[list(chosen)]) + sp.BALANCE * sum(((s - even) / limit) ** 2 for s in sizes))
        if found and k > min(found):
            break
    return min(found.values()), found


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n,;-", min_size=12, max_size=36), st.integers(9, 15), st.integers(0, 8))
def test_whole_division_equals_brute_force(text, limit, overlap):
    if len(text) <= limit or len(sp.candidates(text, limit, overlap)[0]) > 16:
        return
    best, by_pieces = cheapest(text, limit, overlap)
    ranges = sp.split_text(text, limit, overlap)
    at, cost = sp.candidates(text, limit, overlap)
    price = dict(zip(at.tolist(), cost.tolist()))
    even = (len(text) - overlap) / len(ranges) + overlap
    own = sum(price[b] for _, b in ranges[:-1]) + sp.BALANCE * sum(((b - a - even) / limit) ** 2 for a, b in ranges)
    assert np.isclose(own, best) and len(ranges) in by_pieces


def test_layers_solved_in_order_equal_layers_solved_by_matrix():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, int(rng.integers(1, 80)))) for _ in range(2))
        room = int(rng.integers(20, 200))
        lo, hi = np.searchsorted(a, b - room), np.searchsorted(a, b)
        keep = lo < hi
        if not keep.any():
            continue
        args = (rng.choice(sp.PENALTY, len(a)).astype(float), a, b[keep], float(rng.integers(-50, 50)), 0.001, lo[keep], hi[keep])
        assert np.allclose(sp._dense(*args)[1], sp._ordered(*args)[1])


def test_an_overlap_of_most_of_the_limit_is_kept():
    ranges = sp.split_text("word " * 1000, 1000, 600)
    assert all(b - c == 600 for (_, b), (c, _) in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("text", ["abc\n" * 60_000, "word word. " * 20_000, "x" * 200_000], ids=["lines", "words", "none"])
def test_many_boundaries_take_little_time_and_memory(text):
    tracemalloc.start()
    began = time.perf_counter()
    ranges = sp.split_text(text, 60_000, 500)
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ranges) in (4, 5) and took < 20 and peak < 300e6  # tracing itself slows it down


def test_cuts_at_natural_boundaries_where_they_allow_it():
    text = "First sentence here. " * 30 + "\n\n" + "Second paragraph, with a clause. " * 20
    ranges = sp.split_text(text, 300, 20)
    assert all(text[:b].endswith((" ", "\n")) and text[:b].rstrip()[-1] == "." for _, b in ranges[:-1])


def test_division_is_the_cheapest_of_all():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, limit, overlap = int(rng.integers(30, 60)), 20, 4
        at = np.sort(rng.choice(np.arange(overlap + 1, n), 9, replace=False))
        cost = rng.choice(sp.PENALTY, 9)
        fewest = sp._fewest(n, limit, overlap, at)
        for k in range(1, 7):
            value, ends = sp._divide(n, limit, overlap, at, cost, k)
            even = (n - overlap) / k + overlap
            best = np.inf
            for chosen in combinations(range(9), k - 1):
                stops = [*at[list(chosen)], n]
                sizes = [b - a + (overlap if i else 0) for i, (a, b) in enumerate(zip([0, *stops], stops))]
                if max(sizes) <= limit:
                    best = min(best, sum(cost[list(chosen)]) + sp.BALANCE * sum(((s - even) / limit) ** 2 for s in sizes))
            assert np.isclose(value, best) or (np.isinf(value) and np.isinf(best))
            assert fewest is None or k >= fewest or np.isinf(best)


@settings(max_examples=300, deadline=None)
@given(st.text("ab -/_\n\x1c\xa0\u2003é中1.", max_size=40))
def test_word_boundaries_equal_the_pattern(text):
    pattern = re.compile(r"\s+|(?<=\w)-(?=\w)|/")
    assert sp.boundaries(text, 4).tolist() == [m.end() for m in pattern.finditer(text)]


def test_hard_cuts_stay_even_and_never_part_a_cluster():
    assert len(sp.split_text("A" * 10_000, 900, 60)) == 12
    text = "é" * 500
    assert all(not text[b:].startswith("́") for _, b in sp.split_text(text, 101, 0)[:-1])


def test_rows_with_nulls_repeats_and_extra_columns(spark):
    rows = [("a", "x" * 25, 10, 2, 1), ("a", "x" * 25, 10, 2, 1), ("b", None, 10, 2, 1), ("c", "", 10, 2, 1), ("d", "short", None, 2, 1), ("e", "y" * 15, 10, None, 1), (None, "z" * 30, 10, 3, None)]
    df = spark.createDataFrame(rows, "id string, t string, cap int, shared int, start int")
    out = sp.split_texts(df, "t", "cap", "shared", keep=("id",)).collect()
    assert {r.id: r.n_pieces for r in out} == {"a": 3, "d": 1, "e": 2, None: 4}
    assert sum(r.id == "a" for r in out) == 6
    assert sp.split_texts(df.limit(0), "t", "cap", "shared").collect() == []
    never = sp.split_texts(spark.createDataFrame([("f", "y" * 15, 10, 10), ("g", "y" * 15, 0, 0), ("h", "y" * 10, 10, 10)], "id string, t string, cap int, shared int"), "t", "cap", "shared", keep=("id",))
    assert {(r.id, r.n_pieces, r.piece_text) for r in never.collect()} == {("f", 0, None), ("g", 0, None), ("h", 1, "y" * 10)}
    assert {r.id for r in sp.split_texts(df, "t", "cap", "shared", keep=("id",), only_oversized=True).collect()} == {"a", "e", None}
