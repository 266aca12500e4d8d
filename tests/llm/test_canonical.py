import random
import time

import pytest

from marginalia.llm import canonical as cn

ENTRIES = ("primary T cells", "primary B cells", "house mouse", "StripeFISH", "TileFISH", "in vivo delivery screen", "in vitro delivery screen", "Gridmark array", "Gridmark HD array", "tissue microarray core", "cytosine base conversion")
ALIASES = (("GM", "Gridmark array"), ("Mus musculus", "house mouse"))


@pytest.mark.parametrize(
    "value,expected",
    [
        ("  PRIMARY_t-cells ", "primary T cells"), ("primay Bcells", "primary B cells"), ("the house mouse [12]", "house mouse"), ("Ｍus musculus.", "house mouse"), ("cells, primary t", "primary T cells"),
        ("tissue micro", "tissue microarray core"), ("tiss. microar. core", "tissue microarray core"), ("TMC", "tissue microarray core"), ("StripeFIISH", "StripeFISH"), ("Gridmark HD array (main)", "Gridmark HD array"),
        ("gm", "Gridmark array"), ("house mouses", "house mouse"), ("cyto. base convers.", "cytosine base conversion"),
        ("primary NK cells", ""), ("ex vivo delivery screen", ""), ("GridFISH", ""), ("primary", ""), ("field mouse", ""), ("house mouse and StripeFISH", ""), ("?", ""), ("​", ""),
    ],
)
def test_values(value, expected):
    assert cn.canonical_of(value, ENTRIES, ENTRIES, ALIASES) == expected


def test_entry_missing_from_the_own_list_is_no_match():
    own = [e for e in ENTRIES if e != "primary B cells"]
    assert cn.canonical_of("primary B cels", own, ENTRIES, ALIASES) == ""
    assert cn.canonical_of("primary B cells", own, ENTRIES, ALIASES) == ""


def test_longest_mention_wins_and_slips_are_counted():
    lex = cn.Lexicon(ENTRIES, ALIASES)
    assert cn.find("a Gridmark HD array, then GM", [lex]) is None and cn.find("a Gridmark HD array", [lex]) == "Gridmark HD array"
    assert cn.slips("abcd", "abdc", 2) == 1 and cn.slips("abc", "xyz", 2) == 3 and cn.slips("", "ab", 2) == 2


TOOLS = ("Prime editing", "Base editing", "Zinc finger nuclease", "TALE nuclease")


@pytest.mark.parametrize(
    "value,expected",
    [
        ("prime genome editing", "Prime editing"), ("nuclease with zinc finger", "Zinc finger nuclease"), ("zinc finger based nuclease", "Zinc finger nuclease"),
        ("editing", ""), ("genome editing", ""), ("editing of prime or base kind", ""), ("nuclease", ""), ("finger protein nuclease", ""), ("meganuclease", ""),
    ],
)
def test_words_in_any_order_with_others_between(value, expected):
    assert cn.canonical_of(value, TOOLS, TOOLS, ()) == expected


def test_indexed_likenesses_equal_a_scan_of_all_names():
    rng = random.Random(3)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.randint(2, 14))).strip() or "x" for _ in range(300)]
    lex = cn.Lexicon(names)
    for _ in range(300):
        name = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(name) + 1)
            if rng.random() < 0.5:
                name.insert(i, rng.choice("abcde "))
            elif len(name) > 1:
                del name[min(i, len(name) - 1)]
        value = "".join(name)
        own = cn.words(value)
        if not own:
            continue
        solid = "".join(own)
        near: dict[str, int] = {}
        for key, entry in lex.names.items():
            k = "".join(key)
            d = cn.slips(solid, k, cn.allowed_slips(len(k)))
            if d <= cn.allowed_slips(len(k)) and not cn._other_word(own, key):
                near[entry] = max(-d, near.get(entry, -99))
        assert lex.slipped(own, value) == near
        starts = {e for k, e in lex.names.items() if len(solid) >= 5 and "".join(k).startswith(solid) and len(solid) >= 0.5 * len("".join(k)) and k[: len(own) - 1] == own[:-1]}
        assert set(lex.truncated(own, value)) == starts or len(starts) > 1 and len(lex.truncated(own, value)) > 1


def test_large_lists_and_differing_row_lists_take_little_time():
    rng = random.Random(4)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(100_000)})
    lex = cn.Lexicon(names)
    values = [rng.choice(names)[:-1] + "q" for _ in range(500)] + [word() + " " + word() for _ in range(500)] + [" ".join(reversed(rng.choice(names).split())) + " new" for _ in range(500)]
    began = time.perf_counter()
    for i, v in enumerate(values):
        cn.entry_of(v, [f"own entry {i}"], lex)
    assert (time.perf_counter() - began) / len(values) < 0.01


def tables(spark):
    rows = [("1", "housemouse", ["house mouse"], "Species"), ("1", "housemouse", ["house mouse"], "Species"), ("2", None, ["house mouse"], "Species"), ("3", " ", ["house mouse"], "Species"), ("4", "house mouse", None, "Species"), ("5", "Mus musculus", ["x", None, "House Mouse"], "Species"), ("6", "own entri", ["own entry"], None), (None, "z" * 50_000, [], "Other")]
    return spark.createDataFrame(rows, "id string, v string, own array<string>, col string"), spark.createDataFrame([("Species", ["house mouse", None], {"Mus musculus": "house mouse"}), ("Species", None, None), (None, ["q"], None)], "col string, allowed_values array<string>, aliases map<string,string>")


@pytest.mark.parametrize("most", [100_000, 0])
def test_rows(spark, monkeypatch, most):
    monkeypatch.setattr(cn, "MOST_NAMES", most)
    df, ref = tables(spark)
    out = cn.map_to_list(df, ref, value="v", allowed="own", list_key="col", keep=("id",)).collect()
    assert sorted((r.id or "", r.canonical_value) for r in out) == [("", ""), ("1", "house mouse"), ("1", "house mouse"), ("2", ""), ("3", ""), ("4", ""), ("5", "House Mouse"), ("6", "own entry")]


def test_empty_tables(spark):
    df, ref = tables(spark)
    assert cn.map_to_list(df.limit(0), ref, value="v", allowed="own", list_key="col", keep=("id",)).collect() == []
    assert cn.map_to_list(df, ref.limit(0), value="v", allowed="own", list_key="col", keep=("id",)).count() == df.count()
