import json
import random

import pyarrow as pa
import pytest

from marginalia.operators.unpack import unpack_strings, unpack_values

CASES = [
    ("Ann Lee; Bo Ray", ["Ann Lee", "Bo Ray"]), ("Ann Lee|Bo Ray||", ["Ann Lee", "Bo Ray"]), ("Lee, Ann; Ray, Bo B.", ["Lee, Ann", "Ray, Bo B."]), ("Lee, A., Ray, B. C. and de Vos, D.", ["Lee, A.", "Ray, B. C.", "de Vos, D."]),
    ("Lee A, Ray BC, et al.", ["Lee A", "Ray BC"]), ("Ann Lee, Bo Ray, and Cy Fox", ["Ann Lee", "Bo Ray", "Cy Fox"]), ("Ann Lee, & Bo Ray", ["Ann Lee", "Bo Ray"]), ("Lee, Ann and Ray, Bo and Fox, Cy C.", ["Lee, Ann", "Ray, Bo", "Fox, Cy C."]),
    ("Lee, Ann", ["Lee, Ann"]), ("van der Vos, Dee P.", ["van der Vos, Dee P."]), ("Ann Lee,Bo Ray", ["Ann Lee", "Bo Ray"]), ("Ann Lee, Jr.; Bo Ray III", ["Ann Lee, Jr.", "Bo Ray III"]), ("Ann Lee, Jr., Bo Ray", ["Ann Lee, Jr.", "Bo Ray"]), ("Ann Lee, PhD", ["Ann Lee, PhD"]),
    ('"Lee, Ann","Ray, Bo ""Bee"""', ["Lee, Ann", 'Ray, Bo "Bee"']), ('"Gene Network, Ooze and Mevur";"Bo Ray"', ["Gene Network, Ooze and Mevur", "Bo Ray"]), ('["L\\u00e9e, Ann", "Bo Ray"]', ["Lée, Ann", "Bo Ray"]), ("[not json", ["[not json"]),
    ("Ann Lee\n\nBo Ray\tCy Fox • Di Oh", ["Ann Lee", "Bo Ray", "Cy Fox", "Di Oh"]), ("Ann Lee / Bo Ray | Cy Fox", ["Ann Lee", "Bo Ray", "Cy Fox"]), ("Ann Lee · Bo Ray", ["Ann Lee", "Bo Ray"]), ("Acme Working Group; Bo Ray ; et al. ", ["Acme Working Group", "Bo Ray"]),
    ("Ann-Marie O'Neil & Bo Ray", ["Ann-Marie O'Neil", "Bo Ray"]), ('Ann "Odd Lee; Bo Ray', ['Ann "Odd Lee', "Bo Ray"]), ("", []), ("  ", []), ("-", []), ("N/A", []), ("NOT_FOUND", []), ("et al.", []), (";;;", []), (None, []), ("[]", []), ('[1, "Bo Ray", null]', ["Bo Ray"]),
]


def entries(cells):
    owner, place, values = unpack_strings(pa.array(cells, pa.string()))
    out = [[] for _ in cells]
    for i, p, v in zip(owner, place, values.to_pylist()):
        out[i].append(v)
        assert len(out[i]) == p
    return out


@pytest.mark.parametrize("cell,expected", CASES)
def test_cells(cell, expected):
    assert entries([cell]) == [expected]


def test_cells_do_not_touch_each_other():
    rng = random.Random(3)
    for _ in range(20):
        picked = [rng.choice(CASES) for _ in range(rng.randint(0, 40))]
        assert entries([c for c, _ in picked]) == [e for _, e in picked]


def test_packing_and_unpacking_is_a_round_trip():
    rng = random.Random(4)
    names = ["Ann Lee", "Lee, Ann", "Vos, D. E.", 'Ray "B" Bo', "Gene Network, Ooze and Mevur", "Jé Ñu", "Bo Ray, Jr."]
    pack = lambda xs, sep: sep.join('"' + x.replace('"', '""') + '"' for x in xs)
    lists = [[rng.choice(names) for _ in range(rng.randint(1, 9))] for _ in range(300)]
    for sep in (";", "; ", ",", ", ", "|", "\n"):
        assert entries([pack(x, sep) for x in lists]) == lists
    assert entries([json.dumps(x) for x in lists]) == lists


def test_rows(spark):
    df = spark.createDataFrame([("a", "X Y; Z W", 1), ("a", "X Y; Z W", 1), ("b", None, 2), (None, "Q R", 3), ("c", "; ".join(["A B"] * 20_000), 4)], "row_id string, authors string, __cell int")
    out = unpack_values(df, "authors", keep=("row_id",)).groupBy("row_id").count().collect()
    assert {r.row_id: r["count"] for r in out} == {"a": 4, None: 1, "c": 20_000}
    assert unpack_values(df.limit(0), "authors", keep=("row_id",)).collect() == []
