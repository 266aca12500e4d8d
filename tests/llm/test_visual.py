import random
import unicodedata

import pytest

from marginalia.llm import visual as vs


def fold(x):
    return vs.transducer().fold(x)


def test_forms_that_read_the_same():
    same = [("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("café", "café"), ("a​­b", "ab"), ("x  y", "x y"), ("рaуѕ", "pays"), ("eﬃcient", "efficient"), ("10 Å", "10 Å"), ("a‐b‑c－d", "a-b-c-d"), ("ё", "ё"), ("a\r\n\tb", "a b"), ("µ", "μ")]
    for a, b in same:
        assert fold(a) == fold(b), (a, b)


def test_hangul_is_composed_and_single_letters_stay():
    assert fold("\u1112\u1161\u11ab\u1100\u1173\u11af") == "한글" == fold("한글")
    assert fold("\uac00\u11a8") == fold("\u1100\u1161\u11a8") == "각"
    assert fold("ㄱㅏ") == "ㄱㅏ" == fold(fold("ㄱㅏ")) and fold("ﾡￂ") == "ㄱㅏ"


def test_letters_of_other_scripts_drawn_alike():
    assert fold("ᎪᏴᏟ ꓮꓐꓚ") == "ABC ABC" and fold("հօոս") == "honu" and fold("ı") != fold("i")


def test_real_differences_stay():
    for a, b in [("Cell", "cell"), ("café", "cafe"), ("10²", "102"), ("1–2", "1-2"), ("CO₂", "CO2"), ("½", "1/2"), ("a−b", "a-b"), ("²", "2"), ("①", "1")]:
        assert fold(a) != fold(b), (a, b)


def test_batches_equal_single_texts_and_are_stable():
    rng = random.Random(1)
    letters = "aаéé  ​\t\nﬁǆＡ１²ﾞカ̂x-‑–όόёёKΩ…½"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    together = vs.transducer().fold_all(texts)
    assert together == [fold(t) for t in texts]
    assert vs.transducer().fold_all(together) == together


def test_compiled_tables_equal_clusters_over_all_letters_and_marks():
    t = vs.transducer()
    rng = random.Random(9)
    letters = [chr(i) for i in range(0x20, 0x32000) if not 0xD800 <= i < 0xE000 and t.kind[i] in (vs.PLAIN, vs.ONE, vs.MANY)]
    marks = [chr(i) for i in range(0x300, 0x32000) if t.kind[i] == vs.MARK]
    texts = [rng.choice(letters) + rng.choice(marks) for _ in range(20_000)] + [x + "\u0301" for x in letters[:3000]] + [x for x in letters if t.kind[ord(x)] == vs.MANY]
    texts += ["".join(rng.choice((rng.choice(letters), rng.choice(marks), "e\u0301", "\u200b", " ")) for _ in range(6)) for _ in range(5000)]
    together = t.fold_all(texts)
    assert together == [fold(x) for x in texts]
    often = ["e\u0301", "а\u0301", "ﬁ", "x\u0323"]
    assert [fold(x) for x in often] == t.fold_all(often) == ["é", "á", "fi", "x\u0323"]


def test_groups_do_not_matter(monkeypatch):
    texts = ["a  b", "ﬁ" * 30, "", "x" * 40, "рау"]
    whole = vs.transducer().fold_all(texts)
    monkeypatch.setattr(vs, "GROUP_CHARS", 20)
    assert vs.transducer().fold_all(texts) == whole


def test_compiler_refuses_conflicts(monkeypatch):
    monkeypatch.setattr(vs, "LOOK_ALIKES", ("aх", "bх"))
    with pytest.raises(ValueError):
        vs.Transducer()


def test_no_raised_or_lowered_digit_is_mapped():
    t = vs.transducer()
    for i in range(0x3000):
        if unicodedata.decomposition(chr(i)).startswith(("<super>", "<sub>", "<fraction>", "<circle>")):
            assert t.kind[i] in (vs.PLAIN, vs.MARK), chr(i)


def test_anchors_of_a_stretch_are_anchors_of_the_text():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(60, 300)))
        n = rng.randint(1, 60)
        at = rng.randrange(0, len(text) - n + 1)
        quote = text[at : at + n]
        tier = vs.tier_of(len(quote))
        own = set(vs.anchors(quote, tier).tolist())
        assert own and own <= set(vs.anchors(text, tier).tolist())


def rows_of(spark):
    quotes = [("q1", "p", 1, "ｓmall edits"), ("q2", "p", 1, "small edits"), ("q3", "p", 2, "сells"), ("q4", None, 1, "x"), ("q5", "p", None, "x"), ("q6", "p", 1, None), ("q7", "p", 1, "  "), ("q8", "p", 1, "cafe"), ("q1", "p", 1, "ｓmall edits")]
    texts = [("t1", "p", 1, "many small edits here, café"), ("t2", "p", 2, "many cells"), ("t2", "p", 2, "many cells"), ("t3", "p", 1, None), ("t4", None, None, "x")]
    return spark.createDataFrame(quotes, "qid string, pdf string, page int, quote string"), spark.createDataFrame(texts, "tid string, pdf string, page int, body string")


NAMES = {"quote_id": "qid", "quote": "quote", "text_id": "tid", "text": "body", "keys": ("pdf", "page")}


def test_quotes_are_found_by_both_ways(spark):
    q, t = rows_of(spark)
    for most in (64, 0):
        found = vs.find_quotes(q, t, most_per_group=most, **NAMES).collect()
        assert sorted(map(tuple, found)) == [("q1", "t1"), ("q3", "t2")], most


def test_both_ways_agree_with_brute_force(spark):
    rng = random.Random(3)
    texts = [(f"t{i}", "p", i % 3, "".join(rng.choice("abcdefgh аеo-‐  ") for _ in range(400))) for i in range(12)]
    quotes = []
    for i in range(60):
        body = rng.choice(texts)
        n = rng.choice([3, 8, 15, 30, 70])
        at = rng.randrange(0, 400 - n)
        quotes.append((f"q{i}", "p", body[2], body[3][at : at + n].translate({ord("a"): "а", ord("-"): "‑"})))
    q, t = spark.createDataFrame(quotes, "qid string, pdf string, page int, quote string"), spark.createDataFrame(texts, "tid string, pdf string, page int, body string")
    brute = {(a[0], b[0]) for a in quotes for b in texts if a[2] == b[2] and fold(a[3]).strip() and fold(a[3]).strip() in fold(b[3]) and a[3] not in b[3]}
    for most in (64, 1):
        assert {tuple(r) for r in vs.find_quotes(q, t, most_per_group=most, **NAMES).collect()} == brute


@pytest.mark.parametrize("most", [64, 0])
def test_one_id_with_several_quotes_finds_the_texts_of_each(spark, most):
    q = spark.createDataFrame([("q", "p", 1, "ｓmall edits of the first kind"), ("q", "p", 1, "ｏther words of the second kind")], "qid string, pdf string, page int, quote string")
    t = spark.createDataFrame([("t1", "p", 1, "small edits of the first kind"), ("t2", "p", 1, "other words of the second kind")], "tid string, pdf string, page int, body string")
    assert sorted(map(tuple, vs.find_quotes(q, t, most_per_group=most, **NAMES).collect())) == [("q", "t1"), ("q", "t2")]


def test_empty_tables_and_clashing_columns(spark):
    q, t = rows_of(spark)
    assert vs.find_quotes(q.limit(0), t, **NAMES).collect() == []
    assert vs.find_quotes(q, t.limit(0), **NAMES).collect() == []
    q2 = q.withColumnRenamed("quote", "body").withColumn("k0", q["qid"])
    assert vs.find_quotes(q2, t.withColumn("quote", t["tid"]).withColumn("qids", t["tid"]), **NAMES | {"quote": "body"}).count() == 2


def test_fold_texts_keeps_rows(spark):
    df = spark.createDataFrame([(None,), ("",), ("ﬁ" * 100_000,)], "x string")
    assert [len(r.y) if r.y is not None else None for r in vs.fold_texts(df, {"x": "y"}).collect()] == [None, 0, 200_000]
