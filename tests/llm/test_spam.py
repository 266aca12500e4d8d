import random

import numpy as np
import pytest

from marginalia.llm import spam as sp

PROSE = [
    "The signal of the gene was lost after two days of culture in the older animals.", "We observed no difference between the two protocols, although the effect was small.",
    "Sections were cut at nine microns and fixed for an hour before they were imaged.", "Whether the linker or the domain accounts for the gain remains open to further work.",
    "Cells near the wall expressed the marker at three times the level of their neighbours.", "Future work should test the profile in primary cells and in other tissue.",
    "Of 412 tested variants, 37 passed the filter and 9 showed a significant effect (p < 0.01).", "Mice received 15 mg of the compound; samples were collected after 3, 7 and 21 days.",
    "The boundary of the lobule had moved by 30 microns, as reported by Smith et al. (2019).",
]
SPAM = {
    "keywords": "cheap editing kit, editing kit online, best editing kit, editing kit near me, editing kit discount, buy editing kit, editing kit free shipping, top editing kit",
    "links": "\n".join(f"shop{i}x.example - Acme tissue cutter" for i in "abcdefghijk"),
    "tags": "Tags: SKU-12345, cheap, 40 ml, Acme, discount, SKU-99, promo, lysis buffer, top, SKU-5, free shipping",
    "hashtags": "#editingkitcheap #editingkitbest #editingkitonline #editingkittop #editingkitbuy #editingkitsale",
    "sentences": "If you need an editing kit, this editing kit is the best editing kit and no other editing kit comes close. " * 2 + "We love editing kit and our editing kit shop has editing kit for every editing kit user.",
    "strung": "See spatial kit, genome editing, Acme, spatial kit and Acme now. Find Acme, genome editing, spatial kit, genome editing and Acme here. Read about spatial kit, Acme, genome editing, spatial kit and genome editing today.",
}
HONEST = {
    "references": "\n".join(f"{i}. Smith A., Brown B. (20{i:02d}). Editing and repair in the kidney. Journal of Cells {i}, 1-9. https://doi.org/10.1000/{i}" for i in range(1, 9)),
    "genes": "Genes of the panel: " + ", ".join(f"GEN{i}" for i in range(40)), "table": "\n".join(f"GEN{i}\t0.{i}\t1.{i}" for i in range(30)),
    "steps": " ".join(f"Step {i}. Keep the tube on ice for {i} min before you go on." for i in range(1, 12)),
    "notes": "Users who buy the editing kit online receive the protocol by mail; the price depends on the batch. Questions about the editing kit are answered on weekdays. Each editing kit contains reagents for 6 reactions and should be stored at 6 °C.",
    "menu": "Home > Articles > Authors\n\n" + " ".join(PROSE) + "\nTags: editing, kit", "twice": PROSE[0] + PROSE[0], "odd": "\x00\x01 ​", "number": "1234", "blank": " \n ", "empty": "",
}
CHINESE_SPAM = {
    "keywords": "基因编辑试剂盒 厂家 包邮 优惠 基因编辑试剂盒 价格 便宜 试剂盒 批发 促销 购买 基因编辑试剂盒 网购 推荐 报价 试剂盒 折扣",
    "mixed": "cell cutter counter 厂家 包邮 优惠 tissue 购买 tissue 价格 价格 便宜 counter 包邮 cell cutter 便宜 cell counter 优惠 厂家",
    "tags": "标签：试剂盒，便宜，优惠，包邮，裂解液，促销，组织，打折，批发",
    "links": "\n".join(f"组织切片机 shop{i}x.example" for i in "abcdefghijk"),
    "hashtags": "#编辑试剂盒便宜 #编辑试剂盒推荐 #编辑试剂盒网购 #编辑试剂盒优惠 #编辑试剂盒厂家 #编辑试剂盒促销",
    "sentences": "编辑试剂盒是好的编辑试剂盒，有编辑试剂盒的编辑试剂盒用户对编辑试剂盒和编辑试剂盒仪器在编辑试剂盒中。" * 2,
}
CHINESE_HONEST = {
    "prose": "总之，这一方法便于推广，但仍受切片厚度限制。在其他器官中是否有效，目前尚不清楚。每组包括60只同龄动物，实验重复94次。处理90小时后，该基因的信号明显减弱。组织切片厚度为38微米，固定18小时后成像。",
    "notes": "在线购买试剂盒的用户会在一周之内收到实验的说明；价格取决于批次的大小。关于试剂盒的问题在工作日答复。每个试剂盒含有六次反应的试剂，应在六度以下保存。",
    "menu": "首页 文章 作者 关于", "references": "\n".join(f"{i}. 王某，李某。基因编辑与肾脏修复。细胞杂志，20{i:02d}，{i}：1-9。" for i in range(1, 9)),
    "japanese": "この方法は広く使えますが、切片の厚さに制限されています。細胞の信号は二日後に弱くなりました。ほかの器官でも有効かどうかは、まだわかっていません。",
}


def background(n=200):
    rng = random.Random(1)
    return [" ".join(rng.sample(PROSE, 5)) for _ in range(n)]


def rows_of(*cases):
    rows = [(i, t) for i, t in enumerate(background())]
    for base, texts in cases:
        rows += [(base + i, t) for i, t in enumerate(texts.values())]
    return rows


@pytest.fixture(scope="module")
def shapes(spark):
    pages = sp.page_parts(spark.createDataFrame(list(enumerate(background())), "doc_id long, text string"), "doc_id", "text")
    return sp.prose_shapes(pages)


def judged(text, shapes, **bounds):
    whole, parts = sp.measure([text])
    language = [[*sp.FUNCTION_WORDS, "und"][whole["language"][0]]]
    return {k: v[0] for k, v in sp.judge_pages(language, parts, parts["text"], shapes, **bounds).items()}


@pytest.mark.parametrize("kind", [*SPAM, *(f"zh {k}" for k in CHINESE_SPAM)])
def test_spam_lies_towards_spam(kind, shapes):
    assert judged(CHINESE_SPAM[kind[3:]] if kind.startswith("zh ") else SPAM[kind], shapes)["is_spam"]


@pytest.mark.parametrize("kind", [*HONEST, *(f"zh {k}" for k in CHINESE_HONEST)])
def test_honest_text_does_not(kind, shapes):
    assert not judged(CHINESE_HONEST[kind[3:]] if kind.startswith("zh ") else HONEST[kind], shapes)["is_spam"]


@pytest.mark.parametrize("kind", ["prose", "notes", "japanese"])
def test_chinese_sentences_are_prose(kind, shapes):
    assert judged(CHINESE_HONEST[kind], shapes)["prose"] > 0.9


def test_distance_and_direction_both_decide(shapes):
    honest = [t for t in HONEST.values()]
    plain = [judged(t, shapes)["is_spam"] for t in honest]
    assert [judged(t, shapes, towards=-1e9)["is_spam"] for t in honest] != plain  # far from prose, but not towards spam
    en = shapes["en"]
    mild = {f: np.array([x]) for f, x in zip(sp.FEATURES, en.centre + en.scale * np.array([-2.2, 0, 2.2, -2.2, 0, 0]))}
    part = {**mild, "kind": np.array([sp.STRINGING]), "words": np.array([50.0]), "chars": np.array([300.0])}
    at = lambda far: sp.judge_pages(["en"], part, np.array([0]), shapes, far=far)["is_spam"][0]
    assert en.place(np.array([[x[0] for x in mild.values()]]))[1][0] > sp.TOWARDS and at(0.0) and not at(sp.FAR)  # towards spam, but near


def test_distance_equals_the_formula(shapes):
    shape = shapes["en"]
    x = np.array([[0.1, 0.2, 0.9, 0.5, 0.1, 0.0], shape.centre])
    cov = np.linalg.inv(shape.inverse) * np.outer(shape.scale, shape.scale)
    by_hand = [(v - shape.centre) @ np.linalg.solve(cov, v - shape.centre) for v in x]
    assert np.allclose(shape.place(x)[0], by_hand) and by_hand[1] == 0


def test_disguised_letters_are_read_as_what_they_look_like():
    plain = "The signal of the gene was lost after two days of culture in the older animals. We observed no difference."
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in plain)
    mixed = plain.replace("a", "а").replace("o", "о").replace("e", "е")
    for text in (wide, mixed):
        for f in sp.FEATURES:
            assert np.allclose(sp.measure([text])[1][f], sp.measure([plain])[1][f])


def test_a_sentence_that_stands_there_twice_does_not_recur():
    once = "Shaded areas mark the 4-31 % interval; n = 3 animals per group."
    assert np.allclose(sp.measure([once])[1]["repetition"], sp.measure([f"{once}\n\n{once}"])[1]["repetition"])


def test_chinese_spam_is_found_among_prose(spark):
    out = sp.find_spam(spark.createDataFrame(rows_of((1000, CHINESE_SPAM), (2000, CHINESE_HONEST)), "doc_id long, text string"))
    assert {r.doc_id for r in out.where("is_spam").collect()} == {1000 + i for i in range(len(CHINESE_SPAM))}


def test_texts_are_measured_alike_alone_and_together():
    texts = [*SPAM.values(), *HONEST.values(), "中文" * 20 + "。", "x" * 100_000]
    whole, parts = sp.measure(texts)
    for i, t in enumerate(texts):
        own, own_parts = sp.measure([t])
        assert own["language"][0] == whole["language"][i] and own["chars"][0] == whole["chars"][i]
        for f in (*sp.FEATURES, "kind", "words", "chars"):
            assert np.allclose(own_parts[f], parts[f][parts["text"] == i]), (f, t[:40])


def test_spam_is_found_among_prose(spark):
    rows = rows_of((1000, SPAM), (2000, HONEST)) + [(3000, None), (1000, SPAM["keywords"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as stuffed_by", "1 as words")
    out = sp.find_spam(df)
    assert {r.doc_id for r in out.where("is_spam").collect()} == {1000 + i for i in range(len(SPAM))}
    assert out.count() == len(rows)


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sp.find_spam(df).collect() == []
    none = spark.createDataFrame([(1, None), (2, ""), (None, "...")], "doc_id long, text string")
    assert [r.is_spam for r in sp.find_spam(none).collect()] == [False] * 3
