import random

import numpy as np
import pytest

from marginalia.llm import encode as en
from marginalia.llm.encode import Encoder, boundaries, count_tokens, default_vocabulary, encode_texts, groups_of

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_vocabulary())


def ids_of(encoder, texts):
    ids, counts, ends = encoder.encode_batch(texts)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])], [ends[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_same_ids_as_the_library_on_random_texts(library, encoder):
    rng = random.Random(5)
    letters = "ab's \n\t é1٣²-.,'’lrevmtd́中🧬\x1c\x85​\r\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "  \n", "don't they'll 'vex ''s", "<|endoftext|>", "ACGT" * 3000, "x" * 5000, "\n" * 999, " '" * 40]
    assert ids_of(encoder, texts)[0] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_and_offsets(encoder):
    texts = ["Größe 12,5 µm\r\n\tund mehr", "naïve café 🧬", ""]
    ids, ends = ids_of(encoder, texts)
    for text, own, end in zip(texts, ids, ends):
        assert encoder.decode(own) == text
        assert not own or end[-1] == len(text)
        for k in range(len(own)):
            if k + 1 == len(own) or end[k + 1] != end[k]:
                assert encoder.decode(own[: k + 1]) == text[: end[k]]


def test_memo_starts_anew_without_changing_ids(encoder, monkeypatch):
    texts = [f"word{i} und {i * 7}" for i in range(300)]
    before = ids_of(encoder, texts)[0]
    monkeypatch.setattr("marginalia.llm.encode.MEMO_SIZE", 10)
    assert [ids_of(encoder, [t])[0][0] for t in texts] == before


def test_separators_part_texts():
    points = np.array([ord(c) for c in "ab\nab\n"], np.uint32)
    assert boundaries(points, np.array([2, 5])).tolist() == [0, 2, 3, 5]


def test_groups_cover_all_texts():
    texts = ["x" * 1_500_000, "y", "z" * 3_000_000, ""]
    spans = list(groups_of(texts))
    assert spans[0][0] == 0 and spans[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_null_empty_repeated_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hello world", "c"), (3, "hello world", "c"), (None, "x", None)], "doc_id long, text string, ids string")
    rows = sorted(encode_texts(df, "doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [len(r.ids) for r in rows] == [0, 0, 2, 2, 1]
    with_ends = encode_texts(df, "doc_id", "text", offsets=True).where("doc_id = 3").first()
    assert with_ends.ends == [5, 11]
    assert encode_texts(df.limit(0), "doc_id", "text").collect() == []
    assert sorted(r.n_tokens for r in count_tokens(df, "text").collect()) == [0, 0, 1, 2, 2]


def test_very_long_texts_are_encoded_in_parts(encoder, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice(["don't ", "a", "  ", " 12", "\n", "é ", "'s", " '", "\t "]) for _ in range(3000))
    whole = ids_of(encoder, [text])
    monkeypatch.setattr("marginalia.llm.encode.GROUP_CHARS", 50)
    assert ids_of(encoder, [text]) == whole


def test_pieces_of_equal_hash_keep_their_own_ids(monkeypatch):
    texts = ["one two three", "two  three four", "", "naïve 12345 naïve"]
    right = en.Encoder(en.default_vocabulary()).encode_batch(texts)[0].tolist()
    monkeypatch.setattr(en, "piece_hashes", lambda points, starts: starts.astype(np.uint64) % np.uint64(2))
    one = en.Encoder(en.default_vocabulary())
    assert one.encode_batch(texts)[0].tolist() == right and one.encode_batch(texts[::-1] + texts)[0].tolist()[-len(right):] == right
