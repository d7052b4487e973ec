import random

import pytest
from pyspark.sql import functions as F

from panelcast.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "B", "é", "1", "²", "'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", " \n", "!", "<|endoftext|>", "漢", "\u200b", "\xa0",
            "\x1c", "\x85", "🙂", "don't", "x'veq", "''s", " 's", "%%%", "\u0301", "०", "\U00013460", "\U0001E5F1", "\x00", "\ufffd"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.load_codec(PATH)


def ids_of(codec, texts):
    return [[int(i) for i in line.split(",")] if line else [] for line in codec.encode_texts(texts)]


def test_ids_are_the_librarys(library, codec):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(codec, texts) == want
    assert [codec.decode_ids(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want] == texts


def test_every_code_point_has_the_librarys_class(library, codec):
    for start in range(0, 0x110000, 0x800):
        chars = [chr(c) for c in range(start, start + 0x800) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}!" for c in chars)
        if chars:
            assert sum(codec.words(text), []) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(start)


@pytest.mark.parametrize("text", ["x" * 30_000, "ab" * 9_000 + " " + "é" * 3_000, "a b'll \n" * 20_000, " " * 9_000 + "x", "\n " * 9_000])
def test_long_texts_and_long_words(library, text, monkeypatch):
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 1000)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    assert ids_of(bpe.load_codec(PATH), [text, "b", "", text[:77]]) == [
        library.encode(t, add_special_tokens=False).ids for t in (text, "b", "", text[:77])]


def test_one_tree_and_many_trees_agree(codec):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(1, 60))).encode() for _ in range(300)]
    for word, ids in zip(words, codec._merge(words, 64)):
        assert ids.tolist() == codec._merge_long(word)


def test_unknown_ids_and_broken_bytes(library, codec):
    assert codec.decode_ids([10 ** 6, 50256, -3]) == "<|endoftext|>"
    broken = [library.token_to_id("Ã"), library.token_to_id("a") or 64]
    assert codec.decode_ids(broken) == library.decode(broken, skip_special_tokens=False)


def test_frames(spark, library):
    rows = [(1, "Hello there<|endoftext|>", "x"), (1, "Hello there<|endoftext|>", "x"), (None, None, None), (3, "", "y"), (4, "é" * 5000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    coded = bpe.encode(docs, PATH)
    got = sorted(((r.doc_id, r.n_tokens, r.ids) for r in coded.collect()), key=str)
    want = sorted(((i, len(x), x) for i, x in ((i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)), key=str)
    assert got == want
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(coded, PATH).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert bpe.encode(docs.limit(0), PATH).collect() == bpe.round_trip(docs.where(F.lit(False)), PATH).collect() == []
