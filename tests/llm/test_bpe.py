import random

import public_tokenizers
import pytest
from pagequarry.llm import bpe
from tables import awkward, documents, empty
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(texts):
    encoder = bpe.Encoder(bpe.load(PATH))
    numbers = [encoder.number(t) for t in texts]
    encoder.learn()
    return [encoder.ids(n)[0].tolist() for n in numbers]


def test_every_code_point(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}'S" for c in points]
    for start in range(0, len(texts), 100_000):
        part = texts[start : start + 100_000]
        assert encoded(part) == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_random_texts(library):
    rng = random.Random(4)
    pieces = list("aabbcdehstnoé  'L1\n_-") + ["<|endoftext|>", "<|startoftext|>", "<|", "the", "ing", "İ", "ΑΣ", "é", "日本"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 80))) for _ in range(5000)]
    texts += ["a" * 1001, "aaab" * 50, "ababab" * 30, ""]
    assert encoded(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encode_and_decode_jobs(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "TOKENS", 7)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 10)
    texts = [f"Hello wörld number {i} don't {'x' * (i % 9)}" for i in range(40)] + [None, "", " ", "<|endoftext|>"]
    rows = bpe.decode(bpe.encode(documents(spark, texts), PATH, decoded="same_task"), PATH).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row["same_task"] == row["decoded"]
        want = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["ids"] == want
        assert row["decoded"] == library.decode(want, skip_special_tokens=False)


def test_long_text_in_pieces(library):
    text = " ".join(["Größe", "naïve", "don't", "x1"] * 60)
    encoder = bpe.Encoder(bpe.load(PATH))
    parts = [encoder.encode(p).tolist() for p in bpe.pieces(text, 40)]
    assert len(parts) > 10 and "".join(bpe.pieces(text, 40)) == text
    assert sum(parts, []) == library.encode(text, add_special_tokens=False).ids


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([(1, [3306, -1, 10**6, 1002]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, PATH).collect()}
    assert got == {1: "hello</w> world</w>", 2: None, 3: ""}


def test_awkward_rows_and_empty_table(spark, library):
    for row, source in zip(bpe.encode(awkward(spark).coalesce(1), PATH).collect(), awkward(spark).collect()):
        assert row["doc_id"] == source["doc_id"]
        assert row["ids"] == library.encode(source["text"] or "", add_special_tokens=False).ids
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).collect() == []
