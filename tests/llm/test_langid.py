import itertools
import random

import numpy as np
from pagequarry.llm import langid
from pagequarry.llm.queries import held_out
from pyspark.sql import functions as F
from tables import awkward, documents, empty

WORDS = {
    "en": ["the", "house", "with", "that", "thing", "water", "through", "night"],
    "de": ["der", "haus", "mit", "dass", "sache", "wasser", "durch", "nächte"],
    "ru": ["дом", "вода", "ночь", "через", "вещь", "что", "где", "когда"],
}


def text_of(lang, rng, n=40):
    return " ".join(rng.choices(WORDS[lang], k=n))


def training(spark):
    rng = random.Random(1)
    langs = [rng.choice(list(WORDS)) for _ in range(300)]
    return documents(spark, [text_of(x, rng) for x in langs], lang=lambda i: langs[i])


def test_viterbi_like_trying_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(0, 6, rng.integers(1, 5))
        scores = rng.normal(size=(int(sizes.sum()), 3)).astype(np.float32)
        got, at = langid.viterbi(scores, sizes, 1.1), 0
        for n in sizes:
            value = lambda path: sum(float(scores[at + i, s]) for i, s in enumerate(path)) - 1.1 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
            best = max((value(p) for p in itertools.product(range(3), repeat=int(n))), default=0.0)
            assert abs(value(tuple(got[at : at + n])) - best) < 1e-4
            at += n


def test_labels_texts_and_spans(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 400)
    model = langid.train(training(spark))
    assert model.languages == ["de", "en", "ru"]
    rng = random.Random(9)
    texts = [text_of(x, rng) for x in WORDS for _ in range(20)]
    mixed = text_of("en", rng, 30) + ". " + text_of("de", rng, 20) + " " + text_of("ru", rng, 10)
    got = {r["doc_id"]: r for r in langid.identify(documents(spark, [*texts, mixed]), model).collect()}
    assert [got[i]["lang_pred"] for i in range(60)] == ["en"] * 20 + ["de"] * 20 + ["ru"] * 20
    assert all(0.9 < got[i]["score"] <= 1 for i in range(60))
    assert [tuple(s) for s in got[60]["spans"]] == [(0, 30, "en"), (30, 50, "de"), (50, 60, "ru")]
    assert got[60]["lang_pred"] == "en" and got[60]["score"] < 0.7


def test_only_the_text_counts(spark):
    model = langid.train(training(spark))
    docs = documents(spark, [text_of("de", random.Random(3))] * 3, lang=lambda i: "xyz"[i], source=lambda i: None)
    rows = langid.identify(docs, model).select("lang_pred", "score").distinct().collect()
    assert len(rows) == 1 and rows[0]["lang_pred"] == "de"


def test_sample_is_bounded_and_ignores_null_labels(spark):
    docs = training(spark).withColumn("lang", F.when(F.col("lang") != "ru", F.col("lang")))
    model = langid.train(docs, sample=5, grams=20)
    assert model.languages == ["de", "en"]
    assert len(model.scores) + len(model.scripts) <= 40


def test_without_training_rows_all_is_unknown(spark):
    model = langid.train(empty(spark))
    rows = langid.identify(awkward(spark), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)} and len(rows) == 11


def test_awkward_rows(spark):
    model = langid.train(training(spark))
    for row, source in zip(langid.identify(awkward(spark).coalesce(1), model).collect(), awkward(spark).collect()):
        letters = any(map(str.isalpha, source["text"] or ""))
        assert (row["lang_pred"] != "und") == letters and 0 <= row["score"] <= 1
    assert langid.identify(empty(spark), model).collect() == []
    numerals = langid.identify(documents(spark, ["½ ² Ⅷ 12"]), model).first()
    assert (numerals["lang_pred"], numerals["score"]) == ("und", 0.0)


def test_held_out_documents(spark):
    import zlib

    rows = spark.range(50).select("id", held_out("id").alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_accuracy_on_documents_kept_from_training(spark):
    from pagequarry.llm.queries import language_id

    folder = "/root/testdata/sf0.001"
    known = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = language_id(spark, folder).where("held_out").join(known, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_copies_do_not_shrink_the_sample(spark):
    # Nearly all rows of one language are copies of a few texts.
    rng = random.Random(4)
    few = {x: [text_of(x, rng, 12) for _ in range(20)] for x in ("de", "en")}
    rows = [("de", few["de"][i % 20]) for i in range(20_000)] + [("en", t) for t in few["en"]]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    got = langid.train(labelled, sample=20)
    assert got.languages == ["de", "en"]
    once = spark.createDataFrame([(x, t) for x in few for t in few[x]], "lang string, text string")
    want = langid.train(once, sample=20)
    assert got.scores.keys() == want.scores.keys()
    assert all(np.array_equal(got.scores[g], want.scores[g]) for g in want.scores)
