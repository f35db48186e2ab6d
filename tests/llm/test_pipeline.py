import hashlib
import re

import corpus_pipeline
import public_tokenizers
from pagequarry.llm import langid, mixing, secretscan
from pagequarry.llm.queries import BPE_FILE, QUERIES, documents, language_model
from pyspark.sql import functions as F
from tables import awkward, empty, reach
from test_simhash import plain_fingerprint
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


def test_stages_keep_columns_and_take_effect(spark):
    docs = documents(spark, FOLDER)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stage(spark, out[-1], FOLDER).cache())
        assert out[-1].columns == docs.columns
    rows = [{r["doc_id"]: r for r in x.collect()} for x in out]
    # Language: only documents it is sure of nothing about go.
    found = {r["doc_id"]: r for r in langid.identify(docs, language_model(spark, docs)).collect()}
    assert rows[1].keys() == {i for i, r in found.items() if r["lang_pred"] != "und" and r["share"] >= 0.25}
    # Near copies: one of each group.
    ids = sorted(rows[1])
    bits = [plain_fingerprint(rows[1][i]["text"]) for i in ids]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if (bits[a] ^ bits[b]).bit_count() <= 4]
    assert rows[2].keys() == {ids[a] for a, label in enumerate(reach(len(ids), near)) if label == a}
    # Secrets: nothing the patterns find is left, all else is as it was.
    assert rows[3].keys() == rows[2].keys()
    assert all(not r["spans"] for r in secretscan.scan(out[3]).collect())
    spans = {r["doc_id"]: r["spans"] for r in secretscan.scan(out[2]).collect()}
    assert all(rows[3][i] == rows[2][i] for i in rows[2] if not spans[i])
    # Mixing: as often as planned.
    copies = {r["doc_id"]: r["copies"] for r in mixing.planned(out[3]).collect() if r["copies"]}
    assert dict(out[4].groupBy("doc_id").count().collect()) == copies
    # Encoding: as the library does.
    library = Tokenizer.from_file(public_tokenizers.path(BPE_FILE))
    last = corpus_pipeline.STAGES[-1][1](spark, out[4], FOLDER).collect()
    assert len(last) == sum(copies.values())
    for row in last:
        want = library.encode(rows[4][row["doc_id"]]["text"], add_special_tokens=False).ids
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    # The whole run is the stages in a row.
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last))


def test_the_number_of_languages_drops_no_text(spark):
    """Texts that every language fits equally, or in a script of none, stay however many are learnt."""
    learnt = [(i, f"wort{'abcdefghijkl'[i]} sache ding", f"l{i}", "s", 20) for i in range(12) for _ in range(3)]
    texts = [(100, "Ωμέγα και άλφα", None, "s", 14), (101, "xq", None, "s", 2), (102, "sache ding", None, "s", 10), (103, "123", None, "s", 3)]
    docs = spark.createDataFrame(learnt + texts, "doc_id long, text string, lang string, source string, n_chars int")
    found = {r["doc_id"]: r for r in langid.identify(docs, language_model(spark, docs)).collect()}
    assert found[100]["score"] < 0.25 <= found[100]["share"]
    kept = {r["doc_id"] for r in corpus_pipeline.identify_languages(spark, docs, "").collect()}
    assert kept == {*range(12), 100, 101, 102}


def test_awkward_rows(spark):
    docs = awkward(spark)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept if (r["text"] or "").startswith("one")) == [(True, 0)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty(spark), "").collect() == []
    labelled = docs.withColumn("lang", F.coalesce("lang", F.lit("en")))
    assert all(r["text"] and any(map(str.isalpha, r["text"])) for r in corpus_pipeline.identify_languages(spark, labelled, "").collect())
