"""From raw documents to token digests: five stages, each one operator over all that is left.

1. language identification: documents without a letter, or in which no language holds a quarter
   of the letters, go; documents that mix languages stay;
2. SimHash near-duplicates: of each group of near copies the document with the smallest id stays;
3. secrets: every span found is replaced by a mark, the document stays;
4. mixing: documents are repeated as their source's target asks, or left out;
5. byte-pair encoding: each remaining row becomes the digests of its token ids.

Repeated rows are near copies of each other, so one of them stays after the second stage; rows
without an id are treated like others. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, langid, mixing, secretscan, simhash
from pagequarry.llm.queries import BPE_FILE, documents, language_model, token_digests
from pagequarry.session import written

LEAST_SHARE = 0.25


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    found = langid.identify(rows, language_model(spark, docs), key="_row")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("share") >= LEAST_SHARE)).select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row is known by its id and a digest of all its columns; equal rows share it.
    digests = [F.xxhash64(F.lit(seed), *docs.columns) for seed in (1, 2)]
    rows = docs.select(F.struct(F.col("doc_id"), *(d.alias(f"h{i}") for i, d in enumerate(digests))).alias("_row"), "text")
    found = simhash.groups(rows, key="_row")
    stay = found.where(F.col("_row") == F.col("component_id")).select(F.col("_row.h0").alias("_h0"), F.col("_row.h1").alias("_h1")).distinct()
    named = docs.select("*", *(d.alias(f"_h{i}") for i, d in enumerate(digests)))
    kept = named.join(stay, ["_h0", "_h1"], "left_semi").dropDuplicates(["_h0", "_h1"])
    return kept.select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode(docs, public_tokenizers.path(BPE_FILE), decoded="decoded"))


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("bpe_encoding", encode_tokens),
]

# Neither the fingerprints nor the encoding can be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
