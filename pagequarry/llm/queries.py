"""One query per operator, over the whole of its table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import ann, bpe, dialogue, langid, mixing, packing, passages, periods, repeats, secretscan, simhash, textprints, veclinks


BPE_FILE = "word_bpe_49k.json"
RANK_FILE = "byte_bpe_50k.tiktoken"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def token_digests(ids: DataFrame) -> DataFrame:
    """The number of tokens, the digest of the ids, and that of the decoded text."""
    return ids.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha256(F.array_join("ids", " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode(documents(spark, sf_dir), public_tokenizers.path(BPE_FILE), decoded="decoded"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training; one without an id is not (nor does it teach)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_model(spark: SparkSession, docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, language_model(spark, docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir))
    return found.select("doc_id", simhash.digest(F.col("bits")).alias("fingerprint"), "component_id")


def vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veclinks.near_vectors(embeddings(spark, sf_dir))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(embeddings(spark, sf_dir), "key % 50 = 0")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sha256(secretscan.listed("spans", base=True))
    return secretscan.scan(documents(spark, sf_dir)).select(
        "doc_id", *[secretscan.count(kind).alias(f"n_{kind}") for kind in secretscan.KINDS],
        base.alias("base_sha256"), secretscan.listed("spans").alias("spans"),
    )


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.planned(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return repeats.cut_repeats(documents(spark, sf_dir), passages=repeats.PASSAGES).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"), (F.size("spans") > 0).alias("repeats"),
        "n_shared_words",
    )


def packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(documents(spark, sf_dir), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    return rows.select(
        "row_id", F.col("keys").alias("doc_ids"), "offsets", "cumulative", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )


def near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.near_passages(documents(spark, sf_dir))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return found.select("doc_id", "n_words", F.size("spans").alias("n_spans"), listed.alias("spans"), "component_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of their ends, repeated or given a role, by a CRC of id and turn."""
    shown = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    rows = rows.select("*", (F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20).alias("_damage")).where("_damage <> 0")
    text = F.expr("case _damage when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '') else coalesce(text, ' ') end")
    role = F.expr("if(_damage = 4, 'user', coalesce(role, ' '))")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.expr("if(_damage = 3, array(0, 1), array(0))")))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns, summary = dialogue.repair(damaged(rows))
    found = summary.join(dialogue.transcripts(turns).withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")), "left")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in ("gaps", *dialogue.COUNTS, "cost")]
    digest = F.coalesce("sha256", sha256(F.lit("")))
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), digest.alias("repaired_sha256"))


def last_third_replaced(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one, as long if that is long enough."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = textprints.against_edit(documents(spark, sf_dir), last_third_replaced)
    shown = [F.lower(F.hex(name)).alias(name) for name in ("fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", "edited_sha256", *shown, "near_edited", "near_next")


def looped(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the CRC of its id, goes in circles from one of its words on."""
    words = r"filter(split(text, r'[\x20\x09-\x0D]+'), w -> w <> '')"
    circle = "w[if(i < a, i, a + (i - a) % (1 + (n - a) div (3 + g % 8)))]"
    made = f"array_join(transform(sequence(0, n - 1), i -> {circle}), ' ')"
    for name, value in (("a", "cast(g % n as int)"), ("g", "crc32(cast(cast(doc_id as string) as binary)) div 10"), ("n", "size(w)"), ("w", words)):
        made = f"get(transform(array({value}), {name} -> {made}), 0)"
    hit = "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0 and text rlike r'[^\\x20\\x09-\\x0D]'"
    return docs.select("doc_id", F.expr(f"if({hit}, {made}, text)").alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.runs(looped(documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("*", longest.alias("_longest"))
    length, period = F.col("_longest.length"), F.col("_longest.period")
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_longest.start").alias("start"), length.alias("length"),
        period.alias("period"), F.floor(F.lit(1000) * length / period).alias("exponent_milli"),
        sha256(F.array_join(lines, "")).alias("runs_sha256"), sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_near_dedup": vector_near_dedup,
    "op2_secret_scan": secret_scan,
    "op3_bpe_encoding": bpe_encoding,
    "op4_language_id": language_id,
    "op5_near_passages": near_passages,
    "op6_nearest_neighbours": nearest_neighbours,
    "op7_simhash_near_dedup": simhash_near_dedup,
    "op9_packed_tokens": packed_tokens,
    "op10_substring_dedup": substring_dedup,
    "op8_mix_sources": mix_sources,
    "op11_conversation_repair": conversation_repair,
    "op12_document_fingerprints": document_fingerprints,
    "op13_periodic_runs": periodic_runs,
}
ORACLES: dict[str, str] = {"op8_mix_sources": mixing.ORACLE}
