"""Request batches: validation, first-seen URLs, size gates and options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import rules, urls
from pagequarry.functions.text import strip
from pagequarry.operators import skew


def validated(requests: DataFrame) -> DataFrame:
    """Add the trimmed ``url`` and ``valid`` to request rows."""
    trimmed = requests.selectExpr("*", f"{strip('url_raw')} as url")
    return trimmed.selectExpr("*", f"{urls.is_web_url('url')} as valid")


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected rows; together they are the input, without empty batches."""
    rows = validated(requests.where(F.col("ord").isNotNull()))
    return (
        rows.where("valid").drop("valid"),
        rows.where(~F.col("valid")).drop("valid", "url"),
    )


def first_seen(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First occurrence of each URL of a batch, and the rows that repeat one.

    The first place of a URL is a minimum of a number: a hash aggregate with partial
    aggregation, so a URL repeated very often is reduced before the shuffle. Both results are
    then found by row number, which no key dominates.
    """
    places = valid.groupBy("batch_id", "url").agg(F.min("ord").alias("ord")).select("batch_id", "ord")
    at = ["batch_id", "ord"]
    return valid.join(places, at, "left_semi"), valid.join(places, at, "left_anti")


def repeat_counts(valid: DataFrame) -> DataFrame:
    """How often each repeated URL of a batch came again."""
    return (
        valid.groupBy("batch_id", "url")
        .agg((F.count("*") - 1).alias("repeats"))
        .where(F.col("repeats") > 0)
    )


def measure(requests: DataFrame) -> DataFrame:
    """Rows, invalid rows and distinct valid URLs per batch.

    The first aggregation is by URL, so a huge batch is spread over its URLs; the second
    only adds up one partial sum per task.
    """
    rows = validated(requests)
    key = F.when(F.col("valid"), F.col("url"))
    per_url = rows.groupBy("batch_id", key.alias("_url")).agg(
        F.count("ord").alias("_rows"), F.count_if(F.col("ord").isNotNull() & ~F.col("valid")).alias("_bad")
    )
    return per_url.groupBy("batch_id").agg(
        F.sum("_rows").alias("n_urls"),
        F.sum("_bad").alias("n_invalid"),
        F.count("_url").alias("n_unique"),
    )


def gate(
    requests: DataFrame, max_urls: int = rules.DEFAULT_MAX_URLS, strict: bool = True
) -> DataFrame:
    """One row per batch with ``reason``: null when the batch is accepted.

    Strict: ``no_urls``, then ``invalid_urls``, then ``too_many_urls``. Lenient: only
    ``too_many_urls``, counting distinct valid URLs. A batch is refused, never cut.
    """
    too_many = F.when(F.col("n_unique") > max_urls, "too_many_urls")
    reason: Column = too_many
    if strict:
        reason = (
            F.when(F.col("n_urls") == 0, "no_urls")
            .when(F.col("n_invalid") > 0, "invalid_urls")
            .otherwise(too_many)
        )
    return measure(requests).withColumn("reason", reason)


def accepted(rows: DataFrame, gated: DataFrame) -> DataFrame:
    """Rows of the batches that passed a gate.

    Batch sizes are known from the gate, so refused giants are filtered by the broadcast of
    their few keys before anything is shuffled; the rest is an ordinary semi join.
    """
    refused = gated.where(F.col("reason").isNotNull())
    refused_large = skew.hot_keys(refused, ["batch_id"], counts="n_urls").select("batch_id")
    passed = gated.where(F.col("reason").isNull())
    small = rows.join(F.broadcast(refused_large), "batch_id", "left_anti")
    hot = skew.hot_keys(passed, ["batch_id"], counts="n_urls")
    return (
        skew.salt(small, hot, ["batch_id"], ["ord"])
        .join(skew.spread(passed.select("batch_id"), hot, ["batch_id"]), ["batch_id", "_part"], "left_semi")
        .drop("_part")
    )


def invalid_lists(requests: DataFrame, piece: int = skew.LIST_PIECE) -> DataFrame:
    """Invalid URLs per batch, in order, as given, joined by a comma and a blank.

    A batch with more than ``piece`` of them has several rows, numbered by ``piece``.
    """
    _, rejected = split_valid(requests)
    pieces = skew.listed(rejected, ["batch_id"], "ord", "url_raw", "urls", piece)
    return pieces.select(
        "batch_id", "piece", F.size("urls").cast("bigint").alias("n"),
        F.array_join("urls", ", ").alias("invalid_urls"),
    )


def with_options(
    requests: DataFrame, default_timeout_s: float = rules.DEFAULT_TIMEOUT_S
) -> DataFrame:
    """Resolve options per row: ``timeout``, ``timeout_reason`` and ``long_timeout``.

    A row with a ``timeout_reason`` cannot be run: ``judge.outcomes`` gives it that error.
    """
    resolved = F.coalesce(F.col("timeout_s"), F.lit(default_timeout_s))
    return requests.select(
        "*",
        resolved.alias("timeout"),
        F.when(resolved <= 0, "timeout_not_positive").alias("timeout_reason"),
        F.coalesce(
            F.col("timeout_s") > rules.LONG_TIMEOUT_FACTOR * default_timeout_s, F.lit(False)
        ).alias("long_timeout"),
    )
