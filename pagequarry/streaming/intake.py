"""Continuous versions: request intake, outcome counts, progress and artifact retention.

What a call holds is settled inside its row; sums are written per micro-batch, rolled up now and
then, and added up when read; the table of artifacts that is carried on is bounded. None of that
keeps state in memory or drops a late row. Two jobs keep state for a stated time, bounded by a
watermark: calls delivered more than once (:func:`intake_once`) and counts of windows that are
final when they come out (:func:`closed_counts`). Every runner takes the folder to work in; called
again with the same folder it goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions import rules, urls
from pagequarry.functions.inline import let
from pagequarry.functions.text import strip
from pagequarry.sources.requests import parse_bodies


def read_files(spark: SparkSession, folder: str, schema: str, pattern: str, fmt: str = "parquet") -> DataFrame:
    """A folder as a stream of files with a fixed schema."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("pathGlobFilter", pattern)
        .load(folder)
    )


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table as a stream with a fixed schema, whether ``path`` is one file or a folder of files.

    A stream takes a single file only by a pattern, so the last letter of the name is one.
    """
    return spark.readStream.format(fmt).schema(schema).load(f"{path[:-1]}[{path[-1]}]")


def _listed(bodies: DataFrame, *kept: str) -> DataFrame:
    """URLs of accepted bodies with their place: ``(batch_id, *kept, ord, url_raw, url, valid, first)``.

    ``first`` is false for a URL the same body has named before. A call is one body, so it is
    settled inside the row: no state, and nothing is too late.
    """
    parsed = parse_bodies(bodies).where(F.col("reason").isNull())
    rows = f"transform(urls, (_ur, _or) -> struct({strip('_ur')} as url, cast(_or as bigint) as ord, _ur as url_raw))"
    # Equal URLs lie together, in order, once sorted.
    marked = "transform(_so, (_en, _ix) -> struct(_en.url as url, _en.ord as ord, _en.url_raw as url_raw, " \
        "_ix = 0 or _so[greatest(_ix - 1, 0)].url <> _en.url as first))"
    exploded = parsed.selectExpr("batch_id", *kept, f"inline({let(f'array_sort({rows})', '_so', marked)})")
    return exploded.selectExpr("*", f"{urls.is_web_url('url')} as valid")


def intake(bodies: DataFrame) -> DataFrame:
    """Valid request rows ``(batch_id, ord, url)`` of a stream ``(batch_id, body)``, once per body and URL."""
    return _listed(bodies).where("valid and first").select("batch_id", "ord", "url")


def intake_once(bodies: DataFrame, at: str = "at", within: str = "1 hour") -> DataFrame:
    """Valid request rows ``(batch_id, ord, url, at)`` of a stream ``(batch_id, body, at)``, once per call and URL.

    A call that is delivered again adds nothing, as long as its deliveries are no further apart
    than ``within``; a call that comes later than that after the newest one is taken for old and
    dropped. One key per call and URL is kept for that time, dealt by key over all tasks.
    """
    rows = _listed(bodies.withWatermark(at, within), at).where("valid and first")
    return rows.select("batch_id", "ord", "url", at).dropDuplicatesWithinWatermark(["batch_id", "url"])


def rejects(bodies: DataFrame) -> DataFrame:
    """What the intake does not take, ``(batch_id, ord, url_raw, reason)``: bodies (without place) and invalid URLs."""
    none = F.lit(None)
    whole = parse_bodies(bodies).where(F.col("reason").isNotNull()).select(
        "batch_id", none.cast("bigint").alias("ord"), none.cast("string").alias("url_raw"), "reason"
    )
    single = _listed(bodies).where("not valid").select("batch_id", "ord", "url_raw", F.lit("invalid_url").alias("reason"))
    return whole.unionByName(single)


def counts(rows: DataFrame, kind: Column, at: Column, width: str = "5 minutes") -> DataFrame:
    """Rows to be counted per kind and tumbling window, for :func:`run_sums`."""
    window = F.window(at.cast("timestamp"), width)
    return rows.select(window["start"].alias("window_start"), kind.alias("kind"))


def closed_counts(rows: DataFrame, kind: Column, at: Column, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts ``(window_start, kind, n)`` per kind and tumbling window, for :func:`run_append`.

    A window comes out once, when the newest row is ``late`` past its end; rows that come after
    that, and rows without a time, do not count. Use :func:`counts` where every row has to.
    """
    timed = rows.select(at.cast("timestamp").alias("at"), kind.alias("kind")).where("at is not null").withWatermark("at", late)
    sums = timed.groupBy(F.window("at", width), "kind").agg(F.count("*").alias("n"))
    return sums.select(F.col("window.start").alias("window_start"), "kind", "n")


def run_append(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Process what is new, append to a table in ``folder``, and read the table back."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/table")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_sums(
    spark: SparkSession, stream: DataFrame, keys: list[str], folder: str, largest: tuple[str, ...] = (), every: int = 64
) -> DataFrame:
    """Count the rows of a stream per key: ``(keys, n, largest)``; ``largest`` columns are maxima.

    A micro-batch writes its own counts to a folder named after it, so a repeated one changes
    nothing and no row can come too late; they are added up when read. After each ``every``
    micro-batches (the same number in all runs of a folder) what is there becomes one table, made
    of the one before and the folders since, so reading opens ``every`` folders at most, however
    long the stream has run.
    """
    sums = T.StructType([*(stream.schema[k] for k in keys), T.StructField("n", T.LongType()), *(stream.schema[c] for c in largest)])
    maxima = [F.max(c).alias(c) for c in largest]

    def upto(last: int, tables: int) -> DataFrame:
        """All counts up to a micro-batch, of which ``tables`` times ``every`` are in one table."""
        folders = [f"{folder}/rolled/upto={tables * every - 1}"] if tables else []
        folders += [f"{folder}/table/epoch={e}" for e in range(tables * every, last + 1)]
        parts = spark.read.schema(sums).parquet(*folders) if folders else spark.createDataFrame([], sums)
        return parts.groupBy(*keys).agg(F.sum("n").alias("n"), *maxima)

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch.groupBy(*keys).agg(F.count("*").alias("n"), *maxima)
        own.write.mode("overwrite").parquet(f"{folder}/table/epoch={epoch}")
        if (epoch + 1) % every == 0:
            upto(epoch, epoch // every).write.mode("overwrite").parquet(f"{folder}/rolled/upto={epoch}")

    last = _run_each(stream, write, folder)
    return upto(last, (last + 1) // every)


def retention(
    spark: SparkSession, stream: DataFrame, folder: str, n: int = rules.KEPT_ARTIFACTS, keep: bool = False
) -> DataFrame:
    """Live artifacts after a stream of registrations and deliveries.

    ``stream`` holds ``(token, path, seq)`` for a registration and ``(token, delivered)`` with
    ``delivered`` true for a complete delivery. Each micro-batch reads the table the one before
    wrote (at most ``n`` rows), adds what is new, and writes its own version; nothing old is
    read again. The capacity applies to what was registered; a delivery then ends a token.
    """
    columns = ("token", "path", "seq", "delivered")

    def step(batch: DataFrame, epoch: int) -> None:
        known = batch.where("seq is not null").select(*columns[:3], F.lit(False).alias("delivered"))
        if epoch > 0:
            known = known.unionByName(spark.read.schema(known.schema).parquet(f"{folder}/table/version={epoch - 1}"))
        newest = known.orderBy(F.desc("seq")).limit(n)
        sent = batch.where("delivered").select("token").distinct().withColumn("_sent", F.lit(not keep))
        out = newest.join(sent, "token", "left").withColumn("delivered", F.col("delivered") | F.coalesce("_sent", F.lit(False)))
        out.select(*columns).write.mode("overwrite").parquet(f"{folder}/table/version={epoch}")

    last = _run_each(stream, step, folder)
    schema = "token string, path string, seq bigint, delivered boolean"
    if last < 0:
        return spark.createDataFrame([], schema).drop("delivered")
    return spark.read.schema(schema).parquet(f"{folder}/table/version={last}").where("not delivered").drop("delivered")


def _run_each(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str) -> int:
    """Run to the end of what is there; the number of the last micro-batch, of this run or an earlier one, or -1."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # The checkpoint says which ones are done; a run that finds nothing new reports no number to rely on.
    done = stream.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/checkpoint").select("path")
    numbers = done.select(F.regexp_extract("path", r"/commits/([0-9]+)$", 1).alias("number")).where("number <> ''")
    last = numbers.agg(F.max(F.col("number").cast("int"))).first()[0]
    return -1 if last is None else last
