"""Request sources: URL lists from tables and files, and JSON request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import schemas


def from_lists(df: DataFrame, urls: str = "urls", batch: str = "batch_id") -> DataFrame:
    """One row per list entry, with its place in the list; an empty list keeps one null row."""
    rest = [c for c in df.columns if c not in (urls, batch)]
    exploded = df.select(
        F.col(batch).alias("batch_id"), F.posexplode_outer(urls).alias("ord", "url_raw"), *rest
    )
    return schemas.conform(exploded.withColumn("ord", F.col("ord").cast("bigint")), schemas.REQUESTS, keep_extra=True)


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read a request table with the fixed schema from any built-in file format."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "parquet" or fmt == "orc":
        return schemas.conform(reader.load(path), schemas.REQUESTS)
    return reader.schema(schemas.ddl(schemas.REQUESTS)).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files with one URL per line: each file is a batch, lines keep their order.

    ``ord`` is put together from the split of the file and the row in the reading task, so a
    large file is read by many tasks. It grows along the file but is not dense. Splits are
    larger than a mebibyte, as Spark's defaults make them.
    """
    lines = spark.read.text(path).selectExpr(
        "xxhash64(_metadata.file_path) as batch_id",
        "shiftleft(shiftright(_metadata.file_block_start, 20), 33) + "
        "(monotonically_increasing_id() & 8589934591) as ord",
        "value as url_raw",
    )
    return schemas.conform(lines.where("trim(url_raw) <> ''"), schemas.REQUESTS)


def parse_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``urls`` and ``reason`` to request bodies.

    ``reason`` is one of ``not_json``, ``not_object``, ``no_urls``, ``bad_urls`` or null.
    Unknown keys are ignored; list entries must be strings, nothing is converted.
    """
    text = F.col(body)
    if dict(df.dtypes)[body] == "binary":
        text = F.try_validate_utf8(text.cast("string"))
    parsed = df.withColumn("_v", F.try_parse_json(text))
    shape = F.schema_of_variant("_v")
    urls = F.try_variant_get("_v", "$.urls", "variant")
    urls_shape = F.schema_of_variant(urls)
    listed = F.try_variant_get("_v", "$.urls", "array<string>")
    has_null = F.coalesce(F.exists(listed, lambda x: x.isNull()), F.lit(False))
    reason = (
        F.when(F.col("_v").isNull(), "not_json")
        .when(~shape.startswith("OBJECT"), "not_object")
        .when(urls.isNull(), "no_urls")
        .when((urls_shape == "ARRAY<STRING>") & ~has_null, None)
        .when(F.to_json(urls) == "[]", None)
        .otherwise("bad_urls")
    )
    return parsed.select(
        *df.columns, reason.alias("reason"), F.when(reason.isNull(), listed).alias("urls")
    )


def from_bodies(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Split bodies ``(batch_id, body)`` into request rows and rejected bodies."""
    parsed = parse_bodies(df, body)
    good = parsed.where(F.col("reason").isNull()).select("batch_id", "urls")
    return from_lists(good), parsed.where(F.col("reason").isNotNull()).drop("urls")
