"""Capture sources: attempts, final responses and files that were collected elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import schemas


def normalise(df: DataFrame) -> DataFrame:
    """Give captures the full schema and fill in what can be told from other columns."""
    full = schemas.conform(df, schemas.CAPTURES, keep_extra=True)
    return full.select(
        *[
            c
            for c in full.columns
            if c not in ("raised", "success", "probe_skipped", "probe_error_kind")
        ],
        F.coalesce("raised", F.lit(False)).alias("raised"),
        F.coalesce("success", F.col("error_text").isNull()).alias("success"),
        F.coalesce("probe_skipped", F.lit(False)).alias("probe_skipped"),
        F.coalesce(
            "probe_error_kind", F.when(F.col("proxy_status").isNotNull(), "proxy")
        ).alias("probe_error_kind"),
    )


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return normalise(spark.read.format(fmt).load(path))
