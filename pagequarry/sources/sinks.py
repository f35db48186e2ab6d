"""Writers for documents, records, payloads, manifests and report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators import report


def write_payloads(named: DataFrame, path: str) -> None:
    """Payloads as rows ``(batch_id, name, payload)``, one folder per extension.

    The file name is a column: millions of small files would be slower to write and to list
    than the rows. Extensions of this run replace what was there before, others stay.
    """
    rows = named.select(
        "batch_id", "ord", F.col("allocated").alias("name"), report.payload().alias("payload"),
        F.regexp_replace("extension", r"^\.", "").alias("extension"),
    )
    rows.write.mode("overwrite").partitionBy("extension").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Report lines as text files, sorted by a range shuffle, never in one task."""
    lines.orderBy("batch_id", "section", "ord", "n").select("line").write.mode("overwrite").text(path)
