"""Saved files that are still offered: lookup, delivery and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import rules
from pagequarry.operators import skew


def newest(artifacts: DataFrame, n: int = rules.KEPT_ARTIFACTS) -> DataFrame:
    """The ``n`` latest registrations; each task keeps its own ``n`` before they are merged."""
    return artifacts.orderBy(F.desc("seq")).limit(n)


def present(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Registrations whose file is still there. A path can be registered very often, so
    frequent paths are spread."""
    paths = files.select("path").distinct()
    return skew.lookup(artifacts, paths, ["path"], ["token"], "left_semi")


def delivered(deliveries: DataFrame) -> DataFrame:
    """Tokens whose file was sent whole: a GET without a range, seen to its end."""
    whole = (F.upper("method") == "GET") & ~F.col("ranged") & F.col("complete")
    return deliveries.where(whole).select("token").distinct()


def live(artifacts: DataFrame, deliveries: DataFrame, keep: bool = False) -> DataFrame:
    """Registrations left after complete deliveries, which end a token unless ``keep``.

    A token is unique and deliveries are reduced to distinct tokens, so no key is hot.
    """
    if keep:
        return artifacts
    return artifacts.join(delivered(deliveries), "token", "left_anti")
