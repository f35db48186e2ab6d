"""Connected components of a link table, by alternating star contraction.

Each round replaces links by links to the smallest neighbour, in two joins whose shuffles
pre-aggregate; a round is written to the shared folder, so a lost executor costs one round.
No component is ever gathered in a task: a component with a third of all nodes is a key of a
sort-merge join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.session import written


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``links(src, dst)``.

    ``component`` is the smallest node reachable. Links may repeat, point either way or to
    themselves (then ignored); a null end drops the link. No links: an empty table.
    """
    pairs = written(
        links.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        purpose,
    )
    before = None
    while before != (state := _state(pairs)):
        before = state
        pairs = written(_small_star(_large_star(pairs)), purpose)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(pairs: DataFrame) -> tuple:
    """Differs between two rounds unless they hold the same links."""
    return tuple(
        pairs.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
        ).first()
    )


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one (or the node itself)."""
    both = pairs.union(pairs.select("v", "u")).toDF("n", "x")
    least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
    return (
        both.join(least, "n").where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """The smaller neighbours of a node and the node are linked to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
