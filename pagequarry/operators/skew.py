"""Joins, rankings and lists that stay balanced when one key holds much of the data.

The operators here never gather all rows of a key in one task:

* :func:`lookup` spreads the rows of frequent keys over several join partitions,
* :func:`positions` numbers the rows of a group from counts of small value ranges,
* :func:`listed` builds ordered lists in pieces of a fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOT_ROWS = 100_000  # a key with more rows than this is spread
HOT_KEYS = 1024  # a key with more than one such part of all rows is spread; this bounds the broadcast
MOST_PARTS = 4096
RANGE = 65_536  # rows of one numbering range
LIST_PIECE = 1000  # entries of one list piece, unless the caller says otherwise


def hot_keys(
    df: DataFrame, keys: Sequence[str], floor: int | None = None, counts: str | None = None
) -> DataFrame:
    """The frequent keys and the number of parts each is spread over.

    Frequent is a key with more than ``floor`` rows and more than one ``HOT_KEYS``-th of all
    rows. Fewer than ``HOT_KEYS`` keys can have that many, so the result can be broadcast
    whatever the size of ``df``, and no frequent key is left out. ``counts`` names a column that
    already holds row counts per key; otherwise they are computed from the key columns alone,
    with partial aggregation before the shuffle.
    """
    floor = HOT_ROWS if floor is None else floor
    known = [F.col(k).isNotNull() for k in keys]
    per_key = (
        df.where(reduce(lambda a, b: a & b, known))
        .groupBy(*keys)
        .agg((F.sum(counts) if counts else F.count("*")).alias("_n"))
    )
    least = per_key.agg(F.greatest(F.lit(float(floor)), F.coalesce(F.sum("_n") / HOT_KEYS, F.lit(0.0)))).scalar()
    return (
        per_key.where(F.col("_n") > floor)  # most keys go here, before the scalar is needed
        .withColumn("_floor", least)
        .where(F.col("_n") > F.col("_floor"))
        .select(*keys, F.least(F.ceil(F.col("_n") / F.col("_floor")), F.lit(MOST_PARTS)).cast("int").alias("_parts"))
    )


def salt(
    df: DataFrame, hot: DataFrame, keys: Sequence[str], row: Sequence[str], name: str = "_part"
) -> DataFrame:
    """Add ``name``: 0 for ordinary keys, a part chosen by the ``row`` columns for hot ones."""
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn(
            name,
            F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(*row), F.col("_parts"))
            ).cast("int"),
        )
        .drop("_parts")
    )


def spread(df: DataFrame, hot: DataFrame, keys: Sequence[str], name: str = "_part") -> DataFrame:
    """Add ``name`` to the other side: one copy per part of a hot key, one copy otherwise."""
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn(
            name, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
        )
        .drop("_parts")
    )


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    row: Sequence[str],
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` with a ``right`` that holds each key once, spreading hot keys.

    ``row`` names columns of ``left`` that differ between the rows of one key.
    """
    hot = hot_keys(left, keys) if hot is None else hot
    return salt(left, hot, keys, row, "_salt").join(
        spread(right, hot, keys, "_salt"), [*keys, "_salt"], how
    ).drop("_salt")


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    levels: Sequence[Column] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in the order of ``order``.

    ``order`` is a whole number unique within a group. Groups are cut into ranges of it; the
    rows before a range come from a running sum over range counts, so a window never sees
    more than ``RANGE`` rows of one group. ``levels`` are coarser sort keys that come before
    ``order``, each finer than the one before. With ``weight``, a running sum of that 0/1
    column replaces the row number.
    """
    keys = list(keys)
    steps = [*(levels or []), F.floor(F.col(order) / RANGE)]
    names = [f"_l{i}" for i in range(len(steps))]
    one = F.lit(1) if weight is None else weight
    rows = df.select("*", one.cast("bigint").alias("_w"), *[s.alias(n) for s, n in zip(steps, names)])
    before: DataFrame | None = None
    # Finest counts are taken once; coarser ones are sums of them.
    finest = rows.groupBy(*keys, *names).agg(F.sum("_w").alias("_n"))
    for i, level in enumerate(names):
        counts = finest if i == len(names) - 1 else finest.groupBy(
            *keys, *names[: i + 1]
        ).agg(F.sum("_n").alias("_n"))
        window = (
            W.partitionBy(*keys, *names[:i]).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
        )
        sums = counts.withColumn(f"_b{i}", F.coalesce(F.sum("_n").over(window), F.lit(0))).drop("_n")
        if before is None:
            before = sums
        else:
            shared = [*keys, *names[:i]]
            before = sums.join(before, shared)
    start = reduce(lambda a, b: a + b, [F.col(f"_b{i}") for i in range(len(names))])
    offsets = before.select(*keys, *names, start.alias("_start"))
    inner = (
        W.partitionBy(*keys, *names).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        rows.withColumn("_i", F.sum("_w").over(inner))
        .join(offsets, [*keys, *names])
        .withColumn(name, F.col("_start") + F.col("_i"))
        .drop("_w", "_i", "_start", *names)
    )


def listed(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, piece: int = LIST_PIECE
) -> DataFrame:
    """Ordered lists per group as rows ``(keys, piece, name array)``.

    A list longer than ``piece`` entries continues in the next piece, so no cell grows with
    the group. ``order`` is a whole number unique within a group.
    """
    numbered = positions(df.select(*keys, order, value), keys, order, "_pos")
    return (
        numbered.withColumn("piece", F.floor((F.col("_pos") - 1) / piece))
        .groupBy(*keys, "piece")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", value))).alias("_items"))
        .select(*keys, "piece", F.transform("_items", lambda x: x[value]).alias(name))
    )
