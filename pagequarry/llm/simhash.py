"""SimHash near-duplicates: 64-bit fingerprints, compared exactly in tiles.

A fingerprint has a bit for each bit position that is set in over half of the XXH64 values of
the text's word shingles. Distinct fingerprints are cut into stripes of equal population count
(number of set bits). Two fingerprints within ``radius`` bits differ by at most ``radius`` in
that count, so only stripes whose counts are that close are paired; inside a pair of stripes the
same holds for the counts of the upper halves, tile by tile. What is left is compared by
exclusive-or and bit counts in numpy: nothing is missed, whatever the data.

A pair of stripes yields a spanning forest of its links, at most one row per fingerprint, so a
group of near copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.components import components
from pagequarry.llm.fields import with_fields
from pagequarry.llm.forest import Forest
from pagequarry.session import written

BITS = 64
STRIPE = 32_768  # fingerprints that are paired at once
TILE = 1024  # fingerprints of one numpy comparison
# Row v holds the bits of the byte v, highest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
LANES = np.arange(8) * 256


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of one text; 0 for null, or a text without words.

    Words are separated by ASCII white space, A-Z count as a-z; a text of fewer than ``words``
    words is one shingle. A bit set in exactly half of the shingles is 0.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    digests = np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    lanes = np.bincount((digests + LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (lanes @ BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, bits)``: one row per row of ``docs``; ``bits`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "bits"])

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, with_fields(rows.schema[key], bits="bigint"))


def _stripes(bits: DataFrame) -> tuple[DataFrame, list[int]]:
    """``(count, stripe, items)`` of the distinct ``bits``, and the number of stripes per count."""
    counted = bits.select("bits", F.bit_count("bits").alias("count"))
    sizes = dict(counted.groupBy("count").agg(F.count("*")).collect())  # 65 rows at most
    stripes = [-(-sizes.get(c, 0) // STRIPE) for c in range(BITS + 1)]
    placed = counted.withColumn("stripe", F.pmod(F.xxhash64("bits"), _at(stripes, F.col("count"))))
    return placed.groupBy("count", "stripe").agg(F.collect_list("bits").alias("items")), stripes


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int")).cast("bigint")


def links(bits: DataFrame, radius: int = 4) -> DataFrame:
    """``(src, dst)``: a spanning forest, per pair of stripes, of all distinct ``bits`` within ``radius``.

    Repeated and null values are ignored.
    """
    folder = written(bits.where("bits is not null").select("bits").distinct(), "simhash-bits")
    tiles, stripes = _stripes(folder)
    tiles = written(tiles, "simhash-stripes")
    # The stripes to meet: of the same count this one and those after it, of higher counts all.
    counts = F.explode(F.sequence("count", F.least(F.col("count") + radius, F.lit(BITS))))
    first = F.when(F.col("to_count") == F.col("count"), F.col("stripe")).otherwise(F.lit(0))
    asks = (
        tiles.select("count", "stripe", "items", counts.alias("to_count"))
        .where(_at(stripes, F.col("to_count")) > first)
        .select("*", F.explode(F.sequence(first, _at(stripes, F.col("to_count")) - 1)).alias("to_stripe"))
    )
    other = tiles.select(F.col("count").alias("to_count"), F.col("stripe").alias("to_stripe"), F.col("items").alias("others"))
    pairs = asks.join(other.hint("shuffle_merge"), ["to_count", "to_stripe"])
    same = (F.col("count") == F.col("to_count")) & (F.col("stripe") == F.col("to_stripe"))
    # Pairs of stripes are the unit of work: spread them evenly, whatever their keys.
    return (
        pairs.select("items", F.when(same, F.array().cast("array<bigint>")).otherwise(F.col("others")).alias("others"))
        .repartition(max(2 * bits.sparkSession.sparkContext.defaultParallelism, sum(stripes)))
        .mapInArrow(_compare(radius), "src bigint, dst bigint")
    )


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                x = np.asarray(a.values).view(np.uint64)
                y = np.asarray(b.values).view(np.uint64)
                src, dst = near(x, y if len(y) else x, radius, not len(y))
                yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    return run


def near(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs ``x[i], y[j]`` within ``radius`` bits, as two arrays.

    The values of ``x`` have one population count, those of ``y`` another (or the same).
    """
    upper = lambda v: np.bitwise_count(v >> np.uint64(32)).astype(np.int64)
    x = x[np.argsort(upper(x), kind="stable")]
    y = x if same else y[np.argsort(upper(y), kind="stable")]
    more = int(np.bitwise_count(y[0])) - int(np.bitwise_count(x[0])) if len(x) and len(y) else 0
    hx, hy = upper(x), upper(y)
    forest = Forest(len(x) if same else len(x) + len(y))
    for i in range(0, len(x), TILE):
        a, low, high = x[i : i + TILE], hx[i], hx[min(i + TILE, len(x)) - 1]
        for j in range(i if same else 0, len(y), TILE):
            last = hy[min(j + TILE, len(y)) - 1]
            # The halves differ by d and more - d in count; |d| + |more - d| bits differ at least.
            d = np.arange(hy[j] - high, last - low + 1)
            if (np.abs(d) + np.abs(more - d)).min() > radius:
                continue
            p, q = np.nonzero(np.bitwise_count(a[:, None] ^ y[None, j : j + TILE]) <= radius)
            forest.link(p + i, q + (j if same else len(x) + j))
    value = x if same else np.concatenate([x, y])
    root = forest.roots()
    linked = np.nonzero(root != np.arange(len(value)))[0]
    return value[linked], value[root[linked]]


def groups(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, bits, component_id)``: one row per row of ``docs``.

    ``component_id`` is the smallest ``key`` reachable over fingerprints within ``radius`` bits,
    itself included; texts that are null or without words share the fingerprint 0 and link like
    any other. A null key keeps its row and never names a group, unless the group has no other.
    Repeated rows come out repeated. An empty table gives an empty table; other columns are
    not read.
    """
    marked = written(fingerprints(docs, words, seed, key, text), "simhash-docs")
    classes = written(marked.groupBy("bits").agg(F.min(key).alias("_least")), "simhash-classes")
    found = components(links(classes, radius), "simhash-links")
    named = classes.join(found, classes.bits == found.node, "left").select(
        "bits", "_least", F.coalesce("component", "bits").alias("_group")
    )
    named = written(named, "simhash-groups")
    least = named.groupBy("_group").agg(F.min("_least").alias("component_id"))
    return marked.join(named.join(least, "_group").select("bits", "component_id"), "bits").select(key, "bits", "component_id")


def digest(bits: Column) -> Column:
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
