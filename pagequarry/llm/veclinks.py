"""Near-duplicate vectors by sorted projection passes.

A pass gives every vector a key, the signs of its random projections one after the other, sorts
all vectors by group and key, and compares each with the ``window`` ones that follow; pairs whose
cosine reaches the threshold are verified links. Each task unites what it has found and hands on
a spanning forest, the forests of all passes are united by :mod:`components`, and the members of
a component are then compared in tiles, which gives exact link counts however large it is.

How many passes a group takes is measured: in the first passes, how many signs a vector shares
with the one ``window`` places on. Two vectors that agree in more signs than any of these lie
within a window; at the threshold's angle they agree in a sign with probability ``p``, and all
passes miss a pair with a probability of at most ``miss``. Vectors that lie in a cone share many
signs and so take many passes. Where passes would compare as many pairs as there are, all
pairs of the group are compared instead, in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.vectors import matrix, numbered, unit, usable
from pagequarry.llm.components import components
from pagequarry.llm.forest import Forest
from pagequarry.session import written

WINDOW = 128  # rows each row is compared with, in each pass
MISS = 1e-6  # chance that no pass compares a pair just at the threshold
SIGNS = 60  # in a key
TOGETHER = 5  # passes that are shuffled at once
PREFIX = 8  # signs by which a group is dealt out to be measured
PART = 50_000  # rows of a sorted partition
TILE = 1024  # members of a component compared at once
EDGES = "src bigint, dst bigint"


def passes_for(rows: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """How many passes find a pair at the threshold among ``rows`` vectors, but for ``miss``."""
    agree = 1 - math.acos(threshold) / math.pi
    depth = math.log2(max(1.0, rows / window))
    hit = min(1 - 1e-9, agree**depth)
    return max(1, math.ceil(math.log(miss) / math.log1p(-hit)))


def _keys(passes: range, seed: int):
    """Rows of a pass each: ``(pass, key, group columns, _row, vec)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes):
                rows = batch.take(pa.array(np.nonzero(sizes == dims)[0]))
                units = unit(matrix(rows.column("vec")))
                for number in passes:
                    planes = np.random.default_rng([seed, number]).standard_normal((SIGNS, int(dims)))
                    key = (units @ planes.T > 0) @ (1 << np.arange(SIGNS - 1, -1, -1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), number, np.int32)), *rows.columns, pa.array(key)],
                        names=["pass", *rows.schema.names, "key"],
                    )

    return run


class _Run:
    """Rows in sorted order, compared with those that follow in the same pass and group."""

    def __init__(self, threshold: float, window: int):
        self.threshold, self.window = threshold, window

    def links(self, rows: pa.Table, first: int = 0, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Links of the rows from ``first`` on, as a forest of row numbers; ``split``: only across this place."""
        ids = rows.column("_row").to_numpy()
        forest = Forest(len(rows))
        same = [rows.column(c).to_numpy() for c in ("pass", "group", "dims")]
        cuts = np.nonzero(reduce(np.logical_or, [c[1:] != c[:-1] for c in same]))[0] + 1 if len(rows) else []
        for start, end in zip([0, *cuts], [*cuts, len(rows)]):
            if end - start < 2 or end <= first:
                continue
            units = unit(matrix(rows.column("vec").slice(start, end - start).combine_chunks()))
            w = self.window
            for i in range(0, end - start, w):
                a, b = units[i : i + w], units[i : i + 2 * w]
                p, q = np.nonzero(a @ b.T >= self.threshold)
                near = (q > p) & (q - p <= w) & (start + i + q >= first)
                if split is not None:
                    near &= (start + i + p < split) & (start + i + q >= split)
                forest.link(start + i + p[near], start + i + q[near])
        root = forest.roots()
        at = np.nonzero(root != np.arange(len(root)))[0]
        return ids[at], ids[root[at]]


COLUMNS = ["pass", "group", "dims", "_row", "vec"]


def _sorted_pass(threshold: float, window: int):
    """Links within a sorted partition, and its first and last ``window`` rows for its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        compare = _Run(threshold, window)
        held: pa.Table | None = None
        head: pa.Table | None = None
        seen = 0
        for batch in batches:
            new = pa.Table.from_batches([batch]).select(COLUMNS)
            before = 0 if held is None else len(held)
            rows = new if held is None else pa.concat_tables([held, new])
            yield _edges(*compare.links(rows, before))
            if seen < window:
                head = new if head is None else pa.concat_tables([head, new])
                head = head.slice(0, window)
            seen += len(new)
            held = rows.slice(max(0, len(rows) - window))
        for rows, border, side in ((head, part - 1, 1), (held, part, 0)):
            if rows is not None and len(rows):
                yield from _border(rows, border, side)

    return run


def _edges(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
    n = len(src)
    empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), *empty], names=EDGE_NAMES)


EDGE_NAMES = ["src", "dst", "border", "side", "place", "pass", "group", "dims", "_row", "vec"]
EDGE_ROWS = f"{EDGES}, border int, side int, place int, pass int, `group` bigint, dims int, _row bigint, vec array<double>"


def _border(rows: pa.Table, border: int, side: int) -> Iterator[pa.RecordBatch]:
    n = len(rows)
    columns = [
        pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([border] * n, pa.int32()), pa.array([side] * n, pa.int32()),
        pa.array(np.arange(n, dtype=np.int32)), rows.column("pass"), rows.column("group"), rows.column("dims"), rows.column("_row"),
        rows.column("vec").cast(pa.list_(pa.float64())),
    ]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    yield pa.RecordBatch.from_arrays(columns, names=EDGE_NAMES)


def _across(threshold: float, window: int):
    """Links between the end of a sorted partition and the start of the next."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("place", "ascending")])
        split = int((rows.column("side").to_numpy() == 0).sum())
        src, dst = _Run(threshold, window).links(rows.select(COLUMNS), 0, split)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _shared_signs(keys: np.ndarray, window: int) -> int:
    """The most leading signs that a sorted key shares with the one ``window`` places on; -1 if there is none."""
    if len(keys) <= window:
        return -1
    apart = int((keys[window:] ^ keys[:-window]).min())
    return SIGNS - apart.bit_length()


def _depths(passes: int, window: int, seed: int):
    """Rows ``(group, dims, key, pass)`` for the depth of each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keyed in _keys(range(passes), seed)(batches):
            yield keyed.select(["pass", "group", "dims", "key"])

    return run


def passes_of(rows: DataFrame, threshold: float, window: int, miss: float, seed: int) -> DataFrame:
    """``(group, dims, rows, passes)`` of each group; ``passes`` is null where all pairs are to be compared."""
    agree = 1 - math.acos(threshold) / math.pi
    sizes = rows.groupBy("group", "dims").agg(F.count("*").alias("rows"))
    # A group in which even one sign more than chance gives takes no fewer comparisons than all pairs.
    least = F.greatest(F.lit(0.0), F.log2(F.col("rows") / window))
    hit = F.least(F.lit(1 - 1e-9), F.pow(F.lit(agree), least))
    large = written(sizes.where(F.col("rows") > 2 * window * F.ceil(F.lit(math.log(miss)) / F.log1p(-hit))), "vector-large")
    measured = rows.join(large.select("group", "dims"), ["group", "dims"], "left_semi").select("_row", "group", "dims", "vec")
    keys = measured.mapInArrow(_depths(TOGETHER, window, seed), "pass int, `group` bigint, dims int, key bigint")
    # The key that many places on, of parts of a group that share their first signs.
    shift = SIGNS - PREFIX
    parts = keys.groupBy("pass", "group", "dims", F.shiftright("key", shift).alias("prefix"))

    def depth(part: pa.Table) -> pa.Table:
        found = _shared_signs(np.sort(part.column("key").to_numpy()), window)
        return part.slice(0, 1).select(["pass", "group", "dims"]).append_column("depth", pa.array([max(found, PREFIX)], pa.int32()))

    depths = parts.applyInArrow(depth, "pass int, `group` bigint, dims int, depth int").groupBy("pass", "group", "dims").agg(F.max("depth").alias("depth"))
    rate = F.avg(F.log1p(-F.least(F.lit(1 - 1e-9), F.pow(F.lit(agree), F.col("depth") + 1)))).alias("rate")
    needed = depths.groupBy("group", "dims").agg(F.max("depth").alias("depth"), rate)
    passes = F.ceil(F.lit(math.log(miss)) / F.col("rate"))
    fits = (F.col("depth") < SIGNS) & (passes * 2 * window < F.col("rows"))
    known = needed.join(large, ["group", "dims"]).select("group", "dims", F.when(fits, passes).cast("int").alias("passes"))
    return written(sizes.join(known, ["group", "dims"], "left"), "vector-groups")


def found_links(rows: DataFrame, threshold: float, window: int = WINDOW, miss: float = MISS, seed: int = 1) -> DataFrame:
    """``(src, dst)``: forests of the verified links over ``(_row, group, dims, vec)``."""
    groups = passes_of(rows, threshold, window, miss, seed)
    whole = rows.join(groups.where("passes is null").select("group", "dims"), ["group", "dims"], "left_semi")
    whole = whole.select("_row", F.col("group").alias("component"), "dims", "vec")
    forests = [_tiled(whole).applyInArrow(_all_links(threshold), EDGES)]
    most = groups.agg(F.max("passes")).first()[0] or 0
    for first in range(0, most, TOGETHER):
        some = range(first, min(most, first + TOGETHER))
        open_groups = groups.where(F.col("passes") > first)
        total = open_groups.agg(F.sum("rows")).first()[0]
        parts = max(1, -(-total * len(some) // PART))
        kind = rows.schema["vec"].dataType.simpleString()
        left = rows.join(open_groups.select("group", "dims"), ["group", "dims"], "left_semi")
        keyed = left.select("_row", "group", "dims", "vec").mapInArrow(
            _keys(some, seed), f"pass int, _row bigint, `group` bigint, dims int, vec {kind}, key bigint"
        )
        ordered = keyed.repartitionByRange(max(parts, 1), "pass", "group", "dims", "key", "_row").sortWithinPartitions(
            "pass", "group", "dims", "key", "_row"
        )
        out = written(ordered.mapInArrow(_sorted_pass(threshold, window), EDGE_ROWS), "vector-pass")
        forests.append(out.where("src is not null").select("src", "dst"))
        # At most two windows of rows on either side of a border.
        borders = out.where("border >= 0").drop("src", "dst").groupBy("border")
        forests.append(borders.applyInArrow(_across(threshold, window), EDGES))
    return reduce(DataFrame.union, forests)


def _near(rows: pa.Table, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first row, first column, links)`` of each component in a sorted pair of tiles."""
    component, tile = rows.column("component").to_numpy(), rows.column("tile").to_numpy()
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    units = unit(matrix(rows.column("vec").combine_chunks()))
    cuts = np.nonzero(component[1:] != component[:-1])[0] + 1
    for start, end in zip([0, *cuts], [*cuts, len(rows)]):
        middle = start if low == high else start + int((tile[start:end] == low).sum())
        first = units[start : end if low == high else middle]
        yield start, middle, first @ units[middle:end].T >= threshold


def _all_links(threshold: float):
    """Links within a pair of tiles, as a forest."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("component", "ascending"), ("tile", "ascending"), ("_row", "ascending")])
        ids = rows.column("_row").to_numpy()
        forest = Forest(len(rows))
        for start, middle, near in _near(rows, threshold):
            a, b = np.nonzero(near)
            forest.link(start + a, middle + b)
        root = forest.roots()
        at = np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"src": pa.array(ids[at], pa.int64()), "dst": pa.array(ids[root[at]], pa.int64())})

    return run


def _count(threshold: float):
    """Link counts within a pair of tiles, for each component in it."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("component", "ascending"), ("tile", "ascending"), ("_row", "ascending")])
        component, tile = rows.column("component").to_numpy(), rows.column("tile").to_numpy()
        pair = (int(rows.column("low")[0].as_py()), int(rows.column("high")[0].as_py()))
        units = unit(matrix(rows.column("vec").combine_chunks()))
        counts = np.zeros(len(rows), np.int64)
        cuts = np.nonzero(component[1:] != component[:-1])[0] + 1
        for start, end in zip([0, *cuts], [*cuts, len(rows)]):
            if pair[0] == pair[1]:
                near = units[start:end] @ units[start:end].T >= threshold
                np.fill_diagonal(near, False)
                counts[start:end] += near.sum(1)
            else:
                middle = start + int((tile[start:end] == pair[0]).sum())
                near = units[start:middle] @ units[middle:end].T >= threshold
                counts[start:middle] += near.sum(1)
                counts[middle:end] += near.sum(0)
        return pa.table({"_row": rows.column("_row"), "n": pa.array(counts)})

    return run


def _tiled(members: DataFrame):
    """Groups of two tiles of ``(_row, component, dims, vec)``, or of one tile of many small components."""
    sizes = members.groupBy("component", "dims").agg(F.count("*").alias("_size"))
    total = members.count()
    tiles = F.ceil(F.col("_size") / TILE).cast("int")
    sized = members.join(sizes.withColumn("_tiles", tiles).drop("_size"), ["component", "dims"])
    tile = F.pmod(F.xxhash64("_row"), F.col("_tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other")
    placed = sized.withColumn("tile", tile).select("*", other).select(
        "component", "dims", "tile", "_row", "vec",
        F.least("tile", "_other").alias("low"), F.greatest("tile", "_other").alias("high"),
        F.when(F.col("_tiles") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(1 + total // TILE))).alias("pack"),
    )
    return placed.groupBy("pack", "dims", "low", "high")


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``(_row, n_links)`` of ``(_row, component, dims, vec)``: links to others of the component.

    Components larger than a tile are compared tile by tile, each pair of tiles in a group of its
    own; small ones are packed, about a tile's rows to a group.
    """
    partial = _tiled(members).applyInArrow(_count(threshold), "_row bigint, n bigint")
    return partial.groupBy("_row").agg(F.sum("n").alias("n_links"))


def near_vectors(
    df: DataFrame, threshold: float = 0.93, window: int = WINDOW, miss: float = MISS, seed: int = 1,
    key: str = "vec_id", vector: str = "embedding", group: str = "label",
) -> DataFrame:
    """``(key, n_links, component_id, kept)``: one row per row of ``df``.

    Rows link when their ``group`` is equal and not null and the cosine reaches ``threshold``, in
    double precision. Vectors that are null, empty, zero, or hold null or non-finite components,
    link with nothing; vectors of different lengths neither. ``component_id`` is the smallest key
    reachable, itself included; a null key names no component. Repeated rows count as other
    vectors. An empty table gives an empty table; other columns are not read.
    """
    rows = numbered(df, "vector-rows", key=key, label=group, vec=vector)
    linkable = rows.where(F.col("label").isNotNull() & usable("vec")).select(
        "_row", F.xxhash64("label").alias("group"), F.size("vec").alias("dims"), "vec"
    )
    found = components(found_links(linkable, threshold, window, miss, seed), "vector-links")
    found = written(found, "vector-components")
    counts = link_counts(found.join(linkable, found.node == linkable._row).select("_row", "component", "dims", "vec"), threshold)
    ids = rows.select("_row", "key")
    least = found.join(ids, found.node == ids._row).groupBy("component").agg(F.min("key").alias("_least"))
    named = found.join(least, "component").select(F.col("node").alias("_row"), "_least").join(counts, "_row", "left")
    return ids.join(named, "_row", "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("_least", "key").alias("component_id"),
        F.coalesce(F.col("key") == F.coalesce("_least", "key"), F.lit(False)).alias("kept"),
    )
