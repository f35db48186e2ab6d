"""Approximate nearest neighbours by multi-index hashing.

Codes are the signs of learned rotations (principal axes, turned so that the signs lose least),
cut into bytes. A block of vectors indexes its codes once per byte: byte value -> rows. A query
probes every byte for the values within the share of the radius that the pigeonhole principle
leaves to it, so every code within the radius is met; these are checked by their whole distance
and reranked by the cosine of the original vectors. Blocks of vectors meet chunks of queries in
groups of bounded size, and each group returns the nearest few of each query.

The rotation and the radius are learned from a bounded sample: at most ``fit_rows`` vectors. The
radius is the distance that all but ``miss`` of the true neighbours within the sample keep to; in
the whole table neighbours are nearer. A block in which the radius yields too few widens it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.llm.vectors import matrix, numbered, unit, usable

FIT_ROWS = 8192
ROTATIONS = 4  # codes have this many bits per dimension
TURNS = 20  # steps of learning a rotation
MISS = 0.01
BLOCK = 16_384  # vectors of an index
CHUNK = 4096  # queries that meet a block together
MASKS = [np.nonzero(np.bitwise_count(np.arange(256)) <= r)[0] for r in range(9)]  # by distance


@dataclass(frozen=True)
class Codes:
    """How vectors become codes, and how far codes of neighbours are apart."""

    mean: np.ndarray
    turn: np.ndarray  # dimensions x bits
    radius: int

    def of(self, units: np.ndarray) -> np.ndarray:
        """The codes as rows of bytes."""
        return np.packbits((units - self.mean) @ self.turn > 0, axis=1)


def learn(sample: np.ndarray, k: int, rotations: int = ROTATIONS, miss: float = MISS, seed: int = 6) -> Codes:
    """Fit codes to unit vectors, the rows of ``sample``."""
    dims = sample.shape[1]
    mean = sample.mean(0)
    _, axes = np.linalg.eigh(np.cov((sample - mean).T).reshape(dims, dims))
    spread = (sample - mean) @ axes
    turns = []
    for number in range(rotations):
        turn = np.linalg.qr(np.random.default_rng([seed, number]).standard_normal((dims, dims)))[0]
        for _ in range(TURNS):  # the nearest corners, then the rotation that brings them nearest
            left, _, right = np.linalg.svd(spread.T @ np.sign(spread @ turn))
            turn = left @ right
        turns.append(axes @ turn)
    whole = np.hstack(turns)
    whole = np.hstack([whole, np.zeros((dims, -whole.shape[1] % 8))])
    codes = Codes(mean, whole, 0)
    packed = codes.of(sample)
    asked = np.arange(0, len(sample), max(1, len(sample) // 512))
    cosine = sample[asked] @ sample.T
    cosine[np.arange(len(asked)), asked] = -2
    near = np.argsort(-cosine, 1)[:, : min(k, len(sample) - 1)]
    distance = np.bitwise_count(packed[asked][:, None] ^ packed[near]).sum(2, dtype=int)
    return Codes(mean, whole, int(np.quantile(distance, 1 - miss)) if distance.size else 0)


class Index:
    """A block of codes, by the value of each byte."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code differs from ``code`` in at most ``radius`` bits."""
        parts = len(code)
        # If every byte had more than its share, the sum would exceed the radius.
        share, more = divmod(radius, parts)
        seen = np.zeros(len(self.codes), bool)
        for part in range(parts):
            allowed = share if part <= more else share - 1
            if allowed < 0:
                continue
            values = code[part] ^ MASKS[min(allowed, 8)].astype(np.uint8)
            starts, ends = self.starts[part][values], self.starts[part][values.astype(int) + 1]
            sizes = ends - starts
            upto = np.cumsum(sizes)
            seen[self.order[part][np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1])]] = True
        rows = np.nonzero(seen)[0]
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=int) <= radius]


def _search(codes: dict[int, dict], k: int):
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, float]] = []
        if len(block) and len(asked):
            model = Codes(**codes[block.column("dims")[0].as_py()])
            rows, keys = block.column("_row").to_numpy(), block.column("key").to_numpy()
            units = unit(matrix(block.column("vec").combine_chunks()))
            index = Index(model.of(units))
            queries = unit(matrix(asked.column("vec").combine_chunks()))
            bits = 8 * index.codes.shape[1]
            for own, query, code in zip(asked.column("_row").to_pylist(), queries, model.of(queries)):
                radius = model.radius
                near = index.within(code, radius)
                while (near := near[rows[near] != own]).size < k and radius < bits:
                    radius += len(code)
                    near = index.within(code, radius)
                cosine = units[near] @ query
                best = np.lexsort((keys[near], -cosine))[:k]
                found += [(own, int(rows[near[i]]), int(keys[near[i]]), float(cosine[i])) for i in best]
        names = ["_asked", "_row", "key", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table({n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate(zip(names, kinds))})

    return run


def nearest(
    df: DataFrame, asked: str, k: int = 5, fit_rows: int = FIT_ROWS, seed: int = 6, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest of every row for which ``asked`` holds.

    ``asked`` is a condition on the key, named ``key``. ``score`` is the cosine in double
    precision; ties go to the smaller key. Every row of the query's length but its own is a
    candidate; a query with fewer candidates gets all. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows without a key. Vectors of each length
    have codes of their own; the lengths should be few. Repeated rows are queries and candidates of
    their own. An empty table gives an empty table.
    """
    rows = numbered(df, "ann-rows", key=key, vec=vector).where(F.col("key").isNotNull() & usable("vec"))
    rows = rows.select("_row", F.col("key").cast("bigint").alias("key"), "vec", F.size("vec").alias("dims"))
    queries = rows.where(F.expr(asked))
    counts = rows.groupBy("dims").agg(F.count("*").alias("rows"), F.count_if(F.expr(asked)).alias("asked")).where("asked > 0").collect()
    out = "_asked bigint, _row bigint, key bigint, score double"
    if not counts:
        found = df.sparkSession.createDataFrame([], out)
    else:
        mix = F.xxhash64("_row", F.lit(seed))
        drawn = rows.where(F.col("dims").isin([c["dims"] for c in counts])).withColumn("mix", mix)
        first = F.row_number().over(W.partitionBy("dims").orderBy("mix"))
        samples: dict[int, list] = {c["dims"]: [] for c in counts}
        for r in sorted(drawn.withColumn("place", first).where(F.col("place") <= fit_rows).select("dims", "place", "vec").collect(), key=lambda r: r["place"]):
            samples[r["dims"]].append(r["vec"])
        codes = {dims: vars(learn(unit(np.array(sample, np.float64)), k, seed=seed)) for dims, sample in samples.items()}
        split = lambda count, size: F.create_map(*[F.lit(x) for c in counts for x in (c["dims"], -(-c[count] // size))])[F.col("dims")]
        blocks, chunks = split("rows", BLOCK), split("asked", CHUNK)
        part = F.pmod(F.xxhash64("_row"), blocks).cast("int").alias("block")
        piece = F.pmod(F.xxhash64("_row"), chunks).cast("int").alias("chunk")
        placed = rows.where(chunks.isNotNull()).select("*", part, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        asking = queries.select("*", piece, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        keys = ["dims", "block", "chunk"]
        found = placed.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_search(codes, k), out)
    order = W.partitionBy("_asked").orderBy(F.desc("score"), "key", "_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asker = queries.select(F.col("_row").alias("_asked"), F.col("key").alias("query_id"))
    return ranked.join(asker, "_asked").select("query_id", "rank", F.col("key").alias("vec_id"), "score")
