"""Fingerprints of documents from prefix polynomial hashes, and how alike two of them are.

A fingerprint holds the prefix array of a text at a few landmarks: the name of what stands before
each, and so the name of every span between two of them. Landmarks depend on the text around
them, not on how far from its start they are, so a passage carries its own into any document.

Landmarks are found level by level. Every place of a text has a rank, the name of the ``CONTEXT``
code points before it (ties are ordered by place). The first level has all places; at level n a
place stays if no other within ``2 ** n`` has a lower rank. The first level with at most ``KEEP``
places makes the fingerprint. Two fingerprints of different levels are compared at the higher
one, which the ranks of the lower one give.

Likeness is the share of both texts that lies in common stretches between landmarks. A stretch
that starts with an equal piece is extended as far as both texts are the same; because equality
of prefixes is monotone, a binary search over span names finds the end.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagequarry.llm.fields import with_fields
from pagequarry.llm.polyhash import BASES, PRIME, Powers, Prefixes

KEEP = 48  # landmarks at most
CONTEXT = 12  # code points that rank a place
STRETCH = 8  # code points of a common stretch at least, or half of the shorter text
PIECE = 1 << 16  # code points worked on at once; longer texts have landmarks of level LOCAL at least
LOCAL = 6
HEAD = "<QIIB"  # code points, the two sums of the whole text, the level
MARK = np.dtype([("place", "<u4"), ("sum", "<u4"), ("rank", "<u2")])
SHUFFLE, LOW_BITS = np.uint64(0x9E3779B1), np.uint64((1 << 32) - 1)
INVERSE = pow(BASES[0], -1, PRIME)


def keys(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The total order of places: by rank, then by a fixed shuffle of the numbers below 2**32."""
    return (rank.astype(np.uint64) << np.uint64(32)) | (place.astype(np.uint64) * SHUFFLE & LOW_BITS)


def stay(place: np.ndarray, key: np.ndarray, level: int) -> np.ndarray:
    """Which places no other within ``2 ** level`` undercuts.

    Those of the level before are more than half of that apart, so only neighbours can.
    """
    out = np.ones(len(place), bool)
    near = np.diff(place) <= 1 << level
    falls = key[1:] < key[:-1]
    out[:-1] &= ~(near & falls)
    out[1:] &= ~(near & ~falls)
    return out


def landmarks(codes: np.ndarray, made: Powers) -> tuple[np.ndarray, int, tuple[int, int]]:
    """The landmarks of a text, their level, and the name of the whole text, as two sums."""
    size, margin = len(codes), 2 << LOCAL
    totals, level, found = [0, 0], 0, []
    for begin in range(0, max(size, 1), PIECE):
        end = min(begin + PIECE, size)
        low, high = max(0, begin - margin - CONTEXT), min(size, end + margin)
        hashes = Prefixes(codes[low:high], made)
        place = np.arange(max(1, begin - margin), high)
        rank = hashes.part(0, np.maximum(place - CONTEXT, 0) - low, place - low) >> np.uint64(15)
        # In a piece of a longer text, what a place needs to know is within the margin up to LOCAL.
        place, rank, level = thinned(place, rank, 0, LOCAL if size > PIECE else None)
        own = (place >= begin) & (place < end)
        shift = [pow(base, low, PRIME) for base in BASES]
        marks = np.empty(np.count_nonzero(own), MARK)
        marks["place"], marks["rank"] = place[own], rank[own]
        inside = (hashes.sums[0][place[own] - low] + np.uint64(PRIME) - hashes.sums[0][begin - low]) % np.uint64(PRIME)
        marks["sum"] = (inside * np.uint64(shift[0]) + np.uint64(totals[0])) % np.uint64(PRIME)
        found.append(marks)
        for which, sums in enumerate(hashes.sums):
            more = (int(sums[end - low]) - int(sums[begin - low])) * shift[which]
            totals[which] = (totals[which] + more) % PRIME
    marks = np.concatenate(found)
    if size > PIECE:
        marks, level = coarser(marks, level, None)
    return marks, level, (totals[0], totals[1])


def thinned(place: np.ndarray, rank: np.ndarray, level: int, upto: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of a higher level: of ``upto``, or the first one with few enough."""
    key = keys(rank, place)
    while len(place) > KEEP if upto is None else level < upto:
        left = stay(place, key, level)
        place, rank, key, level = place[left], rank[left], key[left], level + 1
    return place, rank, level


def coarser(marks: np.ndarray, level: int, upto: int | None) -> tuple[np.ndarray, int]:
    """The same for landmarks of a fingerprint."""
    place = marks["place"].astype(np.int64)
    places, _, level = thinned(place, marks["rank"], level, upto)
    return marks[np.searchsorted(place, places)], level


def fingerprint(text: str, made: Powers) -> bytes:
    """The fingerprint of a text; equal texts have equal ones."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    marks, level, whole = landmarks(codes, made)
    return struct.pack(HEAD, len(codes), *whole, level) + marks.tobytes()


def _pieces(size: int, total: int, marks: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The bounds of the pieces of a text, the sums before them, and the powers that make names."""
    places = [0, *marks["place"].tolist(), size]
    return places, [0, *marks["sum"].tolist(), total], [pow(INVERSE, p, PRIME) for p in places[:-1]]


def likeness(a: bytes, b: bytes) -> float:
    """The share of two texts, from 0 to 1, that lies in common stretches, from their fingerprints.

    1 for equal texts; 0 if one is empty and the other is not, or nothing is in common.
    """
    if a == b:
        return 1.0
    a, b = min(a, b), max(a, b)
    (size_a, total_a, _, level_a), (size_b, total_b, _, level_b) = struct.unpack_from(HEAD, a), struct.unpack_from(HEAD, b)
    if not size_a or not size_b:
        return 0.0
    marks_a, marks_b = np.frombuffer(a, MARK, offset=struct.calcsize(HEAD)), np.frombuffer(b, MARK, offset=struct.calcsize(HEAD))
    if level_a < level_b:
        marks_a, _ = coarser(marks_a, level_a, level_b)
    elif level_b < level_a:
        marks_b, _ = coarser(marks_b, level_b, level_a)
    at_a, sum_a, turn_a = _pieces(size_a, total_a, marks_a)
    at_b, sum_b, turn_b = _pieces(size_b, total_b, marks_b)

    def name(sums: list[int], turns: list[int], start: int, stop: int) -> int:
        return (sums[stop] - sums[start]) * turns[start] % PRIME

    starts: dict[tuple[int, int], list[int]] = {}
    for j in range(len(turn_b)):
        starts.setdefault((at_b[j + 1] - at_b[j], name(sum_b, turn_b, j, j + 1)), []).append(j)
    free = [True] * len(turn_b)
    least = min(STRETCH, max(1, min(size_a, size_b) // 2))
    covered = i = 0
    while i < len(turn_a):
        best = best_at = 0
        for j in starts.get((at_a[i + 1] - at_a[i], name(sum_a, turn_a, i, i + 1)), ()):
            most = 0
            while i + most < len(turn_a) and j + most < len(turn_b) and free[j + most]:
                most += 1
            low = min(1, most)
            while low < most:
                half = (low + most + 1) // 2
                same = at_a[i + half] - at_a[i] == at_b[j + half] - at_b[j] and name(sum_a, turn_a, i, i + half) == name(sum_b, turn_b, j, j + half)
                low, most = (half, most) if same else (low, half - 1)
            if low > best:
                best, best_at = low, j
        if best and at_a[i + best] - at_a[i] >= least:
            covered += at_a[i + best] - at_a[i]
            free[best_at : best_at + best] = [False] * best
            i += best
        else:
            i += 1
    return min(1.0, 2 * covered / (size_a + size_b))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_chars, fingerprint)``: one row per row of ``docs``; the fingerprint is binary.

    A null text counts as empty. Null keys and repeated rows stay as they are; an empty table gives
    an empty table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Powers()
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            prints = pa.array([fingerprint(t, made) for t in texts], pa.binary())
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, prints], names=[key, "n_chars", "fingerprint"])

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, with_fields(rows.schema[key], n_chars="bigint", fingerprint="binary"))


def _range_of(order: Column, lows: Column, count: int) -> Column:
    """The number of the last of ``lows``, ascending, that is not above ``order``; 0 if all are. A binary search."""
    steps = F.lit([1 << s for s in reversed(range(count.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(lows, at + step) <= order, at + step).otherwise(at))


def chained(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ahead, text)``, sorted by key within partitions: the row before any other is its neighbour.

    Each partition starts with a row marked ``ahead``, a copy of the last row of the partition
    before (of the last partition, for the first one). Rows with equal keys are ordered by a hash
    of their texts. The bounds of the partitions come from the sorted keys, without the texts,
    which move once; the driver sees two keys per partition.
    """
    spark = docs.sparkSession
    # Rows of equal key and text are interchangeable; their number lets many partitions share them.
    order = F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = docs.select(F.col(key), F.col(text).cast("string").alias(text), order.alias("_order"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = rows.select("_order").repartitionByRange(parts, "_order")
    ranges = sorted_keys.groupBy(F.spark_partition_id()).agg(F.min("_order").alias("low"), F.max("_order").alias("high"))
    found = ranges.select(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("all")).select(
        F.to_json("all.low", {"ignoreNullFields": "false"}), F.to_json("all.high", {"ignoreNullFields": "false"}), F.size("all")
    )
    low_text, high_text, count = found.first()
    if not count:
        return rows.select(key, F.lit(False).alias("ahead"), text)
    kind = f"array<{rows.schema['_order'].dataType.simpleString()}>"
    lows, highs = F.from_json(F.lit(low_text), kind), F.from_json(F.lit(high_text), kind)
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("ahead"))
    following = F.struct(((F.col("_part") + 1) % count).alias("part"), F.lit(True).alias("ahead"))
    last = F.get(highs, F.col("_part")) == F.col("_order")
    placed = rows.withColumn("_part", _range_of(F.col("_order"), lows, count)).select(
        key, text, "_order", F.explode(F.when(last, F.array(own, following)).otherwise(F.array(own))).alias("_to")
    )
    dealt = placed.select(key, text, "_order", "_to.*").repartitionById(count, F.col("part"))
    return dealt.sortWithinPartitions(F.desc("ahead"), "_order").select(key, "ahead", text)


def against_edit(docs: DataFrame, edit: Callable[[str, str], str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against an edited version of itself, and against the next document by descending key.

    ``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, one
    row per row of ``docs``; fingerprints are binary, likenesses from 0 to 1. ``edit`` makes the
    edited text from a text and that of the next document; after the last document comes the first,
    so the only row of a table is its own next one. Null keys come last, rows of equal key in the
    order of a hash of their texts; a null text counts as empty. An empty table gives an empty
    table; other columns are not read. Keys are numbers or strings. The rows are read twice and
    have to come in the same partitions, as those of a file or a written table do.
    """
    made_of = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Powers()
        # By ascending key, the row before is the next one of the descending order.
        other, other_print = "", b""
        for batch in batches:
            out: list[tuple] = []
            for ahead, value in zip(batch.column(1).to_pylist(), batch.column(2)):
                value = value.as_py() or ""
                own = fingerprint(value, made)
                if not ahead:
                    edited = edit(value, other)
                    changed = fingerprint(edited, made)
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((len(value), digest, own, changed, likeness(own, changed), likeness(own, other_print)))
                other, other_print = value, own
            kept = batch.column(0).filter(pc.invert(batch.column(1)))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(made_of.values())]
            yield pa.RecordBatch.from_arrays([kept, *columns], names=[key, *made_of])

    rows = chained(docs, key, text)
    kinds = dict(n_chars="bigint", edited_sha256="string", fingerprint="binary", edited_fingerprint="binary", near_edited="double", near_next="double")
    schema: StructType = with_fields(rows.schema[key], **kinds)
    return rows.mapInArrow(run, schema)
