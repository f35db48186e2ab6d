"""Packing token ids into rows of fixed length, best fit decreasing, and binary output.

A task takes texts until they have about ``GROUP`` tokens, and packs these: texts longer than a
row are cut into full rows and a rest, and the rests go, longest first, to the row with the least
room that still holds them. A segment tree over the possible amounts of room finds that row.
Groups never leave their task, so nothing is shuffled, whatever the size of the corpus; a group
is thousands of rows, and hardly any room is left over.

A packed row has its ids as little-endian 16-bit numbers (32-bit if the vocabulary needs them),
padded to the full length; the ends of its segments as cumulative lengths, from 0; and positions
that start anew with each segment. With the document and the offset of each segment, every
document can be put together again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.fields import with_fields

ROW = 2048
GROUP = 1 << 22  # tokens packed together


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: base64, then the rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Room:
    """Rows by the room they have left; finds the least room that is enough, in logarithmic time."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]
        self.filled = [False] * (2 * self.leaves)  # whether a node's range of rooms has a row

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node and not self.filled[node]:
            self.filled[node] = True
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``, and that room."""
        node = self.leaves + need
        filled = self.filled
        if not filled[node]:
            # Up to the first subtree on the right that has a row, then down to its left.
            while node > 1 and not (node % 2 == 0 and filled[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if filled[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            filled[node] = False
            while node > 1 and not filled[node ^ 1]:
                node //= 2
                filled[node] = False
        return row, room


def pack(lengths: np.ndarray, size: int) -> list[list[tuple[int, int, int]]]:
    """Rows of segments ``(text, start, end)`` for texts of the given lengths. Every token is in one."""
    rows: list[list[tuple[int, int, int]]] = []
    rests = []
    for text, length in enumerate(lengths.tolist()):
        full = length - length % size
        rows += [[(text, start, start + size)] for start in range(0, full, size)]
        if length > full:
            rests.append((full - length, text, full, length))
    room = Room(size)
    for less, text, start, end in sorted(rests):
        found = room.take(-less)
        if found is None:
            row, left = len(rows), size
            rows.append([])
        else:
            row, left = found
        rows[row].append((text, start, end))
        if left + less:
            room.add(row, left + less)
    return rows


def packed(
    docs: DataFrame, path: str, pattern: str, size: int = ROW, pad: int | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Packed rows: ``(row_id, keys, offsets, cumulative, n_tokens, ids, positions)``.

    ``keys`` and ``offsets`` say which document each segment is from, and the place of its first
    token there; ``cumulative`` has the ends of the segments, 0 first; ``ids`` and ``positions``
    are binary, ``size`` numbers each; what is beyond ``n_tokens`` holds ``pad`` (one above the
    largest id unless given) and position 0. A null or empty text has no tokens and is in no row;
    a null key stays null in ``keys``; repeated rows are packed repeatedly; an empty table gives
    no rows; other columns are not read. ``row_id`` is unique, but depends on how the table is
    partitioned.
    """
    ranks = load_ranks(path)
    top = max(ranks.values())
    filler = top + 1 if pad is None else pad
    kind = "<u2" if max(top, filler, size) < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        part = TaskContext.get().partitionId()
        tokens: list[np.ndarray] = []
        keys: list[pa.Array] = []
        total = made = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = pack(np.array([len(t) for t in tokens]), size)
            all_keys = pa.concat_arrays(keys)
            for first in range(0, len(rows), 1024):
                some = rows[first : first + 1024]
                ids = np.full((len(some), size), filler, kind)
                positions = np.zeros((len(some), size), kind)
                ends = []
                for i, row in enumerate(some):
                    at = 0
                    ends.append([0])
                    for t, start, end in row:
                        ids[i, at : at + end - start] = tokens[t][start:end]
                        positions[i, at : at + end - start] = np.arange(end - start)
                        at += end - start
                        ends[-1].append(at)
                sizes = np.cumsum([0, *map(len, some)])
                flat = [s for row in some for s in row]
                lists = [
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
                    for values in (all_keys.take(pa.array([s[0] for s in flat])), pa.array([s[1] for s in flat], pa.int64()))
                ]
                numbers = (part << 32) + made + np.arange(len(some))
                made += len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers), *lists, pa.array(ends, pa.list_(pa.int32())), pa.array([e[-1] for e in ends], pa.int32()),
                        pa.array([r.tobytes() for r in ids], pa.binary()), pa.array([r.tobytes() for r in positions], pa.binary()),
                    ],
                    names=["row_id", "keys", "offsets", "cumulative", "n_tokens", "ids", "positions"],
                )
            tokens.clear()
            keys.clear()

        for batch in batches:
            start = 0
            for i, value in enumerate(batch.column(1)):
                tokens.append(np.array(encode(value.as_py() or ""), kind))
                total += len(tokens[-1])
                if total >= GROUP:
                    keys.append(batch.column(0).slice(start, i + 1 - start))
                    yield from done()
                    start, total = i + 1, 0
            keys.append(batch.column(0).slice(start))
        if tokens:
            yield from done()

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    name = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(
        run,
        with_fields(
            row_id="bigint", keys=f"array<{name}>", offsets="array<bigint>", cumulative="array<int>", n_tokens="int", ids="binary", positions="binary"
        ),
    )


def write(rows: DataFrame, folder: str) -> None:
    """Write packed rows as Parquet files, the matrices as binary columns."""
    rows.write.mode("overwrite").parquet(folder)
