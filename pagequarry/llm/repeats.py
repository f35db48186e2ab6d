"""Exact substring dedup: bytes covered by a long string that starts anywhere else as well.

Prefix doubling over the positions that matter. Strings get names by doubling: the name of the
2n bytes at a position comes from the pair of names of n bytes there and n bytes on. Spark sorts
(name, position) rows over all documents at growing lengths; equal neighbours share a rank, a
string without an equal neighbour is unique and its positions are dropped, and what is equal past
the threshold is a repeat.

A row for every byte would be many times the corpus, so a window of ``LENGTH`` bytes is named
after its anchor, the ``CORE``-byte string in it with the smallest name; equal windows have equal
anchors at equal places, and an anchor serves some hundred windows. A round looks at runs of
consecutive windows with one anchor. What all windows of the run share (the inner string) must be
repeated for any of them to be, and if what they cover together (the outer string) is repeated,
all are. Runs in between are cut into shorter ones for the next round: 273 windows, then 21, then
single ones, whose inner and outer strings are the window itself.

The sort keys end in the position, so a string that a third of all rows share is spread over many
sorted partitions like any other, and no task sees more than a partition.

The same rounds find the passages of ``WORDS`` words that another row has as well: strings of words
instead of bytes, and only what stands in several rows counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.session import written

LENGTH = 400
CORE = 128
ROUNDS = (273, 21, 1)  # windows that are named together; the first is LENGTH - CORE + 1
BUFFER = 1 << 17  # bytes named at once
PIECE = 1 << 22  # windows of a long text named at once
PART = 250_000  # rows of a sorted partition
PLACE_BITS = 24  # of a position in a buffer, beside the upper bits of a name
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = np.random.default_rng(10).integers(0, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OUTSIDE = 256  # stands for what is before and after a text
WORDS = 51
BLANK = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 1 << 18  # bytes split into words at once
WORD = 64  # bytes of a word that are named eight by eight; a longer word is named by a digest
EIGHT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first bytes of eight


@dataclass(frozen=True)
class Shape:
    """The threshold, the anchor's size, and the windows named together in each round.

    With ``words`` they are counted in words, and what repeats within one row only is no repeat.
    """

    length: int = LENGTH
    core: int = CORE
    rounds: tuple[int, ...] = ROUNDS
    words: bool = False

    @property
    def gap(self) -> int:
        return self.length - self.core

    @property
    def least(self) -> int:
        """The bytes of the shortest text with a window."""
        return 2 * self.length - 1 if self.words else self.length


PASSAGES = Shape(WORDS, 12, (40, 8, 1), True)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of two strings one after the other, from theirs."""
    name = left * MULTIPLIER
    name ^= name >> np.uint64(29)
    name *= MULTIPLIER
    name += right
    return name


def _split(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte and the name of each word; words are separated by ASCII white space."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = (padded[:-8] == 0x20) | (padded[:-8] - np.uint8(0x09) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    names = pair(eights[first] & EIGHT[np.minimum(size, 8)], size.view(np.uint64))
    more = np.flatnonzero(size > 8)
    for at in range(8, WORD, 8):
        names[more] = pair(names[more], eights[first[more] + at] & EIGHT[np.minimum(size[more] - at, 8)])
        more = more[size[more] > at + 8]
    for i in more:
        names[i] = int.from_bytes(blake2b(data[first[i] : first[i] + size[i]], digest_size=8).digest())
    return first, names


def word_names(texts: list[bytes]) -> list[np.ndarray]:
    """The names of the words of each text, from all texts together."""
    data = b" ".join(texts)
    first, names, start = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while start < len(data):
        blank = BLANK.search(data, start + BLOCK) if len(data) - start > BLOCK else None
        stop = blank.start() if blank else len(data)
        at, name = _split(data[start:stop])
        first.append(at + start)
        names.append(name)
        start = stop
    words = np.concatenate(names)
    upto = np.searchsorted(np.concatenate(first), np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    return [words[a:b] for a, b in zip(upto, upto[1:])]


def units(texts: Iterable[tuple[tuple, bytes]], shape: Shape) -> Iterator[tuple[tuple, bytes | np.ndarray]]:
    """Texts as their bytes or the names of their words, with what came with them."""
    if not shape.words:
        yield from texts
        return
    about, held, size = [], [], 0
    for what, text in texts:
        about.append(what)
        held.append(text)
        size += len(text)
        if size >= BLOCK:
            yield from zip(about, word_names(held))
            about, held, size = [], [], 0
    yield from zip(about, word_names(held))


class Names:
    """Names of strings in a buffer of texts, by doubling up to ``longest`` bytes (or words, given by their names)."""

    def __init__(self, texts: list[bytes] | list[np.ndarray], gap: int, longest: int):
        self.starts = np.cumsum([gap, *(len(t) + gap for t in texts)])[:-1] if texts else np.empty(0, int)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        words = bool(texts) and isinstance(texts[0], np.ndarray)
        outside, kind = (SYMBOLS[OUTSIDE], np.uint64) if words else (OUTSIDE, np.int64)
        symbols = np.full(int(self.sizes.sum()) + gap * (len(texts) + 1), outside, kind)
        for start, text in zip(self.starts, texts):
            symbols[start : start + len(text)] = text if words else np.frombuffer(text, np.uint8)
        self.levels = [symbols if words else SYMBOLS[symbols]]
        n = 1
        while 2 * n <= longest:
            last = self.levels[-1]
            self.levels.append(pair(last[:-n], last[n:]) if len(last) > n else last[:0])
            n *= 2

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        """The names of the strings of ``length`` bytes at the given places."""
        name, at = None, start
        while length:
            level = min(length.bit_length(), len(self.levels)) - 1
            piece = self.levels[level][at]
            name = piece if name is None else pair(name, piece)
            at = at + (1 << level)
            length -= 1 << level
        return name

    def everywhere(self, length: int) -> np.ndarray:
        """The names of the strings of ``length`` bytes at all places."""
        n = len(self.levels[0]) - length + 1
        return self.of(np.arange(n), length) if length & (length - 1) else self.levels[length.bit_length() - 1][:n]


def anchors(names: Names, shape: Shape, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, place, low, high, core name)``: each anchor and how far before it its windows start.

    ``first`` and ``last`` bound the windows to look at in each text; none if last < first.
    """
    core = names.everywhere(shape.core)
    places = np.arange(len(core), dtype=np.uint64)
    keyed = core * MULTIPLIER
    keyed = (keyed & ~np.uint64((1 << PLACE_BITS) - 1)) | places
    # Sliding minimum: by doubling, then two overlapping halves.
    n, reach = 1, shape.gap + 1
    while 2 * n <= reach:
        keyed = np.minimum(keyed[:-n], keyed[n:])
        n *= 2
    if reach > n:
        keyed = np.minimum(keyed[: len(keyed) - (reach - n)], keyed[reach - n :])
    counts = np.maximum(last - first + 1, 0)
    texts = np.repeat(np.arange(len(counts)), counts)
    upto = np.cumsum(counts)
    windows = np.repeat(names.starts + first - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)
    anchor = (keyed[windows] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    turn = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (texts[1:] != texts[:-1])])[: len(anchor)]
    begin = np.nonzero(turn)[0]
    end = np.append(begin[1:], len(anchor))[: len(begin)] - 1
    at = anchor[begin]
    return texts[begin], at, at - windows[end], at - windows[begin], core[at]


def pieces(text: bytes | np.ndarray, shape: Shape, limit: int = PIECE) -> Iterator[tuple[int, bytes | np.ndarray, int, int]]:
    """``(offset, part, first window, last window)``: a long text in parts, with what lies around."""
    windows = len(text) - shape.length + 1
    for start in range(0, windows, limit):
        stop = min(start + limit, windows)
        base = max(0, start - shape.gap)
        yield base, text[base : stop + shape.length + shape.gap], start - base, stop - 1 - base


KEYS = ["grp", "inner_name", "outer_name", "k1", "k2", "place", "low", "high", "first", "salt"]
ROWS = "grp bigint, inner_name bigint, outer_name bigint, k1 bigint, k2 bigint, place bigint, low int, high int, first int, salt bigint"


def _rows(core, names, buffer_at, first, size, shape, k1, k2, place, low, high, salt) -> pa.RecordBatch:
    """Rows of runs of ``size`` windows; the last window of a run starts ``first`` bytes before its anchor."""
    inner = core if size == shape.rounds[0] else names.of(buffer_at - first, shape.length - size + 1)
    outer = inner if size == 1 else names.of(buffer_at - first - size + 1, shape.length + size - 1)
    group = core + first.astype(np.uint64) * MULTIPLIER
    columns = [group.view(np.int64), inner.view(np.int64), outer.view(np.int64), k1, k2, place, low, high, first, salt]
    kinds = [pa.int64()] * 6 + [pa.int32()] * 3 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=KEYS)


def _first_round(shape: Shape):
    """Rows of all anchors. A text met more than twice in a task adds nothing that two do not show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], int] = {}
        part = TaskContext.get().partitionId()

        def named(texts: list, about: list[tuple]) -> pa.RecordBatch:
            names = Names(texts, shape.gap, shape.core)
            k1, k2, salt, base, first, last = np.array(about, np.int64).reshape(-1, 6).T
            text, at, low, high, core = anchors(names, shape, first, last)
            zero = np.zeros(len(at), np.int64)
            place = at - names.starts[text] + base[text]
            return _rows(core, names, at, zero, shape.rounds[0], shape, k1[text], k2[text], place, low, high, salt[text])

        def whole(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bytes]]:
            for k1, k2, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                times = met[k1, k2] = met.get((k1, k2), 0) + 1
                if times <= 2:
                    yield (k1, k2, times), value.as_py().encode()

        for batch in batches:
            texts, about, size = [], [], 0
            for (k1, k2, times), data in units(whole(batch), shape):
                for base, piece, first, last in pieces(data, shape):
                    texts.append(piece)
                    about.append((k1, k2, 2 * part + times - 1, base, first, last))
                    size += len(piece)
                    if size >= BUFFER:
                        yield named(texts, about)
                        texts, about, size = [], [], 0
            if texts:
                yield named(texts, about)

    return run


def _next_round(shape: Shape, before: int, size: int):
    """Rows of runs of ``size`` windows, for the runs of ``before`` windows left to look at.

    Names what lies around each anchor. A text with copies gives each row twice, one for a copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            around, about, total = [], [], 0
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)))
            for (k1, k2, copies, runs), text in units((((r[0], r[1], *r[3:]), r[2].encode()) for r in rows), shape):
                for r in runs:
                    base = max(0, r["place"] - shape.gap)
                    around.append(text[base : r["place"] + shape.length])
                    about.append((k1, k2, base, r["place"], r["low"], r["high"], r["first"], min(copies, 2)))
                    total += len(around[-1])
                    if total >= BUFFER:
                        yield named(around, about)
                        around, about, total = [], [], 0
            if about:
                yield named(around, about)

    def named(around: list, about: list[tuple]) -> pa.RecordBatch:
        k1, k2, base, place, low, high, first, copies = np.array(about, np.int64).T
        names = Names(around, shape.gap, 256)
        steps = np.arange(0, before, size)
        pick = np.repeat(np.arange(len(first)), len(steps))
        start = (first[:, None] + steps).ravel()
        there = (start <= high[pick]) & (start + size > low[pick])
        pick, start = pick[there], start[there]
        salt = np.concatenate([np.zeros(len(pick), np.int64), np.ones(int((copies[pick] > 1).sum()), np.int64)])
        start = np.concatenate([start, start[copies[pick] > 1]])
        pick = np.concatenate([pick, pick[copies[pick] > 1]])
        at = (names.starts + place - base)[pick]
        core = names.of(at, shape.core)
        return _rows(core, names, at, start, size, shape, k1[pick], k2[pick], place[pick], low[pick], high[pick], salt)

    return run


FOUND = "k1 bigint, k2 bigint, start bigint, stop bigint, place bigint, low int, high int, first int, part int, side int, grp bigint, name bigint, salt bigint"
FOUND_NAMES = [f.split()[0] for f in FOUND.split(", ")]
FOUND_KINDS = [pa.int64()] * 5 + [pa.int32()] * 5 + [pa.int64()] * 3


def _found(rows: pa.Table, at: np.ndarray, shape: Shape, size: int, part: int, accepted: bool, side: np.ndarray | None = None) -> pa.RecordBatch:
    col = {n: rows.column(n).to_numpy()[at] for n in ("k1", "k2", "place", "low", "high", "first", "grp", "outer_name", "salt")}
    near = np.maximum(col["low"], col["first"])
    far = np.minimum(col["high"], col["first"] + size - 1)
    no = pa.nulls(len(at))
    start, stop = (col["place"] - far, col["place"] - near + shape.length) if accepted or side is not None else (no, no)
    todo = [no] * 4 if accepted or side is not None else [col[n] for n in ("place", "low", "high", "first")]
    border = [no] * 5 if side is None else [np.full(len(at), part), side, col["grp"], col["outer_name"], col["salt"]]
    columns = [col["k1"], col["k2"], start, stop, *todo, *border]
    return pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c.cast(k) for c, k in zip(columns, FOUND_KINDS)], names=FOUND_NAMES)


def _ranked(shape: Shape, size: int):
    """Compare the neighbours of a sorted partition: what repeats, and what is to be looked at again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        n = len(rows)
        col = {c: rows.column(c).to_numpy() for c in KEYS}
        turn = lambda c: col[c][1:] != col[c][:-1]
        new_inner = np.concatenate([[True], turn("grp") | turn("inner_name")])
        new_outer = new_inner | np.concatenate([[True], turn("outer_name")])
        # A rank repeats if its rows are of several places, or of copies of a text; a place
        # whose windows were named in two pieces has two rows of its own. Words have to be of
        # several texts, or of copies of a text.
        begin = np.nonzero(new_outer)[0]
        other = np.concatenate([[False], turn("k1") | turn("k2")])
        moved = ~new_outer & (other if shape.words else other | np.concatenate([[False], turn("place")]))
        repeated = np.add.reduceat(moved.astype(np.int64), begin) > 0
        repeated |= np.minimum.reduceat(col["salt"], begin) != np.maximum.reduceat(col["salt"], begin)
        alone = ~repeated[np.cumsum(new_outer) - 1]
        yield _found(rows, np.nonzero(~alone)[0], shape, size, part, True)
        if size == 1:
            # The first and the last row may have their equal in the partition beside. Places of
            # one text with the same words are all as the first or the last.
            ends = np.array([0, n - 1])
            yield _found(rows, ends, shape, size, part, False, np.where(alone[ends], [0, 1], [2, 3]))
            if shape.words:
                rank = np.cumsum(new_outer)
                more = np.nonzero(alone[1:-1] & ((rank[1:-1] == 1) | (rank[1:-1] == rank[-1])))[0] + 1
                yield _found(rows, more, shape, size, part, False, np.zeros(len(more), np.int32))
            return
        # Ranks with several outer strings, or that may go on beyond the partition, are not
        # settled: one place of each outer string stays, with all its rows; of words, two texts,
        # so that the places of one of them in another partition meet the other.
        run_of = np.cumsum(new_inner) - 1
        several = np.bincount(run_of, new_outer) > 1
        if shape.words:
            several &= np.bincount(run_of, ~new_inner & other) > 0
        several[[0, -1]] = True
        moves = np.cumsum(moved)
        first_place = moves <= moves[begin][np.cumsum(new_outer) - 1] + shape.words
        yield _found(rows, np.nonzero(first_place & several[run_of])[0], shape, size, part, False)

    return run


def _sorted(rows: DataFrame, count: int) -> DataFrame:
    return rows.repartitionByRange(max(1, -(-count // PART)), *KEYS).sortWithinPartitions(*KEYS)


def _across(found: DataFrame) -> DataFrame:
    """Windows equal to their neighbour over a border of sorted partitions; few rows per partition."""
    ends = found.where("side is not null").withColumn("end", F.col("side") % 2)
    order = W.orderBy("part", "end")
    beside = F.when(F.col("end") == 0, F.lag(F.struct("grp", "name")).over(order)).otherwise(F.lead(F.struct("grp", "name")).over(order))
    return ends.withColumn("beside", beside).where("side < 2 and beside = struct(grp, name)").select("k1", "k2", "start", "stop")


def _across_rows(found: DataFrame) -> DataFrame:
    """Windows of words at a border of sorted partitions that another row has at such a border."""
    ends = found.where("side is not null")
    row = F.struct("k1", "k2", "salt")
    several = ends.groupBy("grp", "name").agg(F.min(row).alias("least"), F.max(row).alias("most")).where("least <> most")
    return ends.where("side < 2").join(several, ["grp", "name"], "left_semi").select("k1", "k2", "start", "stop")


def _spans(found: DataFrame) -> DataFrame:
    return found.where("start is not null and side is null").select("k1", "k2", "start", "stop")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the spans of each text and remove them."""
    for batch in batches:
        spans, kept = [], []
        for value, found in zip(batch.column(2), batch.column(3).to_pylist()):
            data = value.as_py().encode()
            runs: list[list[int]] = []
            for x in sorted((r["start"], r["stop"]) for r in found):
                if runs and x[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], x[1])
                else:
                    runs.append(list(x))
            edges = [0, *(e for r in runs for e in r), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": a, "stop": b} for a, b in runs])
        kind = pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()}))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["k1", "k2", "spans", "kept"]
        )


def _first_found(long: DataFrame, shape: Shape) -> DataFrame:
    """What the first round finds in the texts."""
    named = long.where(F.octet_length("body") >= shape.least).select("k1", "k2", "body").mapInArrow(_first_round(shape), ROWS)
    rows = written(named, "repeats-rows")
    return written(_sorted(rows, rows.count()).mapInArrow(_ranked(shape, shape.rounds[0]), FOUND), "repeats-found")


def _all_spans(found: DataFrame, texts: DataFrame, shape: Shape) -> DataFrame:
    """``(k1, k2, start, stop)``: what repeats, from what the first round found on."""
    spans = _spans(found)
    for before, size in zip(shape.rounds, shape.rounds[1:]):
        todo = found.where("place is not null").select("k1", "k2", "place", "low", "high", "first").distinct()
        runs = todo.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "low", "high", "first")).alias("runs"))
        left = texts.join(runs, ["k1", "k2"]).select("k1", "k2", "body", "copies", "runs")
        rows = written(left.mapInArrow(_next_round(shape, before, size), ROWS), "repeats-rows")
        found = written(_sorted(rows, rows.count()).mapInArrow(_ranked(shape, size), FOUND), "repeats-found")
        spans = spans.union(_spans(found))
    return spans.union(_across_rows(found) if shape.words else _across(found)).distinct()


def cut_repeats(
    docs: DataFrame, shape: Shape = Shape(), key: str = "doc_id", text: str = "text", passages: Shape | None = None
) -> DataFrame:
    """``(key, n_bytes, spans, kept, whole_sha256)``: one row per row of ``docs``.

    ``spans`` are the maximal runs of bytes (``start``, ``stop``) covered by a string of
    ``shape.length`` bytes that also starts elsewhere, in the same text or another; ``kept`` is
    the rest of the text as bytes, null where there are no spans (then the text stays, and
    ``whole_sha256`` is its digest). Null text counts as empty; shorter texts keep all bytes;
    copies and repeated rows lose what they share, each of them; an empty table gives an empty
    table; other columns are not read.

    With ``passages``, a shape of words, ``n_shared_words`` follows: how many words of the text are
    in a passage of ``passages.length`` words that another row has as well, whatever white space is
    between them. It removes nothing.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.col(key).alias("key"), body.alias("body")).select(
        "key", F.xxhash64("body").alias("k1"), F.xxhash64(F.lit(10), "body").alias("k2"), "body"
    )
    narrow = written(
        keyed.select("key", "k1", "k2", F.octet_length("body").cast("bigint").alias("n_bytes"), F.sha2(F.col("body").cast("binary"), 256).alias("whole_sha256")),
        "repeats-documents",
    )
    found = _first_found(keyed, shape)
    some = found.select("k1", "k2")
    if passages:
        shared = _first_found(keyed, passages)
        some = some.union(shared.where("place is not null").select("k1", "k2"))
    # Only texts with a repeat, or something left to look at; each distinct text once.
    least = min(s.least for s in (shape, passages) if s)
    once = keyed.where(F.octet_length("body") >= least).groupBy("k1", "k2").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    texts = written(once.join(some.distinct(), ["k1", "k2"]), "repeats-texts")
    per_text = _all_spans(found, texts, shape).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    cut = texts.join(per_text, ["k1", "k2"]).select("k1", "k2", "body", "found").mapInArrow(
        _cut, "k1 bigint, k2 bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    )
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    out = narrow.join(cut, ["k1", "k2"], "left")
    columns = [F.col("key").alias(key), "n_bytes", F.coalesce("spans", none).alias("spans"), "kept", "whole_sha256"]
    if passages:
        before = F.max("stop").over(W.partitionBy("k1", "k2").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1))
        new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", before))
        covered = _all_spans(shared, texts, passages).withColumn("new", new).groupBy("k1", "k2").agg(F.sum("new").alias("n_shared_words"))
        out = out.join(covered, ["k1", "k2"], "left")
        columns.append(F.coalesce("n_shared_words", F.lit(0)).cast("bigint").alias("n_shared_words"))
    return out.select(*columns)
