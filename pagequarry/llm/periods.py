"""Periodic runs in texts: maximal stretches of words that repeat with a period.

Seed and extend on diagonals. A run with period q that is long enough overlaps itself, moved by
q, in so many words that a short sequence of words (a gram) has to occur at both places: half the
least length for small lags, and at least ``gram`` words for lags from ``gram`` on. Grams of
length 6, 12, 24, ... (for a least length of 12) serve lags below twice their length. Places with
equal grams in one document, a lag apart, are seeds; a seed grows to the right to the end of what
both places share, found by binary search over prefix hashes.

Two rules keep this near linear, however repetitive a text is, and lose nothing.

* The table of what is covered per lag: a seed whose words just before both places are equal as
  well lies on a stretch that an earlier seed of the same lag covers. Such seeds never grow.
* Where a gram overlaps its previous place by half or more, it is inside a repetition of a
  shorter period. A pair of two such places has equal words before it, so it would be covered:
  only pairs with a place that is not of this kind are made. A gram has at most four of those
  within the reach of its lags, so a text of one word repeated yields a pair per lag, not all.

A stretch found with several lags has the smallest as its period: the others are multiples of it.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.fields import with_fields
from pagequarry.llm.polyhash import Powers, Prefixes

LEAST = 12  # words of a run
BUFFER = 1 << 17  # words that are worked on together


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with ``first[i] <= j < last[i]``."""
    sizes = np.maximum(last - first, 0)
    upto = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, first[owner] + np.arange(upto[-1] if len(upto) else 0) - (upto - sizes)[owner]


def seeds(names: np.ndarray, at: np.ndarray, owner: np.ndarray, gram: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """``(place, lag, repeated)``: pairs of equal grams with ``low <= lag < high``; all places of repeated grams.

    ``at`` are ascending places with the names of their grams; ``owner`` tells documents apart.
    """
    order = np.argsort(names, kind="stable")
    place, name = at[order], names[order]
    same = (name[1:] == name[:-1]) & (owner[place[1:]] == owner[place[:-1]])
    repeated = np.zeros(len(place), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    inside = np.zeros(len(place), bool)
    inside[1:] = same & (np.diff(place) <= gram // 2)
    group = np.concatenate([[0], np.cumsum(~same)])[repeated]
    place, inside = place[repeated], inside[repeated]
    line = group * (len(owner) + 2 * high + 2) + place  # groups one after the other, with room between
    heads = np.nonzero(~inside)[0]
    after = spread(np.searchsorted(line, line[heads] + low), np.searchsorted(line, line[heads] + high))
    before = spread(np.searchsorted(line, line[heads] - high, "right"), np.searchsorted(line, line[heads] - low, "right"))
    left = np.concatenate([place[heads][after[0]], place[before[1]]])
    right = np.concatenate([place[after[1]], place[heads][before[0]]])
    return left, right - left, np.sort(place)


def find(words: np.ndarray, owner: np.ndarray, least: int, made: Powers) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs, by start, then period.

    ``words`` are numbers; a number that occurs nowhere else stands first, last and between
    documents, so that no run crosses them; ``owner`` is the document of each place.
    """
    hashes, size = Prefixes(words, made), len(words)
    gram, low, found = (least + 1) // 2, 1, []
    at = np.arange(max(size - gram + 1, 0))
    while len(at):
        left, lag, at = seeds(hashes.names(at, at + gram), at, owner, gram, low, 2 * gram)
        # Sorted by lag and place, what is covered already is known from the words before.
        fresh = words[left - 1] != words[left - 1 + lag]
        pairs = np.unique(lag[fresh] * size + left[fresh])
        lag, left = pairs // size, pairs % size
        far = hashes.extensions(left, left + lag, gram, size - left - lag)
        long = far + lag >= np.maximum(least, 2 * lag)
        found.append(np.stack([left, far + lag, lag], 1)[long])
        low = gram = 2 * gram
        at = at[at + gram <= size]
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def in_texts(texts: list[bytes], least: int, made: Powers) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each text its number of words, its runs, and the words that are kept, one space apart."""
    counter = itertools.count()
    number: dict[bytes, int] = defaultdict(counter.__next__)
    split = [t.split() for t in texts]
    flat: list[int] = [next(counter)]
    starts = []
    for words in split:
        starts.append(len(flat))
        flat += map(number.__getitem__, words)
        flat.append(next(counter))
    sizes = [len(words) for words in split]
    owner = np.zeros(len(flat), np.int32)
    owner[starts] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    runs = find(np.array(flat, np.int64), owner, least, made)
    change = np.zeros(len(flat) + 1, np.int32)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change) == 0
    bounds = np.searchsorted(runs[:, 0], [*starts, len(flat)])
    for i, words in enumerate(split):
        own = runs[bounds[i] : bounds[i + 1]] - [starts[i], 0, 0]
        some = itertools.compress(words, kept[starts[i] : starts[i] + sizes[i]].tolist()) if len(own) else words
        yield sizes[i], own, b" ".join(some)


def runs(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, runs, collapsed)``: one row per row of ``docs``.

    A word is what stands between ASCII white space. ``runs`` holds ``(start, length, period)`` of
    every stretch of at least ``least`` words, and of two periods, in which words a period apart
    are equal, which no neighbouring word extends; the period is the smallest one. It is sorted by
    start, then period. ``collapsed`` is the text without the words that some run contains after
    its first period, one space apart. ``least`` is 2 or more.

    A null or empty text has no words, no runs and an empty collapsed text. Null keys and repeated
    rows stay as they are; an empty table gives an empty table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Powers()
        for batch in batches:
            start, size = 0, 0
            values: list[bytes] = []
            for i, value in enumerate(batch.column(1)):
                values.append(value.as_py() or b"")
                size += len(values[-1]) // 4
                if size < BUFFER and i + 1 < len(batch):
                    continue
                counts, lists, texts = zip(*in_texts(values, least, made))
                flat = np.concatenate(lists)
                rows = pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], ["start", "length", "period"])
                offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(values)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, rows),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=[key, "n_words", "runs", "collapsed"],
                )
                start, size, values = i + 1, 0, []

    rows = docs.select(F.col(key), F.col(text).cast("string").cast("binary"))
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return rows.mapInArrow(run, with_fields(rows.schema[key], n_words="bigint", runs=kind, collapsed="string"))
