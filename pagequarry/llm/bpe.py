"""Byte-pair encoding with a pair occurrence index, and decoding.

A task collects the distinct words of some texts it has not seen, lays their symbols out in one
list, and maps every pair with a rank to all its positions there. Ranks are applied in ascending
order, each to all its positions at once; a merge files the two new pairs beside it, which may
make further ranks active. Every distinct word is therefore encoded once per task, whatever its
number of occurrences, and texts are put together from the words' ids.

The vocabulary file is read where the job is defined and goes to the tasks as a broadcast; its
size is that of a vocabulary, not of the data.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.fields import with_fields

CHUNK = 1 << 22  # characters whose words are learnt together
PIECE = 1 << 20  # characters of a long text split at once
TOKENS = 1 << 17  # words put together, or tokens decoded, at once
KNOWN_WORDS = 1 << 18  # words a task remembers before it starts anew

# Fixed values. The patterns are read with the letters and numbers of Unicode 16, the case of
# Unicode 17; the libraries at hand have other versions. These code points differ.
LETTERS_AFTER_16 = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
DIGITS_AFTER_16 = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
CASED_AFTER_15 = r"\u1c89\ua7cb-\ua7da\ua7dc\U00010d50-\U00010d65\U00016ea0-\U00016eb8"
LOWER_AFTER_15 = {0xA7CB: 0x264, 0xA7DC: 0x19B} | {
    c: c + step
    for step, first, last in ((1, 0x1C89, 0x1C89), (32, 0x10D50, 0x10D65), (27, 0x16EA0, 0x16EB8))
    for c in range(first, last + 1)
} | {c: c + 1 for c in (0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file of this family says: words with an end mark over byte symbols."""

    ids: dict[str, int]
    ranks: dict[tuple[int, int], tuple[int, int]]  # pair -> (rank, merged symbol)
    special: dict[str, int]
    pattern: str
    end: str


def load(path: str) -> Vocabulary:
    """Read a tokenizer file (JSON): byte-level BPE, NFC, lower case, a pattern that picks words."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    ids = model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Vocabulary(
        ids, ranks, {t["content"]: t["id"] for t in spec["added_tokens"]}, split["pattern"]["Regex"], model["end_of_word_suffix"]
    )


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Encoder:
    """Encodes texts, remembering the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        symbols = byte_symbols()
        self.inner = np.array([vocabulary.ids[s] for s in symbols])
        self.last = np.array([vocabulary.ids[s + vocabulary.end] for s in symbols])
        self.width = 1 + max(vocabulary.ids.values())
        # Ranks in order, each with its pair and what it becomes; and the pairs, sorted.
        ranked = sorted((rank, *pair, merged) for pair, (rank, merged) in vocabulary.ranks.items())
        _, self.left, self.right, self.merged = np.array(ranked).T
        keys = self.left * self.width + self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        self.words = regex.compile(vocabulary.pattern).findall
        newer = LETTERS_AFTER_16 + DIGITS_AFTER_16
        narrow = vocabulary.pattern
        for old, new in (
            (r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]"),
            (r"[\p{L}]", rf"[\p{{L}}--[{LETTERS_AFTER_16}]]"),
            (r"[\p{N}]", rf"[\p{{N}}--[{DIGITS_AFTER_16}]]"),
        ):
            narrow = narrow.replace(old, new)
        self.rare_words = regex.compile(narrow, regex.V1).findall
        self.rare = regex.compile(f"[{LETTERS_AFTER_16}{DIGITS_AFTER_16}{CASED_AFTER_15}]").search
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__  # a new word gets the next number
        self.starts = np.zeros(1, np.int64)  # of each learnt word in ``flat``, and the end
        self.flat = np.empty(0, np.int32)
        for name, number in self.vocabulary.special.items():
            self.known[name]
            self._remember(np.array([number], np.int32), np.ones(1, np.int64))

    def _remember(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.words(text.lower())
        # Letters change case one by one: a sigma at the end of a word is no exception.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.rare(text):
                return self.rare_words(text.translate(LOWER_AFTER_15))
        return self.words(text)

    def split(self, text: str) -> list[str]:
        """The words of a text, in order; special tokens are words of their own."""
        if self.special is None or "<|" not in text or not self.special.search(text):
            return self._plain(text)
        found: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            found += [part] if i % 2 else self._plain(part)
        return found

    def number(self, text: str) -> np.ndarray:
        """The numbers of a text's words; words without one get the next ones."""
        words = self.split(text)
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def learn(self) -> None:
        """Encode all words that have a number and no ids yet, together."""
        words = list(islice(self.known, len(self.starts) - 1, None))
        data = [word.encode() for word in words]
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        n = int(ends[-1]) if len(ends) else 0
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbol = np.append(self.inner[raw], -1)
        symbol[ends - 1] = self.last[raw[ends - 1]]
        after = np.arange(1, n + 2)  # the next symbol of the word; n: none
        before = np.arange(-1, n)  # the one before; n: none
        after[ends - 1] = n
        before[np.concatenate([[0], ends[:-1]])] = n
        before[n] = after[n] = n
        # The index: rank of a pair -> lists of the places where its left symbol is.
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(at: np.ndarray) -> None:
            ranks = self._ranks(symbol[at], symbol[after[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if len(at) > 1:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
            cuts = np.concatenate([[0], np.nonzero(np.diff(ranks))[0] + 1, [len(ranks)]]) if len(at) else [0]
            for x, y in pairwise(cuts):
                rank = int(ranks[x])
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(active, rank)
                places[rank].append(at[x:y])

        file(np.nonzero(after[:n] < n)[0])
        while active:
            rank = heapq.heappop(active)
            lists = places.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, right = self.left[rank], self.right[rank]
            # A place is out of date when a merge beside it has changed its symbols.
            at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
            if left == right and len(at) > 1:
                at = _apart(at, after)
            if not len(at):
                continue
            gone = after[at]
            far = after[gone]
            symbol[at] = self.merged[rank]
            symbol[gone] = -1
            after[at] = far
            before[far] = at
            before[n] = n
            near = before[at]
            file(np.unique(np.concatenate([at[far < n], near[near < n]])))
        kept = symbol[:n] >= 0
        counts = np.add.reduceat(kept, ends - np.diff(ends, prepend=0), dtype=np.int64) if n else np.empty(0, np.int64)
        self._remember(symbol[:n][kept].astype(np.int32), counts)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of learnt words one after the other, and how many each word has."""
        starts, sizes = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        upto = np.cumsum(sizes)
        where = np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
        return self.flat[where], sizes

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        numbers = self.number(text)
        self.learn()
        return self.ids(numbers)[0]


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places of a pair of equal symbols, those merged from the left: aaa has one, not two."""
    kept, last = [], -1
    for i in at.tolist():
        if i != last:
            kept.append(i)
            last = int(after[i])
    return np.array(kept)


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """A text in parts of about ``limit`` characters, cut at spaces, where no word goes on."""
    start = 0
    while len(text) - start > limit and (cut := text.find(" ", start + limit)) >= 0:
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``(key, ids array<int>)``: one row per row of ``docs``.

    ``decoded`` names a further column with what :func:`decode` makes of the ids, in the same
    task.

    A null or empty text has no ids; repeated rows come out repeated; an empty table gives an
    empty table; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(load(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(**shared.value)
        encoder = Encoder(vocabulary)
        table = pa.array(names_of(vocabulary), pa.string())
        keys: list[pa.Array] = []
        numbers: list[np.ndarray] = []  # of each waiting text
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            encoder.learn()
            all_keys = pa.concat_arrays(keys)
            start = 0
            while start < len(numbers):
                sizes = np.cumsum([len(x) for x in numbers[start : start + 4096]])
                end = start + max(1, int(np.searchsorted(sizes, TOKENS, "right")))
                words = np.concatenate(numbers[start:end])
                flat, counts = encoder.ids(words)
                upto = np.concatenate([[0], np.cumsum(counts)])
                offsets = upto[np.concatenate([[0], np.cumsum([len(x) for x in numbers[start:end]])])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                columns = {key: all_keys.slice(start, end - start), ids: lists}
                if decoded:
                    columns[decoded] = joined(lists, table)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                start = end
            keys.clear()
            numbers.clear()
            if len(encoder.known) > KNOWN_WORDS:
                encoder.forget()

        for batch in batches:
            start = 0
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                parts = [encoder.number(p) for p in pieces(text)]
                numbers.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
                size += len(text)
                if size >= CHUNK:
                    keys.append(batch.column(0).slice(start, i + 1 - start))
                    yield from done()
                    start, size = i + 1, 0
            keys.append(batch.column(0).slice(start))
        if numbers:
            yield from done()

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, with_fields(rows.schema[key], **{ids: "array<int>"}, **({decoded: "string"} if decoded else {})))


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Add ``text``: the symbols of ``ids``, joined by spaces, as a tokenizer without a decoder does.

    Null ids give null, no ids an empty text; an id that the vocabulary lacks adds nothing. The
    other columns stay, and the ids unless they are not to be kept.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(names_of(load(path)))
    kept = [n for n in tokens.columns if n != text and (keep_ids or n != ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.string())
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            start = 0
            while start < len(batch):
                sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at).slice(start)), 0).to_numpy(zero_copy_only=False))
                part = batch.slice(start, max(1, int(np.searchsorted(sizes, TOKENS, "right"))))
                texts = joined(part.column(at), table)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), texts], names=[*kept, text])
                start += len(part)

    return tokens.mapInArrow(run, with_fields(*(tokens.schema[n] for n in kept), **{text: "string"}))


def names_of(vocabulary: Vocabulary) -> list[str | None]:
    """The symbol of each id; None where an id is not used."""
    names: list[str | None] = [None] * (1 + max([*vocabulary.ids.values(), *vocabulary.special.values()]))
    for name, number in (vocabulary.ids | vocabulary.special).items():
        names[number] = name
    return names


def joined(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    """The strings that the ids in each list stand for, joined by spaces."""
    flat = lists.flatten()
    known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), flat, None)
    strings = table.take(known)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if strings.null_count:
        there = pc.is_valid(strings).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(there)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        sizes = np.diff(upto[bounds])
        strings = strings.drop_null()
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(offsets, strings), " ")
    return pc.if_else(pc.is_valid(lists), texts, pa.scalar(None, pa.string()))
