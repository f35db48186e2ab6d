"""Language identification of texts that may mix languages.

Every distinct word of a task is scored once: its script leaves the languages that use it, and
the character trigrams of the word give each of these a log-likelihood. A Viterbi pass over the
words of a text, with a penalty for every switch of language, labels spans; the language with the
most letters is the text's. The pass runs over many texts side by side, word by word, in numpy.

The model is learnt from a bounded sample: at most ``sample`` labelled texts per language, those
with the smallest digests, counted by Spark. It holds at most ``grams`` trigrams per language.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.llm.fields import with_fields
from pagequarry.session import written

UNKNOWN = "und"
SAMPLE = 4000  # texts per language
GRAMS = 30_000  # trigrams per language
SWITCH = 12.0  # log-likelihood that a switch of language costs
WORST = 8.0  # at most this much does one word speak against a language
CHUNK = 1 << 21  # characters labelled side by side
KNOWN_WORDS = 1 << 18  # words a task remembers before it starts anew
WORDS = regex.compile(r"[\p{L}\p{M}]+")

# Where scripts begin; a script goes on to the next entry.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB07, "Other"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
STARTS = [start for start, _ in SCRIPTS]


def script(word: str) -> str:
    return SCRIPTS[bisect_right(STARTS, ord(word[0])) - 1][1]


def trigrams(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


def words_of(text: str) -> list[str]:
    """The words of a text: runs of letters and their marks, lower case, composed."""
    text = text.lower()
    return WORDS.findall(text if text.isascii() else unicodedata.normalize("NFC", text))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: dict[str, np.ndarray]  # trigram -> log-probability per language
    unseen: np.ndarray  # of a trigram no language has
    scripts: dict[str, np.ndarray]  # script -> which languages use it


def train(labelled: DataFrame, sample: int = SAMPLE, grams: int = GRAMS, lang: str = "lang", text: str = "text") -> Model:
    """Learn from ``(lang, text)``; rows where either is null teach nothing.

    At most ``sample`` distinct texts per language count. No usable row: a model without
    languages, for which every text is ``und``.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    # The texts with the smallest digests: a share of the distinct ones, then the rank among these.
    digest = F.xxhash64("text")
    place = F.pmod(F.col("_digest"), F.lit(1 << 30))
    distinct = written(rows.select("lang", digest.alias("_digest")).distinct(), "languages-digests")
    sizes = distinct.groupBy("lang").count()
    limits = sizes.select("lang", ((2.0 * sample + 100) / F.col("count") * (1 << 30)).alias("_share"))
    near = distinct.join(F.broadcast(limits) if _few(sizes) else limits, "lang").where(place < F.col("_share"))
    order = W.partitionBy("lang").orderBy(place, "_digest")
    chosen = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).select("lang", "_digest")
    # Copies go before the texts are shuffled: a digest keeps one of each task's.
    chosen = rows.withColumn("_digest", digest).join(F.broadcast(chosen) if _few(sizes, 100) else chosen, ["lang", "_digest"])
    chosen = chosen.groupBy("lang", "_digest").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: defaultdict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(words_of(value)).items():
                    kind = "\t" + script(word)
                    found[name][kind] += n * len(word)
                    for gram in trigrams(word):
                        found[name][gram] += n
        for name, counts in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "gram", "n"],
            )

    counts = chosen.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= grams)
    return _model([(r["lang"], r["gram"], r["n"]) for r in kept.collect()])  # at most ``grams`` per language


def _few(sizes: DataFrame, most: int = 10_000) -> bool:
    """Whether the languages are few enough to broadcast a number for each."""
    return len(sizes.limit(most + 1).collect()) <= most


def _model(counts: list[tuple[str, str, int]]) -> Model:
    languages = sorted({lang for lang, _, _ in counts})
    at = {lang: i for i, lang in enumerate(languages)}
    table: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for lang, gram, n in counts:
        target = scripts if gram[0] == "\t" else table
        key = gram[1:] if gram[0] == "\t" else gram
        target.setdefault(key, np.zeros(len(languages)))[at[lang]] = n
    totals = sum(table.values(), np.zeros(len(languages))) + 0.5 * (len(table) + 1)
    letters = np.maximum(sum(scripts.values(), np.zeros(len(languages))), 1)
    uses = {k: v / letters >= 0.01 for k, v in scripts.items()}
    return Model(
        languages,
        {g: np.log((n + 0.5) / totals) for g, n in table.items()},
        np.log(0.5 / totals),
        {k: v for k, v in uses.items() if v.any()},
    )


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word, for texts laid one after the other.

    ``scores`` has a row per word; ``sizes`` says how many words each text has. All texts advance
    together, the longest first, so that those still running are a prefix.
    """
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[: int((sizes > 0).sum())]
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    if not len(order):
        return labels
    running = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts with more than t words
    stays = np.ones(scores.shape, bool)  # whether the best way to a state comes from the same one
    best = np.zeros(len(scores), np.int64)  # the best state before each word
    value = scores[starts].copy()
    for t in range(1, int(sizes[0])):
        k = running[t]
        at = starts[:k] + t
        v = value[:k]
        top = v.argmax(1)
        other = v[np.arange(k), top][:, None] - switch
        stays[at] = v >= other
        best[at] = top
        value[:k] = np.maximum(v, other) + scores[at]
    state = value.argmax(1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        k = running[t]
        at = starts[:k] + t
        labels[at] = state[:k]
        state[:k] = np.where(stays[at, state[:k]], state[:k], best[at])
    return labels


class Labeller:
    """Labels texts, remembering the scores of the words it has met."""

    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, switch
        self.rows = {gram: i for i, gram in enumerate(model.scores)}
        self.table = np.array([*model.scores.values(), model.unseen]).reshape(len(model.scores) + 1, len(model.languages))
        self.nowhere = np.zeros(len(model.languages), bool)
        self.forget()

    def forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.scores = np.empty((0, len(self.model.languages)), np.float32)
        self.letters = np.empty(0, np.int64)

    def number(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))

    def learn(self) -> None:
        new = list(islice(self.known, len(self.scores), None))
        if new:
            self.scores = np.concatenate([self.scores, self.score(new)])
            letters = [len(w) if any(map(str.isalpha, w)) else 0 for w in new]
            self.letters = np.concatenate([self.letters, np.array(letters, np.int64)])

    def score(self, words: list[str]) -> np.ndarray:
        """The score of each language for each word: 0 for the best, down to ``-WORST``.

        0 for all if no language uses the script of the word.
        """
        unseen, get = len(self.rows), self.rows.get
        grams = [get(gram, unseen) for word in words for gram in trigrams(word)]
        starts = np.cumsum([0, *map(len, words)])[:-1]  # a word has as many trigrams as letters
        totals = np.add.reduceat(self.table[grams], starts)
        uses = np.array([self.model.scripts.get(script(w), self.nowhere) if w[0].isalpha() else self.nowhere for w in words])
        best = np.where(uses, totals, -np.inf).max(1, initial=-np.inf, keepdims=True)
        known = uses.any(1)[:, None]
        kept = np.where(uses, np.maximum(totals - np.where(known, best, 0), -WORST), -WORST)
        return np.where(known, kept, 0).astype(np.float32)

    def label(self, numbers: list[np.ndarray]) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
        """Of each text: its language, a score, the spans ``(first word, end, language)``, and the share of letters."""
        self.learn()
        names = self.model.languages
        flat = np.concatenate(numbers)
        sizes = np.array([len(x) for x in numbers])
        letters = self.letters[flat]
        if not names or not len(flat):
            return [(UNKNOWN, 0.0, [], 0.0)] * len(numbers)
        scores = self.scores[flat]
        labels = viterbi(scores, sizes, self.switch)
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        weight = np.bincount(text * len(names) + labels, letters, len(sizes) * len(names)).reshape(len(sizes), -1)
        top = weight.argmax(1)
        # How sure the words of the language are of it, against each other language.
        own = labels == top[text]
        sums = np.stack([np.bincount(text[own], scores[own, i], len(sizes)) for i in range(len(names))], 1)
        odds = np.exp(np.minimum(sums - sums[np.arange(len(sizes)), top][:, None], 0.0)).sum(1)
        turn = np.concatenate([[True], (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])])
        first = np.nonzero(turn)[0]
        last = np.append(first[1:], len(labels))
        found = []
        cuts = np.searchsorted(first, np.concatenate([[0], ends]))
        for i in range(len(sizes)):
            total = weight[i].sum()
            if not total:
                found.append((UNKNOWN, 0.0, [], 0.0))
                continue
            base = int(ends[i] - sizes[i])
            spans = [(int(first[j]) - base, int(last[j]) - base, names[labels[first[j]]]) for j in range(cuts[i], cuts[i + 1])]
            share = float(weight[i, top[i]] / total)
            found.append((names[top[i]], share / float(odds[i]), spans, share))
        return found


SPANS = "array<struct<first:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, spans, share)``: one row per row of ``docs``; only the text is an input.

    ``spans`` are word ranges (end exclusive) with their languages. ``share`` is the share of
    letters in spans of ``lang_pred``, ``score`` is that times how much its words prefer it to the
    other languages, which depends on how many languages there are.
    A text that is null or has no letter is ``und`` with score 0 and no spans; so is every text
    if the model has no languages. A word in a script of no learnt language counts for the
    language of its neighbours. Repeated rows come out repeated; an empty table gives an empty
    table; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Model(**shared.value), switch)
        for batch in batches:
            start, size, numbers = 0, 0, []
            for i, value in enumerate(batch.column(1)):
                content = value.as_py() or ""
                numbers.append(labeller.number(content))
                size += len(content)
                if size < CHUNK and i < len(batch) - 1:
                    continue
                found = labeller.label(numbers)
                spans = [[{"first": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(found)),
                        pa.array([x[0] for x in found], pa.string()),
                        pa.array([x[1] for x in found], pa.float64()),
                        pa.array(spans, pa.list_(pa.struct({"first": pa.int32(), "end": pa.int32(), "lang": pa.string()}))),
                        pa.array([x[3] for x in found], pa.float64()),
                    ],
                    names=[key, "lang_pred", "score", "spans", "share"],
                )
                start, size, numbers = i + 1, 0, []
                if len(labeller.known) > KNOWN_WORDS:
                    labeller.forget()

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, with_fields(rows.schema[key], lang_pred="string", score="double", spans=SPANS, share="double"))
