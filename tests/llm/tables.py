"""Small tables of awkward cases, and the parts of brute-force versions that several tests use."""

import random

# Extra columns whose names the operators use themselves.
EXTRA = "bits long, ids string, spans string, size long, score double, _row long, _text string, key string, copies int, lang_pred string"
EXTRA_VALUES = (7, "x", "y", 3, 0.5, 1, "z", "k", 2, "q")
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def documents(spark, texts, lang=lambda i: "en", source=lambda i: f"s{i % 3}"):
    """Documents with ids from 0 on."""
    rows = [(i, t, lang(i), source(i), None if t is None else len(t), *EXTRA_VALUES) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = " ".join(rng.choices(["the", "and", "über", "été", "token", "x1"], k=30_000))
    rows = [
        (1, None, "en", "a", 3),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, None, None),
        (None, "one two three four five six", "en", None, 27),
        (None, None, None, None, None),
        (4, "one two three four five six", "en", "b", 27),
        (4, "one two three four five six", "en", "b", 27),
        (5, "one two three four five six", "fr", "b", 27),
        (6, long, "en", "a", len(long)),
        (7, "12345 67890 !!!", "en", "a", 15),
        (8, "a\u0000b   \U0001f600 İ Σ", "en", "c", 9),
    ]
    return spark.createDataFrame([(*r, *EXTRA_VALUES) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def reach(n, linked):
    """The smallest index reachable from each of ``n``, given who is linked to whom."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label
