import hashlib
import random
import re
import zlib

import pytest
from pagequarry.llm import periods, queries
from pagequarry.llm.polyhash import Powers
from tables import awkward, documents, empty


def plain_runs(w, least=12):
    """Every maximal run, from trying all periods and starts."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, 2 * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {x for start, size, period in runs for x in range(start + period, start + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng):
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(rng.randint(0, 120))]
    if kind < 0.6:
        words = []
        for _ in range(rng.randint(1, 5)):
            words += [rng.choice("abc") for _ in range(rng.randint(1, 20))] * rng.randint(1, 8)
        return (words * rng.randint(1, 3))[: rng.randint(1, 300)]
    if kind < 0.7:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(1, 9)):
            a, b = b, b + a
        return b
    if kind < 0.8:
        thue = [0]
        for _ in range(6):
            thue += [1 - x for x in thue]
        return [str(x) for x in thue] * 2
    return ["a"] * rng.randint(0, 60)


@pytest.mark.parametrize("least", [2, 3, 5, 12, 20])
def test_like_trying_all_periods(least):
    rng, made = random.Random(least), Powers()
    for _ in range(60):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        found = periods.in_texts([" ".join(w).encode() for w in texts], least, made)
        for w, (n, runs, kept) in zip(texts, found, strict=True):
            want = plain_runs(w, least)
            assert n == len(w) and [tuple(r) for r in runs.tolist()] == want
            assert kept.decode() == collapsed(w, want)


def test_every_gram_twice_in_a_period():
    """No gram's next place is a period away, so neighbours in the index alone would not find the run."""
    rng = random.Random(4)
    half = [rng.choice("abcd") for _ in range(100)]
    period = half + ["x"] + half + ["y"]
    (_, runs, _), = periods.in_texts([" ".join(period * 2).encode()], 12, Powers())
    assert (0, 404, 202) in [tuple(r) for r in runs.tolist()]


@pytest.mark.parametrize("word", ["a", "a b", "a b a"])
def test_long_repetitions_stay_linear(word):
    text = " ".join([word] * (300_000 // len(word.split())))
    (n, runs, kept), = periods.in_texts([text.encode()], 12, Powers())
    assert runs.tolist() == [[0, n, len(word.split())]] and kept.decode() == word


@pytest.mark.parametrize("buffer", [1 << 17, 50])
def test_query_like_a_plain_version(spark, monkeypatch, tmp_path, buffer):
    monkeypatch.setattr(periods, "BUFFER", buffer)
    rng = random.Random(9)
    texts = [rng.choice([" ", "\t\n ", "  "]).join(repetitive(rng)) for _ in range(150)] + ["", None, " \n", "one"]
    documents(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.periodic_runs(spark, str(tmp_path)).collect()}
    hit = 0
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
            hit += 1
        runs = plain_runs(w)
        row, best = got[i], min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert hit > 5


def test_awkward_rows_and_empty_table(spark):
    rows = periods.runs(awkward(spark)).collect()
    assert len(rows) == 11 and sum(r["doc_id"] is None for r in rows) == 2
    assert all(r["runs"] == [] for r in rows if r["n_words"] < 12)
    assert next(r["n_words"] for r in rows if r["doc_id"] == 6) == 30_000
    assert periods.runs(empty(spark)).collect() == []
