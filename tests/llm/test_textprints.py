import hashlib
import random
import struct

import numpy as np
import pytest
from pagequarry.llm import queries, textprints
from pagequarry.llm.polyhash import BASES, PRIME, Powers, Prefixes
from pagequarry.llm.textprints import fingerprint, likeness
from tables import EXTRA_VALUES, SCHEMA, awkward, documents, empty

MADE = Powers()
RNG = random.Random(12)
WORDS = ["".join(RNG.choices("abcdefghijklmnopé", k=RNG.randint(2, 9))) for _ in range(3000)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(WORDS, k=n))


def test_span_names_and_extensions_like_comparing_strings():
    rng = random.Random(1)
    text = "".join(rng.choices("ab", k=400)) + "".join(rng.choices("ab", k=20)) * 9
    hashes = Prefixes(np.frombuffer(text.encode("utf-32-le"), np.uint32), Powers())
    places = [(rng.randrange(len(text)), rng.randrange(len(text))) for _ in range(3000)]
    a, b = (np.array(x) for x in zip(*places))
    most = len(text) - np.maximum(a, b)
    want = [next((k for k in range(m) if text[i + k] != text[j + k]), m) for (i, j), m in zip(places, most.tolist())]
    assert hashes.extensions(a, b, 0, most).tolist() == want
    size = np.minimum(most, 9)
    same = hashes.names(a, a + size) == hashes.names(b, b + size)
    assert same.tolist() == [text[i : i + n] == text[j : j + n] for (i, j), n in zip(places, size.tolist())]


@pytest.mark.parametrize("text", ["", "x", "xy", prose(30), prose(3000), "é" * 500])
def test_a_fingerprint_holds_prefix_sums(text):
    def plain(part, base):
        return sum((ord(c) + 1) * pow(base, i, PRIME) for i, c in enumerate(part)) % PRIME

    found = fingerprint(text, MADE)
    size, *whole, _ = struct.unpack_from(textprints.HEAD, found)
    assert size == len(text) and whole == [plain(text, b) for b in BASES]
    marks = np.frombuffer(found, textprints.MARK, offset=struct.calcsize(textprints.HEAD)).tolist()
    assert len(marks) <= textprints.KEEP and all(0 < p < len(text) for p, _, _ in marks)
    assert all(s == plain(text[:p], BASES[0]) for p, s, _ in marks)


def test_pieces_of_long_texts_make_no_difference(monkeypatch):
    text = prose(30_000)
    whole = fingerprint(text, MADE)
    monkeypatch.setattr(textprints, "PIECE", 5000)
    assert fingerprint(text, MADE) == whole


@pytest.mark.parametrize("n", [1, 4, 12, 50, 200, 1000, 6000])
def test_likeness(n):
    rng, elsewhere = random.Random(n), []
    for _ in range(15):
        text, other = prose(n, rng), prose(n + 1, rng)
        a, b = fingerprint(text, MADE), fingerprint(other, MADE)
        assert likeness(a, a) == 1.0 and likeness(a, b) == likeness(b, a) <= 0.4
        if len(text) > 5:
            third = len(text) // 3
            edited = fingerprint(text[: len(text) - third] + other[:third], MADE)
            assert 0.4 <= likeness(a, edited) <= 0.85
        # The same passage elsewhere, in a text three times as long: half of both.
        elsewhere.append(likeness(a, fingerprint(other + " " + text + " " + other, MADE)))
    assert n < 50 or 0.3 < np.mean(elsewhere) < 0.55


def test_repetitive_texts_and_edits_in_the_middle():
    for text in ("a" * 50_000, "ab" * 10_000, "some line of text that repeats\n" * 400):
        third = len(text) // 3
        assert 0.5 < likeness(fingerprint(text, MADE), fingerprint(text[:-third] + prose(9000)[:third], MADE)) < 0.8
    words = prose(1500).split()
    changed = words[:700] + ["instead"] + words[701:]
    assert likeness(fingerprint(" ".join(words), MADE), fingerprint(" ".join(changed), MADE)) > 0.8


def plain_chain(rows, edit):
    """By descending id, nulls last, rows of one id by a hash that only the test of ties needs."""
    out = []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        edited = edit(text, following)
        a, b, c = (fingerprint(x, MADE) for x in (text, edited, following))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), likeness(a, b), likeness(a, c)))
    return out


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_query_like_a_plain_version(spark, tmp_path, parts):
    rng = random.Random(parts)
    texts = [prose(rng.randint(0, 80), rng) for _ in range(60)] + ["", None, "x"]
    rows = [(7 * i - 100, t) for i, t in enumerate(texts)]
    values = [(i, t, "en", "a", 1, *EXTRA_VALUES) for i, t in rows]
    spark.createDataFrame(values, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = sorted(map(tuple, queries.document_fingerprints(spark, str(tmp_path)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_chain([(i, t or "") for i, t in reversed(rows)], queries.last_third_replaced)
    assert got == sorted(want)


def test_one_id_on_many_rows_is_shared_by_partitions(spark, tmp_path):
    texts = [(1, "first"), *[(5, "the same text again")] * 40, (9, "last")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = textprints.against_edit(rows, lambda text, following: f"{text}>{following}").collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    twins = [r["edited_sha256"] for r in found if r["doc_id"] == 5]
    assert len(twins) == 40 and twins.count(digest("the same text again>the same text again")) == 39 and digest("the same text again>first") in twins
    assert {r["edited_sha256"] for r in found if r["doc_id"] != 5} == {digest("first>last"), digest("last>the same text again")}


def test_awkward_rows_and_empty_table(spark, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/awkward")
    rows = textprints.against_edit(spark.read.parquet(f"{tmp_path}/awkward"), queries.last_third_replaced).collect()
    assert len(rows) == 11 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    same = {bytes(r["fingerprint"]) for r in rows if r["n_chars"] == 27}
    assert len(same) == 1 and {bytes(r["fingerprint"]) for r in textprints.fingerprints(awkward(spark)).collect() if r["n_chars"] == 27} == same
    assert textprints.against_edit(empty(spark), queries.last_third_replaced).collect() == []
    assert textprints.fingerprints(empty(spark)).collect() == []
    single = documents(spark, ["only one"])
    single.write.parquet(f"{tmp_path}/one")
    row = textprints.against_edit(spark.read.parquet(f"{tmp_path}/one"), queries.last_third_replaced).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"only oon").hexdigest()
