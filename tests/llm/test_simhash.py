import random
import re

import pytest
import xxhash
from pagequarry.llm import simhash
from pagequarry.llm.components import components
from tables import awkward, documents, empty, reach


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}É" for i in range(50)]
    base = rng.choices(words, k=120)
    texts = []
    for _ in range(n):
        copy = list(base) if rng.random() < 0.7 else rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            if copy:
                copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("stripe", [7, 10_000])
def test_groups_like_brute_force(spark, monkeypatch, stripe):
    monkeypatch.setattr(simhash, "STRIPE", stripe)
    texts = near_texts(60, 3) + ["", None, "  ", "A b", "a B"]
    got = {r["doc_id"]: r for r in simhash.groups(documents(spark, texts)).collect()}
    bits = [plain_fingerprint(t) for t in texts]
    near = [(a, b) for a in range(len(bits)) for b in range(a) if (bits[a] ^ bits[b]).bit_count() <= 4]
    label = reach(len(bits), near)
    assert [got[i]["bits"] % (1 << 64) for i in range(len(bits))] == bits
    assert [got[i]["component_id"] for i in range(len(bits))] == label
    assert 1 < len(set(label)) < len(label)


def test_bit_set_in_exactly_half_is_zero():
    text = "a b c d e"
    first, second = (xxhash.xxh64_intdigest(s, 42) for s in ("a b c d", "b c d e"))
    assert simhash.fingerprint(text) == first & second


def test_awkward_rows(spark):
    rows = simhash.groups(awkward(spark)).collect()
    assert len(rows) == 11
    same = [r for r in rows if r["bits"] == simhash.fingerprint("one two three four five six") - (1 << 64) * (simhash.fingerprint("one two three four five six") >> 63)]
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in same) == [(0, 4), (4, 4), (4, 4), (5, 4)]
    blank = [r for r in rows if r["bits"] == 0]
    assert {r["doc_id"] for r in blank} == {None, 1, 2, 3} and {r["component_id"] for r in blank} == {1}


def test_empty_table(spark):
    assert simhash.groups(empty(spark)).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "src long, dst long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
