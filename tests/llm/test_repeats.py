import hashlib
import random
from collections import Counter

import pytest
from pagequarry.llm import repeats
from tables import awkward, documents, empty

SHAPE = repeats.Shape(19, 8, (12, 4, 1))


def plain(texts, length):
    """Covered runs of each text, from counting all strings of the length."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = set()
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                covered.update(range(i, i + length))
        runs = []
        for i in sorted(covered):
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        out.append((runs, bytes(x for i, x in enumerate(d) if i not in covered)))
    return out


def check(spark, texts, shape):
    got = {r["doc_id"]: r for r in repeats.cut_repeats(documents(spark, texts).repartition(4), shape).collect()}
    assert len(got) == len(texts)
    for i, (runs, kept) in enumerate(plain(texts, shape.length)):
        row = got[i]
        assert [[s["start"], s["stop"]] for s in row["spans"]] == runs, texts[i]
        assert row["n_bytes"] == len((texts[i] or "").encode())
        digest = hashlib.sha256(row["kept"]).hexdigest() if row["kept"] is not None else row["whole_sha256"]
        assert digest == hashlib.sha256(kept).hexdigest()


def mixed_texts(seed, n=250):
    rng = random.Random(seed)
    base = "".join(rng.choices("abcdefgh é", k=500))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35:
            start = rng.randrange(450)
            texts.append("".join(rng.choices("abc", k=rng.randint(0, 30))) + base[start : start + rng.randint(1, 90)] + "".join(rng.choices("abc", k=rng.randint(0, 30))))
        elif kind < 0.5 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.6:
            texts.append(rng.choice(["", None, "a" * rng.randint(0, 80), "ab" * rng.randint(0, 40)]))
        else:
            texts.append("".join(rng.choices(["ab", "cde", "ghij", "é", "x y"], k=rng.randint(0, 50))))
    return texts


@pytest.mark.parametrize("part, buffer, piece", [(250_000, 1 << 17, 1 << 22), (90, 300, 16)])
def test_like_counting_all_strings(spark, monkeypatch, part, buffer, piece):
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "BUFFER", buffer)
    monkeypatch.setattr(repeats.pieces, "__defaults__", (piece,))
    check(spark, mixed_texts(part), SHAPE)


def test_production_shape(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, longer = prose(75)[:400], prose(300)
    texts = [prose(60) + shared + prose(60) for _ in range(3)] + [prose(50) + longer[:900] + prose(9), longer + prose(70), longer[200:1100]]
    texts += [shared[:399] + "?", prose(100), "x" * 399, "x" * 400, "y" * 401, shared]
    check(spark, texts, repeats.Shape())


def test_awkward_rows_and_empty_table(spark):
    rows = repeats.cut_repeats(awkward(spark), SHAPE).collect()
    assert len(rows) == 11
    twins = [r for r in rows if r["n_bytes"] == 27]
    assert len(twins) == 4 and all([tuple(s) for s in r["spans"]] == [(0, 27)] and r["kept"] == b"" for r in twins)
    assert repeats.cut_repeats(empty(spark)).collect() == []


def shared_words(texts, length):
    """The words of each text in passages that another row has, from counting all passages."""
    split = [(t or "").encode().split() for t in texts]
    has = [{tuple(w[i : i + length]) for i in range(len(w) - length + 1)} for w in split]
    rows = Counter(p for own in has for p in own)
    return [
        len({j for i in range(len(w) - length + 1) if rows[tuple(w[i : i + length])] > 1 for j in range(i, i + length)})
        for w in split
    ]


def check_words(spark, texts, shape):
    found = repeats.cut_repeats(documents(spark, texts).repartition(4), SHAPE, passages=shape).collect()
    got = {r["doc_id"]: r["n_shared_words"] for r in found}
    expected = shared_words(texts, shape.length)
    assert [got[i] for i in range(len(texts))] == expected
    return expected


@pytest.mark.parametrize("part, buffer, piece, seed", [(250_000, 1 << 17, 1 << 22, 1), (9, 50, 9, 3)])
def test_words_like_counting_all_passages(spark, monkeypatch, part, buffer, piece, seed):
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "BUFFER", buffer)
    monkeypatch.setattr(repeats, "BLOCK", 20)
    monkeypatch.setattr(repeats.pieces, "__defaults__", (piece,))
    rng = random.Random(seed)
    base = rng.choices(["aa", "b", "çé", "dd", "e"], k=200)
    texts = [None, "", " ", "x " * 60, "x " * 19, " ".join(base[:60] * 2)]
    while len(texts) < 60 if part > 100 else len(texts) < 30:
        start = rng.randrange(190)
        words = [*rng.choices("pqr", k=rng.randint(0, 9)), *base[start : start + rng.randint(1, 25)], *rng.choices("pqr", k=rng.randint(0, 9))]
        texts.append(rng.choice([" ", "\t", " \n"]).join(words) if rng.random() < 0.8 else rng.choice(texts))
    expected = check_words(spark, texts, repeats.Shape(8, 3, (6, 2, 1), True))
    assert 0 < sum(map(bool, expected)) < len(texts)


def test_words_are_those_of_split():
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", "b", "\0", "é", " ", "\t", "\x0b", "\x1c", "c" * 7, "d" * 8, "e" * 70], k=rng.randint(0, 60))).encode() for _ in range(200)]
    names = repeats.word_names(texts)
    pairs = {(w, int(n)) for t, found in zip(texts, names, strict=True) for w, n in zip(t.split(), found, strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({n for _, n in pairs}) > 100
    assert [len(x) for x in repeats.word_names([b"", b" "])] == [0, 0] and repeats.word_names([]) == []


def test_passages_of_over_fifty_words_without_400_bytes(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, twice, fifty = prose(55), prose(60), prose(50)
    assert len(passage) < 400
    texts = [f"{prose(80)} {passage} {prose(9)}", f"{passage.replace(' ', chr(10))} {prose(70)}", f"{twice} {twice}"]
    texts += [f"{prose(9)} {fifty} {prose(30)}", f"{prose(30)} {fifty}", prose(200), prose(20) + " " + passage]
    rows = repeats.cut_repeats(documents(spark, texts), passages=repeats.PASSAGES).collect()
    got = {r["doc_id"]: (r["n_shared_words"], len(r["spans"])) for r in rows}
    assert [got[i][0] for i in range(7)] == shared_words(texts, 51) == [55, 55, 0, 0, 0, 0, 55]
    assert got[0][1] == got[6][1] == 0
