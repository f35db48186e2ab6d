import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pagequarry.llm import packing
from pagequarry.llm.queries import RANK_FILE
from tables import awkward, documents, empty

PATH, PATTERN = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


def test_packs_as_trying_every_row_does():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.choice([1, 2, 5, 16, 33])
        lengths = [rng.randint(0, 3 * size) for _ in range(rng.randint(0, 60))]
        rows = packing.pack(np.array(lengths, int), size)
        seen = {(t, i) for r in rows for t, a, b in r for i in range(a, b)}
        assert seen == {(t, i) for t, n in enumerate(lengths) for i in range(n)}
        assert sum(b - a for r in rows for _, a, b in r) == len(seen)
        assert all(0 < sum(b - a for _, a, b in r) <= size for r in rows)
        room = []
        for rest in sorted((n % size for n in lengths if n % size), reverse=True):
            fits = [i for i, left in enumerate(room) if left >= rest]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= rest
            else:
                room.append(size - rest)
        assert len(rows) == len(room) + sum(n // size for n in lengths)


@pytest.mark.parametrize("group", [200, 1 << 22])
def test_rows_give_back_every_document(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    texts = [f"Größe {i} " * (i % 23) for i in range(70)] + [None, "", " "]
    encode = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=packing.load_ranks(PATH), special_tokens={}).encode_ordinary
    back, rows = {}, packing.packed(documents(spark, texts), PATH, PATTERN, size=32).collect()
    assert len({r["row_id"] for r in rows}) == len(rows)
    for r in rows:
        ids, positions = (np.frombuffer(r[c], "<u2") for c in ("ids", "positions"))
        assert len(ids) == len(positions) == 32 and r["cumulative"][0] == 0 and r["cumulative"][-1] == r["n_tokens"]
        assert (ids[r["n_tokens"] :] == 50256).all() and not positions[r["n_tokens"] :].any()
        for key, offset, a, b in zip(r["keys"], r["offsets"], r["cumulative"][:-1], r["cumulative"][1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            back.setdefault(key, {})[offset] = ids[a:b].tolist()
    for i, text in enumerate(texts):
        parts = back.get(i, {})
        assert sum((parts[o] for o in sorted(parts)), []) == encode(text or "")


def test_written_rows_are_read_back(spark, tmp_path):
    rows = packing.packed(documents(spark, ["a b c", "d"]), PATH, PATTERN, size=8)
    packing.write(rows, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).collect() == rows.collect()


def test_awkward_rows_and_empty_table(spark):
    rows = packing.packed(awkward(spark), PATH, PATTERN, size=64).collect()
    keys = [k for r in rows for k in r["keys"]]
    assert None in keys and keys.count(4) == 2 and keys.count(6) > 100
    assert packing.packed(empty(spark), PATH, PATTERN).collect() == []
