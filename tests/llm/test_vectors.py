import math

import numpy as np
import pytest
from pagequarry.llm import ann, veclinks
from tables import reach

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, component_id string, score string, `group` string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g, "a", "b", "c", "d") for i, v, g in rows], SCHEMA)


def clustered(n, seed, dims=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    kind = rng.integers(0, 9, n)
    noise = rng.normal(size=(n, dims))
    vectors = np.where((kind < 6)[:, None], centers[np.minimum(kind, 5)] + 0.25 * noise, 2 * noise).astype(np.float32)
    return vectors, rng.integers(0, 3, n)


@pytest.mark.parametrize("window, part, tile", [(128, 50_000, 1024), (8, 60, 7)])
def test_links_like_brute_force(spark, monkeypatch, window, part, tile):
    monkeypatch.setattr(veclinks, "PART", part)
    monkeypatch.setattr(veclinks, "TILE", tile)
    vectors, labels = clustered(300, 1)
    rows = [(1000 - i, v, int(g)) for i, (v, g) in enumerate(zip(vectors.tolist(), labels))]
    got = {r["vec_id"]: r for r in veclinks.near_vectors(table(spark, rows), window=window).collect()}
    units = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    near = (units @ units.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    assert near.sum() > 500
    order = sorted(range(300), key=lambda i: 1000 - i)
    label = reach(300, [(order.index(a), order.index(b)) for a, b in zip(*np.nonzero(near))])
    for i in range(300):
        row = got[1000 - i]
        assert row["n_links"] == near[i].sum()
        assert row["component_id"] == 1000 - order[label[order.index(i)]]
        assert row["kept"] == (row["component_id"] == row["vec_id"])


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 2.0]
    rows = [
        (1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1),
        (8, [1.0, math.nan], 1), (9, [1.0, math.inf], 1), (10, [], 1), (11, [1.0, 2.0, 0.0], 1), (2, one, 1), (None, one, 1),
    ]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in veclinks.near_vectors(table(spark, rows)).collect())
    assert got == sorted(
        [(0, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False)] + [(i, 0, i, True) for i in range(3, 12)]
    )


def test_no_vectors(spark):
    assert veclinks.near_vectors(table(spark, [])).collect() == []
    assert ann.nearest(table(spark, []), "key % 50 = 0").collect() == []
    assert ann.nearest(table(spark, [(0, None, 1)]), "key % 50 = 0").collect() == []


def test_passes_grow_slowly_and_cover_small_tables():
    assert veclinks.passes_for(100, 0.93) == 1
    assert 10 < veclinks.passes_for(5000, 0.93) < veclinks.passes_for(10**8, 0.93) < 400


def test_tiny_and_huge_numbers(spark):
    rows = [(1, [1e-30, 2e-30], 1), (2, [1e30, 2e30], 1), (3, [-1e30, 2e30], 1)]
    got = {r["vec_id"]: r["n_links"] for r in veclinks.near_vectors(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def brute(units, ids, asked, k):
    out = {}
    for q in asked:
        cosine = units @ units[q]
        order = [i for i in np.lexsort((ids, -cosine)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(cosine[i])) for i in order]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 150)
    monkeypatch.setattr(ann, "CHUNK", 7)
    vectors, _ = clustered(600, 4)
    units = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    ids = np.arange(600)
    want = brute(units, ids, range(0, 600, 20), 5)
    found = {}
    for r in ann.nearest(table(spark, [(i, v, 0) for i, v in enumerate(vectors.tolist())]), "key % 20 = 0").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found.keys() == want.keys()
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        assert all(abs(s - units[q] @ units[i]) < 1e-12 for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 5 * len(want)


def test_ties_few_candidates_and_odd_rows(spark):
    rows = [(50, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (2, [3.0, 0.0], 0), (7, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (100, None, 0), (9, [1.0], 0), (8, [0.0, 0.0], 0)]
    got = [tuple(r) for r in ann.nearest(table(spark, rows), "key % 50 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(50, 1, 2, 1.0), (50, 2, 3, 1.0), (50, 3, 7, 0.0)]


def test_each_length_is_searched(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = np.random.default_rng(8)
    sizes = [(16, 200), (24, 90), (8, 3)]
    vectors = [v.tolist() for dims, n in sizes for v in rng.normal(size=(n, dims))]
    found = {}
    for r in ann.nearest(table(spark, [(i, v, 0) for i, v in enumerate(vectors)]), "key % 10 = 0").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert found.keys() == set(range(0, 293, 10))
    hits = total = base = 0
    for dims, n in sizes:
        units = np.array([v / np.linalg.norm(v) for v in map(np.array, vectors[base : base + n])])
        ids = np.arange(base, base + n)
        want = brute(units, ids, [i for i in range(n) if ids[i] % 10 == 0], 5)
        for q, near in want.items():
            got = [i for _, i in sorted(found[q])]
            assert len(got) == len(near) and all(base <= i < base + n for i in got)
            hits, total = hits + len(set(got) & {i for i, _ in near}), total + len(near)
        base += n
    assert hits >= 0.9 * total


def test_index_meets_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (400, 4), dtype=np.uint8)
    index = ann.Index(codes)
    for radius in (0, 3, 8, 9, 13, 32):
        for code in codes[:10]:
            want = np.nonzero(np.bitwise_count(codes ^ code).sum(1, dtype=int) <= radius)[0]
            assert index.within(code, radius).tolist() == want.tolist()


def test_pairs_in_a_cone_are_found(spark, cone=0.85):
    # Background vectors at a cosine of ``cone``, and pairs just above the threshold.
    rng = np.random.default_rng(11)
    n, pairs, dims = 6000, 100, 64
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    axis = np.eye(dims)[:1]
    vectors = unit(np.sqrt(cone) * axis + np.sqrt(1 - cone) * unit(rng.normal(size=(n, dims)) * (np.arange(dims) > 0)))
    side = rng.normal(size=(pairs, dims))
    side = unit(side - (side * vectors[:pairs]).sum(1)[:, None] * vectors[:pairs])
    vectors = np.concatenate([vectors, 0.935 * vectors[:pairs] + np.sqrt(1 - 0.935**2) * side])
    near = np.triu(vectors @ vectors.T >= 0.93, 1)
    rows = [(i, v, 0) for i, v in enumerate(vectors.tolist())]
    got = {r["vec_id"]: r["component_id"] for r in veclinks.near_vectors(table(spark, rows), window=8).collect()}
    want = reach(len(rows), list(zip(*(x.tolist() for x in np.nonzero(near)))))
    assert got == dict(enumerate(want))


def test_depth_is_that_of_sorted_keys(spark):
    vectors, _ = clustered(1500, 3)
    rows = spark.createDataFrame([(i, 1, 16, v) for i, v in enumerate(vectors.astype(float).tolist())], "_row long, `group` long, dims int, vec array<double>")
    groups = veclinks.passes_of(rows, 0.93, 8, 0.5, 1).collect()
    assert [r["rows"] for r in groups] == [1500]
    # The depth is that of the sorted keys.
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 60, 500))
    plain = max(next((i for i in range(60) if (int(a) ^ int(b)) >> (59 - i)), 60) for a, b in zip(keys, keys[8:]))
    assert veclinks._shared_signs(keys, 8) == plain


def test_passes_over_partition_borders(spark, monkeypatch):
    monkeypatch.setattr(veclinks, "PART", 700)
    rng = np.random.default_rng(12)
    vectors = np.repeat(rng.normal(size=(1500, 32)), 2, 0) + 1e-4 * rng.normal(size=(3000, 32))
    rows = spark.createDataFrame([(i, 1, 32, v) for i, v in enumerate(vectors.tolist())], "_row long, `group` long, dims int, vec array<double>")
    assert veclinks.passes_of(rows, 0.93, 8, 0.05, 1).first()["passes"] > 5
    links = {tuple(sorted(r)) for r in veclinks.found_links(rows, 0.93, 8, 0.05).collect()}
    assert links == {(i, i + 1) for i in range(0, 3000, 2)}
