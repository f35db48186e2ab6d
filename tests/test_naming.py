import random
import re

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import naming, skew


def check(asked, given):
    """What names of a batch must satisfy, from the names given to the requests before."""
    assert len(set(given)) == len(given)
    for i, (name, got) in enumerate(zip(asked, given, strict=True)):
        before = set(given[:i])
        if name not in before:
            assert got == name  # a free name goes to the first that asks for it
            continue
        front, suffix = re.fullmatch(r"(?s)(.+?)(\.[^.]+)?", name).groups("") if "." in name[1:] else (name, "")
        number = int(re.fullmatch(re.escape(front) + r"-(\d+)" + re.escape(suffix), got)[1])
        assert number >= 2 and all(f"{front}-{k}{suffix}" in before for k in range(2, number))


def test_numbers_are_the_lowest_free_ones(spark):
    rnd = random.Random(11)
    # Names that are numbered forms of each other, at several depths, with and without suffix.
    stems = ["page", "page-2", "page-3", "page-2-2", "page-02", "page-1", ".dot", ".dot-2"]
    names = [s + e for s in stems for e in ("", ".txt")] + ["page-2-3.txt", "page-7.txt", "Page.txt", "page-2-2-2"]
    batches = [rnd.choices(names[: rnd.randint(2, len(names))], k=rnd.randint(1, 24)) for _ in range(300)]
    batches += [["n", "n", "n-2", "n"], ["n-2", "n", "n", "n-2", "n"]]
    rows = [(b, o, n) for b, asked in enumerate(batches) for o, n in enumerate(asked)]
    df = spark.createDataFrame(rows, "batch_id long, ord long, name string").repartition(7)
    got = {(r.batch_id, r.ord): r.allocated for r in naming.allocate(df).collect()}
    assert len(got) == len(rows)
    for b, asked in enumerate(batches):
        check(asked, [got[b, o] for o in range(len(asked))])


@pytest.mark.parametrize("width", [3, 1000])
def test_frequent_names_are_numbered_in_pieces(spark, monkeypatch, width):
    monkeypatch.setattr(skew, "RANGE", width)
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rows = [(1, i, "q.txt" if i % 4 else "q-5.txt") for i in range(100)]
    df = spark.createDataFrame(rows, "batch_id long, ord long, name string")
    check([r[2] for r in rows], [r.allocated for r in naming.allocate(df).orderBy("ord").collect()])


def test_positions_with_levels(spark, monkeypatch):
    monkeypatch.setattr(skew, "RANGE", 4)
    rnd = random.Random(1)
    rows = [(i % 2, i, rnd.choice([1, 1, 1, 7, 9, 30, 31])) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, ord long, at long")
    out = skew.positions(df, ["g"], "ord", "n", levels=[F.floor(F.col("at") / 10), F.col("at")]).collect()
    for g in (0, 1):
        want = sorted((at, o) for gg, o, at in rows if gg == g)
        got = sorted((r.n, r["at"], r.ord) for r in out if r.g == g)
        assert [x[1:] for x in got] == want
        assert [x[0] for x in got] == list(range(1, len(want) + 1))


def test_listed_pieces_keep_every_entry(spark):
    df = spark.range(57).select(F.lit(1).alias("k"), F.col("id").alias("ord"), F.col("id").cast("string").alias("v"))
    rows = skew.listed(df, ["k"], "ord", "v", "vs", piece=10).orderBy("piece").collect()
    assert [x for r in rows for x in r.vs] == [str(i) for i in range(57)]
    assert max(len(r.vs) for r in rows) == 10


def test_lookup_spreads_hot_keys_without_loss(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    left = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    right = left.select("k").distinct().where("k <> 'k1'").withColumn("v", F.lit(1))
    out = skew.lookup(left, right, ["k"], ["id"])
    assert out.count() == 100 and out.where("v is null").count() == 1
    parts = skew.salt(left, skew.hot_keys(left, ["k"]), ["k"], ["id"]).where("k = 'hot'").select("_part").distinct().count()
    assert parts > 1


def test_more_frequent_keys_than_can_be_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    # 1500 keys over the floor, one of them with a third of all rows.
    df = spark.range(1500 * 5 + 4000).select(F.when(F.col("id") < 7500, F.col("id") % 1500).otherwise(-1).alias("k"))
    hot = {r.k: r._parts for r in skew.hot_keys(df, ["k"]).collect()}
    assert hot.keys() == {-1} and hot[-1] > 300  # no other has a 1024th of the rows
    few = {r.k for r in skew.hot_keys(df.where("k < 20"), ["k"]).collect()}
    assert few == {-1, *range(20)}
