import re

from pagequarry.llm import mixing
from pyspark.sql import functions as F
from tables import awkward, documents, empty


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: most * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 1000, "b": 10, "é": 500, "Z": 3, None: 70, "c": 0, "aa": 400}
    got = mixing.targets(spark.createDataFrame([(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()], "source string, size long"))
    want = plain_targets(sizes)
    for row in got.collect():
        assert row["source_size"] == sizes[row["source"]]
        assert abs(row["target"] - want[row["source"]]) < 1e-9 * 3000
    assert abs(sum(r["target"] for r in got.collect()) - 1.5 * sum(sizes.values())) < 1e-6


def test_copies_near_the_target_and_the_same_again(spark):
    docs = documents(spark, ["w " * (1 + i % 7) for i in range(6000)], source=lambda i: "hot" if i % 3 else f"s{i % 4}")
    plan = mixing.planned(docs)
    per_source = docs.join(plan, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    for row in per_source.collect():
        assert abs(row["taken"] - row["target"]) < 0.1 * row["target"]
    first = sorted(tuple(r) for r in plan.collect())
    assert first == sorted(tuple(r) for r in mixing.planned(docs.repartition(7)).collect())
    assert all(r[5] <= 2 * r[1] for r in first)


def test_mix_emits_what_was_planned(spark):
    docs = documents(spark, ["w " * (1 + i % 5) for i in range(300)])
    copies = {r["doc_id"]: r["copies"] for r in mixing.planned(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert dict(out.groupBy("doc_id").count().collect()) == {k: n for k, n in copies.items() if n}


def test_sizes_count_words_between_ascii_blanks(spark):
    texts = ["a b c", "\x0b\x0c", " x\ty\r\nz ", None, "", "\x1fa \x00"]
    got = {r["doc_id"]: r["size"] for r in mixing.planned(documents(spark, texts)).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_awkward_rows_and_empty_table(spark):
    rows = mixing.planned(awkward(spark)).collect()
    assert len(rows) == 11
    assert all(r["taken"] == r["size"] * r["copies"] for r in rows)
    twin = [r for r in rows if r["doc_id"] == 4]
    assert len(twin) == 2 and twin[0] == twin[1]
    assert mixing.planned(empty(spark)).collect() == [] and mixing.mix(empty(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(documents(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
