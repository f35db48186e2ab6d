import pytest
from pyspark.sql import functions as F

from pagequarry.operators import artifacts, batches, report, skew
from pagequarry.sources import requests as source

SCHEMA = "batch_id long, ord long, url_raw string, format string, timeout_s double"


def rows(spark, *urls_of_batches):
    data = [(b, o, u, None, None) for b, urls in enumerate(urls_of_batches) for o, u in enumerate(urls)]
    data += [(b, None, None, None, None) for b, urls in enumerate(urls_of_batches) if not urls]
    return spark.createDataFrame(data, SCHEMA)


def test_gates_check_in_order(spark):
    many = [f"http://h/{i}" for i in range(4)]
    df = rows(spark, [], ["http://h/", "x"], [*many, "x"], many, many[:3] + [" http://h/0 "])
    strict = {r.batch_id: r.reason for r in batches.gate(df, 3).collect()}
    assert strict == {0: "no_urls", 1: "invalid_urls", 2: "invalid_urls", 3: "too_many_urls", 4: None}
    lenient = {r.batch_id: r.reason for r in batches.gate(df, 3, strict=False).collect()}
    assert lenient == {0: None, 1: None, 2: "too_many_urls", 3: "too_many_urls", 4: None}


def test_split_covers_the_input(spark):
    df = rows(spark, ["http://a", " http://a", "b", ""], ["http://a", "ftp://x"])
    valid, rejected = batches.split_valid(df)
    both = valid.select("batch_id", "ord").unionAll(rejected.select("batch_id", "ord"))
    assert both.exceptAll(df.select("batch_id", "ord")).count() == 0 and both.count() == df.count()
    first, again = batches.first_seen(valid)
    assert sorted((r.batch_id, r.ord) for r in first.collect()) == [(0, 0), (1, 0)]
    assert [(r.batch_id, r.ord) for r in again.collect()] == [(0, 1)]


@pytest.mark.parametrize("parts", [1, 5])
def test_one_huge_batch_gives_the_same_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    df = rows(spark, [f"http://h/{i % 3}" for i in range(90)], ["http://h/1"], [f"http://h/{i}" for i in range(40)]).repartition(parts)
    first = batches.first_seen(batches.split_valid(df)[0])[0]
    kept = batches.accepted(first, batches.gate(df, 3))
    assert sorted((r.batch_id, r.url) for r in kept.collect()) == [(0, "http://h/0"), (0, "http://h/1"), (0, "http://h/2"), (1, "http://h/1")]


def test_options(spark):
    df = spark.createDataFrame([(1, 0, "u", None, t) for t in (None, 0.0, 700.0, -1.0, 600.0)], SCHEMA).coalesce(1)
    got = [(r.timeout, r.timeout_reason is None, r.long_timeout) for r in batches.with_options(df).collect()]
    assert got == [(60.0, True, False), (0.0, False, False), (700.0, True, True), (-1.0, False, False), (600.0, True, False)]


def test_bodies(spark):
    cases = {
        b'{"urls":["http://a"],"x":[1]}': None, b'{"urls":[]}': None, b"{": "not_json", b"\xff": "not_json", b"[]": "not_object",
        b'"a"': "not_object", b"null": "not_object", b"{}": "no_urls", b'{"urls":null}': "bad_urls", b'{"urls":"a"}': "bad_urls",
        b'{"urls":["a",1]}': "bad_urls", b'{"urls":["a",null]}': "bad_urls", b'{"urls":[["a"]]}': "bad_urls", b'{"urls":{}}': "bad_urls",
    }
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(cases)], "batch_id long, body binary")
    got = [r.reason for r in source.parse_bodies(df).orderBy("batch_id").collect()]
    assert got == list(cases.values())
    good, bad = source.from_bodies(df)
    assert sorted((r.batch_id, r.ord, r.url_raw) for r in good.collect() if r.ord is not None) == [(0, 0, "http://a")]
    assert good.where("ord is null").count() == 1 and bad.count() == 12


def test_request_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("http://one\r\nhttp://two\n\n")
    got = source.read_lines(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.url_raw for r in got] == ["http://one", "http://two"] and got[0].ord < got[1].ord
    rows(spark, ["http://a"]).write.json(str(tmp_path / "j"))
    assert source.read(spark, str(tmp_path / "j"), "json").first().url_raw == "http://a"


def test_progress_of_equal_instants(spark, monkeypatch):
    monkeypatch.setattr(skew, "RANGE", 8)
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    df = spark.range(100).select((F.col("id") % 3 == 0).cast("long").alias("batch_id"), F.col("id").alias("ord"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") * 700).cast("long").alias("finished_at"))
    got = report.progress(df).orderBy("batch_id", "done").collect()
    for batch in (0, 1):
        mine = [r for r in got if r.batch_id == batch]
        assert [r.done for r in mine] == list(range(1, len(mine) + 1)) and {r.total for r in mine} == {len(mine)}
        assert [(r.finished_at, r.ord) for r in mine] == sorted((r.finished_at, r.ord) for r in mine)


def test_artifacts(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    arts = spark.range(50).select(F.concat(F.lit("t"), "id").alias("token"), F.when(F.col("id") < 40, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("path"), F.col("id").alias("seq"))
    files = spark.createDataFrame([("hot",), ("p41",)], "path string")
    assert artifacts.present(arts, files).count() == 41
    sent = spark.createDataFrame([("t1", "GET", False, True), ("t2", "HEAD", False, True), ("t3", "GET", True, True), ("t4", "GET", False, False), ("t1", "GET", False, True)], "token string, method string, ranged boolean, complete boolean")
    assert {r.token for r in arts.join(artifacts.live(arts, sent), "token", "left_anti").collect()} == {"t1"}
    assert artifacts.live(arts, sent, keep=True).count() == 50
    assert sorted(r.seq for r in artifacts.newest(arts, 3).collect()) == [47, 48, 49]
