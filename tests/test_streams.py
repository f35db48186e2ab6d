"""Streams that stop and go on in the same folder."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagequarry.streaming import intake

BODIES = "batch_id long, body string"


def files(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return intake.read_files(spark, f"{folder}/{name}", schema, "*.parquet")


def test_intake_goes_on_where_it_stopped(spark, tmp_path):
    def run(rows):
        stream = files(spark, tmp_path, "bodies", rows, BODIES)
        taken = intake.run_append(spark, intake.intake(stream), f"{tmp_path}/taken")
        left = intake.run_append(spark, intake.rejects(stream), f"{tmp_path}/left")
        return sorted(map(tuple, taken.collect())), sorted((r.batch_id, r.reason) for r in left.collect())

    first = [(1, '{"urls":["http://b"," http://a","http://b","x"]}'), (2, "no")]
    assert run(first) == ([(1, 0, "http://b"), (1, 1, "http://a")], [(1, "invalid_url"), (2, "not_json")])
    taken, left = run([(3, '{"urls":["http://b"]}')])
    assert taken == [(1, 0, "http://b"), (1, 1, "http://a"), (3, 0, "http://b")] and len(left) == 2


def test_counts_take_rows_of_any_age(spark, tmp_path):
    schema = "at timestamp, kind string"

    def run(rows):
        stream = files(spark, tmp_path, "rows", rows, schema)
        out = intake.run_sums(spark, intake.counts(stream, F.col("kind"), F.col("at")), ["window_start", "kind"], f"{tmp_path}/sums")
        return {(r.window_start.year, r.kind): r.n for r in out.collect()}

    assert run([(datetime(2024, 1, 1), "a")] * 3) == {(2024, "a"): 3}
    assert run([(datetime(2020, 1, 1), "a"), (datetime(2024, 1, 1), "a")]) == {(2024, "a"): 4, (2020, "a"): 1}
    assert run([]) == {(2024, "a"): 4, (2020, "a"): 1}


def test_retention_reads_only_what_is_new(spark, tmp_path):
    schema = "token string, path string, seq long, delivered boolean"

    def run(rows):
        stream = files(spark, tmp_path, "arts", rows, schema)
        return sorted(r.seq for r in intake.retention(spark, stream, f"{tmp_path}/kept", n=4).collect())

    assert run([(f"t{i}", "p", i, False) for i in range(6)]) == [2, 3, 4, 5]
    assert run([("t4", None, None, True), ("t6", "p", 6, False)]) == [3, 5, 6]
    assert run([]) == [3, 5, 6]
    assert run([("t7", "p", 7, False), ("t7", None, None, True)]) == [5, 6]


def test_sums_are_rolled_up(spark, tmp_path):
    schema = "kind string, size long"
    wanted = {}
    for step in range(8):  # three to a table: the last run reads one table and two folders
        rows = [(kind, 10 * step) for kind in "abc"[: 1 + step % 3]]
        for kind, size in rows:
            n, most = wanted.get(kind, (0, 0))
            wanted[kind] = n + 1, max(most, size)
        stream = files(spark, tmp_path, "rows", rows, schema)
        out = intake.run_sums(spark, stream, ["kind"], f"{tmp_path}/sums", ("size",), every=3)
        assert {r.kind: (r.n, r["size"]) for r in out.collect()} == wanted
    assert sorted(f.name for f in (tmp_path / "sums" / "rolled").iterdir()) == ["upto=2", "upto=5"]
    assert len(out.inputFiles()) <= 1 * 8 + 2 * 8 and not any("epoch=5" in f for f in out.inputFiles())
    again = intake.read_files(spark, f"{tmp_path}/rows", schema, "*.parquet")  # nothing new
    out = intake.run_sums(spark, again, ["kind"], f"{tmp_path}/sums", ("size",), every=3)
    assert {r.kind: (r.n, r["size"]) for r in out.collect()} == wanted


def test_streams_of_nothing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    rows = intake.read_files(spark, f"{tmp_path}/none", "kind string", "*.parquet")
    assert intake.run_sums(spark, rows, ["kind"], f"{tmp_path}/sums").collect() == []
    artifacts = intake.read_files(spark, f"{tmp_path}/none", "token string, path string, seq long, delivered boolean", "*.parquet")
    assert intake.retention(spark, artifacts, f"{tmp_path}/kept").collect() == []


def test_a_call_delivered_again_adds_nothing(spark, tmp_path):
    start = datetime(2024, 1, 1)

    def run(rows):
        stream = files(spark, tmp_path, "bodies", [(b, body, start + timedelta(minutes=m)) for b, body, m in rows], f"{BODIES}, at timestamp")
        out = intake.run_append(spark, intake.intake_once(stream, within="1 hour"), f"{tmp_path}/once")
        return sorted((r.batch_id, r.ord, r.url) for r in out.collect())

    call = '{"urls":["http://b","http://a","http://b"]}'
    assert run([(1, call, 0), (1, call, 1)]) == [(1, 0, "http://b"), (1, 1, "http://a")]
    assert run([(1, call, 30), (2, '{"urls":["http://a"]}', 30)]) == [(1, 0, "http://b"), (1, 1, "http://a"), (2, 0, "http://a")]
    assert len(run([(3, '{"urls":["http://a"]}', 600)])) == 4  # and what is older than nine hours is forgotten
    assert len(run([(1, call, 601), (4, call, 5)])) == 6  # the first call counts anew, the fourth is too old


def test_windows_come_out_once_when_closed(spark, tmp_path):
    start = datetime(2024, 1, 1)

    def run(rows):
        stream = files(spark, tmp_path, "rows", [(m if m is None else start + timedelta(minutes=m), kind) for m, kind in rows], "at timestamp, kind string")
        out = intake.run_append(spark, intake.closed_counts(stream, F.col("kind"), F.col("at")), f"{tmp_path}/closed")
        return sorted(((r.window_start - start).seconds // 60, r.kind, r.n) for r in out.collect())

    assert run([(0, "a"), (4, "a"), (4, "b"), (7, "a"), (None, "a")]) == []
    assert run([(3, "a"), (15, "b")]) == [(0, "a", 3), (0, "b", 1)]  # 15 is ten minutes past the end of the first
    assert run([(1, "a"), (8, "a"), (40, "a")]) == [(0, "a", 3), (0, "b", 1), (5, "a", 2), (15, "b", 1)]


def test_a_table_is_a_file_or_a_folder(spark, tmp_path):
    spark.range(10).selectExpr("id as page_id").repartition(3).write.parquet(f"{tmp_path}/folder.parquet")
    single = next((tmp_path / "folder.parquet").glob("part-*.parquet"))
    (tmp_path / "file.parquet").write_bytes(single.read_bytes())
    for name, rows in (("folder", 10), ("file", spark.read.parquet(str(single)).count())):
        stream = intake.read_table(spark, f"{tmp_path}/{name}.parquet", "page_id long")
        assert intake.run_append(spark, stream, f"{tmp_path}/out-{name}").count() == rows > 0
