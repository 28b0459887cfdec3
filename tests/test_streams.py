import pytest
from pyspark.sql import functions as F

from polystrata.staging import new_dir
from polystrata.streaming import flows, rollup


def files(spark, path, schema, *batches):
    """A stream of one file a batch, one file a trigger."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_group_hands_out_again_and_gives_up(spark, tmp_path):
    rows = [[("g", 1, "message", 0), ("g", 2, "message", 0), ("h", 1, "message", 5)], [("g", 1, "ack", 10), ("g", 0, "tick", 100), ("h", 0, "tick", 50)], [("g", 0, "tick", 250), ("h", 0, "tick", 120)], [("g", 0, "tick", 400)]]
    s = files(spark, str(tmp_path / "in"), "`group` string, position long, kind string, at_ms long", *rows)
    out = flows.replay(flows.hand_out(s, "group", 100, 2), str(tmp_path / "mark"), str(tmp_path / "out")).collect()
    assert sorted((r.group, r.position, r.delivery, r.what) for r in out) == [("g", 1, 1, "deliver"), ("g", 2, 1, "deliver"), ("g", 2, 2, "dead"), ("g", 2, 2, "deliver"), ("h", 1, 1, "deliver"), ("h", 1, 2, "deliver")]


def test_upserts_count_once(spark, tmp_path):
    s = files(spark, str(tmp_path / "in"), "k string, v int, at int", [("a", 1, 1), ("b", 2, 2)], [("a", 9, 5), (None, 1, 9)], [("a", 3, 3)])
    path = new_dir(spark, "up")
    for mark in ("m1", "m2"):  # a second time from the beginning: the same table
        flows.upsert(s, "k", "at", path, str(tmp_path / mark)).awaitTermination()
        assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_what_cannot_be_read(spark, tmp_path):
    d = spark.createDataFrame([(1, '{"k": 5}'), (2, "{bad"), (3, None)], "at int, body string")
    good, bad = flows.parsed(d, "body", "k int", "quarantine")
    assert [tuple(r) for r in good.collect()] == [(1, 5)] and [r.at for r in bad.collect()] == [2]
    with pytest.raises(Exception, match="can't be read"):
        flows.parsed(d, "body", "k int")[0].collect()


def test_first_within_a_span(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:30:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-01 00:10:00")]
    d = spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    assert sorted(str(r.t)[11:16] for r in flows.first_within(d, "t", "1 hour", "k").collect()) == ["00:00", "00:10", "02:00"]


def test_rollup_forgets_what_is_older_than_its_retention(spark, tmp_path):
    batches = [[("2024-01-01 00:00:10", "a", 1), ("2024-01-05 00:00:00", "a", 2)], [("2024-01-01 00:00:20", "a", 5), ("2024-01-04 23:59:00", "a", 7)], [("2024-01-05 00:01:00", "a", 9), ("2024-01-01 00:00:30", "a", 50)]]
    schema = "ts string, k string, v long"
    got = {}
    for retain in (None, "2 days"):
        s = files(spark, str(tmp_path / f"in-{retain}"), schema, *batches).withColumn("ts", F.col("ts").cast("timestamp"))
        path = new_dir(spark, "kept")
        rollup.keep(s, "ts", "k", "v", "1 hour", path, str(tmp_path / f"mark-{retain}"), retain=retain).awaitTermination()
        got[retain] = sorted((str(r.window)[:13], r.n, r.total) for r in rollup.current(spark, path, "k").collect())
    assert got[None] == [("2024-01-01 00", 3, 56), ("2024-01-04 23", 1, 7), ("2024-01-05 00", 2, 11)]
    assert got["2 days"][1:] == got[None][1:] and got["2 days"][0][1] < 3
