"""Streaming queries over the events, replayed from their files, each with the SQL of the batch that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import new_dir
from ..streaming import flows, rollup
from .catalog import register


def stream_of(spark, d: str, table: str) -> DataFrame:
    """A table's file as a stream; instants with a zone, as watermarks ask."""
    batch = spark.read.parquet(f"{d}/{table}.parquet")
    s = spark.readStream.schema(batch.schema).parquet(f"{d}/{table}*.parquet")
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in batch.schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


def streamed(name: str, sql: str | None):
    def add(f):
        register(name, f, sql, raw=True)
        return f

    return add


def ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.simpleString() == "timestamp"})


@streamed("stream_rollup", """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window, event_type, count(value) AS n, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2""")
def stream_rollup(spark, d):
    path = new_dir(spark, "stream-rollup")
    rollup.keep(stream_of(spark, d, "events"), "ts", "event_type", "value", "6 hours", path, new_dir(spark, "mark")).awaitTermination()
    return ntz(rollup.current(spark, path, "event_type")).select("window", "event_type", "n", F.round("total", 2).alias("total"), "low", "high")


@streamed("stream_sliding", """WITH s AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start FROM events, range(3) r(k)) SELECT start, start + INTERVAL 3 HOUR AS stop, event_type, count(*) AS n FROM s GROUP BY ALL""")
def stream_sliding(spark, d):
    s = flows.sliding(stream_of(spark, d, "events"), "ts", "3 hours", "1 hour", "event_type")
    return ntz(flows.replay(s, new_dir(spark, "mark"), new_dir(spark, "sliding"), "complete"))


@streamed("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
 SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS stop, user_id, count(*) AS n FROM n GROUP BY user_id, run""")
def stream_sessions(spark, d):
    s = flows.sessions(stream_of(spark, d, "events"), "ts", "12 hours", "user_id")
    return ntz(flows.replay(s, new_dir(spark, "mark"), new_dir(spark, "sessions"), "complete"))


@streamed("stream_upsert", """SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1""")
def stream_upsert(spark, d):
    path = new_dir(spark, "upserted")
    flows.upsert(stream_of(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", path, new_dir(spark, "mark")).awaitTermination()
    return ntz(spark.read.parquet(path).drop("bucket"))


@streamed("stream_parsed", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def stream_parsed(spark, d):
    good, _ = flows.parsed(stream_of(spark, d, "events").select("event_id", "props"), "props", "k long", "quarantine")
    return flows.replay(good, new_dir(spark, "mark"), new_dir(spark, "parsed")).select("event_id", "k")


@streamed("changes_between", """SELECT CASE WHEN c_custkey % 10 = 0 THEN 'delete' WHEN c_custkey % 10 = 1 THEN 'create' ELSE 'update' END AS op, c_custkey AS id FROM customer WHERE c_custkey % 10 < 3""")
def changes_between(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey") % 10
    after = c.where(k != 0).withColumn("c_acctbal", F.when(k == 2, -1.0).otherwise(F.col("c_acctbal")))
    return flows.changes(c.where(k != 1), after, "c_custkey").select("op", "id")


@streamed("subscribed", """SELECT CASE WHEN c_custkey % 10 = 2 AND c_acctbal > 0 THEN 'remove' WHEN c_custkey % 10 = 2 THEN NULL WHEN c_custkey % 10 = 0 THEN 'remove' ELSE 'add' END AS told, c_custkey AS id FROM customer WHERE c_custkey % 10 < 3 AND c_acctbal > 0""")
def subscribed(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey") % 10
    after = c.where(k != 0).withColumn("c_acctbal", F.when(k == 2, -1.0).otherwise(F.col("c_acctbal")))
    return flows.subscription(flows.changes(c.where(k != 1), after, "c_custkey"), lambda s: F.col(s)["c_acctbal"] > 0).select("told", "id")


@streamed("first_within", None)
def first_within(spark, d):
    s = flows.first_within(stream_of(spark, d, "events"), "ts", "1 hour", "user_id", "event_type")
    return ntz(flows.replay(s.select("event_id", "user_id", "event_type", "ts"), new_dir(spark, "mark"), new_dir(spark, "first")).select("event_id", "user_id", "event_type", "ts"))
