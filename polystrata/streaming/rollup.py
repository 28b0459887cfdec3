"""A windowed continuous aggregate that stays exact under late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..staging import forget, written


def rollup(events: DataFrame, time: str, by: str, value: str, width: str, slide: str | None = None) -> DataFrame:
    """count, sum, min, max, distinct values (a sketch) and the median's sketch per window and key; over a batch or a stream. `slide` makes windows overlap."""
    w = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    g = events.groupBy(w.alias("w"), by)
    folds = [F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.approx_count_distinct(F.col(value), 0.0081).alias("kinds"), F.percentile_approx(value, 0.5, 10000).alias("middle")]
    return g.agg(*folds).select(F.col("w.start").alias("window"), by, "n", "total", "low", "high", "kinds", "middle")


def keep(events: DataFrame, time: str, by: str, value: str, width: str, path: str, checkpoint: str, retain: str | None = None, slide: str | None = None) -> StreamingQuery:
    """Keeps `path` current: a table of one row a window and key, in a folder for each day.

    A batch replaces touched rows and rewrites only the days that hold one; to
    run a batch again changes nothing. Without `retain` no late row is dropped
    and the state holds every window. With it, windows older than the newest
    event by so much are final: their state goes, as a series' retention floor
    hides them.
    """
    spark = events.sparkSession

    def put(batch: DataFrame, _: int) -> None:
        new = written(batch.withColumn("day", F.to_date("window")), "rollup-batch")
        days = [r[0] for r in new.select("day").distinct().collect()]  # the days that a batch touches
        if not days:
            return
        old = table(spark, path, new.schema)
        rest = old.where(F.col("day").isin(days)).join(new.select(F.col("window").alias("_w"), F.col(by).alias("_b")), (F.col("window") == F.col("_w")) & F.col(by).eqNullSafe(F.col("_b")), "left_anti")
        merged = written(rest.unionByName(new), "rollup-merged")
        merged.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        forget(new)
        forget(merged)

    if retain:
        events = events.withWatermark(time, retain)
    return rollup(events, time, by, value, width, slide).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows at a path, or none where there is no folder yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def current(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The rollup's rows as of now."""
    return spark.read.parquet(path).drop("day")
