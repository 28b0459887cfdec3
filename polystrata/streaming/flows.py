"""Streams: windows, repeats within a time, upserts that count once, messages that can't be read, subscriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..staging import forget, written
from .rollup import table


def tumbling(events: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    return _counted(events, F.window(F.col(time), width), keys)


def sliding(events: DataFrame, time: str, width: str, slide: str, *keys: str) -> DataFrame:
    """Windows of a width that begin every `slide`; a row is in each that holds it."""
    return _counted(events, F.window(F.col(time), width, slide), keys)


def sessions(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Runs of rows of a key that follow each other within a gap."""
    return _counted(events, F.session_window(F.col(time), gap), keys)


def _counted(events: DataFrame, window: Column, keys: tuple[str, ...]) -> DataFrame:
    return events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def first_within(events: DataFrame, time: str, span: str, *keys: str) -> DataFrame:
    """Repeats of a key that come within a span of its first row are dropped; a watermark of the span bounds the state. On a batch: the first row of each key in each run of the span."""
    if events.isStreaming:
        return events.withWatermark(time, span).dropDuplicatesWithinWatermark(list(keys))
    us = F.unix_micros(F.col(time).cast("timestamp"))
    d = events.withColumn("_us", us).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_us", F.struct(*events.columns).alias("_row")))).alias("_rows"))
    width = int(pd.Timedelta(span) / pd.Timedelta(microseconds=1))
    kept = F.aggregate("_rows", F.struct(F.lit(None).cast("long").alias("t"), F.slice(F.col("_rows"), 1, 0).alias("out")), lambda a, x: F.when(a["t"].isNull() | (x["_us"] - a["t"] > width), F.struct(x["_us"].alias("t"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a), lambda a: a["out"])
    return d.select(F.explode(kept).alias("x")).select("x._row.*")


def upsert(stream: DataFrame, identity: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """A table of the newest row of each identity. At least once or exactly once, the table is the same: a batch that comes again replaces rows by themselves.

    Rows are kept in folders by hash of their identity; a batch rewrites the folders that it touches.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, _: int) -> None:
        new = batch.where(F.col(identity).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(identity), F.lit(64)).cast("int"))
        new = written(new, "upserts")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # 64 at most
        if not touched:
            return
        both = table(spark, path, new.schema).where(F.col("bucket").isin(touched)).unionByName(new)
        newest = both.groupBy(identity).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        merged = written(newest, "upserted")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        forget(new)
        forget(merged)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Unreadable(ValueError):
    """A message that can't be read, where the policy is to stop."""


def parsed(messages: DataFrame, column: str, schema: str, policy: str = "stop") -> tuple[DataFrame, DataFrame]:
    """JSON texts as rows, and those that can't be read: with 'stop' one of them ends the query, with 'quarantine' they are the second frame."""
    d = messages.withColumn("_v", F.try_parse_json(column))
    bad = F.col("_v").isNull() & F.col(column).isNotNull()
    if policy == "stop":
        d = d.withColumn("_v", F.when(bad, F.raise_error(F.concat(F.lit("a message can't be read: "), F.substring(column, 1, 80))).cast("variant")).otherwise(F.col("_v")))
    good = d.where(F.col("_v").isNotNull()).withColumn("_m", F.from_json(column, schema)).select(*[c for c in messages.columns if c != column], "_m.*")
    return good, d.where(bad).select(*messages.columns)


def changes(before: DataFrame, after: DataFrame, identity: str) -> DataFrame:
    """op, id, before, after: the net effect between two states of a table."""
    b = before.select(F.col(identity).alias("_b"), F.struct("*").alias("before"))
    a = after.select(F.col(identity).alias("_a"), F.struct("*").alias("after"))
    both = b.join(a, F.col("_b") == F.col("_a"), "full")
    op = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("update")
    same = F.coalesce(F.to_json("before") == F.to_json("after"), F.lit(False))
    return both.where(~same).select(op.alias("op"), F.coalesce("_a", "_b").alias("id"), "before", "after")


def subscription(stream: DataFrame, condition: Callable[[str], Column]) -> DataFrame:
    """What a subscriber to the rows that meet a condition is told: a row that begins to meet it comes, one that ceases to is removed. condition('after') is the test of one side."""
    was, now = (F.coalesce(F.col(s).isNotNull() & condition(s), F.lit(False)) for s in ("before", "after"))
    told = F.when(now & ~was, "add").when(now & was, "change").when(was & ~now, "remove")
    return stream.withColumn("told", told).where("told is not null").select("told", "id", F.when(F.col("told") != "remove", F.col("after")).alias("row"))


def alive(df: DataFrame, expires: str, now: Column | None = None) -> DataFrame:
    """Rows that haven't expired."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > (F.current_timestamp() if now is None else now)))


def hand_out(messages: DataFrame, group: str, deadline_ms: int, deliveries: int) -> DataFrame:
    """A consumer group as a stateful operator. messages (group, position, kind, ...): 'message' brings one, 'ack' settles it, 'tick' is a reading of the clock in `at_ms`.

    Answers group, position, delivery and what: 'deliver' when a message is
    handed out, again after each deadline that passes without an ack, and
    'dead' when it was handed out `deliveries` times. State: what isn't settled.
    """
    schema = "`group` string, position long, delivery int, what string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, list[int]] = {int(p): [int(n), int(t)] for p, n, t in (state.get[0] if state.exists else [])}
        out: list[tuple] = []
        for pdf in batches:
            for r in pdf.sort_values(["at_ms", "position"]).itertuples():
                if r.kind == "message" and r.position not in held:
                    held[r.position] = [1, r.at_ms + deadline_ms]
                    out.append((key[0], r.position, 1, "deliver"))
                elif r.kind == "ack":
                    held.pop(r.position, None)
                elif r.kind == "tick":
                    for p in [p for p, (_, t) in sorted(held.items()) if t <= r.at_ms]:
                        n = held[p][0]
                        if n >= deliveries:
                            del held[p]
                            out.append((key[0], p, n, "dead"))
                        else:
                            held[p] = [n + 1, r.at_ms + deadline_ms]
                            out.append((key[0], p, n + 1, "deliver"))
        state.update(([[p, n, t] for p, (n, t) in held.items()],))
        yield pd.DataFrame(out, columns=["group", "position", "delivery", "what"])

    return messages.groupBy(group).applyInPandasWithState(step, schema, "held array<array<long>>", "append", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and answers what it wrote: of complete results the last, of others all."""
    spark: SparkSession = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table(spark, path, stream.schema)
