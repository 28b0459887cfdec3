"""Folds, gap filling and latest-per-key reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_all(df: DataFrame, *folds: Column) -> DataFrame:
    """A fold without groups: one row, or none over no rows."""
    return df.groupBy(F.lit(True).alias("_g")).agg(*folds).drop("_g")


def total(c: Column | str) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def counter_folds(df: DataFrame, keys: list[str], value: str, at: str, identity: str) -> DataFrame:
    """increase (a fall restarts from zero), rate per second and delta of a counter; absent below two samples."""
    w = Window.partitionBy(*keys).orderBy(at, identity)
    rise = F.when(F.col(value) >= F.lag(value).over(w), F.col(value) - F.lag(value).over(w)).when(F.lag(value).over(w).isNotNull(), F.col(value))
    d = df.where(F.col(value).isNotNull() & F.col(at).isNotNull()).withColumn("_rise", rise)
    g = d.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum("_rise").alias("_inc"), (F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))).alias("_us"),
        (F.max_by(value, F.struct(at, identity)) - F.min_by(value, F.struct(at, identity))).alias("_delta"),
    )
    two = F.col("_n") >= 2
    return g.select(*keys, F.when(two, F.col("_inc")).alias("increase"), F.when(two & (F.col("_us") > 0), F.col("_inc") / (F.col("_us") / 1e6)).alias("rate"), F.when(two, F.col("_delta")).alias("delta"))


def quantile_sketch(df: DataFrame, keys: list[str], value: str, q: float, alpha: float = 0.01) -> DataFrame:
    """A quantile within alpha of its value: logarithmic buckets are counted (mergeable), then walked to rank floor(q (n - 1))."""
    gamma = (1 + alpha) / (1 - alpha)
    x = F.col(value)
    bucket = F.when(F.abs(x) < 1e-9, F.lit(0)).otherwise(F.ceil(F.log(F.abs(x)) / F.log(F.lit(gamma))).cast("long"))
    sign = F.when(F.abs(x) < 1e-9, 0).otherwise(F.signum(x)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(*keys, sign.alias("s"), bucket.alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    run = F.sum("n").over(w.orderBy("s", F.col("s") * F.col("b")).rowsBetween(Window.unboundedPreceding, 0))
    walk = counts.withColumns({"upto": run, "all": F.sum("n").over(w)}).where(F.col("upto") > F.floor(q * (F.col("all") - 1)))
    first = walk.groupBy(*keys).agg(F.min_by(F.struct("s", "b"), "upto").alias("k"))
    return first.select(*keys, (F.col("k.s") * 2 * F.pow(F.lit(gamma), F.col("k.b")) / (gamma + 1)).alias("quantile"))


def bucket(ts: Column, seconds: int) -> Column:
    """Epoch-anchored floor, also before 1970."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("timestamp_ntz")


def fill_windows(df: DataFrame, keys: list[str], window: str, values: dict[str, object], start: str, stop: str, seconds: int) -> DataFrame:
    """One row per combination of keys and window of [start, stop), windows of other times left out.

    A written window keeps its values, absent ones too. An unwritten one takes,
    by column: 'previous' the nearest written window before, 'linear' the line
    between both neighbours, 'count' 0, or else the given value. Without keys an
    empty input has all windows as well. At most a million windows a key.
    """
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, stop))
    step = F.make_dt_interval(secs=F.lit(seconds))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    count = F.ceil((us(hi) - us(lo)) / (seconds * 1_000_000))
    spine = F.when(count > 1_000_000, F.raise_error(F.lit("more than a million windows"))).otherwise(F.when(count > 0, F.sequence(lo, hi - F.expr("interval '0.000001' second"), step)))
    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    base = base.withColumn(window, F.explode(spine))
    on = reduce(lambda a, b: a & b, (F.col(f"s.{k}").eqNullSafe(F.col(f"d.{k}")) for k in [*keys, window]))
    d = base.alias("s").join(df.select(*keys, window, *values, F.lit(True).alias("_w")).alias("d"), on, "left").select(*(F.col(f"s.{k}").alias(k) for k in [*keys, window]), *values, "_w")
    part = keys or [F.lit(0)]
    up = Window.partitionBy(*part).orderBy(window).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part).orderBy(window).rowsBetween(0, Window.unboundedFollowing)
    out = []
    for c, mode in values.items():
        kind = df.schema[c].dataType
        if mode == "count":
            new = F.lit(0).cast(kind)
        elif mode == "previous":
            new = F.last(F.when(F.col("_w"), F.struct(F.col(c).alias("v"))), True).over(up)["v"]
        elif mode == "linear":
            mark = F.when(F.col("_w"), F.struct(F.col(window).alias("t"), F.col(c).cast("double").alias("v")))
            p, n = F.last(mark, True).over(up), F.first(mark, True).over(down)
            new = p["v"] + (n["v"] - p["v"]) * (us(F.col(window)) - us(p["t"])) / F.nullif(us(n["t"]) - us(p["t"]), F.lit(0))
        else:
            new = F.lit(mode)
        out.append(F.when(F.col("_w"), F.col(c).cast("double") if mode == "linear" else F.col(c)).otherwise(new).alias(c))
    return d.select(*keys, window, *out)


def fill(df: DataFrame, key: str, window: str, value: str, start: str, stop: str, seconds: int, mode: object) -> DataFrame:
    """fill_windows() of one key and one value."""
    d = fill_windows(df, [key], window, {value: mode}, start, stop, seconds)
    return d.withColumn(value, F.col(value).cast("double")) if mode in ("previous", "linear") else d


def collect(value: Column, order: Column) -> Column:
    """Present values in the order of the rows; an empty array over none."""
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


def approx_distinct(value: Column) -> Column:
    """A mergeable sketch of 2^14 registers: a relative error of 0.8 % as a standard deviation."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(value.cast("string"), 14))


def latest_by(df: DataFrame, key: str, at: str, identity: str) -> DataFrame:
    """The newest row of each key; a pre-aggregated maximum, no sort."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("*"), F.struct(at, identity)).alias("_r")).select("_r.*")
