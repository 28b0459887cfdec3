"""Joins, set operations and read clauses whose rules differ from SQL's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], prefix: str = "r_", slices: int | None = None) -> DataFrame:
    """Each left row with the newest right row at or before its time and of its key; left rows without one, without key or without time stay alone.

    Both sides are cut into as many slices of time as there are shuffle
    partitions, by quantiles, and go through one shuffle by key and slice, so
    that a hot key is spread over many tasks. A running last() answers within a
    slice; what an earlier slice leaves over comes from a table of one row a
    key and slice. No rows are multiplied.
    """
    spark = left.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = F.col(key).isNotNull() & F.col(time).isNotNull()
    fields = F.struct(F.col(time), *values)
    kind = right.select(fields.alias("s")).schema["s"].dataType
    none = F.lit(None).cast(kind)
    both = left.where(usable).withColumn("_right", none).withColumn("_side", F.lit(1))
    both = both.unionByName(right.where(usable).select(F.col(key), F.col(time), fields.alias("_right"), F.lit(0).alias("_side")), allowMissingColumns=True)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = both.agg(F.percentile_approx(us, [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else []  # n numbers
    at = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < us)) if cuts else F.lit(0)
    both = both.withColumn("_slice", at)
    ends = both.groupBy(key, "_slice").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col(time))).alias("_end"))
    carried = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy(key, "_slice").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_m", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    seen = seen.join(carried.select(key, "_slice", "_before"), [key, "_slice"], "left").withColumn("_m", F.coalesce("_m", "_before"))
    alone = left.where(~usable).withColumn("_m", none)
    rows = seen.select(*left.columns, "_m").unionByName(alone)
    return rows.select(*left.columns, *(F.col("_m")[c].alias(prefix + c) for c in [time, *values]))


def split_on(df: DataFrame, column: str) -> DataFrame:
    """A row per element; an empty array gives none, an absent one passes once."""
    item = df.schema[column].dataType.elementType
    return df.withColumn(column, F.explode(F.when(F.col(column).isNull(), F.array(F.lit(None).cast(item))).otherwise(F.col(column))))


def combine(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """union, union_all, intersect and except from left to right, without precedence."""
    how = {"union": lambda a, b: a.unionByName(b).distinct(), "union_all": lambda a, b: a.unionByName(b), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}
    return reduce(lambda a, x: how[x[0]](a, x[1]), rest, first)


def after(df: DataFrame, keys: list[tuple[str, bool]], anchor: tuple) -> DataFrame:
    """Rows strictly after the anchor in the order of (column, ascending) keys; pages are read without an offset.

    An absence is lowest: before all values ascending, after them descending.
    """
    tests: list[Column] = []
    for i, (name, up) in enumerate(keys):
        same = [F.col(n).eqNullSafe(F.lit(a)) for (n, _), a in zip(keys[:i], anchor)]
        c, a = F.col(name), anchor[i]
        if up:
            step = c.isNotNull() if a is None else c > F.lit(a)
        else:
            step = F.lit(False) if a is None else (c < F.lit(a)) | c.isNull()
        tests.append(reduce(lambda a, b: a & b, same, F.coalesce(step, F.lit(False))))
    return df.where(reduce(lambda a, b: a | b, tests))


def fuse(df: DataFrame, branches: list[tuple[Column, float]], identity: str, depth: int = 100, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over branches that rank a row within depth. Each branch is a top-k, not a sort of all rows."""
    ranked = []
    for i, (order, weight) in enumerate(branches):
        top = df.orderBy(order, F.col(identity)).limit(depth)
        rank = F.row_number().over(Window.orderBy(order, F.col(identity)))  # of depth rows at most
        ranked.append(top.select(identity, (F.lit(weight) / (k + rank)).alias("part"), F.lit(i).alias("branch")))
    return reduce(DataFrame.unionByName, ranked).groupBy(identity).agg(F.sum("part").alias("score"))


def ranks(df: DataFrame, branches: list[tuple[Column, float]], identity: str, depth: int = 100) -> DataFrame:
    """Each fused row's rank in every branch, absent where the branch doesn't rank it."""
    parts = []
    for i, (order, _) in enumerate(branches):
        top = df.orderBy(order, F.col(identity)).limit(depth)
        parts.append(top.select(identity, F.row_number().over(Window.orderBy(order, F.col(identity))).alias("rank"), F.lit(i).alias("branch")))  # of depth rows at most
    one = lambda i: F.max(F.when(F.col("branch") == i, F.col("rank")))
    return reduce(DataFrame.unionByName, parts).groupBy(identity).agg(F.array(*(one(i) for i in range(len(branches)))).alias("ranks"))


def omit(df: DataFrame, *routes: str) -> DataFrame:
    """The row without some fields; a.b takes b out of the struct a."""
    for r in routes:
        head, _, rest = r.partition(".")
        if head in df.columns:
            df = df.withColumn(head, F.col(head).dropFields(rest)) if rest else df.drop(head)
    return df


def only(df: DataFrame) -> DataFrame:
    """The one row, or none; several are refused. Two rows at most are looked at."""
    if len(df.limit(2).collect()) > 1:
        raise ValueError("ONLY was asked of several rows")
    return df


def fetch(df: DataFrame, reference: str, target: DataFrame, identity: str = "id") -> DataFrame:
    """A reference, or an array of them, replaced by the rows that they name; a reference to nothing becomes absent, in an array it is left out."""
    row = F.struct("*").alias("_row")
    t = target.select(F.col(identity).alias("_id"), row)
    if not df.schema[reference].dataType.simpleString().startswith("array"):
        return df.join(t, F.col(reference) == F.col("_id"), "left").withColumn(reference, F.col("_row")).drop("_row", "_id")
    names = list(df.columns)
    d = df.select(F.struct(*names).alias("_all"), F.xxhash64(F.struct(*names)).alias("_h"), F.posexplode_outer(reference).alias("_at", "_ref"))
    found = d.join(t, F.col("_ref") == F.col("_id"), "left").where(F.col("_ref").isNull() | F.col("_row").isNotNull() | (F.col("_at") == 0))
    rows = found.groupBy("_h", "_all").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("_row").isNotNull(), F.struct("_at", "_row")))), lambda x: x["_row"]).alias("_rows"))
    return rows.select(*(F.when(F.col("_all")[reference].isNotNull(), F.col("_rows")).alias(c) if c == reference else F.col("_all")[c].alias(c) for c in names))
