"""Connected components by alternating large-star and small-star, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood, itself included."""
    d = _both(e)
    low = d.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return d.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    d = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = d.groupBy("u").agg(F.min("v").alias("m"))
    onto = d.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onto.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node long, component long), the component's smallest node.

    Nodes without edges are not listed; loops and repeated edges are ignored;
    no edges give no rows. Minima are pre-aggregated per node and joined back,
    so that no neighbourhood is ever gathered in one row; the join's hot nodes
    are split by adaptive execution. Every round is written to the shared
    folder, and the one before is deleted. Only two counters a round come to the driver.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        last, e = e, written(_small_star(_large_star(e)), "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
