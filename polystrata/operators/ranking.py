"""Full-text ranking, vector distances and bounded graph reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import written

INF = float("inf")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(docs: DataFrame, identity: str, text: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Score of every document that holds a word. One pass over the texts writes lengths and counts of the asked words; statistics and scores come from those."""
    asked = sorted({w.lower() for w in words})
    t = docs.where(F.col(text).isNotNull()).select(identity, tokens(F.col(text)).alias("t"))
    f = written(t.select(identity, F.size("t").alias("len"), *(F.size(F.filter("t", _is(w))).alias(f"f{i}") for i, w in enumerate(asked))), "counts")
    stats = f.agg(F.count("*").alias("N"), F.avg("len").alias("avg"), *(F.sum(F.when(F.col(f"f{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(asked))))
    both = f.where(" or ".join(f"f{i} > 0" for i in range(len(asked)))).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.log(1 + (F.col("N") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return both.select(identity, score.alias("score"))


def _is(word: str):
    return lambda x: x == word


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(F.size(a) == F.size(b), _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))), F.lit(INF))


def euclidean(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(F.size(a) == F.size(b), F.sqrt(_fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))), F.lit(INF))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; infinite for absent, zero or differently long vectors."""
    norm = F.sqrt(_fold(a, a, lambda x, y: x.cast("double") * y.cast("double"))) * F.sqrt(_fold(b, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), 1 - dot(a, b) / norm), F.lit(INF))


def nearest(df: DataFrame, identity: str, distance: Column, k: int) -> DataFrame:
    """Exact: a top-k, never a full sort."""
    return df.withColumn("distance", distance).orderBy("distance", identity).limit(k)


def hop(front: DataFrame, edges: DataFrame, back: bool = False) -> DataFrame:
    """node: the far ends of the front's edges, each once; `back` follows them from dst to src."""
    near, far = ("dst", "src") if back else ("src", "dst")
    e = edges.select(F.col(near).alias("_near"), F.col(far).alias("_far"))
    return front.select("node").join(e, F.col("node") == F.col("_near")).select(F.col("_far").alias("node")).distinct()


def walk(front: DataFrame, steps: list[tuple[DataFrame, bool]]) -> DataFrame:
    """Several hops from left to right, over edges of several kinds."""
    for edges, back in steps:
        front = hop(front, edges, back)
    return front


def reach(edges: DataFrame, start: list, depth: int, back: bool = False) -> DataFrame:
    """node, steps: nodes within 1..depth hops, the start left out.

    Every round's front is written, so the plan of a round doesn't hold the
    rounds before it; nodes seen already are dropped from the next front. It
    ends with the depth or with an empty front.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    front = spark.createDataFrame([(x, 0) for x in start], f"node {kind}, steps int")
    fronts = [front]
    for n in range(1, depth + 1):
        step = hop(front, edges, back)
        for f in fronts:
            step = step.join(f.select("node"), "node", "left_anti")
        front = written(step.select("node", F.lit(n).alias("steps")), "front")
        if front.limit(1).count() == 0:
            break
        fronts.append(front)
    return reduce(DataFrame.unionByName, fronts).where("steps > 0")


def path_to(edges: DataFrame, start, goal, depth: int, weight: str | None = None) -> DataFrame:
    """at, node, cost, steps: the nodes along the cheapest way of at most `depth` edges, in order; no rows where there is none.

    Among ways of equal cost the one of fewest steps, then of the smallest
    nodes. Without a weight every edge costs 1; a negative one is refused, an
    absent one is no edge. Each round extends the nodes that got better in the
    one before and is written.
    """
    spark = edges.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.when(w < 0, F.raise_error(F.lit("a way has no negative weights")).cast("double")).otherwise(w).alias("_w")).where("_w is not null")
    kind = edges.schema["src"].dataType.simpleString()
    best = spark.createDataFrame([(start, (0.0, 0, [start]))], f"node {kind}, way struct<cost:double,steps:int,path:array<{kind}>>")
    front = best
    for _ in range(depth):
        way = F.struct((F.col("way.cost") + F.col("_w")).alias("cost"), (F.col("way.steps") + 1).alias("steps"), F.array_append("way.path", F.col("_to")).alias("path"))
        step = front.join(e, F.col("node") == F.col("_from")).select(F.col("_to").alias("node"), way.alias("way"))
        both = best.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        now = written(both.groupBy("node").agg(F.min("way").alias("way"), F.min(F.when(F.col("old"), F.col("way"))).alias("was")), "ways")
        best = now.select("node", "way")
        front = now.where(F.col("was").isNull() | (F.col("way") < F.col("was"))).select("node", "way")
        if front.limit(1).count() == 0:
            break
    found = best.where(F.col("node") == F.lit(goal))
    return found.select(F.posexplode("way.path").alias("at", "node"), "way.cost", "way.steps")
