"""Mixing sources to target weights with DataFrame functions only: Pfair blocks, earliest deadline first."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a source that one task ranks, as a mean; hash ranges keep them near it.
BUCKET_ROWS = 20_000
#: Blocks of the mix: one task plans them, and their table, some 30 bytes a block, is broadcast.
MOST_BLOCKS = 1 << 18
#: Key in a column's metadata, beside which a mixed table keeps the arguments of its mix.
SETTINGS = "polystrata.mix"


def ranked(docs: DataFrame, source: str, order: list[Column], bucket_rows: int = BUCKET_ROWS, total: int | None = None, ties: list[Column] = ()) -> DataFrame:
    """Adds `_rank`, from 0 in each source, in an order by hash: counts of (source, hash bucket) are summed up, ranks are taken within buckets only.

    Rows that are equal in `order` go by `ties`. No task gets a whole source, however hot.
    """
    total = docs.count() if total is None else total
    buckets = max(1, -(-total // bucket_rows))
    d = docs.withColumn("_h", F.xxhash64(*order)).withColumn("_bucket", F.pmod(F.col("_h"), F.lit(buckets)))
    sizes = d.groupBy(source, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(source).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col(source).alias("_s"), F.col("_bucket").alias("_b"), "_before")
    both = d.join(before, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
    within = Window.partitionBy(source, "_bucket").orderBy("_h", *order, *ties)
    return both.withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1).drop("_h", "_bucket", "_s", "_b", "_before")


def schedule(sources: DataFrame) -> DataFrame:
    """sources (source, blocks long, weight double) -> one row per block: source, block, slot.

    In the fluid mix every source gets its weight's share among the sources
    that still have blocks: at virtual time v it has had min(weight v, blocks),
    all together T(v) slots. Block k of a source is released at slot
    floor(T(k / weight)) and due by ceil(T((k + 1) / weight)). Slots take the
    released block of the earliest deadline, ties by source. As the fluid mix
    itself keeps all these windows, this meets every deadline: no source is
    ever a whole block off the given weights, however far the mix goes.

    Sources of weight 0 come after all others have ended, with equal shares.

    One task plans it, slot by slot in chunks, from two numbers a block; mix()
    bounds the number of blocks.
    """
    tier = F.when(F.col("weight") > 0, 0).otherwise(1)
    s = sources.select("source", "blocks", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("weight"), tier.alias("tier"))
    all_ = s.groupBy("tier").agg(F.sort_array(F.collect_list(F.struct("source", "blocks", "weight"))).alias("all"), F.sum("blocks").alias("total")).where("total > 0")
    # two rows at most: those of weight 0 start where the others end
    all_ = all_.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    fluid = "aggregate(all, 0D, (a, y) -> a + least(y.weight * {v}, cast(y.blocks as double)))"
    windows = f"""flatten(transform(all, x -> transform(sequence(0L, x.blocks - 1), k -> named_struct(
        'rel', cast(floor({fluid.format(v='(k / x.weight)')} + 1e-6) as int),
        'due', cast(ceil({fluid.format(v='((k + 1) / x.weight)')} - 1e-6) as int)))))"""
    d = all_.withColumn("win", F.expr(windows)).withColumns({"rel": F.expr("win.rel"), "due": F.expr("win.due")}).drop("win")
    d = d.withColumn("off", F.expr("transform(all, (x, i) -> cast(aggregate(slice(all, 1, i), 0L, (a, y) -> a + y.blocks) as int))"))
    d = d.withColumn("until", F.expr("transform(all, (x, i) -> off[i] + cast(x.blocks as int))")).withColumn("chunk", F.expr("cast(ceil(sqrt(total)) as int)"))
    # the next block of each source is at[i]; one that is not released waits for those that are
    due = """array_min(transform(acc.at, (n, i) -> if(n < until[i], named_struct('waits', rel[n] > t, 'due', due[n], 'i', i), null))).i"""
    step = f"""(acc, t) -> element_at(transform(array({due}), p -> named_struct(
        'at', transform(acc.at, (n, i) -> if(i = p, n + 1, n)),
        'pick', concat(acc.pick, array(named_struct('i', p, 'block', acc.at[p] - off[p]))))), 1)"""
    empty = "cast(array() as array<struct<i:int,block:int>>)"
    chunk = f"aggregate(sequence(c * chunk, least(cast(total as int), (c + 1) * chunk) - 1), named_struct('at', outer_acc.at, 'pick', {empty}), {step})"
    fold = f"""aggregate(
        sequence(0, cast(ceil(total / chunk) as int) - 1),
        named_struct('at', off, 'picks', cast(array() as array<array<struct<i:int,block:int>>>)),
        (outer_acc, c) -> element_at(transform(array({chunk}), r -> named_struct('at', r.at, 'picks', concat(outer_acc.picks, array(r.pick)))), 1),
        outer_acc -> flatten(outer_acc.picks))"""
    slots = d.select("all", "base", F.posexplode(F.expr(fold)).alias("slot", "p"))
    return slots.select(F.col("all")[F.col("p.i")]["source"].alias("source"), F.col("p.block").cast("long").alias("block"), (F.col("base") + F.col("slot")).alias("slot"))


def target_weights(docs: DataFrame, source: str, weights: dict[str, float] | None, temperature: float, block_rows: int) -> DataFrame:
    """source, blocks and weight: as given, or their share to the power `temperature`."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n"), F.lit(temperature))
    else:
        weight = F.lit(min(weights.values(), default=1.0))
        for k, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(weight)
    return counts.select("source", F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"), weight.cast("double").alias("weight"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_rows: int = 64, source: str = "source", keep: list[str] | None = None, most_blocks: int = MOST_BLOCKS, ties: list[str] | None = None) -> DataFrame:
    """docs (doc_id, source, ...) -> all its columns (or `keep`) and block, slot, place: one row for each input row.

    A source's rows, in an order by hash of their first column other than the
    source (the id), are cut into blocks of `block_rows` or, so that the table
    of blocks has `most_blocks` rows and one for each source at most, of a
    `most_blocks`th of all rows. Blocks of all sources get `slot`, a number that
    grows along the mix, and `place` is the row's place in its block. Read by
    (slot, place), any prefix has every source within one block of its target
    weight among the sources that still have rows. Nothing is dropped or
    repeated: when a source ends the others go on by their weights.

    A source that `weights` doesn't name has the smallest weight given; one of
    weight 0 comes after all others; a negative, infinite or undefined weight
    is an error. A null source is a source of its own. Null ids and repeated
    rows keep their rows; among equal ids the
    columns `ties` decide, or any order is as good. Columns named
    block, slot or place are replaced. An empty table gives no rows.
    """
    if weights is not None and not all(0 <= w < float("inf") for w in weights.values()):
        raise ValueError("weights are finite numbers from 0 on")
    d = docs.drop("block", "slot", "place")
    names = [c for c in (keep or d.columns)]
    total = d.count()
    size = max(block_rows, -(-total // most_blocks))
    r = ranked(d.select(*names), source, [F.col(c) for c in names if c != source][:1] or [F.col(source)], total=total, ties=[F.col(c) for c in ties or []])
    r = r.withColumn("block", F.floor(F.col("_rank") / size).cast("long")).withColumn("place", (F.col("_rank") % size).cast("int"))
    p = schedule(target_weights(d, source, weights, temperature, size))
    p = F.broadcast(p.select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "slot"))  # most_blocks rows and one a source at most
    return r.join(p, F.col(source).eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")), "left").select(*names, "block", "slot", "place")


def laid_out(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the mix, range-partitioned: written files, read in order, are the mix."""
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")


def noted(docs: DataFrame, settings: dict, column: str = "doc_id") -> DataFrame:
    """The same rows and columns, with the arguments of their mix in the column's metadata: selections, shuffles and Parquet keep it."""
    note = settings | ({"weights": [*settings["weights"].items()]} if settings.get("weights") else {})  # a null source is no key of JSON
    mark = F.col(column).alias(column, metadata={**docs.schema[column].metadata, SETTINGS: json.dumps(note)})
    return docs.select(*(mark if c == column else F.col(f"`{c}`") for c in docs.columns))


def settings_of(docs: DataFrame, column: str = "doc_id") -> dict | None:
    """What noted() kept; None for a table that was never mixed."""
    note = docs.schema[column].metadata.get(SETTINGS)
    settings = json.loads(note) if note else None
    return settings | {"weights": dict(settings["weights"])} if settings and settings.get("weights") else settings
