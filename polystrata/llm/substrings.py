"""Substring dedup: runs of consecutive sentences that were seen before are removed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, written

#: Sentences of a run, and the characters that a run must have: short runs recur by chance.
RUN, LEAST_CHARS = 2, 80
#: A sentence of so many words is a run of its own where runs grow.
LONE_WORDS = 50
#: A sentence up to its marks and the space behind them, or the rest of a line; pieces concatenated are the text.
SENTENCE = r"[\s\S][^.!?\n]*+(?:[.!?]++(?!\s)[^.!?\n]*+)*+(?:[.!?]++\s*+|\n\s*+|\z)"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def keys_of(text: Column) -> Column:
    return F.transform(pieces(text), lambda s: F.lower(F.btrim(s, F.lit(" \t\n\r\f\v"))))


def grown_spans(lengths: list[np.ndarray], lone: list[np.ndarray], run: int, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, first sentence and sentences of each run of a batch of texts, from their sentences' lengths and which of them stand alone.

    From each sentence on, and back from each, the least run of `run` sentences
    or more that has `least_chars` characters, a mark between sentences counted.
    Both depend on the run's own characters only, so a repeat has them at all
    its places; and together they cover any stretch that is long enough.
    """
    n = np.array([len(x) for x in lengths], dtype=np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return (np.zeros(0, dtype=np.int64),) * 3
    doc = np.repeat(np.arange(len(n)), n)
    first, end, i = (ends - n)[doc], ends[doc], np.arange(total)
    sums = np.concatenate([[0], np.cumsum(np.concatenate(lengths).astype(np.int64) + 1)])
    to = np.maximum(np.searchsorted(sums, sums[:-1] + least_chars + 1), i + run)
    since = np.minimum(np.searchsorted(sums, sums[1:] - least_chars - 1, side="right") - 1, i + 1 - run)
    on, back, own = to <= end, since >= first, np.concatenate(lone).astype(bool)
    whole = (i == first) & (end - first < run) & (sums[end] - sums[first] > least_chars)
    at = np.concatenate([i[on], since[back], i[own], i[whole]])
    size = np.concatenate([to[on] - i[on], i[back] + 1 - since[back], np.ones(int(own.sum()), dtype=np.int64), (end - first)[whole]])
    at, size = np.unique(np.stack([at, size]), axis=1) if len(at) else (at, size)
    return doc[at], at - first[at], size


def grown_runs(docs: DataFrame, run: int, least_chars: int, lone_words: int) -> DataFrame:
    """As runs(), with n sentences in each run: grown_spans(), and every sentence of `lone_words` words. Sentences are hashed once, runs from their sentences' hashes."""

    @F.pandas_udf("struct<at:array<int>,n:array<int>>")
    def spans(lengths: pd.Series, lone: pd.Series) -> pd.DataFrame:
        doc, at, size = grown_spans(list(lengths), list(lone), run, least_chars)
        cuts = np.searchsorted(doc, np.arange(1, len(lengths)))
        parts = lambda x: np.split(x.astype(np.int32), cuts)[: len(lengths)]
        return pd.DataFrame({"at": parts(at), "n": parts(size)})

    ship(docs.sparkSession)
    d = docs.where(F.length("text") > 0).select("doc_id", F.hash("text").alias("th"), keys_of(F.col("text")).alias("keys"))
    long_ = lambda k: F.when(F.length(k) >= 2 * lone_words - 1, F.regexp_count(k, F.lit(r"\S+")) >= lone_words).otherwise(F.lit(False))
    d = d.select("doc_id", "th", *(F.transform("keys", f).alias(c) for c, f in (("len", F.length), ("lone", long_), ("a", lambda k: F.xxhash64(k)), ("b", lambda k: F.xxhash64(F.lit(1), k)))))
    d = d.withColumn("s", spans("len", "lone")).withColumn("s", F.arrays_zip(F.col("s.at").alias("at"), F.col("s.n").alias("n")))
    part = lambda c, s: F.slice(c, s["at"] + 1, s["n"])
    hashed = F.transform("s", lambda s: F.struct(F.xxhash64(part("a", s)).alias("h1"), F.xxhash64(F.lit(1), part("b", s)).alias("h2"), s["at"].alias("at"), s["n"].alias("n")))
    return d.select("doc_id", "th", F.inline(hashed))


def runs(docs: DataFrame, run: int, least_chars: int) -> DataFrame:
    """doc_id, th, h1, h2, at: a 128-bit hash of each run of `run` sentences (of all, where a text has fewer), ASCII blanks at ends and letter case aside."""
    d = docs.select("doc_id", F.hash("text").alias("th"), keys_of(F.col("text")).alias("keys"))
    last = F.greatest(F.size("keys") - run, F.lit(0))
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("keys", i + 1, run), "\n").alias("k")))
    d = d.where(F.size("keys") > 0).select("doc_id", "th", F.explode(spans).alias("x"))
    d = d.where(F.length("x.k") >= least_chars)
    return d.select("doc_id", "th", F.xxhash64("x.k").alias("h1"), F.xxhash64(F.lit(1), "x.k").alias("h2"), F.col("x.at").alias("at"), F.lit(run).alias("n"))


def drop_repeats(docs: DataFrame, run: int = RUN, least_chars: int = LEAST_CHARS, grown: bool = False, lone_words: int = LONE_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) -> all columns, text without its repeats, and n_sentences, n_removed.

    Every run of `run` consecutive sentences with at least `least_chars`
    characters is looked up in the whole corpus; its first place, by (doc_id,
    place in the text), stays, and the sentences that any other place covers
    go, also within one text. The rest of the text is unchanged.

    `grown`: the characters are asked of the repeat, not of each `run`
    sentences of it. Every repeated stretch of at least `run` sentences and
    `least_chars` characters goes whole, however short its sentences, and so
    does a repeated sentence of `lone_words` words between other ones.

    A first pass counts 64-bit hashes, pre-aggregated; only runs whose hash is
    there twice go on to find their first place by all 128 bits. No run's
    places are ever gathered: first places are joined back, and adaptive
    execution splits the hot ones.

    Null texts stay null, with 0 sentences; empty ones stay empty. Rows with
    equal ids and texts are one document to this operator and keep equal
    results; a null doc_id is the smallest. Columns named n_sentences or
    n_removed are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_sentences", "n_removed")
    all_runs = written(grown_runs(docs, run, least_chars, lone_words) if grown else runs(docs, run, least_chars), "runs")
    again = all_runs.groupBy("h1").agg(F.count("*").alias("places")).where("places > 1").select("h1")
    seen = written(all_runs.join(again, "h1", "left_semi"), "repeats")
    first = seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at", "th")).alias("first"), F.count("*").alias("places")).where("places > 1").select("h1", "h2", "first")
    later = seen.join(first, ["h1", "h2"]).where(~F.struct("doc_id", "at", "th").eqNullSafe(F.col("first")))
    gone = later.select("doc_id", "th", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("i")).groupBy("doc_id", "th").agg(F.collect_set("i").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "gone")
    both = docs.withColumn("_h", F.hash("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left").drop("_d", "_t", "_h")
    both = both.withColumn("_p", pieces(F.coalesce(F.col("text"), F.lit(""))))
    n = F.size("_p")
    left = F.when(n > 0, F.array_except(F.sequence(F.lit(0), n - 1), "gone"))
    text = F.when(F.col("gone").isNotNull(), F.array_join(F.transform(left, lambda i: F.get(F.col("_p"), i)), "")).otherwise(F.col("text"))
    removed = F.when(F.col("gone").isNotNull(), n - F.size(left)).otherwise(0)
    return both.withColumns({"text": text, "n_sentences": n.cast("long"), "n_removed": removed.cast("long")}).drop("_p", "gone")
