"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, trained by numpy stochastic gradient descent."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

WORD_BITS, CHAR_BITS = 17, 16
#: Character n-grams; within words and their marks, case kept.
GRAMS = (3, 5)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: Bytes of a text that are hashed at a time; pieces overlap, so that cuts change nothing.
PIECE = 1 << 20


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(12))) >> np.uint32(32 - bits)


def _char_buckets(raw: np.ndarray, n: int) -> np.ndarray:
    x = raw.astype(np.uint32) + np.uint32(1)
    inside = ~_SPACE[raw]
    acc = x[: len(x) - n + 1].copy()
    keep = inside[: len(x) - n + 1].copy()
    for j in range(1, n):
        acc = acc * _M1 + x[j : len(x) - n + 1 + j]
        keep &= inside[j : len(x) - n + 1 + j]
    return _bucket(acc[keep] * np.uint32(2 * n + 1), CHAR_BITS).astype(np.int64) + (1 << WORD_BITS)


def _words(raw: np.ndarray) -> np.ndarray:
    """A 32-bit hash per word."""
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.empty(0, np.uint32)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    kept, starts = raw[inside].astype(np.uint32) + np.uint32(1), np.flatnonzero(first[inside])
    place = (np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept))))).astype(np.uint32)
    v = (kept * _M2) ^ (place * _M1)
    v = (v ^ (v >> np.uint32(13))) * _M2
    return np.add.reduceat(v, starts, dtype=np.uint32)


def features(text: object) -> Iterator[np.ndarray]:
    """Bucket numbers of words, word pairs and character n-grams of the whole text, in arrays of bounded size."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if isinstance(text, str) else np.empty(0, np.uint8)
    w = _words(raw)
    yield _bucket(w, WORD_BITS).astype(np.int64)
    if len(w) > 1:
        yield _bucket(w[:-1] * _M1 + w[1:] * _M2, WORD_BITS).astype(np.int64)
    for n in GRAMS:
        for at in range(0, len(raw) - n + 1, PIECE):
            yield _char_buckets(raw[at : at + PIECE + n - 1], n)


@dataclass
class Model:
    """What a bucket adds to the logit of label 1 against 0; a document's logit is the mean over its features plus the bias."""

    weight: np.ndarray
    bias: float
    empty: float

    def score(self, text: object) -> float:
        total, n = 0.0, 0
        for f in features(text):
            total += float(self.weight[f].sum(dtype=np.float64))
            n += len(f)
        z = self.bias + total / n if n else self.empty
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list, labels: list[int], width: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> Model:
    """Softmax regression on averaged n-gram vectors. Classes count alike; a step per document, the rate falls to zero."""
    r = np.random.default_rng(seed)
    size = (1 << WORD_BITS) + (1 << CHAR_BITS)
    table = r.uniform(-1 / width, 1 / width, (size, width)).astype(np.float32)
    out, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    # flat arrays, which go back to the system as a whole
    flat, shares, ends = array("i"), array("f"), [0]
    for t in texts:
        f, c = np.unique(np.concatenate(list(features(t))), return_counts=True)
        flat.frombytes(f.astype(np.int32).tobytes())
        shares.frombytes((c / max(1, c.sum())).astype(np.float32).tobytes())
        ends.append(len(flat))
    all_f, all_c = np.frombuffer(flat, np.int32), np.frombuffer(shares, np.float32)
    y = np.array(labels, int)
    share = np.bincount(y, minlength=2) / max(1, len(y))
    if len(y) == 0 or share.min() == 0:
        z = 0.0 if len(y) == 0 else (4.0 if share[1] else -4.0)
        return Model(np.zeros(size, np.float32), z, z)
    weigh = 0.5 / share
    step, steps = 0, epochs * len(y)
    for _ in range(epochs):
        for i in r.permutation(len(y)):
            f, c = all_f[ends[i] : ends[i + 1]], all_c[ends[i] : ends[i + 1]]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(f):
                continue
            mean = c @ table[f]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= np.float32(weigh[y[i]] * lr)
            back = out @ p
            out -= np.outer(mean, p)
            bias -= np.float32(0.1) * p
            # a feature's gradient is its share of the mean; scaled by the number of distinct features, so that long texts teach as much as short ones
            table[f] -= (c * np.float32(min(len(f), 200)))[:, None] * back[None, :]
    weight = (table @ (out[:, 1] - out[:, 0])).astype(np.float32)
    return Model(weight, float(bias[1] - bias[0]), float(np.log(share[1] / share[0])))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0: such rows teach nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, sample_bytes: int = 64 << 20) -> Model:
    """Train on at most `per_label` documents of each label, by hash of their ids, outside the held-out fold.

    The sample is bounded in rows, and per label in bytes, `sample_bytes` / 2:
    in order of the hash, a text that doesn't fit any more is left out and
    smaller ones go on; so it fits in the driver at any size of the corpus. A
    doc_id with several rows counts once, by its shortest text. Rows with null
    ids, texts or labels teach nothing. Without rows, or with one label only,
    the score is a constant.
    """
    y = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where(~held_out())
    y = y.withColumn("h", F.xxhash64("doc_id"))
    ids = y.where("quality = 0").orderBy("h", "doc_id").limit(per_label).unionByName(y.where("quality = 1").orderBy("h", "doc_id").limit(per_label))
    # 2 * per_label rows at most, whatever the corpus
    known = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    shape = F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("code"))
    sizes = known.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("h").alias("h"), F.min(shape).alias("s")).select("quality", "h", "doc_id", "s.*").collect()
    chosen, room = [], {0: sample_bytes // 2, 1: sample_bytes // 2}
    for r in sorted(sizes):
        if r["size"] <= room[r["quality"]]:
            room[r["quality"]] -= r["size"]
            chosen.append((r["doc_id"], r["size"], r["code"]))
    if not chosen:
        return train([], [])
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(chosen, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, size int, code long"))
    rows = known.withColumns({"size": F.octet_length("text"), "code": F.xxhash64("text")}).join(picked, ["doc_id", "size", "code"])
    rows = rows.dropDuplicates(["doc_id"]).select("h", "doc_id", "text", "quality").toPandas().sort_values(["h", "doc_id"])
    return train(rows["text"].tolist(), rows["quality"].astype(int).tolist())


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns with `score` and `predicted` added (a score or predicted of the input is replaced).

    Whole texts are read in one narrow pass; only the text is an input. Null,
    empty and blank texts get the labels' odds in the sample. One row out per
    row in.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    weights = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = weights.value
        return pd.Series([m.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", score(F.col("text").cast("string"))).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
