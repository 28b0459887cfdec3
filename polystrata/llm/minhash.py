"""Near-duplicate documents: universal hash minima, banding, signature check, full-set check, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .components import components
from .shingles import Minima, band_keys, fingerprint, shingle_set

#: Members of a bucket that one task compares with as many others at once.
BLOCK = 256


def plan_bands(percent: int, miss: float = 1e-6, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the longest rows for which `most` minima leave a pair at the threshold unseen with probability `miss` at most."""
    best = (math.ceil(math.log(miss) / math.log(1 - percent / 100)), 1)
    for rows in range(2, 11):
        bands = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def least_agreement(percent: int, count: int, sigmas: float = 5.0) -> int:
    """Minima (of `count`, one byte each) that must agree: `sigmas` below what a pair at the threshold is expected to share."""
    p = percent / 100 + (1 - percent / 100) / 256
    return max(0, math.floor(count * p - sigmas * math.sqrt(count * p * (1 - p))))


def _signer(k: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minima = Minima(bands * rows)
        for pdf in batches:
            n, fps, keys, sigs = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, k)
                n.append(len(s))
                fps.append(fingerprint(s))
                sig = minima.of(s) if len(s) else None
                keys.append(band_keys(sig, bands, rows) if len(s) else np.empty(0, np.int64))
                sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else b"")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "fp": fps, "keys": keys, "sig": sigs})

    return run


def _setter(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                sets = [shingle_set(t, k) for t in pdf["text"].iloc[at : at + 64]]
                yield pd.DataFrame({"fp": [fingerprint(s) for s in sets], "s": [s.view(np.int64) for s in sets]})

    return run


def _agreeing(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a = np.frombuffer(b"".join(pdf["sig_a"]), np.uint8).reshape(len(pdf), -1)
                b = np.frombuffer(b"".join(pdf["sig_b"]), np.uint8).reshape(len(pdf), -1)
                yield pdf.loc[(a == b).sum(axis=1) >= least, ["a", "b"]]

    return run


def _crossing(least: int, percent: int):
    """Of rows sorted by (h, qb, ab), compares a block's queries with its members of other labels; a block spans batches at most by what is carried over."""

    def block(g: pd.DataFrame) -> tuple[list[bytes], list[bytes]]:
        q = g["query"].to_numpy(bool)
        fp, label, n = g["fp"].to_numpy(), g["label"].to_numpy(), g["n"].to_numpy(np.int64)
        sig = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(g), -1)
        rest = np.flatnonzero(~q)
        left, right = [], []
        for i in np.flatnonzero(q):
            j = rest[(label[rest] != label[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
            for x in j[(sig[j] == sig[i]).sum(axis=1) >= least]:
                left.append(min(fp[i], fp[x]))
                right.append(max(fp[i], fp[x]))
        return left, right

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None and len(rest):
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            h, qb, ab = (pdf[c].to_numpy() for c in ("h", "qb", "ab"))
            cut = np.flatnonzero((h[1:] != h[:-1]) | (qb[1:] != qb[:-1]) | (ab[1:] != ab[:-1])) + 1
            bounds = [0, *cut.tolist()]
            out = [block(pdf.iloc[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
            rest = pdf.iloc[bounds[-1] :]
            yield pd.DataFrame({"a": [x for l, _ in out for x in l], "b": [x for _, r in out for x in r]})
        if rest is not None and len(rest):
            left, right = block(rest)
            yield pd.DataFrame({"a": left, "b": right})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: one row for each input row.

    Two documents are linked when 100 * |A n B| >= percent * |A u B| over their
    sets of `shingle`-word runs, ASCII case folded. Each pair at the threshold
    shares a band with probability 1 - miss.

    1. A pass over the texts makes each set's fingerprint, band keys and
       signature. Equal sets become one class at once, so copies, however many,
       cost one row from there on.
    2. Bucket members are compared with the bucket's smallest fingerprint only
       (linear), by signature, then by full sets; components of those links
       label the classes.
    3. What no such star links is compared, within buckets that still hold
       several labels, in blocks of BLOCK x BLOCK signatures; only pairs that
       agree enough leave a block. Full sets decide again.

    Null or blank texts have empty sets and are linked with nothing. A null
    doc_id is linked with nothing, has no component and is kept. Rows that
    share a doc_id are one document: each row shows its own set's size and
    all have the component of all their texts. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    bands, rows = plan_bands(percent, miss)
    least = least_agreement(percent, bands * rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInPandas(_signer(shingle, bands, rows), "doc_id long, n_shingles long, fp binary, keys array<long>, sig binary"), "signed")
    classes = written(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")),
        "classes",
    )
    keyed = classes.select("fp", F.explode("keys").alias("h"))
    buckets = keyed.groupBy("h").agg(F.min("fp").alias("hub"), F.count("*").alias("m")).where("m > 1")
    members = written(keyed.join(buckets, "h").select("h", "hub", "m", "fp"), "members")
    facts = classes.select("fp", "rep", "n", "sig")

    sets = docs.join(members.select("fp").distinct().join(facts.select("fp", "rep"), "fp").select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(sets.mapInPandas(_setter(shingle), "fp binary, s array<long>").groupBy("fp").agg(F.first("s").alias("s")), "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of fingerprints whose full sets reach the threshold, as pairs of representatives.

        Members' sets travel with their pairs; a hub's set, the side with many
        partners, comes last and is read once for all of them.
        """
        both = pairs.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a")
        common = F.size(F.array_intersect("sa", "sb"))
        linked = both.withColumn("i", common).where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")
        reps = facts.select("fp", "rep")
        return linked.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))

    side = lambda x: facts.select(F.col("fp").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    stars = members.where("hub <> fp").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    stars = stars.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    stars = stars.select("a", "b", "sig_a", "sig_b").mapInPandas(_agreeing(least), "a binary, b binary")
    links = written(checked(stars), "links")

    label = components(links)
    known = facts.join(label, F.col("rep") == F.col("node"), "left").select("fp", "n", "sig", F.coalesce("component", "rep").alias("label"))
    lab = members.join(known.select("fp", "label"), "fp")
    several = lab.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.when(F.col("fp") == F.col("hub"), F.col("label"))).alias("hub_label"), F.sum(F.lit(1)).alias("m2")).where("lo <> hi")
    several = several.join(lab.select("h", "label").join(several.select("h", "hub_label"), "h").where("label <> hub_label").groupBy("h").agg(F.count("*").alias("nq")), "h").select(
        "h", "hub_label", F.ceil(F.col("m2") / BLOCK).cast("int").alias("na"), F.ceil(F.col("nq") / BLOCK).cast("int").alias("nqb")
    )
    left = lab.select("h", "fp", "label").join(several, "h").join(known.select("fp", "n", "sig"), "fp")
    spot = lambda of: F.pmod(F.hash("fp"), F.col(of)).cast("int")
    every = left.select("h", "fp", "label", "n", "sig", spot("na").alias("ab"), F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)).alias("qb"), F.lit(False).alias("query"))
    asked = left.where("label <> hub_label").select("h", "fp", "label", "n", "sig", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ab"), spot("nqb").alias("qb"), F.lit(True).alias("query"))
    blocks = every.unionByName(asked).repartition("h", "qb", "ab").sortWithinPartitions("h", "qb", "ab")
    more = checked(blocks.mapInPandas(_crossing(least, percent), "a binary, b binary").distinct())
    placed = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "fp").join(classes.select("fp", "rep"), "fp").select("doc_id", "n_shingles", "rep")
    same_id = placed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a <> hi")
    same_id = placed.join(same_id, "doc_id").select("a", F.col("rep").alias("b"))
    label = written(components(links.unionByName(written(more, "links")).unionByName(same_id)), "labels")

    result = placed.join(label, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.unionByName(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
