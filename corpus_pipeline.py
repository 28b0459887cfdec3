"""From documents to tokens: quality, near duplicates, secrets, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.

In every stage: null and empty texts are documents (the quality of a text
without words is the labels' odds, it has no near duplicates, no secrets and no
tokens); quality and secrets are of each row's own text; to near_dedup rows that
share a doc_id are one document, kept or dropped together; rows with a null
doc_id have no near duplicates; of a group the smallest doc_id stays; extra columns pass through, whatever their names; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polystrata.llm import bpe, mixing, quality, secrets
from polystrata.llm.common import table, written_alone
from polystrata.llm.minhash import near_duplicates
from polystrata.llm.queries import vocabulary


#: The columns of documents that stages read or write; others are set aside under one name and come back as they were.
OWN = ("doc_id", "text", "lang", "source", "n_chars")
#: The mix: weights are the sources' shares to this power; rows that share an id go by their text, so that both readings of the mix agree.
MIX = {"temperature": 0.5, "block_rows": 64, "ties": ["text"]}


def kept_columns(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the columns of docs; columns that are none of OWN can't clash with the operators' own."""
    others = [c for c in docs.columns if c not in OWN]
    own = [c for c in docs.columns if c in OWN]
    if not others:
        return stage(docs).select(*own)
    aside = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("set_aside")
    back = {c: F.col(f"set_aside.c{i}").alias(c) for i, c in enumerate(others)}
    return stage(docs.select(*own, aside)).select(*(back.get(c, F.col(c)) for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return kept_columns(docs, lambda d: quality.score_documents(d, model, 0.3).where("predicted = 1"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id; five words, similarity 0.8."""
    groups = near_duplicates(docs, shingle=5, percent=80)
    gone = groups.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars is the length of what is left."""
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return kept_columns(docs, lambda d: secrets.redact(secrets.scan(d)).withColumn("n_chars", length))


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' files hold them in the order of the mix, and the metadata of doc_id has its settings: from them tokens() numbers the rows."""
    return mixing.noted(kept_columns(docs, lambda d: mixing.laid_out(mixing.mix(d, **MIX))), MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, slot, place, n_tokens, token_ids; read by (slot, place), the rows are the mix of the mixing stage.

    Files are not read in their order, so the places are worked out again, from ids, sources, texts and the settings
    which that stage noted. Documents that it never had in hand are in no mix: their slot and place are null.
    """
    settings = mixing.settings_of(docs)
    if settings is None:
        coded = bpe.encode_documents(docs, *vocabulary(), carry=("source",))
        return coded.withColumns({"slot": F.lit(None).cast("long"), "place": F.lit(None).cast("int")}).select("doc_id", "source", "slot", "place", "n_tokens", "token_ids")
    return bpe.encode_documents(mixing.mix(docs, keep=["doc_id", "source", "text"], **settings), *vocabulary(), carry=("source", "slot", "place"))


STAGES = [("quality", good_quality), ("near_dedup", one_of_each), ("secrets", without_secrets), ("mixing", in_mixed_order), ("bpe", tokens)]

#: The classifier and the minima have no SQL; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    """Every stage's input and intermediate tables are deleted once its output is written."""
    for name, stage in STAGES:
        docs = written_alone(lambda: stage(spark, docs, sf_dir), f"stage-{name}", docs)  # noqa: B023 - called at once
    return docs
