import base64
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline as pipeline
from polystrata.llm import quality

from .brute import near_dup
from .test_secrets import base


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    kept = pipeline.good_quality(spark, docs, small)
    assert kept.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text) >= 0.3}

    groups = near_dup([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    one = pipeline.one_of_each(spark, docs, small)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    clean = pipeline.without_secrets(spark, docs, small)
    before = {r.doc_id: r.text for r in docs.collect()}
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for r in clean.collect():
        assert base(r.text) == [] and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or "[SECRET]" in r.text

    mixed = pipeline.in_mixed_order(spark, docs, small)
    assert mixed.columns == docs.columns and Counter(map(tuple, mixed.collect())) == Counter(map(tuple, docs.collect()))

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in pipeline.tokens(spark, docs, small).collect():
        assert r.token_ids == oracle.encode_ordinary(before[r.doc_id]) and r.n_tokens == len(r.token_ids)
