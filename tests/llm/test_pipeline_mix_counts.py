import corpus_pipeline as pipeline
from polystrata.llm import mixing
from polystrata.llm.common import written

SCHEMA = "doc_id long, source string, text string, lang string, n_chars long"


def numbered(spark, docs, small):
    """doc_id, source, n_tokens -> (slot, place), once the documents lay in files of unknown order, read without a schema as any reader would."""
    files = written(docs.repartition(5), "mix-counts")
    return [(r.doc_id, r.source, r.n_tokens, r.slot, r.place) for r in pipeline.tokens(spark, spark.read.parquet(files.folder), small).collect()]


def test_without_the_mixing_stage_there_is_no_mix(spark, small):
    docs = spark.createDataFrame([(i, "ab"[i % 3 > 0], "Some text.", "en", 10) for i in range(600)], SCHEMA)
    left = numbered(spark, docs, small)
    assert len(left) == 600 and all(r[3] is None and r[4] is None for r in left)
    mixed = numbered(spark, pipeline.in_mixed_order(spark, docs, small), small)
    assert sorted(r[:3] for r in mixed) == sorted(r[:3] for r in left) and len({r[3:] for r in mixed}) == 600


def test_tokens_follow_the_mixing_stage(spark, small, monkeypatch):
    """Other settings of the stage, other places; rows that share an id, or have none, are numbered as the stage's files hold them."""
    rows = [(i, "abc"[i % 7 % 3], "word " * (i % 4), "en", 10) for i in range(900)]
    rows += [(i, None, "word " * n, "en", 10) for i in (5, 5, None) for n in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    seen = []
    for settings in (pipeline.MIX, pipeline.MIX | {"block_rows": 16, "weights": {"a": 3.0, "c": 0.5, None: 0.0}}):
        monkeypatch.setattr(pipeline, "MIX", settings)
        mixed = pipeline.in_mixed_order(spark, docs, small)
        laid = [(r.doc_id, r.source, r.text.count("word")) for r in mixed.collect()]
        monkeypatch.undo()
        got = sorted(numbered(spark, mixed, small), key=lambda r: r[3:])
        want = {(r.doc_id, r.source, r.text, r.slot, r.place) for r in mixing.mix(docs, **settings).collect()}
        assert [r[:2] for r in got] == [x[:2] for x in laid] and len(got) == len(rows) == len(want)
        assert {(r[0], r[1], r[3], r[4]) for r in got} == {(i, s, slot, place) for i, s, _, slot, place in want}
        tokens = {}
        assert all(tokens.setdefault(x[2], r[2]) == r[2] for x, r in zip(laid, got))  # equal texts, equal tokens, place by place
        assert len(set(tokens.values())) == len(tokens)
        seen.append([r[3:] for r in sorted(got, key=str)])
    assert seen[0] != seen[1]
