import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, slot int, `odd.name` string, _n long, component_id long, score double"
TEXT = "The miller walked along the river to the stone bridge, and there he waited for the boat of the {} that came every morning."
ROWS = [
    (1, TEXT.format("abbot"), "en", "a", 5), (2, TEXT.format("abbot"), "en", "b", 5), (2, TEXT.format("abbot"), "en", "b", 5), (None, TEXT.format("abbot"), None, None, None),
    (3, None, "en", "a", 7), (4, "", "en", "a", 0), (5, "word " * 60_000, "en", "a", 300_000), (6, "Keep this: api_key = abcdefgh12345678 but not this.", "en", "b", 51), (6, "x.", "de", "c", 2),
]
MORE = ("x", 3, "y", 9, 8, 0.25)


def test_odd_rows_and_clashing_columns(spark, small):
    docs = spark.createDataFrame([(*r, *MORE) for r in ROWS], SCHEMA)
    got = {name: stage(spark, docs, small) for name, stage in pipeline.STAGES}
    for name in ("quality", "near_dedup", "secrets", "mixing"):
        rows = got[name].collect()
        assert got[name].columns == docs.columns and all(tuple(r)[5:] == MORE for r in rows), name
        assert len(rows) == len(ROWS) or name in ("quality", "near_dedup")
    assert sorted(str(r.doc_id) for r in got["near_dedup"].collect()) == ["1", "3", "4", "5", "6", "6", "None"]
    clean = {(r.doc_id, r.text, r.n_chars) for r in got["secrets"].collect()}
    assert (6, "Keep this: [SECRET] but not this.", 33) in clean and (3, None, 7) in clean and (4, "", 0) in clean
    tokens = got["bpe"].collect()
    assert len(tokens) == len(ROWS) and {r.n_tokens for r in tokens if r.doc_id in (3, 4)} == {0}
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).collect() == [], name


def test_run_end_to_end(spark, small):
    """run() gives what its stages give one after the other, whatever lies between."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, small)
    want = sorted(tuple(r) for r in docs.collect())
    got = pipeline.run(spark, small)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
    assert got.columns == ["doc_id", "source", "slot", "place", "n_tokens", "token_ids"]
