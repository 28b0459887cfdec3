from collections import Counter

import corpus_pipeline as pipeline
from polystrata.llm.common import written


def test_result_has_the_order_of_the_mix(spark, small):
    sizes = {"a": 6400, "b": 1600, "c": 400}
    rows = [(i * 7919 + j, s, "Some text.", "en", 10) for j, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars long")
    files = written(pipeline.in_mixed_order(spark, docs, small).repartition(7), "mixed-files")
    out = pipeline.tokens(spark, files, small).drop("token_ids").collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[1]) for r in rows)
    weight = {s: n**0.5 for s, n in sizes.items()}
    blocks, seen = sorted({(r.slot, r.source) for r in out}), Counter()
    assert [s for s, _ in blocks] == list(range(len(blocks)))
    for t, (_, s) in enumerate(blocks[:15], 1):  # c ends after 7 of its blocks, in slot 49
        seen[s] += 1
        assert all(abs(seen[x] - t * w / sum(weight.values())) < 1 for x, w in weight.items())
