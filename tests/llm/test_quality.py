import random

from pyspark.sql import functions as F

from polystrata.llm import quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score_documents(docs, model).join(labels, "doc_id").where(quality.held_out()).select("predicted", "quality", "doc_id").collect()
    assert all(quality.is_held_out(r.doc_id) for r in got)
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (None, "", 1.0), (2, "a b", 2.0), (2, "x" * 3_000_000, 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = quality.fit(docs, none)
    assert [r.score for r in quality.score_documents(docs, m).collect()] == [0.5] * 4
    assert quality.score_documents(docs.limit(0), m).collect() == []
    some = quality.train(["good words here", "bad words there"] * 20, [1, 0] * 20)
    assert some.score("good words here") > 0.5 > some.score("bad words there") and some.score("") == 0.5
    folds = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", quality.held_out()).collect()
    assert all(r.h == quality.is_held_out(r.doc_id) for r in folds)


def test_pieces_change_nothing(monkeypatch):
    text = "some läng text; with words " * 500
    model = quality.train(["good words here " + text[:99], "bad words there"] * 9, [1, 0] * 9)
    whole = model.score(text)
    monkeypatch.setattr(quality, "PIECE", 1000)
    assert abs(model.score(text) - whole) < 1e-12


def test_repeated_rows_and_long_texts_leave_both_labels(spark):
    r = random.Random(2)
    text = lambda words: " ".join(r.choice(words) for _ in range(30))
    good, bad = "river stone bridge water mill".split(), "click buy free win now".split()
    rows = [(i, text(good if i % 2 else bad)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    many = spark.createDataFrame([x for x in rows for _ in range(1 if x[0] % 2 else 40)] + [(3, "z" * 9000), (4, "z" * 9000)], "doc_id long, text string")
    m = quality.fit(many, labels, per_label=100, sample_bytes=40_000)
    assert m.score(text(good)) > 0.8 and m.score(text(bad)) < 0.2
    first = next(i for i in range(400) if i % 2 and not quality.is_held_out(i))
    m = quality.fit(spark.createDataFrame([(i, t if i != first else "z" * 90_000) for i, t in rows], "doc_id long, text string"), labels, sample_bytes=80_000)
    assert m.score(text(good)) > 0.8 and m.score(text(bad)) < 0.2
