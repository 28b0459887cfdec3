"""Registered queries that SQL can't say, against plain Python."""

import json

from polystrata.operators import geometry as G
from polystrata.operators import search as S
from polystrata.plans import catalog

D = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalog.queries()[name](spark, D).collect()


def spots(spark):
    return [(k[0], k[0] * 7919 % 3600 / 10 - 180, k[0] * 104729 % 1800 / 10 - 90) for k in spark.read.parquet(f"{D}/customer.parquet").select("c_custkey").collect()]


def test_places(spark):
    far = {}
    for k, lon, lat in spots(spark):
        try:
            far[k] = float(G.geodesic(lon, lat, 2.35, 48.85))
        except ValueError:
            pass
    assert {r.c_custkey: r.metres for r in rows(spark, "geo_radius")} == {k: round(m, 1) for k, m in far.items() if m <= 1e6}
    assert [r.c_custkey for r in rows(spark, "geo_nearest")] == [k for _, k in sorted((m, k) for k, m in far.items())[:10]]


def test_words(spark):
    an = S.Analyzer(("lowercase",))
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    near = {t for d in docs for _, t in an.words(d.text) if t.startswith("in") and S.edits("inthta", t) <= 2}
    assert {r.doc_id for r in rows(spark, "matches_fuzzy")} == {d.doc_id for d in docs if near & {t for _, t in an.words(d.text)}} and near
    stemmed = S.Analyzer(("lowercase", "ascii", "stemmer"))
    asked = {stemmed.fold("the"), stemmed.fold("that")}
    bench = {b.item_id: b.text for b in spark.read.parquet(f"{D}/benchmark.parquet").collect()}
    assert {r.item_id: r.marks for r in rows(spark, "search_marks")} == {i: sum(t in asked for _, t in stemmed.words(x)) for i, x in bench.items()}


def test_sketches(spark):
    e = spark.read.parquet(f"{D}/events.parquet").collect()
    for r in rows(spark, "approx_distinct"):
        for got, c in ((r.users, "user_id"), (r.kinds, "value")):
            want = len({x[c] for x in e if x.event_type == r.event_type})
            assert abs(got - want) <= 0.05 * want + 1


def test_first_of_repeats(spark):
    """A stream keeps no repeat within the span of a first row, and loses no key."""
    e = spark.read.parquet(f"{D}/events.parquet").collect()
    got = rows(spark, "first_within")
    assert {(r.user_id, r.event_type) for r in got} == {(x.user_id, x.event_type) for x in e} and len({r.event_id for r in got}) == len(got) <= len(e)


def test_geojson_is_read_and_written(spark):
    text = json.dumps({"type": "GeometryCollection", "geometries": [{"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]]]}, {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}]})
    s = G.parse(text)
    assert len(s.points) == 2 and len(s.paths) == 1 and len(s.areas) == 1
