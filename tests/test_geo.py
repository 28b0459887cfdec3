import json
import math
import random

import pytest
from pyspark.sql import functions as F

from polystrata.functions import call
from polystrata.operators import geo
from polystrata.operators import geometry as G

P = lambda *c: G.parse(json.dumps({"type": "Point", "coordinates": c}))
LINE = lambda *c: G.parse(json.dumps({"type": "LineString", "coordinates": c}))
POLY = lambda *r: G.parse(json.dumps({"type": "Polygon", "coordinates": r}))
BOX = lambda x, y, u, v: [[x, y], [u, y], [u, v], [x, v], [x, y]]


def test_relations_of_known_shapes():
    square, inner, hole = POLY(BOX(0, 0, 4, 4)), POLY(BOX(1, 1, 2, 2)), POLY(BOX(0, 0, 4, 4), BOX(1, 1, 3, 3))
    on_edge, in_it, out = P(0, 2), P(2, 2), P(5, 5)
    assert G.covers(square, on_edge) and not G.contains(square, on_edge) and G.contains(square, in_it) and G.touches(square, on_edge)
    assert not G.touches(square, in_it) and G.disjoint(square, out) and G.within(in_it, square) and G.covered_by(on_edge, square)
    assert G.contains(square, inner) and not G.covers(inner, square) and not G.covers(hole, inner) and not G.intersects(hole, P(2, 2)) and G.covers(hole, P(1, 2))
    assert not G.intersects(hole, POLY(BOX(1.5, 1.5, 2.5, 2.5))) and G.touches(hole, POLY(BOX(1, 1, 3, 3))) and not G.covers(hole, POLY(BOX(1, 1, 3, 3)))
    assert G.touches(square, POLY(BOX(4, 0, 8, 4))) and not G.touches(square, POLY(BOX(3, 0, 8, 4))) and G.touches(square, POLY(BOX(4, 4, 8, 8)))
    assert G.equals(square, POLY([[4, 4], [0, 4], [0, 2], [0, 0], [4, 0], [4, 4]])) and not G.equals(square, hole) and G.contains(square, square) and not G.touches(square, square)
    notch = POLY([[0, 0], [6, 0], [6, 4], [4, 4], [4, 1], [2, 1], [2, 4], [0, 4], [0, 0]])
    assert not G.covers(notch, LINE([1, 3], [5, 3])) and G.covers(notch, LINE([1, 0.5], [5, 0.5])) and G.covers(notch, LINE([0, 0], [6, 0])) and not G.contains(notch, LINE([0, 0], [6, 0]))
    assert G.touches(LINE([0, 0], [2, 2]), LINE([2, 2], [3, 0])) and not G.touches(LINE([0, 0], [2, 2]), LINE([0, 2], [2, 0])) and G.intersects(LINE([0, 0], [2, 2]), LINE([0, 2], [2, 0]))
    assert G.equals(LINE([0, 0], [1, 1], [2, 2]), LINE([2, 2], [0, 0])) and G.touches(LINE([0, 0], [2, 2]), P(0, 0)) and not G.touches(LINE([0, 0], [2, 2]), P(1, 1))


def test_relations_of_boxes_against_intervals():
    """Of random boxes on few coordinates the relations follow from intervals."""
    r = random.Random(5)
    for _ in range(400):
        a, b = ([*sorted(r.sample(range(6), 2)), *sorted(r.sample(range(6), 2))] for _ in range(2))
        s, t = (POLY(BOX(x[0], x[2], x[1], x[3])) for x in (a, b))
        meet = a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3]
        inner = a[0] < b[1] and b[0] < a[1] and a[2] < b[3] and b[2] < a[3]
        cover = a[0] <= b[0] and b[1] <= a[1] and a[2] <= b[2] and b[3] <= a[3]
        assert (G.intersects(s, t), G.touches(s, t), G.covers(s, t), G.contains(s, t), G.equals(s, t)) == (meet, meet and not inner, cover, cover, a == b)
        assert G.within(t, s) == cover and G.disjoint(s, t) != meet


def test_measures():
    assert abs(float(G.geodesic(144.42486788888888, -37.95103341666667, 143.92649552777777, -37.65282113888889)) - 54972.271) < 0.01
    assert abs(float(G.geodesic(0, 0, 0, 90)) - 10001965.729) < 0.01 and float(G.geodesic(5, 5, 5, 5)) == 0
    assert abs(float(G.geodesic(0, 0, 1, 0)) - math.pi / 180 * G.A) < 1e-6
    with pytest.raises(ValueError):
        G.geodesic(0, 0, 179.9, 0.1)
    world = G.area(POLY(BOX(-180, -90, 0, 90))) + G.area(POLY(BOX(0, -90, 180, 90)))
    assert abs(world - 4 * math.pi * G.authalic_radius() ** 2) < 1e3 and abs(G.authalic_radius() - 6371007.181) < 0.01
    assert G.area(P(1, 1)) == 0 and abs(G.area(POLY(BOX(0, 0, 4, 4), BOX(1, 1, 3, 3))) - (G.area(POLY(BOX(0, 0, 4, 4))) - G.area(POLY(BOX(1, 1, 3, 3))))) < 1e-3
    assert abs(G.distance(P(0, 1), LINE([-10, 0], [10, 0])) - float(G.geodesic(0, 1, 0, 0))) < 1e-3 and G.distance(POLY(BOX(0, 0, 4, 4)), P(1, 1)) == 0
    for bad in ({"type": "Point", "coordinates": [181, 0]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]}, {"type": "Blob"}):
        with pytest.raises(ValueError):
            G.parse(json.dumps(bad))


def test_cells(spark):
    r = random.Random(3)
    spots = [(r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(200)] + [(180.0, 90.0), (-180.0, -90.0), (0.0, 0.0)]
    d = spark.createDataFrame(spots, "lon double, lat double")
    for level in (0, 1, 5, 11, 12, 20, 32):
        got = d.select("lon", "lat", geo.cell_place(F.col("lon"), F.col("lat"), level).alias("c"), geo.hilbert(geo.cell_place(F.col("lon"), F.col("lat"), level)["x"], geo.cell_place(F.col("lon"), F.col("lat"), level)["y"], level).alias("h")).collect()
        for x in got:
            at = G.place(G.snap((x.lon, x.lat)), level)
            assert tuple(x.c) == at and (x.h is not None)
            if level <= 20:
                assert x.h == G.hilbert(*at, level)
    order = sorted((G.hilbert(x, y, 4), x, y) for x in range(16) for y in range(16))
    assert [h for h, _, _ in order] == list(range(256)) and all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(order, order[1:]))
    for _ in range(50):
        box = (*G.snap((r.uniform(-180, 0), r.uniform(-90, 0))), *G.snap((r.uniform(0, 180), r.uniform(0, 90))))
        cells = set(G.covering(box))
        assert 1 <= len(cells) <= 16
        level = next(iter(cells))[0]
        for _ in range(20):
            p = (r.randint(box[0], box[2]), r.randint(box[1], box[3]))
            assert (level, *G.place(p, level)) in cells
    key = d.select(call("geo::cell", geo.point(F.col("lon"), F.col("lat")), F.lit(3)).alias("k"), "lon", "lat").collect()
    assert all(G.covers(G.parse(x.k), P(x.lon, x.lat)) for x in key)
    with pytest.raises(Exception, match="level"):
        d.select(call("geo::cell", geo.point(F.col("lon"), F.col("lat")), F.lit(40))).collect()


def test_reads_by_place_against_all(spark):
    r = random.Random(8)
    spots = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(300)] + [(300, 179.9, 10.0), (301, -179.9, 10.0), (302, None, 1.0)]
    d = spark.createDataFrame(spots, "id int, lon double, lat double")
    far = lambda c: {i: float(G.geodesic(c[0], c[1], x, y)) for i, x, y in spots if x is not None and not (abs(abs(x - c[0]) - 180) < 3 and abs(y + c[1]) < 3)}
    for centre, metres in (((2.0, 48.0), 3e6), ((179.95, 10.0), 5e5), ((10.0, 88.0), 2e6), ((-179.99, 10.0), 5e5)):
        got = {x.id for x in geo.within_radius(d, "lon", "lat", centre, metres).collect()}
        assert got == {i for i, m in far(centre).items() if m <= metres} and got
    zones = [(k, json.dumps({"type": "Polygon", "coordinates": [[[x, y], [x + 40, y], [x + 20, y + 50], [x, y]]]})) for k, (x, y) in enumerate([(-170, -80), (0, 0), (100, 20), (-20, -30)])]
    pairs = {(x.id, x.k) for x in geo.place_join(d, spark.createDataFrame(zones, "k int, zone string"), "lon", "lat", "zone").collect()}
    assert pairs == {(i, k) for i, x, y in spots if x is not None for k, z in zones if G.covers(G.parse(z), P(x, y))} and pairs
    near = [x.id for x in geo.nearest_places(d.where("lon between -60 and 60"), "id", "lon", "lat", (2.0, 48.0), 5).collect()]
    want = sorted((m, i) for i, m in far((2.0, 48.0)).items() if -60 <= spots[i][1] <= 60)[:5]
    assert near == [i for _, i in want]
    assert geo.place_join(d, spark.createDataFrame([], "k int, zone string"), "lon", "lat", "zone").collect() == []
