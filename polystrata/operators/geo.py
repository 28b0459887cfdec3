"""Geometry columns: GeoJSON text, relations and measures in Arrow batches, cells as keys, reads by place."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import ship
from . import geometry as G


def point(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon.cast("double"), lat.cast("double")).alias("coordinates"))))


def _coordinate(shape: Column, i: int) -> Column:
    return F.get_json_object(shape, f"$.coordinates[{i}]").cast("double")


def relation(name: str, a: Column, b: Column) -> Column:
    """Exact. Boxes apart are told before any kernel runs on a pair."""
    return _related(name)(a, b)


@cache
def _related(name: str):
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        test = G.RELATIONS[name]
        return pd.Series([None if x is None or y is None else test(G.parse(x), G.parse(y)) for x, y in zip(a, b)], dtype=object)

    return run


@cache
def _distance():
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.inf)
        shapes = [(i, G.parse(x), G.parse(y)) for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
        single = lambda s: len(s.points) == 1 and not s.paths and not s.areas
        pairs = [(i, s.points[0], t.points[0]) for i, s, t in shapes if single(s) and single(t)]
        if pairs:  # positions go as arrays
            p, q = (np.array([x[k] for x in pairs], float) / G.SCALE for k in (1, 2))
            out[[x[0] for x in pairs]] = G.geodesic(p[:, 0], p[:, 1], q[:, 0], q[:, 1])
        for i, s, t in shapes:
            if not (single(s) and single(t)):
                out[i] = G.distance(s, t)
        return pd.Series(out)

    return run


def distance(a: Column, b: Column) -> Column:
    """Metres between nearest positions; an absent shape is infinitely far."""
    return _distance()(a, b)


@cache
def _area():
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("double")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else G.area(G.parse(x)) for x in a], dtype=float)

    return run


def area(a: Column) -> Column:
    return _area()(a)


# ---- cells, by whole numbers only

_STEP = 87_890_625  # 360e9 is 2^12 of these, 180e9 2^11


def _cell_of(degrees: Column, half: int, bits: int, level: Column) -> Column:
    units = F.round(degrees * G.SCALE).cast("long") + half * G.SCALE
    fine = F.call_function("shiftleft", units, F.greatest(level - bits, F.lit(0)))
    at = F.call_function("shiftright", F.floor(fine.cast("decimal(20,0)") / _STEP).cast("long"), F.greatest(F.lit(bits) - level, F.lit(0)))
    return F.least(at, F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1)


def cell_place(lon: Column, lat: Column, level: Column | int) -> Column:
    """(x, y) of a position's cell among 2^level columns and rows."""
    n = F.lit(level) if isinstance(level, int) else level
    n = n.cast("int")
    return F.struct(_cell_of(lon, 180, 12, n).alias("x"), _cell_of(lat, 90, 11, n).alias("y"))


def cell(shape: Column, level: Column) -> Column:
    """The cell that holds a position, as a polygon: a key to group by. Levels 0 to 32; other shapes than positions are refused."""
    at = cell_place(_coordinate(shape, 0), _coordinate(shape, 1), level)
    side = lambda i, size: i.cast("double") / F.pow(F.lit(2.0), level) * size - size / 2
    w, e, s, n = side(at["x"], 360), side(at["x"] + 1, 360), side(at["y"], 180), side(at["y"] + 1, 180)
    ring = F.array(F.array(w, s), F.array(e, s), F.array(e, n), F.array(w, n), F.array(w, s))
    text = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    bad = (F.get_json_object(shape, "$.type") != "Point") | (level < 0) | (level > 32)
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a cell is of a position, at a level of 0 to 32"))).when(shape.isNotNull(), text)


def hilbert(x: Column, y: Column, level: int) -> Column:
    """The cell's number along the curve: neighbours in number are neighbours in place, so sorting by it clusters files by place. At level 32 it fills 64 bits, sign included."""
    bit = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(F.lit(1).cast("long"))
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        rx, ry = bit(s["x"], k), bit(s["y"], k)
        turned = lambda v: F.when((ry == 0) & (rx == 1), F.bitwise_not(v)).otherwise(v)
        d = F.call_function("shiftleft", s["d"], F.lit(2)).bitwiseOR((rx * 3).bitwiseXOR(ry))
        return F.struct(F.when(ry == 0, turned(s["y"])).otherwise(s["x"]).alias("x"), F.when(ry == 0, turned(s["x"])).otherwise(s["y"]).alias("y"), d.alias("d"))

    if level == 0:
        return F.lit(0).cast("long")
    return F.aggregate(F.sequence(F.lit(level - 1), F.lit(0)), start, step, lambda s: s["d"])


@cache
def _covering(budget: int):
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("array<struct<level:int,x:long,y:long>>")
    def run(a: pd.Series) -> pd.Series:
        boxes = [None if x is None else G.parse(x).box() for x in a]
        return pd.Series([None if b is None else [{"level": n, "x": x, "y": y} for n, x, y in G.covering(b, budget)] for b in boxes])

    return run


def covering(shape: Column, budget: int = 16) -> Column:
    return _covering(budget)(shape)


def place_join(places: DataFrame, shapes: DataFrame, lon: str, lat: str, shape: str, relation_name: str = "covers", budget: int = 16) -> DataFrame:
    """Pairs of a position of `places` (columns lon, lat) and a shape of `shapes` that `covers` (or 'contains', 'intersects') it.

    Shapes go to the cells of their covering, positions to their cell at each
    level that coverings use; the join is on (level, cell), and the exact
    relation tests what it pairs. A shape has at most `budget` cells, so a hot
    cell is split by adaptive execution, never multiplied.
    """
    held = shapes.withColumn("_cell", F.explode(covering(F.col(shape), budget)))
    levels = [r[0] for r in held.select("_cell.level").distinct().collect()]  # 33 at most
    at = F.array(*(F.struct(F.lit(n).alias("level"), cell_place(F.col(lon), F.col(lat), n).alias("p")) for n in sorted(levels))) if levels else F.expr("cast(array() as array<struct<level:int,p:struct<x:long,y:long>>>)")
    spots = places.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("_at", F.explode(at))
    both = spots.join(held, (F.col("_at.level") == F.col("_cell.level")) & (F.col("_at.p.x") == F.col("_cell.x")) & (F.col("_at.p.y") == F.col("_cell.y"))).drop("_at", "_cell")
    return both.where(relation(relation_name, F.col(shape), point(F.col(lon), F.col(lat))))


def within_radius(df: DataFrame, lon: str, lat: str, centre: tuple[float, float], metres: float) -> DataFrame:
    """Positions within so many metres of a centre, with their distance. A box that holds the circle is pushed to the scan."""
    up = metres / 110_000  # a degree of latitude has 110.5 km at least
    near_pole = abs(centre[1]) + up >= 89
    box = F.col(lat).between(centre[1] - up, centre[1] + up)
    if not near_pole:
        side = up / float(np.cos(np.radians(abs(centre[1]) + up)))
        if side < 180:
            low, high = centre[0] - side, centre[0] + side
            around = F.col(lon).between(low, high)
            if low < -180:
                around |= F.col(lon) >= low + 360
            if high > 180:
                around |= F.col(lon) <= high - 360
            box &= around
    here = point(F.lit(float(centre[0])), F.lit(float(centre[1])))
    return df.where(box).withColumn("metres", distance(point(F.col(lon), F.col(lat)), here)).where(F.col("metres") <= metres)


def nearest_places(df: DataFrame, identity: str, lon: str, lat: str, centre: tuple[float, float], k: int) -> DataFrame:
    """The k nearest positions: a top-k by distance, then identity."""
    here = point(F.lit(float(centre[0])), F.lit(float(centre[1])))
    return df.withColumn("metres", distance(point(F.col(lon), F.col(lat)), here)).orderBy("metres", identity).limit(k)
