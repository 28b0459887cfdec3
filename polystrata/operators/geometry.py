"""Planar relations on an integer grid, and measures on the WGS-84 ellipsoid, in plain Python and numpy.

Positions are snapped to 1e-9 degrees. Relations compute with whole numbers
and fractions, so that they are exact; edges are straight in longitude and
latitude.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np

SCALE = 10**9
WORLD = 360 * SCALE, 180 * SCALE
A, FLATTENING = 6_378_137.0, 1 / 298.257223563
B = A * (1 - FLATTENING)

Point = tuple
Segment = tuple


@dataclass
class Shape:
    """Loose positions, paths, and areas (a shell and its holes, each a closed ring)."""

    points: list[Point] = field(default_factory=list)
    paths: list[list[Point]] = field(default_factory=list)
    areas: list[list[list[Point]]] = field(default_factory=list)

    def vertices(self) -> Iterator[Point]:
        yield from self.points
        for p in self.paths:
            yield from p
        for rings in self.areas:
            for r in rings:
                yield from r

    def segments(self) -> Iterator[Segment]:
        for p in (*self.paths, *(r for rings in self.areas for r in rings)):
            yield from ((a, b) for a, b in zip(p[:-1], p[1:]) if a != b)

    def box(self) -> tuple | None:
        xs = list(self.vertices())
        return (min(p[0] for p in xs), min(p[1] for p in xs), max(p[0] for p in xs), max(p[1] for p in xs)) if xs else None


def snap(c: Iterable[float]) -> Point:
    lon, lat = list(c)[:2]
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise ValueError(f"no position on the globe: {lon}, {lat}")
    return round(lon * SCALE), round(lat * SCALE)


def _ring(cs: list) -> list[Point]:
    r = [snap(c) for c in cs]
    if len(r) < 4 or r[0] != r[-1]:
        raise ValueError("a ring has four positions at least and ends where it begins")
    return r


def _read(g: dict, out: Shape) -> Shape:
    kind, c = g["type"], g.get("coordinates")
    if kind == "Point":
        out.points.append(snap(c))
    elif kind == "MultiPoint":
        out.points += [snap(x) for x in c]
    elif kind == "LineString":
        out.paths.append([snap(x) for x in c])
    elif kind == "MultiLineString":
        out.paths += [[snap(x) for x in p] for p in c]
    elif kind == "Polygon":
        out.areas.append([_ring(r) for r in c])
    elif kind == "MultiPolygon":
        out.areas += [[_ring(r) for r in p] for p in c]
    elif kind == "GeometryCollection":
        for x in g["geometries"]:
            _read(x, out)
    else:
        raise ValueError(f"no shape: {kind}")
    return out


@lru_cache(maxsize=4096)
def parse(geojson: str) -> Shape:
    return _read(json.loads(geojson), Shape())


# ---- where a position lies


def _side(a: Point, b: Point, p: Point):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a: Point, b: Point, p: Point) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]) and _side(a, b, p) == 0


def in_ring(ring: list[Point], p: Point) -> int:
    """1 inside, 0 on the edge, -1 outside."""
    inside = False
    for a, b in zip(ring[:-1], ring[1:]):
        if _on(a, b, p):
            return 0
        if (a[1] > p[1]) != (b[1] > p[1]) and (_side(a, b, p) > 0) == (b[1] > a[1]):
            inside = not inside
    return 1 if inside else -1


def in_area(rings: list[list[Point]], p: Point) -> int:
    at = in_ring(rings[0], p)
    for hole in rings[1:]:
        if at == 1:
            at = -in_ring(hole, p)
    return at


def holds(s: Shape, p: Point) -> bool:
    return p in s.points or any(_on(a, b, p) for path in s.paths for a, b in zip(path[:-1], path[1:])) or any(len(x) == 1 and x[0] == p for x in s.paths) or any(in_area(r, p) >= 0 for r in s.areas)


def _inner(s: Shape, p: Point) -> bool:
    """Whether p is in the shape's interior: a path's is the path without its two ends."""
    if p in s.points or any(in_area(r, p) == 1 for r in s.areas):
        return True
    ends = {q for path in boundary_ends(s) for q in path}
    return p not in ends and any(_on(a, b, p) for path in s.paths for a, b in zip(path[:-1], path[1:]))


def boundary_ends(s: Shape) -> list[list[Point]]:
    return [[p[0], p[-1]] for p in s.paths if p[0] != p[-1]]


def boundary(s: Shape) -> Shape:
    return Shape([q for e in boundary_ends(s) for q in e], [r for rings in s.areas for r in rings], [])


def _meets(s: Segment, t: Segment) -> list[Point]:
    """The positions where two segments meet; both ends of a common stretch."""
    (a, b), (c, d) = s, t
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return []
    den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    if den == 0:
        return [p for p in (a, b) if _on(c, d, p)] + [p for p in (c, d) if _on(a, b, p)]
    t_ = Fraction((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0]), den)
    u_ = Fraction((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0]), den)
    return [(a[0] + t_ * (b[0] - a[0]), a[1] + t_ * (b[1] - a[1]))] if 0 <= t_ <= 1 and 0 <= u_ <= 1 else []


def _half(a: Point, b: Point) -> Point:
    return (Fraction(a[0] + b[0], 2), Fraction(a[1] + b[1], 2))


def _cut(s: Segment, other: Shape) -> tuple[list[Point], list[Point]]:
    """Where the other shape cuts a segment, and the middles of the pieces. Within a piece nothing about the other shape changes."""
    at = {s[0], s[1], *(p for t in other.segments() for p in _meets(s, t)), *(p for p in other.points if _on(s[0], s[1], p))}
    places = sorted(at)
    return places, [_half(a, b) for a, b in zip(places[:-1], places[1:])]


def _inside_of(rings: list[list[Point]]) -> Point:
    """A position in an area's interior: midway between two crossings of a line that meets no vertex."""
    ys = sorted({p[1] for r in rings for p in r})
    y = Fraction(ys[0] + ys[1], 2)
    xs = sorted(a[0] + Fraction((y - a[1]) * (b[0] - a[0]), b[1] - a[1]) for r in rings for a, b in zip(r[:-1], r[1:]) if (a[1] > y) != (b[1] > y))
    return next(p for p in (((x1 + x2) / 2, y) for x1, x2 in zip(xs[:-1], xs[1:]) if x1 != x2) if in_area(rings, p) == 1)


# ---- relations


def _apart(one: Shape, other: Shape) -> bool:
    a, b = one.box(), other.box()
    return a is None or b is None or a[2] < b[0] or b[2] < a[0] or a[3] < b[1] or b[3] < a[1]


def intersects(one: Shape, other: Shape) -> bool:
    if _apart(one, other):
        return False
    if any(holds(other, p) for p in one.vertices()) or any(holds(one, p) for p in other.vertices()):
        return True
    return any(_meets(s, t) for s in one.segments() for t in other.segments())


def disjoint(one: Shape, other: Shape) -> bool:
    return not intersects(one, other)


def covers(one: Shape, other: Shape) -> bool:
    """Every position of the other is one of this shape's, the boundary included. Nothing is covered by anything."""
    inner, outer = other.box(), one.box()
    if inner is None:
        return True
    if outer is None or inner[0] < outer[0] or inner[1] < outer[1] or inner[2] > outer[2] or inner[3] > outer[3]:
        return False
    if not all(holds(one, p) for p in other.vertices()):
        return False
    for s in other.segments():
        places, middles = _cut(s, one)
        if not all(holds(one, p) for p in (*places, *middles)):
            return False
    for rings in other.areas:
        area = Shape([], [], [rings])
        if not any(in_area(r, _inside_of(rings)) == 1 for r in one.areas):
            return False
        if any(in_area(rings, m) == 1 for r in one.areas for s in Shape([], [], [r]).segments() for m in _cut(s, area)[1]):
            return False
    return True


def covered_by(one: Shape, other: Shape) -> bool:
    return covers(other, one)


def contains(one: Shape, other: Shape) -> bool:
    """Covers it, and more than the boundary does."""
    return other.box() is not None and covers(one, other) and not covers(boundary(one), other)


def within(one: Shape, other: Shape) -> bool:
    return contains(other, one)


def equals(one: Shape, other: Shape) -> bool:
    return covers(one, other) and covers(other, one)


def interiors_meet(one: Shape, other: Shape) -> bool:
    for a, b in ((one, other), (other, one)):
        for rings in a.areas:
            if any(in_area(r, _inside_of(rings)) == 1 for r in b.areas):
                return True
            if any(in_area(r, m) == 1 for s in Shape([], [], [rings]).segments() for m in _cut(s, Shape([], [], b.areas))[1] for r in b.areas):
                return True
        loose = Shape(a.points, a.paths, [])
        for p in loose.vertices():
            if _inner(a, p) and _inner(b, p):
                return True
        for s in loose.segments():
            places, middles = _cut(s, b)
            if any(_inner(a, p) and _inner(b, p) for p in (*places, *middles)):
                return True
    return False


def touches(one: Shape, other: Shape) -> bool:
    return intersects(one, other) and not interiors_meet(one, other)


RELATIONS: dict[str, Callable[[Shape, Shape], bool]] = {f.__name__: f for f in (intersects, disjoint, covers, covered_by, contains, within, equals, touches)}

# ---- measures


def geodesic(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres between positions in degrees, elementwise, by Vincenty's inverse formula. Nearly antipodal ones, where it doesn't settle, are refused."""
    l1, p1, l2, p2 = (np.radians(np.asarray(x, float)) for x in (lon1, lat1, lon2, lat2))
    u1, u2 = np.arctan((1 - FLATTENING) * np.tan(p1)), np.arctan((1 - FLATTENING) * np.tan(p2))
    full = (l2 - l1 + np.pi) % (2 * np.pi) - np.pi
    lam = full.copy()
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.sqrt((cu2 * sl) ** 2 + (cu1 * su2 - su1 * cu2 * cl) ** 2)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, cu1 * cu2 * sl / np.where(ss > 0, ss, 1), 0.0)
            ca2 = 1 - sa**2
            c2m = np.where(ca2 > 1e-18, cs - 2 * su1 * su2 / np.where(ca2 > 1e-18, ca2, 1), 0.0)
            c = FLATTENING / 16 * ca2 * (4 + FLATTENING * (4 - 3 * ca2))
            new = full + (1 - c) * FLATTENING * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if np.all(done | np.isnan(lam)):
                break
        else:
            raise ValueError("positions are nearly antipodal: the shortest way between them is not settled")
        u = ca2 * (A * A - B * B) / (B * B)
        k1 = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        k2 = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        ds = k2 * ss * (c2m + k2 / 4 * (cs * (2 * c2m**2 - 1) - k2 / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        return B * k1 * (sigma - ds)


def _metres(p: Point, q: Point) -> float:
    return float(geodesic(p[0] / SCALE, p[1] / SCALE, q[0] / SCALE, q[1] / SCALE))


def _to_segment(p: Point, s: Segment) -> float:
    """From a position to the nearest one of an edge, by golden section along it."""
    (ax, ay), (bx, by) = s
    at = lambda t: _metres(p, (ax + t * (bx - ax), ay + t * (by - ay)))
    low, high, g = 0.0, 1.0, (math.sqrt(5) - 1) / 2
    x, y = high - g * (high - low), low + g * (high - low)
    fx, fy = at(x), at(y)
    for _ in range(60):
        if fx <= fy:
            high, y, fy = y, x, fx
            x = high - g * (high - low)
            fx = at(x)
        else:
            low, x, fx = x, y, fy
            y = low + g * (high - low)
            fy = at(y)
    return min(at(0.0), at(1.0), fx, fy)


def distance(one: Shape, other: Shape) -> float:
    """Metres between the nearest positions; 0 where the shapes meet."""
    if one.box() is None or other.box() is None:
        return math.inf
    if intersects(one, other):
        return 0.0
    ways = [_metres(p, q) for p in one.points for q in other.points]
    for a, b in ((one, other), (other, one)):
        edges = list(b.segments())
        ways += [_to_segment(p, s) for p in a.vertices() for s in edges]
    return min(ways) if ways else math.inf


def authalic_radius() -> float:
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    return math.sqrt(A * A / 2 * (1 + (1 - e * e) / e * math.atanh(e)))


def _ring_area(ring: list[Point]) -> float:
    total = 0.0
    for a, b in zip(ring[:-1], ring[1:]):
        way = b[0] - a[0]  # the shorter way round
        way += -WORLD[0] if way > WORLD[0] // 2 else WORLD[0] if way < -WORLD[0] // 2 else 0
        east = math.radians(way / SCALE)
        total += east * (math.sin(math.radians(a[1] / SCALE)) + math.sin(math.radians(b[1] / SCALE)))
    return abs(authalic_radius() ** 2 * total / 2)


def area(s: Shape) -> float:
    """Square metres on the sphere of the ellipsoid's surface; holes are taken off, what has no interior has none."""
    return sum(max(0.0, _ring_area(r[0]) - sum(_ring_area(h) for h in r[1:])) for r in s.areas)


# ---- cells


ORDER = 32


def place(p: Point, level: int) -> tuple[int, int]:
    """Column and row of a position's cell among 2^level by 2^level; the last ones hold the far edges too."""
    last = (1 << level) - 1
    return tuple(min(last, ((v + w // 2) << level) // w) for v, w in zip(p, WORLD))


def hilbert(x: int, y: int, level: int) -> int:
    d = 0
    for k in range(level - 1, -1, -1):
        rx, ry = (x >> k) & 1, (y >> k) & 1
        d = d << 2 | ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = ~x, ~y
            x, y = y, x
    return d


def covering(box: tuple, budget: int = 16) -> list[tuple[int, int, int]]:
    """Cells (level, column, row) that cover a box: split while all of a level fit the budget."""
    found = [(0, 0, 0)]
    while found[0][0] < ORDER:
        level = found[0][0] + 1
        (x0, y0), (x1, y1) = place(box[:2], level), place(box[2:], level)
        if (x1 - x0 + 1) * (y1 - y0 + 1) > budget:
            break
        found = [(level, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
    return found
