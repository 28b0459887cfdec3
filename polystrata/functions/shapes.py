"""Geometry: relations, measures and cells of GeoJSON text."""

from ..operators import geo
from ..operators.geometry import RELATIONS
from . import function

for _name in RELATIONS:
    function(f"geo::{_name}", 2)(lambda a, b, name=_name: geo.relation(name, a, b))
function("geo::distance", 2)(geo.distance)
function("geo::area", 1)(geo.area)
function("geo::cell", 2)(geo.cell)
