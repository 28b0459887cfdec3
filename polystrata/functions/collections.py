"""Arrays, sets, objects and rankings.

An object is a struct or a map with text keys; a set an array in order without
repeats; a ranking an array of (member, score) by score, then member.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import function, refuse

# ---- arrays

function("array::len", 1)(lambda a: F.array_size(a).cast("long"))
function("array::first", 1)(lambda a: F.get(a, F.lit(0)))
function("array::last", 1)(lambda a: F.try_element_at(a, F.lit(-1)))
function("array::distinct", 1)(F.array_distinct)
function("array::sort", 1)(lambda a: F.sort_array(a, True))
function("array::reverse", 1)(F.reverse)
function("array::flatten", 1)(F.flatten)
function("array::join", 2)(lambda a, sep: F.when(a.isNotNull() & sep.isNotNull(), F.call_function("array_join", F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit(""))), sep)))
function("array::concat", 2)(lambda a, b: F.concat(a, b))
function("array::append", 2)(lambda a, x: F.array_append(a, x))
function("array::min", 1)(F.array_min)
function("array::max", 1)(F.array_max)
function("array::at", 2)(lambda a, i: F.when(i >= 0, F.get(a, i.cast("int"))).otherwise(F.try_element_at(a, F.when(i < 0, i.cast("int")))))
function("array::index_of", 2)(lambda a, x: F.nullif(F.array_position(a, x), F.lit(0)).cast("long") - 1)


@function("array::slice", 3)
def _slice(a: Column, start: Column, count: Column) -> Column:
    """From 0 on; past the end is empty. Negative bounds are refused."""
    return refuse((start < 0) | (count < 0), "array::slice with a negative bound", F.slice(a, (start + 1).cast("int"), count.cast("int")))


@function("array::sum", 1, typed=True)
def _sum(a: Column, types) -> Column:
    """0 over nothing; absent elements add nothing."""
    t = types[0].elementType if isinstance(types[0], T.ArrayType) else T.DoubleType()
    wide = "decimal(38,10)" if isinstance(t, T.DecimalType) else "double" if isinstance(t, (T.DoubleType, T.FloatType)) else "long"
    return F.aggregate(a, F.lit(0).cast(wide), lambda s, x: (s + F.coalesce(x.cast(wide), F.lit(0).cast(wide))).cast(wide))


# ---- objects


def _names(t: T.DataType | None) -> list[str] | None:
    return sorted(f.name for f in t.fields) if isinstance(t, T.StructType) else None


def as_map(o: Column, t: T.DataType | None) -> Column:
    """A struct as a map, where its values have one type; fields that are absent are left out."""
    names = _names(t)
    if names is None:
        return o
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), o[n].alias("value")) for n in names)), lambda e: e["value"].isNotNull())
    return F.when(o.isNotNull(), F.map_from_entries(entries))


@function("object::keys", 1, typed=True)
def _keys(o: Column, types) -> Column:
    return F.array_sort(F.map_keys(as_map(o, types[0])))


@function("object::values", 1, typed=True)
def _values(o: Column, types) -> Column:
    m = as_map(o, types[0])
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.element_at(m, k))


@function("object::len", 1, typed=True)
def _len(o: Column, types) -> Column:
    m = as_map(o, types[0])
    return F.when(m.isNotNull(), F.size(F.map_keys(m)).cast("long"))


@function("object::entries", 1, typed=True)
def _entries(o: Column, types) -> Column:
    m = as_map(o, types[0])
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("name"), F.element_at(m, k).alias("value")))


@function("object::has", 2, typed=True)
def _has(o: Column, name: Column, types) -> Column:
    if isinstance(types[0], T.VariantType):
        return F.array_contains(F.json_object_keys(o.cast("string")), name)
    return F.map_contains_key(as_map(o, types[0]), name)


@function("object::get", 2, typed=True)
def _get(o: Column, name: Column, types) -> Column:
    if isinstance(types[0], T.VariantType):
        return F.try_variant_get(o, F.concat(F.lit("$['"), name, F.lit("']")), "variant")
    return F.try_element_at(as_map(o, types[0]), name)


@function("object::merge", 2, typed=True)
def _merge(a: Column, b: Column, types) -> Column:
    """Fields of both; of the second where both have one."""
    one, two = as_map(a, types[0]), as_map(b, types[1])
    return F.map_concat(F.map_filter(one, lambda k, _: ~F.map_contains_key(two, k)), two)


# ---- sets

function("set::len", 1)(lambda s: F.array_size(F.array_distinct(s)).cast("long"))
function("set::union", 2)(lambda a, b: F.sort_array(F.array_union(a, b)))
function("set::intersect", 2)(lambda a, b: F.sort_array(F.array_intersect(a, b)))
function("set::difference", 2)(lambda a, b: F.sort_array(F.array_except(a, b)))

# ---- rankings


def ranked(entries: Column) -> Column:
    """(member, score) in order of score, then member."""
    by_score = F.array_sort(F.transform(entries, lambda e: F.struct(e["score"].alias("score"), e["member"].alias("member"))))
    return F.transform(by_score, lambda e: F.struct(e["member"].alias("member"), e["score"].alias("score")))


def _scores(r: Column) -> Column:
    return F.map_from_entries(F.transform(r, lambda e: F.struct(e["member"].alias("key"), e["score"].alias("value"))))


def _ranking(m: Column) -> Column:
    return ranked(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("member"), e["value"].alias("score"))))


function("scores::score", 2)(lambda r, m: F.try_element_at(_scores(r), m))
function("scores::rank", 2)(lambda r, m: F.nullif(F.array_position(F.transform(r, lambda e: e["member"]), m), F.lit(0)).cast("long") - 1)
function("scores::union", 2)(lambda a, b: _ranking(F.map_zip_with(_scores(a), _scores(b), lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))))
function("scores::intersect", 2)(lambda a, b: _ranking(F.map_filter(F.map_zip_with(_scores(a), _scores(b), lambda _, x, y: x + y), lambda _, s: s.isNotNull())))


@function("scores::range", 3)
def _range(r: Column, start: Column, stop: Column) -> Column:
    """Places from start to stop, both included; negative ones count from the highest."""
    n = F.array_size(r)
    at = lambda i: F.when(i < 0, n + i).otherwise(i)
    low = F.greatest(at(start), F.lit(0))
    size = F.least(at(stop), n - 1) - low + 1
    return F.when(size <= 0, F.slice(r, 1, 0)).otherwise(F.slice(r, (low + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int")))


@function("scores::between", 3)
def _between(r: Column, low: Column, high: Column) -> Column:
    """Both bounds included; an absent one is open."""
    return F.filter(r, lambda e: F.coalesce(e["score"] >= low, F.lit(True)) & F.coalesce(e["score"] <= high, F.lit(True)))
