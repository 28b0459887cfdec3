"""Text, numbers, instants, casts, digests and encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import cosine, dot, euclidean
from . import function, refuse

ANY = 1 << 30
_WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
_FRONT, _BACK = r"(?U)^\s+", r"(?U)\s+$"

# ---- text

function("string::len", 1)(lambda s: F.char_length(s).cast("long"))
function("string::lower", 1)(F.lower)
function("string::upper", 1)(F.upper)
function("string::trim", 1)(lambda s: F.regexp_replace(s, f"{_FRONT}|{_BACK}", ""))
function("string::trim_start", 1)(lambda s: F.regexp_replace(s, _FRONT, ""))
function("string::trim_end", 1)(lambda s: F.regexp_replace(s, _BACK, ""))
function("string::concat", 2, ANY)(lambda *parts: F.concat(*parts))
function("string::reverse", 1)(F.reverse)
function("string::starts_with", 2)(F.startswith)
function("string::ends_with", 2)(F.endswith)
function("string::contains", 2)(F.contains)


@function("string::split", 2)
def _split(s: Column, sep: Column) -> Column:
    """By the literal separator; an empty one is refused."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(sep, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return refuse(sep == "", "string::split by an empty separator", F.split(s, quoted, -1))


@function("string::slice", 3)
def _slice(s: Column, start: Column, count: Column) -> Column:
    """A window of characters from 0 on; past the end is ''. Negative bounds are refused."""
    return refuse((start < 0) | (count < 0), "string::slice with a negative bound", F.substring(s, (start + 1).cast("int"), count.cast("int")))


@function("string::lines", 3)
def _lines(s: Column, start: Column, count: Column) -> Column:
    """A window of lines from 0 on, without carriage returns; a last line break begins no line."""
    lines = F.split(F.regexp_replace(s, r"\r?\n\z", ""), r"\r?\n", -1)
    return refuse((start < 0) | (count < 0), "string::lines with a negative bound", F.array_join(F.slice(lines, (start + 1).cast("int"), count.cast("int")), "\n"))


@function("string::replace", 3)
def _replace(s: Column, old: Column, new: Column) -> Column:
    return refuse(old == "", "string::replace of an empty text", F.replace(s, old, new))


@function("string::index_of", 2)
def _index_of(s: Column, part: Column) -> Column:
    """From 0; absent where there is none."""
    return F.nullif(F.position(part, s), F.lit(0)).cast("long") - 1


# ---- numbers


def _kept(c: Column, types) -> Column:
    """Whole results in the kind of number that came in."""
    t = types[0]
    return c.cast(t) if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) else c.cast("long")


def _cut(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


function("math::sqrt", 1)(lambda x: F.when(x >= 0, F.sqrt(x)))
function("math::pow", 2)(lambda x, n: F.pow(x, n))
function("math::ln", 1)(lambda x: F.when(x > 0, F.ln(x)))
function("math::exp", 1)(F.exp)
function("math::floor", 1, typed=True)(lambda x, types: _kept(F.floor(x), types))
function("math::ceil", 1, typed=True)(lambda x, types: _kept(F.ceil(x), types))
function("math::trunc", 1, typed=True)(lambda x, types: _kept(_cut(x), types))
function("math::round", 1, typed=True)(lambda x, types: _kept(_cut(x.cast("decimal(38,6)") + F.signum(x).cast("decimal(2,1)") * F.lit(0.5).cast("decimal(2,1)")) if isinstance(types[0], T.DecimalType) else F.round(x, 0), types))
function("math::sign", 1)(lambda x: F.signum(x).cast("long"))
function("math::min", 2)(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)))
function("math::max", 2)(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)))


@function("math::abs", 1, typed=True)
def _abs(x: Column, types) -> Column:
    """The smallest whole number has no counterpart; its value is the largest one."""
    if isinstance(types[0], _WHOLE):
        x = x.cast("long")
        return F.when(x == F.lit(-(2**63)), F.lit(2**63 - 1)).otherwise(F.abs(F.when(x != F.lit(-(2**63)), x)))
    return F.abs(x)


# ---- instants and durations


def instant(c: Column) -> Column:
    return c.cast("timestamp")


def micros(c: Column) -> Column:
    return F.unix_micros(instant(c))


def duration_micros(d: Column) -> Column:
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + d)


function("time::now", 0)(lambda: F.current_timestamp().cast("timestamp_ntz"))
for _name, _part in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second)):
    function(f"time::{_name}", 1)(lambda t, part=_part: part(t).cast("long"))
function("time::unix", 1)(lambda t: F.floor(micros(t) / 1_000_000).cast("long"))
function("time::from_unix", 1)(lambda s: F.timestamp_micros((s * 1_000_000).cast("long")).cast("timestamp_ntz"))
function("duration::from_secs", 1)(lambda s: F.make_dt_interval(secs=s.cast("decimal(18,6)")))


@function("time::bucket", 2)
def _bucket(t: Column, width: Column) -> Column:
    """Epoch-anchored floor, before 1970 too; the width is a duration of whole seconds above zero."""
    w = duration_micros(width)
    floor = F.timestamp_micros(micros(t) - F.pmod(micros(t), w)).cast("timestamp_ntz")
    return refuse((w <= 0) | (w % 1_000_000 != 0), "time::bucket of a width that is not of whole seconds above zero", floor)


# ---- kinds and casts

_KINDS = {"string": "string", "boolean": "bool", "binary": "bytes", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime", "void": "none", "variant": "any"}
_UUID = r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.ArrayType):
        return "array"
    return "duration" if isinstance(t, T.DayTimeIntervalType) else _KINDS.get(t.simpleString(), t.simpleString())


@function("type::of", 1, typed=True)
def _type_of(x: Column, types) -> Column:
    """The kind's name; 'none' of an absence. A variant answers for its value."""
    if types[0] is None:
        return F.when(x.isNull(), "none").otherwise(F.typeof(x))
    if isinstance(types[0], T.VariantType):
        s = F.schema_of_variant(x)
        named = F.when(F.is_variant_null(x), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s.startswith("BIGINT") | s.startswith("DECIMAL") | (s == "DOUBLE"), "number").when(s == "BOOLEAN", "bool").otherwise(F.lower(s))
        return F.coalesce(named, F.lit("none"))
    return F.when(x.isNull(), "none").otherwise(F.lit(kind_of(types[0])))


@function("type::bool", 1)
def _to_bool(x: Column) -> Column:
    s = x.cast("string")
    return refuse(~s.isin("true", "false"), "type::bool of something else than true or false", s == "true")


@function("type::int", 1)
def _to_int(x: Column) -> Column:
    """A whole number, or text of one."""
    d = x.cast("string").try_cast("decimal(38,10)")
    return refuse(x.isNotNull() & (d.isNull() | (d != F.floor(d))), "type::int of something that is no whole number", d.cast("long"))


@function("type::float", 1)
def _to_float(x: Column) -> Column:
    d = x.cast("string").try_cast("double")
    return refuse(x.isNotNull() & d.isNull(), "type::float of something that is no number", d)


@function("type::string", 1, typed=True)
def _to_string(x: Column, types) -> Column:
    if types[0] is not None and kind_of(types[0]) in ("array", "object", "bytes"):
        return refuse(x.isNotNull(), "type::string of an array, object or bytes", F.lit(None).cast("string"))
    return x.cast("string")


@function("type::datetime", 1, typed=True)
def _to_datetime(x: Column, types) -> Column:
    """An instant, or its text as of RFC 3339; a number is refused."""
    if types[0] is not None and kind_of(types[0]) == "datetime":
        return x.cast("timestamp_ntz")
    ok = x.cast("string").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    t = F.when(ok, x.cast("string").try_cast("timestamp"))
    return refuse(x.isNotNull() & t.isNull(), "type::datetime of something that is no instant", t.cast("timestamp_ntz"))


@function("type::uuid", 1)
def _to_uuid(x: Column) -> Column:
    h = F.lower(F.replace(x.cast("string"), F.lit("-"), F.lit("")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return refuse(~x.cast("string").rlike(_UUID), "type::uuid of something that is no uuid", F.when(x.isNotNull(), F.concat_ws("-", *parts)))


function("rand::uuid", 0)(lambda: F.uuid())
function("session::context", 0)(lambda: F.struct(F.lit("spark").alias("node"), F.current_catalog().alias("namespace"), F.current_database().alias("database")))

# ---- vectors

function("vector::cosine", 2)(cosine)
function("vector::euclidean", 2)(euclidean)
function("vector::dot", 2)(dot)

# ---- digests and encodings

function("crypto::sha256", 1)(lambda s: F.sha2(s, 256))
function("crypto::sha512", 1)(lambda s: F.sha2(s, 512))
function("crypto::md5", 1)(F.md5)
function("crypto::sha1", 1)(F.sha1)
function("encoding::base64", 1)(lambda b: F.regexp_replace(F.base64(b.cast("binary")), "[\r\n]", ""))
function("encoding::hex", 1)(lambda b: F.lower(F.hex(b.cast("binary"))))


@function("encoding::base64_decode", 1)
def _unbase64(s: Column) -> Column:
    """Absent unless strictly padded; the unused bits of the last letter are zero."""
    ok = s.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?\z")
    return F.when(ok, F.unbase64(F.when(ok, s)))


@function("encoding::hex_decode", 1)
def _unhex(s: Column) -> Column:
    return F.when(s.rlike(r"^([0-9a-fA-F]{2})*\z"), F.unhex(s))


function("json::parse", 1)(F.try_parse_json)


@function("json::encode", 1, typed=True)
def _encode(x: Column, types) -> Column:
    """Compact text with keys in order of names; a decimal is quoted, an absent value is absent."""
    return F.when(x.isNotNull(), _unwrapped(F.to_json(F.array(_written(x, types[0])), {"ignoreNullFields": "false"})))


def _unwrapped(j: Column) -> Column:
    return F.substring(j, F.lit(2), F.char_length(j) - 2)


def _written(x: Column, t: T.DataType | None) -> Column:
    if isinstance(t, T.DecimalType):
        return x.cast("string")
    if isinstance(t, T.StructType):
        fields = [_written(x[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)]
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(t, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(x, lambda _, v: _written(v, t.valueType)))))
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda v: _written(v, t.elementType))
    return x
