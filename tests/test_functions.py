import math

import pytest
from pyspark.sql import functions as F

from polystrata.functions import REGISTRY, NoSuchFunction, WrongArguments, call

L = F.lit


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def of(spark, name, *sql):
    d = spark.range(1).select(*(F.expr(s).alias(f"a{i}") for i, s in enumerate(sql)))
    return d.select(call(name, *d.columns, of=d).alias("x")).first()["x"]


def test_all_are_there_and_absence_makes_absence(spark):
    assert len(REGISTRY) == 111
    with pytest.raises(NoSuchFunction):
        call("string::nothing")
    with pytest.raises(WrongArguments):
        call("string::len")
    text = "string::len string::lower string::upper string::trim string::trim_start string::trim_end string::reverse crypto::sha256 crypto::sha512 crypto::md5 crypto::sha1 encoding::base64 encoding::base64_decode encoding::hex encoding::hex_decode json::parse json::encode type::bool type::int type::float type::string type::datetime type::uuid"
    for name in text.split():
        assert of(spark, name, "cast(null as string)") is None, name
    for name in "math::sqrt math::abs math::floor math::ceil math::round math::sign math::trunc math::ln math::exp time::from_unix duration::from_secs".split():
        assert of(spark, name, "cast(null as double)") is None, name
    assert of(spark, "type::of", "cast(null as string)") == "none"
    assert all(of(spark, f"vector::{n}", "array(1D)", "cast(null as array<double>)") == math.inf for n in ("cosine", "euclidean", "dot"))
    assert of(spark, "geo::distance", "cast(null as string)", "cast(null as string)") == math.inf


def test_text(spark):
    assert of(spark, "string::trim", "'\\u00a0 a b\\t\\n'") == "a b"
    assert of(spark, "string::split", "'a.b..c'", "'.'") == ["a", "b", "", "c"] and of(spark, "string::split", "'a\\\\Eb'", "'\\\\E'") == ["a", "b"]
    assert of(spark, "string::slice", "'héllo'", "1", "3") == "éll" and of(spark, "string::slice", "'abc'", "9", "3") == ""
    assert of(spark, "string::lines", "'a\\r\\nb\\nc\\n'", "1", "5") == "b\nc"
    assert of(spark, "string::index_of", "'abcabc'", "'c'") == 2 and of(spark, "string::index_of", "'abc'", "'z'") is None
    assert of(spark, "string::reverse", "'añb'") == "bña" and of(spark, "string::replace", "'a.a'", "'.'", "'$1'") == "a$1a"
    for name, args in (("string::split", ("'a'", "''")), ("string::replace", ("'a'", "''", "'b'")), ("string::slice", ("'a'", "-1", "1")), ("string::lines", ("'a'", "0", "-1")), ("array::slice", ("array(1)", "-1", "1"))):
        with pytest.raises(Exception, match=name):
            of(spark, name, *args)


def test_numbers(spark):
    assert [of(spark, "math::round", x) for x in ("2.5D", "-2.5D", "-2.4D")] == [3.0, -3.0, -2.0]
    assert str(of(spark, "math::round", "cast('-2.5' as decimal(5,1))")) == "-3.0" and of(spark, "math::floor", "-1.5D") == -2.0
    assert of(spark, "math::abs", "-9223372036854775808L + 0") == 2**63 - 1 and of(spark, "math::abs", "-3") == 3
    assert of(spark, "math::sqrt", "-1D") is None and of(spark, "math::ln", "0D") is None and of(spark, "math::min", "3", "cast(null as int)") is None
    assert of(spark, "math::trunc", "-1.7D") == -1.0 and of(spark, "math::trunc", "1.7D") == 1.0


def test_time(spark):
    b = lambda ts, w: str(of(spark, "time::bucket", f"timestamp_ntz'{ts}'", w))
    assert b("1969-12-31 23:59:59", "interval '1' hour") == "1969-12-31 23:00:00" and b("2026-03-01 00:59:59", "interval '15' minute") == "2026-03-01 00:45:00"
    for w in ("interval '0' second", "interval '0.5' second"):
        with pytest.raises(Exception, match="time::bucket"):
            b("2026-03-01 00:59:59", w)
    assert of(spark, "time::unix", "timestamp_ntz'1969-12-31 23:59:59.5'") == -1 and str(of(spark, "time::from_unix", "1.5D")) == "1970-01-01 00:00:01.500000"


def test_casts_refuse(spark):
    assert of(spark, "type::int", "'12'") == 12 and of(spark, "type::int", "3.0D") == 3 and of(spark, "type::bool", "'true'") is True
    assert of(spark, "type::uuid", "'ABCDEF0123456789abcdef0123456789'") == "abcdef01-2345-6789-abcd-ef0123456789"
    assert str(of(spark, "type::datetime", "'2026-03-01T01:00:00+01:00'")) == "2026-03-01 00:00:00"
    for name, x in (("type::int", "2.5D"), ("type::int", "'x'"), ("type::bool", "'yes'"), ("type::bool", "1"), ("type::float", "'x'"), ("type::string", "array(1)"), ("type::datetime", "5"), ("type::datetime", "'2026-03-01'"), ("type::uuid", "'12'")):
        with pytest.raises(Exception, match=name):
            of(spark, name, x)
    kinds = {"1": "number", "'a'": "string", "array(1)": "array", "named_struct('a', 1)": "object", "map('a', 1)": "object", "true": "bool", "X'00'": "bytes", "timestamp_ntz'2020-01-01'": "datetime", "interval '1' day": "duration", "parse_json('[1]')": "array", "parse_json('{}')": "object", "parse_json('1.5')": "number", "parse_json('null')": "null"}
    assert {k: of(spark, "type::of", k) for k in kinds} == kinds


def test_encodings(spark):
    assert of(spark, "encoding::base64", "cast(repeat('x', 200) as binary)") == "eHh4" * 66 + "eHg="
    decode = lambda name, s: (lambda x: x if x is None else bytes(x))(of(spark, name, f"'{s}'"))
    assert decode("encoding::base64_decode", "Zg==") == b"f" and decode("encoding::base64_decode", "") == b""
    assert all(decode("encoding::base64_decode", x) is None for x in ("Zg", "Zh==", "Z===", "Zg==\\n", "Z g="))
    assert decode("encoding::hex_decode", "0aFF") == b"\x0a\xff" and all(decode("encoding::hex_decode", x) is None for x in ("abc", "zz"))
    assert of(spark, "json::encode", "named_struct('b', 1, 'a', array(1.5D, null), 'c', cast('1.50' as decimal(5,2)))") == '{"a":[1.5,null],"b":1,"c":"1.50"}'
    assert of(spark, "json::encode", "'a\"b'") == '"a\\"b"' and of(spark, "json::encode", "3") == "3" and of(spark, "json::parse", "'{bad'") is None


def test_collections(spark):
    assert of(spark, "array::sort", "array(3, null, 1)") == [None, 1, 3] and of(spark, "array::sum", "cast(array() as array<int>)") == 0
    assert of(spark, "array::at", "array(1, 2)", "-1") == 2 and of(spark, "array::at", "array(1, 2)", "5") is None and of(spark, "array::at", "array(1, 2)", "0") == 1
    assert of(spark, "object::keys", "named_struct('b', 1, 'a', 2)") == ["a", "b"] and of(spark, "object::values", "named_struct('b', 1, 'a', 2)") == [2, 1]
    assert of(spark, "object::has", "parse_json('{\"a\":null}')", "'a'") is True and of(spark, "object::has", "map('a', 1)", "'b'") is False
    assert of(spark, "object::merge", "map('a', 1, 'b', 2)", "map('b', 3)") == {"a": 1, "b": 3}
    assert [tuple(e) for e in of(spark, "object::entries", "map('b', 1, 'a', 2)")] == [("a", 2), ("b", 1)]
    r = "array(named_struct('member', 'x', 'score', 1D), named_struct('member', 'a', 'score', 2D), named_struct('member', 'b', 'score', 2D))"
    names = lambda rows: [e["member"] for e in rows]
    assert of(spark, "scores::rank", r, "'b'") == 2 and of(spark, "scores::rank", r, "'q'") is None and of(spark, "scores::score", r, "'x'") == 1.0
    assert names(of(spark, "scores::range", r, "0", "-2")) == ["x", "a"] and names(of(spark, "scores::range", r, "5", "9")) == []
    assert names(of(spark, "scores::between", r, "1.5D", "cast(null as double)")) == ["a", "b"]
    assert [tuple(e) for e in of(spark, "scores::union", r, "array(named_struct('member', 'x', 'score', 5D))")] == [("a", 2.0), ("b", 2.0), ("x", 6.0)]
    assert [tuple(e) for e in of(spark, "scores::intersect", r, "array(named_struct('member', 'x', 'score', 5D))")] == [("x", 6.0)]
    assert of(spark, "session::context")["node"] == "spark" and len(of(spark, "rand::uuid")) == 36
