"""Expressions to columns and reads to DataFrames.

The stages of a read, in order: source and WHERE, FETCH, SPLIT, LATEST BY,
window functions, then FUSE, or groups with FILL and HAVING, or the
projection; ORDER BY and AFTER, START and LIMIT, ONLY. What Spark does better,
as pushing filters and pruning columns, is left to it.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import REGISTRY, call
from ..functions.scalars import duration_micros, kind_of, micros
from ..operators import aggregate as A
from ..operators import ranking as R
from ..operators import relational as J
from ..operators import search as S
from ..staging import written
from .errors import Refused
from .parser import Node

if TYPE_CHECKING:
    from .session import Session

#: The order of kinds where a comparison has two.
_RANK = {k: i for i, k in enumerate(("none", "null", "bool", "number", "string", "bytes", "duration", "datetime", "uuid", "record", "array", "object", "geometry"))}
#: Values of a subquery in an expression, at most; more are refused.
MOST_VALUES = 1_000_000


def literal(v: object) -> Column:
    """A Python value as a constant."""
    if isinstance(v, (list, tuple)):
        return F.array(*(literal(x) for x in v))
    if isinstance(v, dict):
        return F.struct(*(literal(x).alias(k) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return F.lit(v.replace(tzinfo=None)).cast("timestamp_ntz")
    if isinstance(v, int) and not isinstance(v, bool):
        return F.lit(v).cast("long")
    return F.lit(v)


def same_kind(t: T.DataType) -> str:
    if isinstance(t, T.StructType) and t.fieldNames() == ["table", "id"]:
        return "record"
    return kind_of(t)


def record(table: str, identity: Column) -> Column:
    return F.struct(F.lit(table).alias("table"), identity.cast("string").alias("id"))


class Scope:
    """What names mean: the columns of a frame, the parameters, and columns that stand for parts computed before."""

    def __init__(self, session: Session, df: DataFrame, identity: str | None = "id", table: str | None = None, known: dict[Node, Column] | None = None, values: dict[str, Column] | None = None):
        self.session, self.df, self.identity, self.table = session, df, identity, table
        self.known, self.values = known or {}, values or {}

    def type(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("_")).schema["_"].dataType

    def with_(self, df: DataFrame | None = None, known: dict[Node, Column] | None = None) -> Scope:
        return Scope(self.session, self.df if df is None else df, self.identity, self.table, self.known if known is None else known, self.values)

    # ---- paths

    def into(self, c: Column, t: T.DataType, steps: list) -> tuple[Column, T.DataType] | None:
        """The value at a route, or nothing where there can be none. A step over every element maps the rest."""
        for i, s in enumerate(steps):
            if s is None:
                if not isinstance(t, T.ArrayType):
                    return None
                rest, et = steps[i + 1 :], t.elementType
                if not rest:
                    return c, t
                if self.into(F.lit(None).cast(et), et, rest) is None:
                    return None
                out = F.transform(c, lambda x: self.into(x, et, rest)[0])  # noqa: B023
                return out, self.type(out)
            if isinstance(t, T.VariantType):
                path = "$" + "".join(f"[{x}]" if isinstance(x, int) else f"['{x}']" for x in steps[i:] if x is not None)
                return F.try_variant_get(c, F.lit(path), "variant"), t
            if isinstance(s, int):
                if not isinstance(t, T.ArrayType):
                    return None
                c, t = (F.get(c, F.lit(s)) if s >= 0 else F.try_element_at(c, F.lit(s))), t.elementType
            elif isinstance(t, T.StructType) and s in t.fieldNames():
                c, t = c[s], t[s].dataType
            elif isinstance(t, T.MapType):
                c, t = F.try_element_at(c, F.lit(s)), t.valueType
            elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) and s in t.elementType.fieldNames():
                c, t = F.transform(c, lambda x, s=s: x[s]), T.ArrayType(t.elementType[s].dataType)
            else:
                return None
        return c, t

    def path(self, steps: list) -> Column:
        head = steps[0]
        if head not in self.df.columns:
            return F.lit(None)
        c, t = F.col(f"`{head}`"), self.df.schema[head].dataType
        found = self.into(c, t, steps[1:])
        return F.lit(None) if found is None else found[0]

    # ---- expressions

    def column(self, e: Node) -> Column:
        if e in self.known:
            return self.known[e]
        return getattr(self, f"_{e.kind}", self._none)(e)

    def _none(self, e: Node) -> Column:
        raise Refused("UnexpectedToken", f"{e.kind} is no value here")

    def condition(self, e: Node) -> Column:
        """A condition that is absent is false; one that is no boolean is refused."""
        c = self.column(e)
        t = self.type(c)
        if isinstance(t, T.NullType):
            return F.lit(False)
        if not isinstance(t, T.BooleanType):
            raise Refused("NotACondition", same_kind(t))
        return F.coalesce(c, F.lit(False))

    def _lit(self, e: Node) -> Column:
        if e.type == "none":
            return F.lit(None)
        if e.type == "duration":
            return F.expr(f"interval '{e.value / 1_000_000:.6f}' second")
        if e.type == "datetime":
            return F.to_timestamp(F.lit(e.value)).cast("timestamp_ntz")
        if e.type == "decimal":
            d = Decimal(e.value)
            return F.lit(d).cast(f"decimal(38,{max(0, -d.as_tuple().exponent)})")
        return literal(e.value)

    def _path(self, e: Node) -> Column:
        if e.steps == ["id"] and self.identity and self.identity in self.df.columns:
            return F.col(f"`{self.identity}`")
        return self.path(e.steps)

    def _param(self, e: Node) -> Column:
        if e.name in self.values:
            c = self.values[e.name]
        elif e.name in self.session.params:
            c = literal(self.session.params[e.name])
        else:
            raise Refused("NoSuchParameter", e.name)
        if not e.path:
            return c
        found = self.into(c, self.type(c), e.path)
        return F.lit(None) if found is None else found[0]

    def _into(self, e: Node) -> Column:
        c = self.column(e.a)
        found = self.into(c, self.type(c), e.path)
        return F.lit(None) if found is None else found[0]

    def _array(self, e: Node) -> Column:
        return F.array(*(self.column(x) for x in e.items)) if e.items else F.array()

    def _set(self, e: Node) -> Column:
        return F.sort_array(F.array_distinct(self._array(e)))

    def _object(self, e: Node) -> Column:
        fields = [self.column(v).alias(k) for k, v in e.fields]
        return F.struct(*fields) if fields else F.expr("map()")

    def _geometry(self, e: Node) -> Column:
        from ..operators.geometry import parse as shape

        text = json.dumps(self.session.constant(e.shape))
        try:
            shape(text)
        except (ValueError, KeyError, TypeError) as x:
            raise Refused("NoShape", str(x)) from None
        return F.lit(text)

    def _range(self, e: Node) -> Column:
        return F.struct(self.column(e.a).alias("low"), self.column(e.b).alias("high"), F.lit(e.closed).alias("closed"))

    def _record(self, e: Node) -> Column:
        return record(e.table, self.column(e.id))

    def _if(self, e: Node) -> Column:
        return F.when(self.condition(e.c), self.column(e.a)).otherwise(self.column(e.b))

    def _coalesce(self, e: Node) -> Column:
        return F.coalesce(self.column(e.a), self.column(e.b))

    def _and(self, e: Node) -> Column:
        return self.condition(e.a) & self.condition(e.b)

    def _or(self, e: Node) -> Column:
        return self.condition(e.a) | self.condition(e.b)

    def _not(self, e: Node) -> Column:
        return ~self.condition(e.a)

    def _neg(self, e: Node) -> Column:
        return -self.column(e.a)

    def _arith(self, e: Node) -> Column:
        a, b = self.operand(e.a), self.operand(e.b)
        s, t = self.type(a), self.type(b)
        if isinstance(s, T.NullType) or isinstance(t, T.NullType):
            return F.lit(None)
        ks, kt = same_kind(s), same_kind(t)
        if ks == kt == "datetime" and e.op == "-":
            return F.make_dt_interval(secs=((micros(a) - micros(b)) / 1_000_000).cast("decimal(18,6)"))
        if {ks, kt} == {"duration", "number"} and e.op in "*/":
            us = (duration_micros(a) * b if e.op == "*" else duration_micros(a) / b) if ks == "duration" else duration_micros(b) * a
            return F.make_dt_interval(secs=(us / 1_000_000).cast("decimal(18,6)"))
        if ks == "string" and kt == "string" and e.op == "+":
            return F.concat(a, b)
        if (ks, kt) not in (("number", "number"), ("datetime", "duration"), ("duration", "datetime"), ("duration", "duration")):
            raise Refused("CannotCompute", f"{ks} {e.op} {kt}")
        if e.op == "/":
            whole = not any(isinstance(x, (T.DoubleType, T.FloatType)) for x in (s, t))
            return a.cast("decimal(38,10)") / b.cast("decimal(28,6)") if whole else a / b
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b}[e.op]()

    def operand(self, e: Node) -> Column:
        """A read of one named value stands for that value; several rows are refused."""
        if e.kind == "subquery" and e.read.kind == "select" and not e.read.star and len(e.read.items) == 1:
            d = plan(self.session, e.read)
            return d.limit(2).agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a read that stands for a value has several rows"))).otherwise(F.first(d.columns[0]))).scalar()
        return self.column(e)

    def _subquery(self, e: Node) -> Column:
        """The rows as an array of objects; one object, or nothing, of ONLY."""
        d = plan(self.session, e.read)
        if e.read.only:
            return d.agg(F.first(F.struct("*"))).scalar()
        return d.agg(F.when(F.count(F.lit(1)) > MOST_VALUES, F.raise_error(F.lit("a read in an expression has too many rows"))).otherwise(F.collect_list(F.struct("*")))).scalar()

    def _get(self, e: Node) -> Column:
        return literal(self.session.space(e.key.table).get(self.session.constant(e.key.id)))

    def _ttl(self, e: Node) -> Column:
        us = self.session.space(e.key.table).ttl(self.session.constant(e.key.id), self.session.now())
        return F.lit(None) if us is None else F.expr(f"interval '{us / 1_000_000:.6f}' second")

    # ---- comparisons: two-valued

    def _cmp(self, e: Node) -> Column:
        for a, b in ((e.a, e.b), (e.b, e.a)):
            if a.kind == "path" and a.steps == ["id"] and b.kind == "record":  # the identity is compared with a record's
                return self.compare(e.op if a is e.a else _MIRROR[e.op], self.column(a), self.column(b.id))
        arrays = [x.kind in ("array", "object", "param", "set") or (x.kind == "subquery") for x in (e.a, e.b)]
        a, b = (self.column(x) if arrays[1 - i] and x.kind == "subquery" and (e.b, e.a)[i].kind in ("array", "object", "set") else self.operand(x) for i, x in enumerate((e.a, e.b)))
        if e.a.kind == "path" and None in e.a.steps:
            return self.any_element(a, lambda x: self.compare(e.op, x, b, element=True))
        return self.compare(e.op, a, b)

    def any_element(self, a: Column, test: Callable[[Column], Column]) -> Column:
        t = self.type(a)
        if not isinstance(t, T.ArrayType):
            return F.lit(False)
        self._element = t.elementType
        return F.coalesce(F.exists(a, test), F.lit(False))

    def compare(self, op: str, a: Column, b: Column, element: bool = False) -> Column:
        s, t = (self._element if element else self.type(a)), self.type(b)
        if isinstance(s, T.NullType) or isinstance(t, T.NullType):
            both = a.isNull() if isinstance(t, T.NullType) else b.isNull()
            return both if op == "=" else ~both if op == "!=" else F.lit(False)
        if isinstance(s, T.VariantType) != isinstance(t, T.VariantType):
            known = t if isinstance(s, T.VariantType) else s
            to = "double" if isinstance(known, T.NumericType) else known.simpleString()
            a = F.try_variant_get(a, F.lit("$"), to) if isinstance(s, T.VariantType) else a
            b = F.try_variant_get(b, F.lit("$"), to) if isinstance(t, T.VariantType) else b
            s = t = known
        if isinstance(s, T.VariantType):
            a, b, s, t = a.cast("string"), b.cast("string"), T.StringType(), T.StringType()
        ks, kt = same_kind(s), same_kind(t)
        if ks == kt == "datetime":
            a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
        if ks == kt in ("array", "object"):
            if op in ("=", "!="):
                try:
                    self.df.select(a.eqNullSafe(b)).schema
                except Exception:  # noqa: BLE001 - arrays or objects of other fields are never equal
                    a, b = F.to_json(a), F.to_json(b)
                if ks == "object" and isinstance(s, T.StructType) and isinstance(t, T.StructType) and s.fieldNames() != t.fieldNames():
                    a, b = (call("json::encode", x, of=self.df) for x in (a, b))
        elif ks != kt and not (isinstance(s, T.NumericType) and isinstance(t, T.NumericType)):
            there = a.isNotNull() & b.isNotNull()
            if op in ("=", "!="):
                same = a.isNull() & b.isNull()
                return same if op == "=" else ~same
            less = _RANK.get(ks, 99) < _RANK.get(kt, 99)
            return there & F.lit(less if op in ("<", "<=") else not less)
        if op == "=":
            return a.eqNullSafe(b)
        if op == "!=":
            return ~a.eqNullSafe(b)
        return F.coalesce({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], F.lit(False))

    def _in(self, e: Node) -> Column:
        if e.b.kind == "subquery":
            d = plan(self.session, e.b.read)
            if len(d.columns) != 1:
                raise Refused("OneValueWanted", "IN (SELECT ...) has one value a row")
            c = d.columns[0]
            values = d.select(c).distinct().agg(F.when(F.count(F.lit(1)) > MOST_VALUES, F.raise_error(F.lit("a read in an expression has too many values"))).otherwise(F.collect_list(F.struct(F.col(c).alias("v"))))).scalar()
            a = self.column(e.a)
            self._element = d.schema[c].dataType
            kinds = self.type(a), d.schema[c].dataType
            if isinstance(kinds[0], T.NullType):
                return F.exists(values, lambda x: x["v"].isNull())
            if same_kind(kinds[0]) != same_kind(kinds[1]):
                return F.lit(False)
            return F.coalesce(F.exists(values, lambda x: x["v"].eqNullSafe(a)), F.lit(False))
        if e.b.kind in ("array", "set"):
            a = self.column(e.a)
            return reduce(lambda x, y: x | y, (self.compare("=", a, self.column(x)) for x in e.b.items), F.lit(False))
        if e.b.kind == "range":
            a = self.column(e.a)
            return self.compare(">=", a, self.column(e.b.a)) & self.compare("<=" if e.b.closed else "<", a, self.column(e.b.b))
        return self.contains(self.column(e.b), self.column(e.a))

    def contains(self, whole: Column, part: Column) -> Column:
        w, p = self.type(whole), self.type(part)
        if isinstance(w, T.ArrayType):
            if isinstance(p, T.NullType):
                return F.coalesce(F.exists(whole, lambda x: x.isNull()), F.lit(False))
            if same_kind(w.elementType) != same_kind(p):
                return F.lit(False)
            return F.coalesce(F.exists(whole, lambda x: x.eqNullSafe(part)), F.lit(False))
        if isinstance(w, T.StringType) and isinstance(p, T.StringType):
            return F.coalesce(F.contains(whole, part), F.lit(False))
        if isinstance(w, T.StructType) and isinstance(p, T.StructType):
            tests = [self.contains(whole[f.name], part[f.name]) if isinstance(f.dataType, T.StructType) else self.compare("=", whole[f.name], part[f.name]) for f in p.fields if f.name in w.fieldNames()]
            return reduce(lambda a, b: a & b, tests, F.lit(len(tests) == len(p.fields)))
        if isinstance(w, T.VariantType) and isinstance(p, T.StructType):
            tests = [self.compare("=", F.try_variant_get(whole, F.lit(f"$['{f.name}']"), "variant"), part[f.name]) for f in p.fields]
            return reduce(lambda a, b: a & b, tests, F.lit(True))
        return F.lit(False)

    def _contains(self, e: Node) -> Column:
        return self.contains(self.column(e.a), self.column(e.b))

    def _like(self, e: Node, insensitive: bool = False) -> Column:
        a, b = self.column(e.a), self.column(e.b)
        if not isinstance(self.type(a), T.StringType) or not isinstance(self.type(b), T.StringType):
            return F.lit(False)
        pattern = self.session.constant(e.b)
        return F.coalesce(a.ilike(pattern) if insensitive else a.like(pattern), F.lit(False))

    def _ilike(self, e: Node) -> Column:
        return self._like(e, True)

    def _matches(self, e: Node) -> Column:
        """Text of a field that has an analyzer; other values match nothing."""
        analyzer = self.session.analyzer_of(self.table, e.a.steps if e.a.kind == "path" else None)
        c = self.column(e.a)
        query = self.session.constant(e.b)
        if not isinstance(query, str):
            return F.lit(False)
        try:
            S.parse(analyzer or S.Analyzer(), query, e.mode)
        except S.BadQuery as x:
            raise Refused("PrefixTooShort" if "letters" in str(x) else "MalformedSlop", str(x)) from None
        if analyzer is None or not isinstance(self.type(c), T.StringType):
            return F.lit(False)
        return S.matches(analyzer, c, query, e.mode)

    # ---- calls

    def _call(self, e: Node) -> Column:
        f = REGISTRY.get(e.name)
        if f is None:
            raise Refused("NoSuchFunction", e.name)
        if not f.least <= len(e.args) <= f.most:
            raise Refused("WrongArity", f"{e.name} takes {f.least} to {f.most}")
        if e.name.startswith("search::"):
            return self.search_call(e)
        if e.name == "session::context":
            return F.struct(F.lit("spark").alias("node"), F.lit(self.session.namespace).alias("namespace"), F.lit(self.session.database).alias("database"))
        if e.name == "time::now":
            return literal(self.session.now())
        args = [self.column(a) for a in e.args]
        types = [self.type(a) for a in args]
        if any(isinstance(t, T.NullType) for t in types):
            if e.name == "type::of":
                return F.lit("none")
            if e.name.startswith("vector::") or e.name == "geo::distance":
                return F.lit(float("inf"))
            if e.name not in ("array::append", "scores::between", "array::index_of"):
                return F.lit(None)
        wanted = _WANTED.get(e.name.partition("::")[0])
        if wanted and types and e.name not in _LOOSE and not isinstance(types[0], T.NullType) and same_kind(types[0]) not in wanted:
            raise Refused("CallFailed", f"{e.name} of {same_kind(types[0])}")
        if e.name == "object::merge" and all(isinstance(t, T.StructType) for t in types):  # structs keep their fields' types
            names = sorted({n for t in types for n in t.fieldNames()})
            return F.struct(*((args[1][n] if n in types[1].fieldNames() else args[0][n]).alias(n) for n in names))
        try:
            return call(e.name, *args, of=self.df)
        except ValueError as x:
            raise Refused("CallFailed", str(x)) from None

    def search_call(self, e: Node) -> Column:
        name = e.name.partition("::")[2]
        if name in ("score", "explain") and not e.args and name in self.df.columns:
            return F.col(name)
        if name == "table_name" and "table_name" in self.df.columns:
            return F.col("table_name")
        if name == "snippet" and "snippet" in self.df.columns:
            return F.col("snippet")
        if name == "ranks" and "ranks" in self.df.columns:
            return F.col("ranks")
        if name == "highlight" and "highlight" in self.session.bound:
            analyzer, query, mode = self.session.bound["highlight"]
            return S.highlight(analyzer, self.column(e.args[0]), query, mode)
        raise Refused("NoSearch", f"{e.name} is asked of a read that doesn't search")

    def _fold(self, e: Node) -> Column:
        """A fold over the group."""
        kinds = [self.type(self.column(a)) for a in e.args]
        args = [self.column(a) for a in e.args]
        if e.name == "count":
            return F.count(F.lit(1)) if e.star else F.count_distinct(args[0]) if e.distinct else F.count(args[0])
        if not args:
            raise Refused("WrongArity", f"{e.name} folds something")
        x, number = args[0], isinstance(kinds[0], T.NumericType)
        if e.name in ("sum", "mean", "variance", "stddev", "median", "approx_quantile") and not number:
            return F.max(F.lit(0).cast("long")) if e.name == "sum" else F.max(F.lit(None).cast("double"))
        order = F.col(f"`{self.identity}`") if self.identity in self.df.columns else F.monotonically_increasing_id()
        return {
            "sum": lambda: A.total(x), "mean": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "variance": lambda: F.var_samp(x), "stddev": lambda: F.stddev_samp(x), "median": lambda: F.median(x),
            "collect": lambda: A.collect(x, order), "approx_distinct": lambda: F.approx_count_distinct(x.cast("string"), 0.0081), "approx_quantile": lambda: F.percentile_approx(x, float(self.session.constant(e.args[1])), 10000).cast("double"),
            "increase": lambda: _counter(x, args[1], order)["increase"], "rate": lambda: _counter(x, args[1], order)["rate"], "delta": lambda: _counter(x, args[1], order)["delta"],
        }[e.name]()

    def windowed(self, e: Node) -> Column:
        part = [self.column(x) for x in e.partition] or [F.lit(0)]
        keys = [ordered(self.column(x), up, nulls) for x, up, nulls in e.order]
        tie = [F.col(f"`{self.identity}`")] if self.identity in self.df.columns else []
        w = Window.partitionBy(*part)
        full = w.orderBy(*keys, *tie) if keys or tie else w.orderBy(F.monotonically_increasing_id())
        args = [self.column(a) for a in e.args]
        if e.name == "row_number":
            return F.row_number().over(full).cast("long")
        if e.name in ("rank", "dense_rank"):
            f = F.rank() if e.name == "rank" else F.dense_rank()
            return f.over(w.orderBy(*keys) if keys else w.orderBy(F.lit(0))).cast("long")
        if e.name in ("lag", "lead"):
            n = int(self.session.constant(e.args[1])) if len(args) > 1 else 1
            v = (F.lag if e.name == "lag" else F.lead)(args[0], n).over(full)
            if len(args) < 3:
                return v
            there = (F.lag if e.name == "lag" else F.lead)(F.lit(1), n).over(full)
            return F.when(there.isNotNull(), v).otherwise(args[2])
        if e.name == "first_value":
            return F.first(args[0]).over(full.rowsBetween(Window.unboundedPreceding, 0))
        if e.name == "last_value":
            return F.last(args[0]).over(full.rowsBetween(Window.unboundedPreceding, 0 if keys else Window.unboundedFollowing))
        if e.name not in ("count", "sum", "mean", "min", "max"):
            raise Refused("NoWindowOf", e.name)
        frame = full.rowsBetween(Window.unboundedPreceding, 0) if keys else w
        f = {"count": lambda: F.count(F.lit(1)) if e.star else F.count(args[0]), "sum": lambda: F.sum(args[0]), "mean": lambda: F.avg(args[0]), "min": lambda: F.min(args[0]), "max": lambda: F.max(args[0])}[e.name]()
        return F.coalesce(f.over(frame), F.lit(0)) if e.name == "sum" else f.over(frame)


_MIRROR = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_WANTED = {"string": ("string",), "math": ("number",), "array": ("array",), "object": ("object", "any", "record"), "set": ("array",), "time": ("datetime",), "geo": ("string",), "crypto": ("string",)}
_LOOSE = frozenset(("time::from_unix",))


def _counter(v: Column, at: Column, order: Column) -> Column:
    """increase, rate and delta of a group's samples, sorted by instant: a fall begins again from zero."""
    us = micros(at)
    rows = F.sort_array(F.collect_list(F.when(v.isNotNull() & at.isNotNull(), F.struct(us.alias("t"), order.alias("o"), v.cast("double").alias("v")))))
    first, last, n = F.get(rows, F.lit(0)), F.try_element_at(rows, F.lit(-1)), F.size(rows)
    rise = F.aggregate(rows, F.struct(F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("s")), lambda a, x: F.struct(x["v"].alias("p"), (a["s"] + F.when(a["p"].isNull(), 0.0).when(x["v"] >= a["p"], x["v"] - a["p"]).otherwise(x["v"])).alias("s")), lambda a: a["s"])
    seconds = (last["t"] - first["t"]) / 1e6
    two = n >= 2
    return F.struct(F.when(two, rise).alias("increase"), F.when(two & (seconds > 0), rise / seconds).alias("rate"), F.when(two, last["v"] - first["v"]).alias("delta"))


def ordered(c: Column, up: bool, nulls: str | None) -> Column:
    """Absences are lowest, unless they are moved."""
    first = (nulls == "FIRST") if nulls else up
    return (c.asc_nulls_first() if first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if first else c.desc_nulls_last())


# ---- reads


def plan(session: Session, r: Node) -> DataFrame:
    """The DataFrame of a read."""
    return shaped(session, r)[0]


def shaped(session: Session, r: Node) -> tuple[DataFrame, str | None]:
    if r.kind == "compound":
        return compound(session, r), None
    return one_read(session, r)


def compound(session: Session, r: Node) -> DataFrame:
    def aligned(d: DataFrame, names: list[str]) -> DataFrame:
        if sorted(d.columns) != sorted(names):
            raise Refused("BranchesDiffer", f"{names} and {d.columns}")
        return d.select(*names)

    first = plan(session, r.first)
    rest = [(op.lower(), aligned(plan(session, x), first.columns)) for op, x in r.rest]
    d = J.combine(first, *rest)
    if r.order:
        sc = Scope(session, d, None)
        keys = []
        for e, up, nulls in r.order:
            c = F.col(d.columns[e.value - 1]) if e.kind == "lit" and e.type == "int" else sc.column(e)
            keys.append(ordered(c, up, nulls))
        d = d.orderBy(*keys, *(F.col(f"`{c}`") for c in d.columns))
    return paged(session, d, r)


def paged(session: Session, d: DataFrame, s: Node) -> DataFrame:
    if s.start is not None:
        d = d.offset(int(session.number(s.start)))
    if s.limit is not None and s.limit != "ALL":
        d = d.limit(int(session.number(s.limit)))
    return d


def source(session: Session, s: Node, where: Node | None, version: int | None) -> Scope:
    """The rows of a source that meet the condition."""
    kind = s.kind
    if kind in ("table", "row", "span"):
        df, identity = session.frame(s.name, version)
        sc = Scope(session, df, identity, s.name)
        i = F.col(f"`{identity}`")
        if kind == "row":
            df = df.where(sc.compare("=", i, sc.column(s.id)))
        elif kind == "span":
            df = df.where(sc.compare(">=", i, sc.column(s.low)) & sc.compare("<=" if s.closed else "<", i, sc.column(s.high)))
    elif kind == "from_param":
        v = session.params.get(s.name)
        if not isinstance(v, list):
            raise Refused("NotASource", s.name)
        df, identity = session.rows(v), None
    elif kind == "sub":
        df, identity = shaped(session, s.read)
        if s.where is not None:
            df = df.where(Scope(session, df, identity).condition(s.where))
    elif kind == "join":
        df, identity = joined(session, s, version)
    elif kind == "walk":
        df, identity = session.walked(s)
    else:
        return searched(session, s, where)
    sc = Scope(session, df, identity, getattr(s, "name", None) if kind in ("table", "row", "span") else None)
    return sc.with_(filtered(sc, where)) if where is not None else sc


def filtered(sc: Scope, where: Node) -> DataFrame:
    """Membership in a read becomes a semi or anti join; the other conditions a filter."""
    df, rest = sc.df, []
    todo = [where]
    while todo:
        e = todo.pop(0)
        if e.kind == "and":
            todo = [e.a, e.b, *todo]
            continue
        inner, how = (e.a, "left_anti") if e.kind == "not" else (e, "left_semi")
        if inner.kind == "in" and inner.b.kind == "subquery":
            d = plan(sc.session, inner.b.read)
            a = sc.column(inner.a)
            if len(d.columns) == 1 and same_kind(sc.type(a)) == same_kind(d.schema[0].dataType):
                v = d.select(F.col(d.columns[0]).alias("_value"))
                df = df.withColumn("_asked", a).join(v, F.col("_asked").eqNullSafe(F.col("_value")), how).drop("_asked")
                continue
        rest.append(e)
    for e in rest:
        df = df.where(sc.condition(e))
    return df


def side_frame(session: Session, s: Node, version: int | None) -> tuple[str, DataFrame, str | None]:
    if s.kind == "table":
        df, identity = session.frame(s.name, version)
        name = s.alias or s.name
    elif s.kind == "sub":
        df, identity = shaped(session, s.read)
        name = s.alias or s.alias_of
        if name is None:
            raise Refused("UnnamedSide", "a read in a join has a name")
    else:
        raise Refused("UnexpectedToken", "a side of a join is a table or a read")
    return name, df, identity


def joined(session: Session, s: Node, version: int | None) -> tuple[DataFrame, str | None]:
    """Rows of named sides, {left: {..}, right: {..}}; an unmatched side is absent. The identity is the left's."""
    sides: list[str] = []

    def one(n: Node) -> tuple[DataFrame, str | None]:
        if n.kind == "join":
            return both(n)
        name, df, identity = side_frame(session, n, version)
        if name in sides:
            raise Refused("OneSidedJoin", name)
        sides.append(name)
        i = F.col(f"`{identity}`") if identity else F.lit(None).cast("string")
        return df.select(F.struct("*").alias(name), i.alias("_id")), name

    def both(n: Node) -> tuple[DataFrame, str | None]:
        left, _ = one(n.left)
        known = list(sides)
        right, rname = one(n.right)
        right = right.drop("_id") if n.how != "right" else right
        a, b = (n.a, n.b) if n.b.steps[0] == rname else (n.b, n.a)
        if a.steps[0] not in known or b.steps[0] != rname:
            raise Refused("OneSidedJoin", "one equality of both sides")
        ls, rs = Scope(session, left, None), Scope(session, right, None)
        x, y = ls.column(a), rs.column(b)
        t, u = ls.type(x), rs.type(y)
        if n.how == "asof":
            return asof(session, n, left, right, known[0], rname, a, b), None
        if isinstance(t, T.NullType) or isinstance(u, T.NullType):
            x = y = None
        elif same_kind(t) != same_kind(u):
            raise Refused("JoinKeysDiffer", f"{same_kind(t)} and {same_kind(u)}")
        lk = left.withColumn("_k", x if x is not None else F.lit(None).cast("string"))
        rk = right.withColumn("_r", y if y is not None else F.lit(None).cast("string"))
        on = F.col("_k") == F.col("_r")
        if n.how == "right":
            out = rk.withColumnRenamed("_id", "_rid").join(lk.drop("_id"), on, "left").withColumnRenamed("_rid", "_id")
        else:
            out = lk.join(rk, on, n.how)
        return out.drop("_k", "_r"), None

    df, _ = both(s)
    return df, "_id"


def asof(session: Session, n: Node, left: DataFrame, right: DataFrame, lname: str, rname: str, a: Node, b: Node) -> DataFrame:
    lt, rt = session.event_time(n.left), session.event_time(n.right)
    ls, rs = Scope(session, left, None), Scope(session, right, None)
    l2 = left.withColumns({"_key": ls.column(a), "_time": ls.path([lname, lt])})
    r2 = right.select(F.col(rname), rs.column(b).alias("_key"), rs.path([rname, rt]).alias("_time"))
    out = J.asof_join(l2, r2, "_key", "_time", [rname], prefix="_r_")
    return out.withColumnRenamed(f"_r_{rname}", rname).drop("_key", "_time", "_r__time")


def searched(session: Session, s: Node, where: Node | None) -> Scope:
    members, analyzer, synonyms, stops = session.search(s.name)
    if s.complete is not None:
        words = [S.vocabulary(m.rows, list(m.fields), analyzer, analyzer.fold(s.complete, False)) for m in members]
        d = reduce(DataFrame.unionByName, words).groupBy("term").agg(F.sum("documents").alias("documents"))
        return Scope(session, d.orderBy(F.desc("documents"), "term"), None)
    query = session.constant(s.query)
    try:
        hits = S.rank(members, analyzer, query, s.mode, synonyms, stops)
        session.bound["highlight"] = (analyzer, query, s.mode)
        q = S.parse(analyzer, query, s.mode, synonyms, stops)
    except S.BadQuery as x:
        raise Refused("PrefixTooShort" if "letters" in str(x) else "MalformedSlop", str(x)) from None
    hits = hits.withColumn("id", F.col("id").cast("string"))
    parts = []
    for m in members:
        field = max(m.fields, key=m.fields.get)
        marks = S._window(analyzer, q)(F.col(field))
        snippet = F.when(marks["start"].isNotNull(), F.struct(F.lit(field).alias("field"), marks["start"].alias("start"), marks["end"].alias("end"))).alias("snippet")
        rows = m.rows.select(F.col(m.identity).cast("string").alias("_hit"), *[c for c in m.rows.columns if c != m.identity], snippet)
        parts.append(hits.where(F.col("table_name") == m.name).join(rows, F.col("id") == F.col("_hit")).drop("_hit"))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sc = Scope(session, df, "id", members[0].name)
    if where is not None:
        sc = sc.with_(filtered(sc, where))
    sc.hidden = ["table_name", "score", "explain", "snippet"]
    return sc


def one_read(session: Session, s: Node) -> tuple[DataFrame, str | None]:
    session.bound = {}
    version = None if s.version is None else session.number(s.version)
    sc = source(session, s.source, s.where, version)
    hidden = [*getattr(sc, "hidden", ["ranks"]), "_id"]
    ranked_search = s.source.kind == "search" and s.source.complete is None
    for route in s.fetch or []:
        sc = sc.with_(session.fetched(sc, route))
    if s.split is not None:
        head = s.split[0]
        if len(s.split) == 1 and head in sc.df.columns and isinstance(sc.df.schema[head].dataType, T.ArrayType):
            sc = sc.with_(J.split_on(sc.df, head))
    if s.latest is not None:
        at = session.event_time(s.source)
        d = sc.df.withColumn("_latest", sc.path(s.latest))
        sc = sc.with_(A.latest_by(d, "_latest", at, sc.identity).drop("_latest"))
    items = list(s.items)
    folds = [x for _, e in items for x in e.walk() if x.kind == "fold"] + [x for e in ([s.having] if s.having else []) + [k[0] for k in s.order or []] for x in e.walk() if x.kind == "fold"]
    wins = [x for _, e in items for x in e.walk() if x.kind == "window"] + [x for k in s.order or [] for x in k[0].walk() if x.kind == "window"]
    if wins and (s.group or folds or s.fuse):
        raise Refused("WindowBesideGroups")
    scores = [x for _, e in items for x in e.walk() if x.kind == "call" and x.name in ("search::score", "search::explain") and x.args]
    scores += [x for e in [k[0] for k in s.order or []] + [b[0] for b in s.fuse or []] + ([s.where] if s.where else []) for x in e.walk() if x.kind == "call" and x.name in ("search::score", "search::explain") and x.args]
    if scores:
        sc = session.scored(sc, scores)
        hidden += [c for c in sc.df.columns if c.startswith("_score")]
    if any(x.kind == "call" and x.name == "search::highlight" for _, e in items for x in e.walk()) and "highlight" not in session.bound:
        asked = [x for x in (s.where.walk() if s.where else []) if x.kind == "matches"]
        if asked:
            session.bound["highlight"] = (session.analyzer_of(sc.table, asked[0].a.steps), session.constant(asked[0].b), asked[0].mode)
    if wins:
        names = {w: f"_win{i}" for i, w in enumerate(dict.fromkeys(wins))}
        d = sc.df.withColumns({n: sc.windowed(w) for w, n in names.items()})
        hidden += list(names.values())
        sc = sc.with_(d, sc.known | {w: F.col(n) for w, n in names.items()})
    if s.fuse:
        return fused(session, s, sc, items, hidden)
    if folds or s.group:
        return grouped(session, s, sc, items, folds), None
    return projected(session, s, sc, items, hidden, ranked_search)


def projected(session: Session, s: Node, sc: Scope, items: list, hidden: list[str], ranked_search: bool) -> tuple[DataFrame, str | None]:
    named = dict(items)
    keys = []
    for e, up, nulls in s.order or []:
        e = named[e.steps[0]] if e.kind == "path" and len(e.steps) == 1 and e.steps[0] in named else e
        keys.append((e, up, nulls))
    tie = [F.col(f"`{sc.identity}`").asc()] if sc.identity and sc.identity in sc.df.columns else []
    d = sc.df
    if s.after is not None:
        d = after(session, sc, keys, s.after)
    if keys:
        d = d.orderBy(*(ordered(sc.column(e), up, nulls) for e, up, nulls in keys), *tie)
    elif ranked_search:
        d = d.orderBy(F.desc("score"), *tie)
    elif (s.limit is not None or s.start is not None) and tie:
        d = d.orderBy(*tie)
    d = paged(session, d, s)
    out = [(n, sc.column(e)) for n, e in items]
    if s.star:
        rest = [c for c in sc.df.columns if c not in hidden and c not in named]
        cols = [F.col(f"`{c}`") for c in rest] + [c.alias(n) for n, c in out]
    else:
        cols = [c.alias(n) for n, c in out]
    identity = sc.identity if sc.identity and (s.star or sc.identity in named) and sc.identity not in hidden else None
    d = d.select(*cols)
    d = no_void(d)
    for route in s.omit or []:
        d = J.omit(d, ".".join(map(str, route)))
    return (J.only(d) if s.only else d), identity


def no_void(d: DataFrame) -> DataFrame:
    """A value that reaches nothing is an absent text: a frame has no columns without a type."""
    bad = [f.name for f in d.schema.fields if isinstance(f.dataType, T.NullType)]
    return d.withColumns({c: F.lit(None).cast("string") for c in bad}) if bad else d


def after(session: Session, sc: Scope, keys: list, anchor: Node) -> DataFrame:
    """Rows after a record in the answer's order."""
    i = F.col(f"`{sc.identity}`")
    at = sc.df.where(sc.compare("=", i, sc.column(anchor.id)))
    cols = {f"_k{n}": sc.column(e) for n, (e, _, _) in enumerate(keys)}
    rows = at.select(*(c.alias(n) for n, c in cols.items()), i.alias("_i")).limit(1).collect()
    if not rows:
        raise Refused("Unknown", f"no record {anchor.table}")
    d = sc.df.withColumns(cols) if cols else sc.df
    order = [(n, up) for n, (_, up, _) in zip(cols, keys)] + [(sc.identity, True)]
    return J.after(d, order, tuple(rows[0][n] for n in cols) + (rows[0]["_i"],))


def fused(session: Session, s: Node, sc: Scope, items: list, hidden: list[str]) -> tuple[DataFrame, str | None]:
    if sc.identity is None:
        raise Refused("NoIdentity", "what is fused has an identity")
    d = sc.df.withColumns({f"_b{i}": sc.column(e) for i, (e, _, _) in enumerate(s.fuse)})
    branches = [(ordered(F.col(f"_b{i}"), up, None), float(w)) for i, (_, up, w) in enumerate(s.fuse)]
    narrow = d.select(sc.identity, *(f"_b{i}" for i in range(len(branches))))
    best = J.fuse(narrow, branches, sc.identity, int(s.depth)).withColumnRenamed("score", "_fused")
    ranks = J.ranks(narrow, branches, sc.identity, int(s.depth))
    d = sc.df.drop("ranks").join(best.join(ranks, sc.identity), sc.identity)
    sc = sc.with_(d)
    d = paged(session, d.orderBy(F.desc("_fused"), sc.identity), s)
    named = dict(items)
    rest = [F.col(f"`{c}`") for c in d.columns if c not in (*hidden, "_fused", "ranks") and c not in named] if s.star else []
    return no_void(d.select(*rest, *(sc.column(e).alias(n) for n, e in items))), sc.identity if s.star else None


def grouped(session: Session, s: Node, sc: Scope, items: list, folds: list[Node]) -> DataFrame:
    if s.star:
        raise Refused("StarBesideGroups")
    named = dict(items)
    # a group may be named by a projection's alias
    group = [named[e.steps[0]] if e.kind == "path" and len(e.steps) == 1 and e.steps[0] in named and e.steps[0] not in sc.df.columns else e for e in s.group or []]
    keys = {e: f"_k{i}" for i, e in enumerate(dict.fromkeys(group))}
    names = {f: f"_f{i}" for i, f in enumerate(dict.fromkeys(folds))}
    aggs = [sc.column(f).alias(n) for f, n in names.items()]
    if not keys:
        d = A.fold_all(sc.df, *aggs)
    else:
        d = sc.df.groupBy(*(_typed(sc.column(e), sc).alias(n) for e, n in keys.items()))
        d = d.agg(*aggs) if aggs else d.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    if s.fill is not None:
        d = filled(session, s, sc, d, keys, names)
    known = {e: F.col(n) for e, n in keys.items()} | {f: F.col(n) for f, n in names.items()}
    g = Scope(session, d, None, sc.table, known)
    for n, e in items:
        loose = [x for x in _outside(e, known) if x.kind == "path"]
        if loose:
            raise Refused("NotGrouped", f"{n} is neither a key nor a fold")
    by_name = Scope(session, d.withColumns({n: g.column(e) for n, e in items}), None, sc.table, known)
    d = by_name.df
    if s.having is not None:
        d = d.where(by_name.condition(s.having))
    if s.order:
        d = d.orderBy(*(ordered(by_name.column(e), up, nulls) for e, up, nulls in s.order), *(F.col(n) for n in keys.values()))
    elif s.limit is not None or s.start is not None:
        d = d.orderBy(*(F.col(n) for n in keys.values())) if keys else d
    d = no_void(paged(session, d, s).select(*(F.col(f"`{n}`") for n, _ in items)))
    return J.only(d) if s.only else d


def _typed(c: Column, sc: Scope) -> Column:
    return c.cast("string") if isinstance(sc.type(c), T.NullType) else c


def _outside(e: Node, known: dict):
    """The parts of an expression that are not within a part known already."""
    if e in known:
        return
    yield e
    for v in e.__dict__.values():
        for x in v if isinstance(v, (list, tuple)) else [v]:
            for y in x if isinstance(x, tuple) else [x]:
                if isinstance(y, Node) and y.kind not in ("select", "compound"):
                    yield from _outside(y, known)


def filled(session: Session, s: Node, sc: Scope, d: DataFrame, keys: dict[Node, str], names: dict[Node, str]) -> DataFrame:
    buckets = [e for e in keys if e.kind == "call" and e.name == "time::bucket"]
    if len(buckets) != 1:
        raise Refused("FillWithoutBucket", "FILL has exactly one time::bucket key")
    seconds = session.micros(buckets[0].args[1]) // 1_000_000
    mode, start, stop = s.fill
    bound = lambda e: str(session.constant(e))
    how = mode.lower() if isinstance(mode, str) else session.constant(mode)
    values = {n: "count" if f.name in ("count", "approx_distinct") else how for f, n in names.items()}
    rest = [n for e, n in keys.items() if e is not buckets[0]]
    return A.fill_windows(d, rest, keys[buckets[0]], values, bound(start), bound(stop), int(seconds))
