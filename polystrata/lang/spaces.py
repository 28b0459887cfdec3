"""Key-value spaces: an append-only log of (key, value, expiry), the newest entry of a key being its value; lists, hashes, members and scores within values.

A point read filters the log by key before it takes the newest; the log is
compacted after COMPACT entries. Values are JSON texts.
"""

from __future__ import annotations

import json
import random
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .errors import Refused
from .parser import Node

if TYPE_CHECKING:
    from .session import Session
    from .store import Table

COMPACT = 64
SCHEMA = "key string, kind string, value string, expires long, seq long, gone boolean"


def at(items: list, i: int) -> int:
    return i + len(items) if i < 0 else i


class Space:
    def __init__(self, session: Session, table: Table):
        self.session, self.table = session, table

    def log(self) -> DataFrame:
        d = self.session.store.frame(self.table)
        return d if "key" in d.columns else self.session.spark.createDataFrame([], SCHEMA)

    def newest(self, d: DataFrame | None = None) -> DataFrame:
        """A row a key that has a value now."""
        w = Window.partitionBy("key").orderBy(F.desc("seq"))
        n = (self.log() if d is None else d).withColumn("_n", F.row_number().over(w)).where("_n = 1 and not gone").drop("_n")
        return n.where(F.col("expires").isNull() | (F.col("expires") > F.lit(self.session.now_micros())))

    def entry(self, key: object) -> tuple[Any, int | None] | None:
        rows = self.newest(self.log().where(F.col("key") == F.lit(str(key)))).select("value", "expires").collect()
        return (json.loads(rows[0]["value"]), rows[0]["expires"]) if rows else None

    def get(self, key: object) -> Any:
        found = self.entry(key)
        return None if found is None else found[0]

    def ttl(self, key: object, _now: object = None) -> int | None:
        found = self.entry(key)
        return None if found is None or found[1] is None else found[1] - self.session.now_micros()

    def put(self, key: object, value: Any, expires: int | None = None, gone: bool = False) -> None:
        kind = "int" if isinstance(key, int) else "string"
        most = self.table.options.get("max")
        if most is not None and not gone and self.entry(key) is None and self.newest().count() >= most:
            raise Refused("SpaceFull", str(most))
        self.session.store.number += 1
        row = [(str(key), kind, json.dumps(value, default=str), expires, self.session.store.number, gone)]
        self.session.store.append(self.table, self.session.spark.createDataFrame(row, SCHEMA).coalesce(1))
        if len(self.table.parts) > COMPACT:
            self.session.store.replace(self.table, self.newest())

    def edit(self, key: object, value: Any) -> None:
        """A new value under the old expiry; an empty container is no key."""
        found = self.entry(key)
        empty = value in ([], {})
        self.put(key, None if empty else value, found[1] if found else None, gone=empty)

    def keys(self, s: Node) -> list:
        d = self.newest()
        c = F.col("key")
        number = F.col("kind") == "int"
        order = F.when(number, F.col("key").try_cast("long"))
        const = lambda e: self.session.constant(e)

        def test(op: str, v: object):
            whole = isinstance(v, int)
            x = {">": order > v, ">=": order >= v, "<": order < v, "<=": order <= v}[op] if whole else {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
            return (number & x) if whole else (~number & x)

        if s.range:
            a, b, closed = s.range
            d = d.where(test(">=", const(a)) & test("<=" if closed else "<", const(b)))
        if s.prefix is not None:
            d = d.where(~number & F.startswith(c, F.lit(s.prefix)))
        if s.after is not None:
            v = const(s.after)
            d = d.where(test(">", v) | ~number if isinstance(v, int) else test(">", v))
        d = d.orderBy(F.desc(number), order, "key")
        if s.limit is not None:
            d = d.limit(int(self.session.number(s.limit)))
        return [int(r["key"]) if r["kind"] == "int" else r["key"] for r in d.select("key", "kind").collect()]


def _held(space: Space, key: object, kind: type) -> Any:
    v = space.get(key)
    if v is None:
        return kind()
    if not isinstance(v, kind):
        raise Refused("WrongStructure", f"{key} holds something else")
    return v


def list_op(session: Session, s: Node) -> Any:
    space, key = session.space(s.key.table), session.constant(s.key.id)
    items = _held(space, key, list)
    vals = [session.constant(a) for a in s.args]
    front, n = s.end == "FRONT", int(session.number(s.limit)) if s.limit is not None else None
    if s.op == "push":
        items = [*reversed(vals), *items] if front else [*items, *vals]
        space.edit(key, items)
        return len(items)
    if s.op == "pop":
        k = 1 if n is None else n
        out = items[:k] if front else items[::-1][:k]
        space.edit(key, items[k:] if front else items[: max(0, len(items) - k)])
        return (out[0] if out else None) if n is None else out
    if s.op == "set":
        i = at(items, int(session.constant(s.at)))
        if not 0 <= i < len(items):
            raise Refused("NoSuchPlace", str(i))
        space.edit(key, [*items[:i], vals[-1], *items[i + 1 :]])
        return None
    if s.op == "trim":
        a, b = at(items, int(session.constant(s.low))), at(items, int(session.constant(s.high)))
        items = items[max(0, a) : b + 1]
        space.edit(key, items)
        return len(items)
    if s.op == "remove":
        places = [i for i, x in enumerate(items) if x == vals[0]]
        places = (places[::-1] if s.back else places)[: n if n is not None else None]
        space.edit(key, [x for i, x in enumerate(items) if i not in set(places)])
        return len(places)
    if s.op == "insert":
        pivot = session.constant(s.before if s.before is not None else s.after)
        if pivot not in items:
            return -1
        i = items.index(pivot) + (s.before is None)
        items = [*items[:i], *vals, *items[i:]]
        space.edit(key, items)
        return len(items)
    if s.op == "move":
        if not items:
            return None
        x = items[0] if front else items[-1]
        space.edit(key, items[1:] if front else items[:-1])
        other, to = session.space(s.to.table), session.constant(s.to.id)
        there = _held(other, to, list)
        other.edit(to, [x, *there] if s.to_end == "FRONT" else [*there, x])
        return x
    raise Refused("UnexpectedToken", s.op)


def hash_op(session: Session, s: Node) -> Any:
    """A hash is {"fields": values, "until": expiries}; a field whose expiry has passed isn't there."""
    space, key = session.space(s.key.table), session.constant(s.key.id)
    held = _held(space, key, dict)
    now = session.now_micros()
    until = {k: t for k, t in held.get("until", {}).items() if t > now}
    fields = {k: v for k, v in held.get("fields", {}).items() if k not in held.get("until", {}) or k in until}
    names = [str(session.constant(a)) for a in s.args]

    def keep(out: Any) -> Any:
        space.edit(key, {"fields": fields, "until": {k: t for k, t in until.items() if k in fields}} if fields else {})
        return out

    if s.op == "set":
        pairs = [(str(session.constant(k)), session.constant(v)) for k, v in s.pairs]
        new = sum(k not in fields for k, _ in pairs)
        fields |= dict(pairs)
        for k, _ in pairs:
            until.pop(k, None)
        return keep(new)
    if s.op == "remove":
        n = sum(fields.pop(k, None) is not None for k in names)
        return keep(n)
    if s.op == "incr":
        by = session.constant(s.by) if s.by is not None else 1
        fields[names[0]] = fields.get(names[0], 0) + by
        return keep(fields[names[0]])
    if s.op == "expire":
        after = session.micros(s.at)
        out = [-2 if k not in fields else (1 if after > 0 else 2) for k in names]
        for k in names:
            if k in fields:
                if after > 0:
                    until[k] = now + after
                else:
                    del fields[k]
        return keep(out)
    if s.op == "ttl":
        return [-2 if k not in fields else (until[k] - now if k in until else -1) for k in names]
    if s.op == "persist":
        out = [-2 if k not in fields else 1 if until.pop(k, None) is not None else -1 for k in names]
        return keep(out)
    raise Refused("UnexpectedToken", s.op)


def _sorted(items: list) -> list:
    return sorted(items, key=lambda x: (str(type(x)), x if not isinstance(x, (dict, list)) else json.dumps(x)))


def members_op(session: Session, s: Node) -> Any:
    space, key = session.space(s.key.table), session.constant(s.key.id)
    items = _held(space, key, list)
    vals = [session.constant(a) for a in s.args]
    if s.op == "add":
        new = [x for i, x in enumerate(vals) if x not in items and x not in vals[:i]]
        space.edit(key, _sorted([*items, *new]))
        return len(new)
    if s.op == "remove":
        left = [x for x in items if x not in vals]
        space.edit(key, left)
        return len(items) - len(left)
    if s.op == "pop":
        n = int(session.number(s.limit)) if s.limit is not None else None
        out = random.sample(items, min(len(items), 1 if n is None else n))
        space.edit(key, [x for x in items if x not in out])
        return (out[0] if out else None) if n is None else out
    if s.op == "move":
        if vals[0] not in items:
            return False
        space.edit(key, [x for x in items if x != vals[0]])
        other, to = session.space(s.to.table), session.constant(s.to.id)
        there = _held(other, to, list)
        other.edit(to, _sorted([*there, vals[0]] if vals[0] not in there else there))
        return True
    raise Refused("UnexpectedToken", s.op)


def scores_op(session: Session, s: Node) -> Any:
    """A ranking is kept as {member: score}; its order is by score, then member."""
    space, key = session.space(s.key.table), session.constant(s.key.id)
    held = _held(space, key, dict)
    order = lambda: sorted(held.items(), key=lambda x: (x[1], x[0]))
    const = session.constant

    def keep(out: Any) -> Any:
        space.edit(key, held)
        return out

    if s.op == "add":
        n = 0
        for m, v in s.pairs:
            m, v = str(const(m)), float(const(v))
            old = held.get(m)
            fits = {"ABSENT": old is None, "PRESENT": old is not None, "GREATER": old is None or v > old, "LESS": old is None or v < old}.get(s.when, True)
            if fits and old != v:
                held[m] = v
                n += 1
        return keep(n)
    if s.op == "incr":
        m = str(const(s.args[0]))
        held[m] = held.get(m, 0.0) + float(const(s.by))
        return keep(held[m])
    if s.op == "remove":
        return keep(sum(held.pop(str(const(a)), None) is not None for a in s.args))
    if s.op.startswith("remove_"):
        low, high = const(s.low), const(s.high)
        ranked = order()
        if s.op == "remove_rank":
            gone = ranked[max(0, at(ranked, low)) : at(ranked, high) + 1]
        else:
            value = (lambda x: x[1]) if s.op == "remove_score" else (lambda x: x[0])
            gone = [x for x in ranked if (low is None or value(x) > low or (value(x) == low and not s.open_low)) and (high is None or value(x) < high or (value(x) == high and not s.open_high))]
        for m, _ in gone:
            del held[m]
        return keep(len(gone))
    if s.op == "pop":
        n = int(session.number(s.limit)) if s.limit is not None else 1
        ranked = order() if s.end == "LOWEST" else order()[::-1]
        out = [[m, v] for m, v in ranked[:n]]
        for m, _ in out:
            del held[m]
        return keep(out)
    raise Refused("UnexpectedToken", s.op)
