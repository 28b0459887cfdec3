"""What follows a write: events, feeds, rollups and materialized views, by sets of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..staging import written
from .errors import Refused
from .parser import Node, parse
from .planner import Scope, no_void, plan
from .store import Table

#: Events that set off events, at most.
DEPTH = 16


class Changes:
    def changed(self, t: Table, before: DataFrame | None, after: DataFrame | None) -> None:
        """Called once a write is in the table, with the rows as they were and as they are."""
        events = [e for e in self._events.values() if e.table == t.name]
        feeds = [f for f in self._feeds.values() if f.table == t.name]
        rollups = [r for r in self._rollups.values() if r.series == t.name]
        views = [n for n, v in self.defs("views").items() if v["materialized"] and t.name in v["body"]]
        if not (events or feeds or rollups or views):
            return
        if events:
            d = self.change_rows(before, after)
            self.depth += 1
            try:
                if self.depth > DEPTH:
                    raise Refused("EventsTooDeep")
                for e in events:
                    self.fire(e, d)
            finally:
                self.depth -= 1
        for f in feeds:
            self.feed_rows(f, before, after)
        for r in rollups:
            self.roll(r, [x for x in (before, after) if x is not None])
        for v in views:
            self.refresh(v, t, before, after)

    def change_rows(self, before: DataFrame | None, after: DataFrame | None) -> DataFrame:
        """op, id, before and after of each row that a write changed: the net effect."""
        empty = self.spark.createDataFrame([], "id string")
        b, a = (empty if before is None else before), (empty if after is None else after)
        b = b.select(F.col("id").alias("_b"), F.struct(*[c for c in b.columns if not c.startswith("_")]).alias("before"))
        a = a.select(F.col("id").alias("_a"), F.struct(*[c for c in a.columns if not c.startswith("_")]).alias("after"))
        both = b.join(a, F.col("_b").cast("string") == F.col("_a").cast("string"), "full")
        op = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("update")
        return both.select(op.alias("op"), F.coalesce(F.col("_a").cast("string"), F.col("_b").cast("string")).alias("id"), "before", "after")

    def _bound(self, d: DataFrame) -> Scope:
        return Scope(self, d, None, values={"event": F.col("op"), "id": F.col("id"), "before": F.col("before"), "after": F.col("after")})

    def _met(self, s: Node, d: DataFrame) -> DataFrame:
        if s.ops:
            d = d.where(F.col("op").isin(*[o.lower() for o in s.ops]))
        return d.where(self._bound(d).condition(s.when)) if s.when is not None else d

    def fire(self, e: Node, d: DataFrame) -> None:
        """THEN for all changed rows at once."""
        d = self._met(e, d)
        then = e.then
        if then.kind == "throw":
            if d.limit(1).count():
                raise Refused("Thrown", str(self.constant(then.value)))
            return
        if not d.limit(1).count():
            return
        sc = self._bound(d)
        if then.kind == "create":
            t = self.table(then.table)
            row = self.object_row(sc, then.value)
            if t.kind == "topic":
                self.publish(t, row, None)
                return
            i = sc.column(then.id) if then.id is not None else F.uuid()
            self.put(t, row.select(i.alias("id"), *[c for c in row.columns if c != "id"]) if then.id is None else self.with_id(sc, then), "create" if then.id is None else "update")
        elif then.kind == "upsert" and then.value is not None:
            self.put(self.table(then.row.table), self.with_id(sc, Node("create", id=then.row.id, value=then.value)), "update")
        elif then.kind == "update" and then.sets is not None and then.id is not None:
            t = self.table(then.table)
            new = d.select(sc.column(then.id).cast("string").alias("_to"), *(sc.column(v).alias(f"_v{i}") for i, (_, v) in enumerate(then.sets))).dropDuplicates(["_to"])
            hit = self.store.frame(t).join(new, F.col("id").cast("string") == F.col("_to"))
            hit = written(hit, "set-off")
            own = [c for c in hit.columns if not c.startswith("_v") and c != "_to"]
            cols = {p[0]: F.col(f"_v{i}") for i, (p, _) in enumerate(then.sets)}
            after = written(self.prepared(t, no_void(hit.withColumns(cols).select(*own, *[k for k in cols if k not in own]))), "set")
            before = hit.select(*own)
            self.store.rewrite(t, before.select("id"), after)
            self.changed(t, before, after)
        elif then.kind == "delete" and then.id is not None:
            t = self.table(then.table)
            gone = d.select(sc.column(then.id).cast("string").alias("_to")).distinct()
            hit = written(self.store.frame(t).join(gone, F.col("id").cast("string") == F.col("_to"), "left_semi"), "gone")
            self.store.rewrite(t, hit.select("id"))
            self.changed(t, hit, None)
        else:
            raise Refused("NoEventOf", then.kind)

    def with_id(self, sc: Scope, s: Node) -> DataFrame:
        cols = [sc.column(v).alias(k) for k, v in s.value.fields if k != "id"]
        return sc.df.select(sc.column(s.id).alias("id"), *cols)

    # ---- feeds

    def feed_rows(self, s: Node, before: DataFrame | None, after: DataFrame | None) -> None:
        """Envelopes of what changed, appended to the feed's topic."""
        d = self._met(s, self.change_rows(before, after))
        text = lambda c: F.to_json(F.col(c))
        cols = [F.col("op"), F.col("id").alias("key"), F.lit(s.table).alias("source")]
        if s.image == "full":
            cols += [text("before").alias("before"), text("after").alias("after")]
        self.publish(self.tables[s.topic], d.select(*cols), None)

    # ---- rollups

    def roll(self, s: Node, touched: list[DataFrame] | None) -> None:
        """Windows that rows touch, late ones too, computed anew from the series; others stay as they are."""
        series, t = self.tables[s.series], self.tables[s.name]
        at = series.options["time"]
        base, _ = self.frame(s.series)
        seconds = s.window // 1_000_000
        window = A.bucket(F.col(at), seconds)
        by = [F.col(s.by)] if s.by else []
        keys = lambda d: d.where(F.col(at).isNotNull()).select(window.alias("window"), *by)
        if touched is not None:
            if at not in base.columns or all(at not in d.columns for d in touched):
                return
            hit = reduce(DataFrame.unionByName, (keys(d) for d in touched if at in d.columns)).distinct()
        d = base.where(F.col(at).isNotNull()).withColumn("window", window)
        on = ["window", *([s.by] if s.by else [])]
        if touched is not None:
            d = d.join(hit, on, "left_semi")
        sc = Scope(self, d, "id")
        g = d.groupBy(*on).agg(*(sc.column(e).alias(n) for n, e in s.compute))
        ident = lambda x: F.concat_ws("/", F.date_format("window", "yyyy-MM-dd'T'HH:mm:ss"), *([F.col(s.by).cast("string")] if s.by else []))
        new = written(g.select(ident(g).alias("id"), *on, *[n for n, _ in s.compute]), "rolled")
        if touched is None or not t.parts:
            self.store.append(t, new)
        else:
            self.store.rewrite(t, hit.select(ident(hit).alias("id")), new)

    # ---- materialized views

    def refresh(self, name: str, t: Table | None = None, before: DataFrame | None = None, after: DataFrame | None = None) -> None:
        """The touched rows or groups of a view of one table; else the whole view."""
        view = self.tables[name]
        r = parse(self.defs("views")[name]["body"])[0].read
        single = r.kind == "select" and r.source.kind == "table" and t is not None and r.source.name == t.name
        keyed = single and r.group and not (r.order or r.limit or r.start or r.having or r.fill) and all(e.kind == "path" and len(e.steps) == 1 for e in r.group)
        plain = single and r.star and not r.items and not (r.group or r.order or r.limit or r.start or r.split or r.latest or r.fuse or r.fetch or r.omit)
        if view.parts and plain and not any(x.kind == "subquery" for x in (r.where.walk() if r.where else [])):
            touched = reduce(lambda a, b: a.unionByName(b), [d.select("id") for d in (before, after) if d is not None]).distinct()
            now = after.where(Scope(self, after, "id", t.name).condition(r.where)) if after is not None and r.where is not None else after
            self.store.rewrite(view, touched, now)
            return
        names = {e.steps[0]: n for n, e in (r.items if r.kind == "select" else []) if e.kind == "path" and len(e.steps) == 1}
        if view.parts and keyed and all(e.steps[0] in names for e in r.group):
            keys = [e.steps[0] for e in r.group]
            pick = lambda d: d.select(*(F.col(k) if k in d.columns else F.lit(None).cast("string").alias(k) for k in keys))
            hit = written(reduce(DataFrame.unionByName, [pick(d) for d in (before, after) if d is not None]).distinct(), "touched")
            base, _ = self.frame(t.name)
            on = reduce(lambda a, b: a & b, (F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys))
            part = base.alias("x").join(hit.alias("y"), on, "left_semi")
            self.attached["_touched"] = (part, "id", None)
            try:
                now = plan(self, Node(**{**r.__dict__, "source": Node("table", name="_touched")}))
            finally:
                del self.attached["_touched"]
            ident = lambda cs: F.to_json(F.array(*(F.col(c).cast("string") for c in cs)))
            now = now.withColumn("id", ident([names[k] for k in keys]))
            self.store.rewrite(view, hit.select(ident(keys).alias("id")), now)
            return
        d = plan(self, r)
        if "id" not in d.columns:
            group = [names[e.steps[0]] for e in r.group if e.kind == "path" and e.steps[0] in names] if r.kind == "select" and r.group else []
            whole = bool(group) and len(group) == len(r.group)
            d = d.withColumn("id", F.to_json(F.array(*(F.col(c).cast("string") for c in group))) if whole else F.uuid())
        if not view.parts and not d.limit(1).count():
            return  # nothing yet; the types come with the first rows
        self.store.replace(view, d)
