"""DEFINE, ALTER, DROP, INFO, CHECK, ANALYZE and REBUILD: what is declared lives in the session's catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from .errors import Refused
from .parser import Node, parse
from .planner import plan
from .store import Table

#: What a definition is kept under.
_KEPT = {"index": "indexes", "analyzer": "analyzers", "search": "searches", "synonyms": "synonyms", "stopwords": "stopwords", "view": "views", "event": "events", "feed": "feeds", "rollup": "rollups", "graph": "graphs", "param": "params", "group": "groups", "kafka_consumer": "consumers", "topic_consumer": "consumers"}
_TABLES = {"table": ("table", "collection"), "collection": ("collection",), "space": ("space",), "topic": ("topic",), "bucket": ("bucket",), "vector": ("vector",), "geo": ("geo",), "queue": ("queue",), "series": ("series",), "edge": ("edge",)}


class Definitions:
    def do_define(self, s: Node):
        if s.absent and s.replace:
            raise Refused("UnexpectedToken", "IF NOT EXISTS or OR REPLACE")
        if s.what == "namespace":
            return self._space_of_names(self.catalog["namespaces"], s, [])
        if s.what == "database":
            here = self.catalog["namespaces"][self.namespace]
            if s.name in here and not s.absent:
                raise Refused("NameTaken", s.name)
            if s.name not in here:
                here.append(s.name)
            return None
        if s.what == "field":
            return self._define_field_of(s)
        if s.what in _TABLES:
            taken = s.name in self.tables or s.name in self.defs("views")
            if taken:
                if s.absent:
                    return None
                raise Refused("NameTaken", s.name)
            return getattr(self, f"_new_{s.what}", self._new_plain)(s)
        kept = self.defs(_KEPT[s.what])
        if s.what == "param":
            value = self.constant(s.value)
            if s.name in kept and not s.replace:
                if s.absent:
                    return None
                raise Refused("NameTaken", s.name)
            kept[s.name] = value
            self.params[s.name] = value
            return None
        key = f"{s.table}/{s.name}" if s.what in ("event", "feed") else f"{s.topic}/{s.name}" if s.what == "group" else s.name
        if key in kept and not s.replace:
            if s.absent:
                return None
            raise Refused("GroupExists" if s.what == "group" else "NameTaken", s.name)
        kept[key] = getattr(self, f"_made_{s.what}")(s)
        after = getattr(self, f"_after_{s.what}", None)
        if after is not None:
            after(s)
        return None

    def _space_of_names(self, held: dict, s: Node, value) -> None:
        if s.name in held:
            if not s.absent:
                raise Refused("NameTaken", s.name)
            return
        held[s.name] = value

    # ---- tables

    def _new_plain(self, s: Node) -> None:
        self.tables[s.name] = Table(s.name, s.what)

    def _new_table(self, s: Node) -> None:
        if s.schemafull and s.schemaless:
            raise Refused("UnexpectedToken", "SCHEMAFULL or SCHEMALESS")
        t = Table(s.name, "edge" if s.edge else "table", strict=bool(s.schemafull) or (bool(s.fields) and not s.schemaless))
        for f in s.fields:
            t.fields[f.name] = {"type": f.type, "required": bool(f.required)}
        by = s.partition_by or s.by
        if by:
            t.options["partition_by"] = by
        if s.edge:
            t.options |= {"from": getattr(s, "from", None), "to": s.to}
        if s.expire_after is not None:
            t.options["expire_after"] = s.expire_after
        self.tables[s.name] = t

    def _new_edge(self, s: Node) -> None:
        if s.graph not in self.defs("graphs"):
            raise Refused("Unknown", s.graph)
        for end in (s.from_, s.to):
            if end not in self.tables and end not in self.attached:
                raise Refused("Unknown", end)
        self.tables[s.name] = Table(s.name, "edge", options={"from": s.from_, "to": s.to, "graph": s.graph})

    def _new_space(self, s: Node) -> None:
        self.tables[s.name] = Table(s.name, s.what, options={"max": s.max} if s.max is not None else {})

    _new_bucket = _new_space

    def _new_topic(self, s: Node) -> None:
        if s.deduplicate is not None and s.deduplicate <= 0:
            raise Refused("UnexpectedToken", "a span above zero")
        self.tables[s.name] = Table(s.name, "topic", options={"retain_us": s.retain, "retain_bytes": s.retain_bytes, "partitions": s.partitions, "deduplicate": s.deduplicate, "on": s.on, "next": 1})

    def _new_queue(self, s: Node) -> None:
        if s.timeout is None:
            raise Refused("UnexpectedToken", "a queue has a TIMEOUT")
        if s.deduplicate is not None and s.deduplicate <= 0:
            raise Refused("UnexpectedToken", "a span above zero")
        self.tables[s.name] = Table(s.name, "queue", strict=bool(s.schemafull), options={"timeout": s.timeout, "attempts": s.attempts, "priority": s.priority_by, "not_before": s.not_before, "deduplicate": s.deduplicate, "on": s.on, "dead_letter": s.dead_letter_to})

    def _new_series(self, s: Node) -> None:
        if not s.retain or s.retain <= 0:
            raise Refused("UnexpectedToken", "a series retains a span above zero")
        self.tables[s.name] = Table(s.name, "series", options={"retain": s.retain, "time": s.time or "at", "partition_by": s.by})

    def _new_vector(self, s: Node) -> None:
        if not s.dimension or s.dimension < 1 or s.distance is None:
            raise Refused("UnexpectedToken", "a vector has a DIMENSION and a DISTANCE")
        if s.distance.lower() not in ("cosine", "euclidean", "dot"):
            raise Refused("NoSuchDistance", s.distance)
        self.tables[s.name] = Table(s.name, "vector", fields={"vector": {"type": f"vector<{s.dimension}>", "required": True}}, options={"distance": s.distance.lower()})

    def _new_geo(self, s: Node) -> None:
        self.tables[s.name] = Table(s.name, "geo", fields={"geometry": {"type": "geometry", "required": True}})

    def _define_field_of(self, s: Node) -> None:
        if s.table in self.attached:
            if not s.analyzer or s.analyzer not in self.defs("analyzers"):
                raise Refused("ReadOnly", s.table)
            self.defs("attached_analyzers")[f"{s.table}.{s.name}"] = s.analyzer
            return
        t = self.table(s.table)
        if s.name in t.fields and not s.replace:
            if s.absent:
                return
            raise Refused("NameTaken", s.name)
        self._field(t, s)

    def _field(self, t: Table, s: Node) -> None:
        if s.analyzer and s.analyzer not in self.defs("analyzers"):
            raise Refused("Unknown", s.analyzer)
        if s.references and s.references not in self.tables and s.references not in self.attached:
            raise Refused("Unknown", s.references)
        t.fields[s.name] = {"type": s.type, "required": bool(s.required), "default": s.default, "assert": getattr(s, "assert"), "analyzer": s.analyzer, "references": s.references, "on_delete": s.on_delete}

    # ---- what is kept by name

    def _made_graph(self, s: Node) -> dict:
        return {}

    def _made_index(self, s: Node) -> dict:
        t = self.table(s.table)
        if s.use == "VECTOR" and s.distance.lower() not in ("cosine", "euclidean", "dot"):
            raise Refused("NoSuchDistance", s.distance)
        made = {"table": t.name, "fields": s.fields, "use": s.use, "distance": s.distance}
        if s.use == "UNIQUE" and t.parts:
            keys = [f[0] for f in s.fields]
            d = self.store.frame(t)
            if all(k in d.columns for k in keys) and d.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
                raise Refused("UniqueViolation", s.name)
        return made

    def _made_analyzer(self, s: Node) -> list:
        try:
            S.Analyzer(tuple(s.filters))
        except S.BadQuery as x:
            raise Refused("UnexpectedToken", str(x)) from None
        return s.filters

    def _made_search(self, s: Node) -> dict:
        for m in s.members:
            if m.table not in self.attached:
                self.table(m.table)
            for what, name in (("analyzers", m.analyzer), ("synonyms", m.synonyms), ("stopwords", m.stopwords)):
                if name and name not in self.defs(what):
                    raise Refused("Unknown", name)
        return {"members": [{"table": m.table, "fields": m.fields, "analyzer": m.analyzer, "synonyms": m.synonyms, "stopwords": m.stopwords} for m in s.members]}

    def _made_synonyms(self, s: Node) -> dict:
        return {k.lower(): v if isinstance(v, list) else [v] for k, v in self.constant(s.value).items()}

    def _made_stopwords(self, s: Node) -> list:
        return [x.lower() for x in self.constant(s.value)]

    def _made_view(self, s: Node) -> dict:
        if s.name in self.tables or s.name in self.attached:
            raise Refused("NameTaken", s.name)
        if s.materialized and "time::now" in s.body.lower():
            raise Refused("NotRepeatable", "a materialized view doesn't ask the time")
        plan(self, parse(s.body)[0].read)
        return {"body": s.body, "materialized": s.materialized}

    def _after_view(self, s: Node) -> None:
        if s.materialized:
            self.tables[s.name] = Table(s.name, "view")
            self.refresh(s.name)

    def _made_event(self, s: Node) -> dict:
        self.table(s.table)
        return {"table": s.table, "text": s.text or ""}

    def _after_event(self, s: Node) -> None:
        self._events[f"{s.table}/{s.name}"] = s

    def _made_feed(self, s: Node) -> dict:
        self.table(s.table)
        self.table(s.topic, "topic")
        return {"table": s.table, "topic": s.topic, "image": s.image, "ops": s.ops, "text": s.text or ""}

    def _after_feed(self, s: Node) -> None:
        self._feeds[f"{s.table}/{s.name}"] = s
        t = self.tables[s.table]
        if s.scan and t.parts:
            self.feed_rows(s, None, self.store.frame(t))

    def _made_rollup(self, s: Node) -> dict:
        t = self.table(s.series, "series")
        if s.window <= 0 or s.window % 1_000_000:
            raise Refused("UnexpectedToken", "a window of whole seconds")
        for _, e in s.compute:
            if e.kind != "fold" or e.name not in ("count", "sum", "min", "max", "approx_distinct", "approx_quantile"):
                raise Refused("NoRollupOf", e.name or e.kind)
        return {"series": t.name, "text": s.text or ""}

    def _after_rollup(self, s: Node) -> None:
        options = {"retain": s.retain, "time": "window"} if s.retain else {}
        self.tables[s.name] = Table(s.name, "rollup", options=options)
        self._rollups[s.name] = s
        base = self.tables[s.series]
        if base.parts:
            self.roll(s, None)

    def _made_group(self, s: Node) -> dict:
        self.table(s.topic, "topic")
        if s.dead_letter_to == s.topic:
            raise Refused("DeadLetterLoop", s.topic)
        if s.dead_letter_to:
            self.table(s.dead_letter_to, "topic")
        return {"topic": s.topic, "deadline": s.ack_deadline, "deliveries": s.deliveries, "in_flight": s.in_flight or 1000, "dead": s.dead_letter_to, "at": 0, "held": {}, "members": []}

    def _made_kafka_consumer(self, s: Node) -> dict:
        if not s.brokers or not s.into:
            raise Refused("UnexpectedToken", "FROM brokers ... INTO table")
        self.table(s.into)
        return {"brokers": s.brokers, "topic": s.topic, "group": s.group, "into": s.into, "format": s.format, "identity": s.identity, "map": s.map or [], "failure": s.on_failure or "stop"}

    def _made_topic_consumer(self, s: Node) -> dict:
        self.table(s.topic, "topic")
        self.table(s.into)
        return {"from": s.topic, "group": s.group or s.name, "into": s.into, "identity": s.identity, "map": s.map or [], "failure": s.on_failure or "stop", "at": 0, "quarantined": []}

    # ---- definitions that hold statements are parsed again in another session

    @property
    def _events(self) -> dict:
        return self._parsed("events")

    @property
    def _feeds(self) -> dict:
        return self._parsed("feeds")

    @property
    def _rollups(self) -> dict:
        return self._parsed("rollups")

    def _parsed(self, what: str) -> dict:
        held = self.__dict__.setdefault("_statements", {}).setdefault((self.namespace, self.database, what), {})
        for key, d in self.defs(what).items():
            if key not in held and d.get("text"):
                held[key] = parse(d["text"])[0]
        for key in [k for k in held if k not in self.defs(what)]:
            del held[key]
        return held

    # ---- drops and changes

    def do_drop(self, s: Node):
        try:
            self._dropped(s)
        except Refused as x:
            if not (s.absent and x.kind == "Unknown"):
                raise

    def _dropped(self, s: Node) -> None:
        if s.what == "namespace":
            dbs = self.catalog["namespaces"].get(s.name)
            if dbs is None:
                raise Refused("Unknown", s.name)
            if any(self.catalog["databases"].get(f"{s.name}/{d}", {}).get("tables") for d in dbs) or (dbs and s.name != "main"):
                raise Refused("NotEmpty", s.name)
            del self.catalog["namespaces"][s.name]
            return
        if s.what == "database":
            here = self.catalog["namespaces"][self.namespace]
            if s.name not in here:
                raise Refused("Unknown", s.name)
            if self.catalog["databases"].get(f"{self.namespace}/{s.name}", {}).get("tables"):
                raise Refused("NotEmpty", s.name)
            here.remove(s.name)
            return
        if s.what == "field":
            t = self.table(s.table)
            if s.name not in t.fields:
                raise Refused("Unknown", s.name)
            del t.fields[s.name]
            return
        if s.what in _TABLES:
            t = self.table(s.name, *_TABLES[s.what])
            if any(r.series == t.name for r in self._rollups.values()):
                raise Refused("HasRollup", t.name)
            self.store.drop(t)
            del self.tables[t.name]
            for what in ("indexes", "events", "feeds"):
                for k in [k for k, d in self.defs(what).items() if d.get("table") == t.name]:
                    del self.defs(what)[k]
            return
        kept = self.defs(_KEPT.get(s.what, s.what))
        key = f"{s.table}/{s.name}" if s.what in ("event", "feed", "group") and s.table else s.name
        if key not in kept:
            raise Refused("Unknown", s.name)
        if s.what == "graph" and any(t.options.get("graph") == s.name for t in self.tables.values()):
            raise Refused("NotEmpty", s.name)
        if s.what == "analyzer" and any(f.get("analyzer") == s.name for t in self.tables.values() for f in t.fields.values()):
            raise Refused("InUse", s.name)
        if s.what == "view" and kept[key]["materialized"] or s.what == "rollup":
            self.store.drop(self.tables[s.name])
            del self.tables[s.name]
        if s.what == "param":
            self.params.pop(s.name, None)
        del kept[key]

    def do_alter_table(self, s: Node):
        t = self.table(s.table)
        df = self.store.frame(t) if t.parts else None
        if s.strict:
            t.strict = s.strict == "SCHEMAFULL"
        elif s.add:
            if s.add.name in t.fields:
                raise Refused("NameTaken", s.add.name)
            self._field(t, s.add)
        elif s.drop:
            if s.drop not in t.fields:
                raise Refused("Unknown", s.drop)
            del t.fields[s.drop]
        elif s.field:
            if df is not None and s.field in df.columns:
                t.schema = ""
                self.store.replace(t, df.withColumnRenamed(s.field, s.to))
            if s.field in t.fields:
                t.fields[s.to] = t.fields.pop(s.field)
        elif s.rename:
            if s.rename in self.tables:
                raise Refused("NameTaken", s.rename)
            self.tables[s.rename] = self.tables.pop(t.name)
            t.name = s.rename
        elif s.alter:
            f = s.alter
            if df is not None and f.name in df.columns and f.using:
                from .parser import parse_expression
                from .planner import Scope

                t.schema = ""
                self.store.replace(t, df.withColumn(f.name, Scope(self, df, "id", t.name).column(parse_expression(f.using))))
            self._field(t, f)
        elif s.merge:
            if df is not None:
                self.store.replace(t, df.coalesce(1))
        elif s.expire is not None:
            t.options["expire_after"] = s.expire
        elif df is not None:  # SPLIT: more folders by ranges of the identity
            self.store.replace(t, df.repartitionByRange(int(s.split or 2), "id"))

    def do_info(self, s: Node):
        from .session import Answer

        t = self.tables.get(s.name) if s.name else None
        rows: list[tuple[str, str, str]] = []
        if s.what in ("table", "series", "queue", "topic", "space", "bucket", "vector", "geo", "collection", "edge", "rollup"):
            if t is None or t.kind not in (*_TABLES.get(s.what, ()), s.what, *(("table", "collection", "edge") if s.what == "table" else ())):
                raise Refused("Unknown", str(s.name))
            rows += [("field", n, str({k: v for k, v in f.items() if v})) for n, f in t.fields.items()]
            rows += [("index", n, str(d["use"])) for n, d in self.defs("indexes").items() if d["table"] == t.name]
            rows += [("column", f.name, f.dataType.simpleString()) for f in t.type.fields]
            rows += [("option", k, str(v)) for k, v in t.options.items() if v is not None]
        elif s.what == "database":
            rows += [("table", n, x.kind) for n, x in self.tables.items()]
            rows += [(what, n, "") for what in sorted(set(_KEPT.values())) for n in self.defs(what)]
        elif s.what == "namespace":
            rows += [("database", d, "") for d in self.catalog["namespaces"].get(s.name or self.namespace, [])]
        elif s.what in _KEPT:
            held = self.defs(_KEPT[s.what])
            if s.name not in held:
                raise Refused("Unknown", str(s.name))
            rows += [(s.what, s.name, str(held[s.name]))]
        else:
            raise Refused("OutOfScope", s.what)
        return Answer("rows", self.spark.createDataFrame(rows, "what string, name string, value string"))

    def do_check(self, s: Node):
        """The rows that break a declaration, and why."""
        from .session import Answer

        return Answer("rows", self.violations(self.table(s.table)).withColumnRenamed("_why", "why"))

    def do_analyze(self, s: Node):
        """Statistics of each column: rows, absences, distinct values by a sketch, bounds."""
        from .session import Answer

        t = self.table(s.table)
        df = self.store.frame(t)
        n = df.count()
        rows = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            text = c.cast("string") if f.dataType.simpleString() in ("string", "bigint", "double", "boolean", "timestamp_ntz") else F.to_json(F.array(c)) if f.dataType.simpleString() not in ("binary",) else F.hex(c)
            r = df.agg(F.sum(c.isNull().cast("long")).alias("a"), F.approx_count_distinct(text).alias("d"), F.min(text).alias("lo"), F.max(text).alias("hi")).first()
            rows.append((f.name, n, int(r["a"] or 0), int(r["d"]), r["lo"], r["hi"]))
        t.options["statistics"] = {r[0]: r[1:4] for r in rows}
        return Answer("rows", self.spark.createDataFrame(rows, "column string, rows long, absent long, values long, low string, high string"))

    def do_rebuild(self, s: Node):
        ix = self.defs("indexes").get(s.name)
        t = self.table(s.table)
        if t.kind == "geo" and s.name == "geometry":
            ix = {"table": t.name, "fields": [["geometry"]], "use": "SPATIAL"}
        if ix is None or ix["table"] != t.name:
            raise Refused("Unknown", s.name)
        if t.parts:  # Spark's index is the files' layout: sorted by the fields, their statistics skip what can't match
            df = self.store.frame(t)
            keys = [f[0] for f in ix["fields"] if f[0] in df.columns and df.schema[f[0]].dataType.simpleString() not in ("binary", "variant") and not df.schema[f[0]].dataType.simpleString().startswith("map")]
            self.store.replace(t, df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df)
