"""Scripts over stored and attached tables."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranking as R
from ..operators import relational as J
from ..operators import search as S
from ..staging import written
from . import spaces
from .changes import Changes
from .definitions import Definitions
from .errors import Refused
from .flows import Flows
from .parser import Node, parse, parse_expression
from .planner import Scope, literal, no_void, plan, record, same_kind, shaped
from .store import Store, Table, stored_type

#: Records that a statement may answer by value, at most.
MOST_ANSWERED = 1_000_000


@dataclass
class Answer:
    """What a statement answers: ok, rows (a DataFrame, read when it is asked for), a value, or keys."""

    kind: str
    frame: DataFrame | None = None
    value: Any = None

    def rows(self) -> list[dict]:
        return [plain(r) for r in self.frame.collect()]


def plain(v: Any) -> Any:
    """Rows as dictionaries, without absences."""
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items() if x is not None}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, bytearray):
        return bytes(v)
    return v


class Session(Definitions, Changes, Flows):
    """One namespace and database at a time; `root` is a folder that all executors share, the checkpoint folder where none is given."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.store = Store(spark, root)
        self.namespace = self.database = "main"
        self.consumer: str | None = None
        self.params: dict[str, Any] = {}
        self.bound: dict[str, Any] = {}
        self.attached: dict[str, tuple[DataFrame, str, str | None]] = {}
        self.depth = 0
        self._now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        held = self.store.load() if root else None
        self.catalog: dict[str, dict] = held or {"namespaces": {"main": ["main"]}, "databases": {}}
        for db in self.catalog["databases"].values():
            db["tables"] = {n: Table(**t) for n, t in db["tables"].items()}

    # ---- names

    @property
    def db(self) -> dict:
        return self.catalog["databases"].setdefault(f"{self.namespace}/{self.database}", {"tables": {}})

    def defs(self, what: str) -> dict:
        return self.db.setdefault(what, {})

    @property
    def tables(self) -> dict[str, Table]:
        return self.db["tables"]

    def table(self, name: str, *kinds: str) -> Table:
        t = self.tables.get(name)
        if t is None or (kinds and t.kind not in kinds):
            raise Refused("Unknown", name)
        return t

    def attach(self, name: str, df: DataFrame, identity: str, time: str | None = None) -> Session:
        """A frame as a table to read: `identity` is its id, `time` the instant of an event."""
        self.attached[name] = (df, identity, time)
        return self

    def frame(self, name: str, version: int | None = None) -> tuple[DataFrame, str]:
        if name in self.attached:
            df, identity, _ = self.attached[name]
            return df, identity
        if name in self.defs("views") and not self.defs("views")[name]["materialized"]:
            df, identity = shaped(self, parse(self.defs("views")[name]["body"])[0].read)
            return (df, identity) if identity else (df, "id")
        t = self.table(name)
        df = self.store.frame(t, version)
        now = F.lit(self.now_micros())
        if t.options.get("retain") is not None and t.options.get("time") in df.columns:
            df = df.where(F.unix_micros(F.col(t.options["time"]).cast("timestamp")) >= now - F.lit(int(t.options["retain"])))
        if "_expires" in df.columns:
            df = df.where(F.col("_expires").isNull() | (F.col("_expires") > now)).drop("_expires")
        return df, "id"

    def event_time(self, source: Node) -> str:
        name = source.name if source.kind in ("table", "row", "span") else None
        time = self.attached[name][2] if name in self.attached else (self.tables[name].options.get("time") if name in self.tables else None)
        if time is None:
            raise Refused("NotASeries", str(name))
        return time

    def analyzer_of(self, table: str | None, steps: list | None) -> S.Analyzer | None:
        name = ".".join(map(str, steps or []))
        if table in self.tables:
            a = self.tables[table].fields.get(name, {}).get("analyzer")
        else:
            a = self.defs("attached_analyzers").get(f"{table}.{name}")
        return S.Analyzer(tuple(self.defs("analyzers")[a])) if a else None

    def space(self, name: str) -> spaces.Space:
        return spaces.Space(self, self.table(name, "space"))

    # ---- values

    def now(self) -> datetime.datetime:
        """One instant a statement."""
        return self._now

    def now_micros(self) -> int:
        return int((self._now - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))

    def constant(self, e: Node) -> Any:
        if e.kind == "lit" and e.type in ("int", "float", "string", "bool", "none", "bytes"):
            return e.value
        if e.kind == "lit" and e.type == "duration":
            return datetime.timedelta(microseconds=e.value)
        if e.kind == "array":
            return [self.constant(x) for x in e.items]
        if e.kind == "object":
            return {k: self.constant(v) for k, v in e.fields}
        if e.kind == "neg" and e.a.kind == "lit":
            return -e.a.value
        if e.kind == "param" and not e.path and e.name in self.params:
            return self.params[e.name]
        if e.kind == "get":
            return self.space(e.key.table).get(self.constant(e.key.id))
        if e.kind == "subquery":
            rows = [plain(r) for r in plan(self, e.read).limit(MOST_ANSWERED).collect()]
            return (rows[0] if rows else None) if e.read.only else rows
        one = self.spark.range(1).select()
        return plain(one.select(Scope(self, one, None).column(e).alias("v")).first()["v"])

    def number(self, e: Any) -> int | float:
        return self.constant(e) if isinstance(e, Node) else e

    def micros(self, e: Node) -> int:
        v = self.constant(e)
        return round(v / datetime.timedelta(microseconds=1)) if isinstance(v, datetime.timedelta) else round(v * 1_000_000)

    def rows(self, values: list[dict]) -> DataFrame:
        """Values that were read before, as a frame."""
        one = self.spark.range(1).select()
        parts = [one.select(*(literal(v).alias(k) for k, v in r.items())) for r in values]
        return no_void(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)) if parts else self.spark.createDataFrame([], "id string")

    # ---- running

    def run(self, script: str) -> list[Answer]:
        """Statements in order; the first refusal ends the script."""
        return [self.step(s) for s in parse(script)]

    def frame_of(self, script: str) -> DataFrame:
        """The rows of the last statement."""
        return self.run(script)[-1].frame

    def step(self, s: Node) -> Answer:
        self._now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        out = getattr(self, f"do_{s.kind}")(s)
        if s.kind not in ("read", "let", "return", "explain", "info"):
            self.store.save(self.catalog)
        return out if out is not None else Answer("ok")

    def do_read(self, s: Node) -> Answer:
        group = None
        r = s.read
        if r.timeout is not None:
            if r.timeout <= 0:
                raise Refused("TimedOut")
            group = f"read-{uuid.uuid4().hex}"
            return Answer("rows", self.timed(r, group, r.timeout / 1e6))
        df = plan(self, r)
        if r.using:
            self.check_access(df, r)
        return Answer("rows", df)

    def timed(self, r: Node, group: str, seconds: float) -> DataFrame:
        """The rows within the time, or a refusal: jobs that go on are cancelled."""
        import threading

        sc = self.spark.sparkContext
        late = threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        sc.setJobGroup(group, "read with a timeout", interruptOnCancel=True)
        timer.start()
        try:
            return written(plan(self, r), "timed")
        except Exception:
            if late.is_set():
                raise Refused("TimedOut") from None
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def check_access(self, df: DataFrame, r: Node) -> None:
        """Spark has one way to a table, the scan; a read that demands an index by name must name a defined one."""
        if r.using not in ("scan", "index", "materialised") and r.using not in self.defs("indexes"):
            raise Refused("Unknown", r.using)

    def do_explain(self, s: Node) -> Answer:
        text = plan(self, s.read)._jdf.queryExecution().toString()
        return Answer("rows", self.spark.createDataFrame([(line,) for line in text.split("\n")], "plan string"))

    def do_let(self, s: Node) -> Answer:
        if s.value.kind in ("select", "compound"):
            rows = [plain(r) for r in plan(self, s.value).limit(MOST_ANSWERED).collect()]
            self.params[s.name] = (rows[0] if rows else None) if s.value.only else rows
        else:
            self.params[s.name] = self.constant(s.value)
        return Answer("ok")

    def do_return(self, s: Node) -> Answer:
        return Answer("value", value=self.constant(s.value))

    def do_throw(self, s: Node) -> Answer:
        if s.when is None or self.constant(s.when) is True:
            raise Refused("Thrown", str(self.constant(s.value)))
        return Answer("ok")

    def do_verify(self, s: Node) -> Answer:
        """Every table's declarations, against its rows."""
        for name in self.tables:
            if self.violations(self.tables[name]).limit(1).count():
                raise Refused("Violated", name)
        return Answer("ok")

    def do_use(self, s: Node) -> Answer:
        if s.what == "consumer":
            self.consumer = s.name
            return Answer("ok")
        if s.what == "namespace":
            if s.name not in self.catalog["namespaces"]:
                raise Refused("Unknown", s.name)
            self.namespace = s.name
            if s.database:
                return self.do_use(Node("use", what="database", name=s.database))
            return Answer("ok")
        if s.name not in self.catalog["namespaces"][self.namespace]:
            raise Refused("Unknown", s.name)
        self.database = s.name
        return Answer("ok")

    # ---- reads that need the catalog

    def walked(self, s: Node) -> tuple[DataFrame, str | None]:
        """Hops along edges; ends on an edge kind: its edges, else the records there."""
        start = str(self.constant(s.id))
        front = self.spark.createDataFrame([(start,)], "node string")
        hops = s.hops
        edge = lambda name: self.edges(name)
        if s.goal is not None or s.depth is not None:
            if len(hops) != 2:
                raise Refused("UnexpectedToken", "DEPTH and PATH TO follow one kind of edge")
            (back, e), (_, target) = hops
            depth = int(self.number(s.depth)) if s.depth is not None else 16
            if s.goal is not None:
                d = edge(e)
                d = d.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in d.columns if c not in ("src", "dst")]) if back else d
                way = R.path_to(d, start, str(self.constant(s.goal.id)), depth, s.weight).select("at", "node", "cost", "steps")
                return self.there(way, target, keep=("at",)).orderBy("at"), "id"
            return self.there(R.reach(edge(e), [start], depth, back).select("node"), target), "id"
        for i in range(0, len(hops), 2):
            back, e = hops[i]
            d = edge(e)
            if i + 1 >= len(hops):
                near = "dst" if back else "src"
                return d.join(front, F.col(near) == F.col("node"), "left_semi"), "id" if "id" in d.columns else "src"
            front = R.hop(front, d, back)
        return self.there(front, hops[-1][1]), "id"

    def edges(self, name: str) -> DataFrame:
        df, _ = self.frame(name)
        if "src" not in df.columns:
            return self.spark.createDataFrame([], "src string, dst string")
        return df.withColumns({"src": F.col("src").cast("string"), "dst": F.col("dst").cast("string")})

    def there(self, nodes: DataFrame, table: str, keep: tuple = ()) -> DataFrame:
        df, identity = self.frame(table)
        out = df.join(nodes.select("node", *keep), F.col(f"`{identity}`").cast("string") == F.col("node")).drop("node")
        return out if identity == "id" else out.withColumn("id", F.col(f"`{identity}`"))

    def fetched(self, sc: Scope, route: list) -> DataFrame:
        """References at a top-level field followed; which table they name is read from them or from the field's declaration."""
        head = route[0]
        if head not in sc.df.columns:
            return sc.df
        t = sc.df.schema[head].dataType
        el = t.elementType if isinstance(t, T.ArrayType) else t
        declared = self.tables[sc.table].fields.get(head, {}).get("references") if sc.table in self.tables else None
        if same_kind(el) != "record":
            return sc.df
        c = F.col(head)
        names = [declared] if declared else [r[0] for r in sc.df.select((F.explode(c) if isinstance(t, T.ArrayType) else c).alias("r")).select("r.table").where("table is not null").distinct().limit(64).collect()]
        parts = []
        for n in names:
            df, identity = self.frame(n)
            i = F.col(f"`{identity}`")
            parts.append(df.select(record(n, i).alias("_ref_id"), i.alias("id"), *[x for x in df.columns if x not in ("id",)]))
        if not parts:
            return sc.df
        target = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return J.fetch(sc.df, head, target, "_ref_id").withColumn(head, _without(F.col(head), isinstance(t, T.ArrayType), "_ref_id"))

    def search(self, name: str) -> tuple[list[S.Member], S.Analyzer, dict, frozenset]:
        d = self.defs("searches").get(name)
        if d is None:
            raise Refused("Unknown", name)
        members, analyzer, synonyms, stops = [], None, {}, frozenset()
        for m in d["members"]:
            df, identity = self.frame(m["table"])
            members.append(S.Member(m["table"], df, identity, {f: w for f, w, _ in m["fields"]}))
            own = S.Analyzer(tuple(self.defs("analyzers")[m["analyzer"]])) if m.get("analyzer") else self.analyzer_of(m["table"], [m["fields"][0][0]])
            analyzer = analyzer or own
            synonyms |= self.defs("synonyms").get(m.get("synonyms"), {})
            stops |= frozenset(self.defs("stopwords").get(m.get("stopwords"), []))
        return members, analyzer or S.Analyzer(), synonyms, stops

    def scored(self, sc: Scope, calls: list[Node]) -> Scope:
        """Columns for search::score(field, query): the whole collection is ranked once a field and query."""
        known = dict(sc.known)
        df = sc.df
        for i, c in enumerate(dict.fromkeys(calls)):
            if len(c.args) != 2 or c.args[0].kind != "path":
                raise Refused("WrongArity", f"{c.name}(field, query)")
            analyzer = self.analyzer_of(sc.table, c.args[0].steps)
            if analyzer is None:
                raise Refused("NoSearchIndex", ".".join(map(str, c.args[0].steps)))
            base, identity = self.frame(sc.table)
            ranked = S.rank([S.Member(sc.table, base, identity, {c.args[0].steps[0]: 1.0})], analyzer, self.constant(c.args[1]), all_rows=True)
            what = "score" if c.name == "search::score" else "explain"
            df = df.join(ranked.select(F.col("id").alias("_rid"), F.col(what).alias(f"_score{i}")), F.col(f"`{identity}`") == F.col("_rid"), "left").drop("_rid")
            known[c] = F.coalesce(F.col(f"_score{i}"), F.lit(0.0)) if what == "score" else F.col(f"_score{i}")
        return sc.with_(df, known)

    # ---- writes

    def do_create(self, s: Node) -> Answer:
        t = self.writable(s.table)
        one = self.spark.range(1).select()
        row = self.object_row(Scope(self, one, None), s.value)
        if t.kind == "topic":
            return self.publish(t, row, self.constant(s.id) if s.id is not None else None, s.answer)
        i = self.constant(s.id) if s.id is not None else self.fresh_id(t, row)
        new = row.drop("id").select(F.lit(i).alias("id"), "*") if i is not None else row
        return self.put(t, new, "create", s.answer)

    def writable(self, name: str) -> Table:
        if name in self.attached:
            raise Refused("ReadOnly", name)
        if name in self.defs("views"):
            raise Refused("AView", name)
        return self.table(name)

    def fresh_id(self, t: Table, row: DataFrame) -> Any:
        if "id" in row.columns:
            return None
        if isinstance(dict((f.name, f.dataType) for f in t.type.fields).get("id"), T.LongType):
            return (self.store.frame(t).agg(F.max("id")).first()[0] or 0) + 1
        return str(uuid.uuid4())

    def object_row(self, sc: Scope, value: Node) -> DataFrame:
        if value.kind == "object":
            return sc.df.select(*(sc.column(v).alias(k) for k, v in value.fields))
        c = sc.column(value)
        if same_kind(sc.type(c)) != "object":
            raise Refused("NotAnObject")
        return sc.df.select(c.alias("_v")).select("_v.*")

    def do_upsert(self, s: Node) -> Answer:
        t = self.writable(s.row.table)
        i = self.constant(s.row.id)
        if s.sets is not None:
            have = self.store.frame(t).where(F.col("id") == F.lit(i)).limit(1).count() if t.parts else 0
            if have:
                return self.do_update(Node("update", table=t.name, id=s.row.id, sets=s.sets, answer=s.answer))
            value = Node("object", fields=[(p[0], e) for p, e in s.sets])
        else:
            value = s.value
        row = self.object_row(Scope(self, self.spark.range(1).select(), None), value)
        return self.put(t, row.drop("id").select(F.lit(i).alias("id"), "*"), "update", s.answer)

    def do_insert(self, s: Node) -> Answer:
        t = self.writable(s.table)
        if s.rows is not None:
            one = self.spark.range(1).select()
            sc = Scope(self, one, None)
            parts = [one.select(*(sc.column(e).alias(n) for n, e in zip(s.names, vs)), F.lit(k).alias("_k")) for k, vs in enumerate(s.rows)]
            new = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            if t.kind == "topic":
                return self.publish(t, new.orderBy("_k").drop("_k"), None, s.answer)
            new = new.drop("_k")
        else:
            d = plan(self, s.read)
            if len(d.columns) != len(s.names):
                raise Refused("WrongNumberOfValues")
            new = d.toDF(*s.names)
            if t.kind == "topic":
                return self.publish(t, new, None, s.answer)
        if "id" not in new.columns:
            new = new.select(F.uuid().alias("id"), "*")
        how = {None: "create", "nothing": "nothing", "update": "update"}[s.conflict]
        return self.put(t, new, how, s.answer)

    def put(self, t: Table, new: DataFrame, how: str, answer: str | None = None) -> Answer:
        """Rows into a table: create refuses an id that is there, nothing leaves it, update replaces it."""
        self.refuse_engine_fields(t, new.columns)
        new = written(self.prepared(t, no_void(new)), "new")
        ids = new.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        if how == "create" and ids.limit(1).count():
            raise Refused("RecordExists", "an id is there twice")
        if how != "create":
            new = new.dropDuplicates(["id"])
        old = self.store.frame(t) if t.parts else None
        before = None
        if old is not None and "id" in old.columns:
            self.id_kind(t, new)
            clash = old.join(new.select(F.col("id").cast(old.schema["id"].dataType)), "id", "left_semi")
            if how == "create":
                if clash.limit(1).count():
                    raise Refused("RecordExists", t.name)
            elif how == "nothing":
                new = new.join(old.select("id"), "id", "left_anti")
            else:
                before = written(clash, "before")
        self.check_unique(t, new, old)
        self.check_references(t, new)
        if before is not None and before.limit(1).count():
            self.store.rewrite(t, before.select("id"), new)
        else:
            self.store.append(t, new)
        self.changed(t, before, new)
        shown = {"BEFORE": before if before is not None else new.limit(0), "NONE": None}.get(answer or "AFTER", new)
        return Answer("rows", shown) if shown is not None else Answer("ok")

    def id_kind(self, t: Table, new: DataFrame) -> None:
        have, come = t.type["id"].dataType, stored_type(new.schema["id"].dataType)
        if have != come:
            raise Refused("IdentityKind", f"{t.name} has identities of {same_kind(have)}")

    def prepared(self, t: Table, new: DataFrame) -> DataFrame:
        """Defaults, types, required fields and assertions of the declarations."""
        unknown = [c for c in new.columns if c != "id" and c not in t.fields and not c.startswith("_")]
        if t.strict and unknown:
            raise Refused("UnknownField", ", ".join(unknown))
        for name, f in t.fields.items():
            if "." in name:
                continue
            if f.get("default") is not None:
                d = Scope(self, new, "id", t.name).column(parse_expression(f["default"]))
                new = new.withColumn(name, F.coalesce(F.col(name), d) if name in new.columns else d)
            if name in new.columns and f.get("type"):
                new = self.typed(new, t.name, name, f)
        new = no_void(new)
        if t.options.get("expire_after"):
            new = new.withColumn("_expires", F.lit(self.now_micros() + int(t.options["expire_after"])).cast("long"))
        bad = self.violations(t, new).select("_why").limit(1).collect()
        if bad:
            kind, _, field = bad[0][0].partition(" ")
            raise Refused(kind, field)
        return new

    def typed(self, df: DataFrame, table: str, name: str, f: dict) -> DataFrame:
        have, want = df.schema[name].dataType, f["type"]
        kind = same_kind(have)
        c = F.col(name)
        if isinstance(have, T.NullType):
            return df
        if want in ("any",) or (want == "object" and kind in ("object", "any")) or (want.startswith("record") and kind == "record") or want == kind or (want in ("geometry", "uuid", "regex") and kind == "string") or want == "table":
            return df
        if want.startswith("one of") and kind == "string":
            return df
        if want == "int" and isinstance(have, (T.LongType, T.IntegerType)):
            return df
        if want in ("float", "decimal", "number") and kind == "number":
            return df if want == "number" else df.withColumn(name, c.cast("double" if want == "float" else "decimal(38,10)"))
        if want == "int" and kind == "number":
            whole = df.where(c.isNotNull() & (c != F.floor(c))).limit(1).count() == 0
            if whole:
                return df.withColumn(name, c.cast("long"))
        if want.startswith("vector<") and kind == "array" and isinstance(have.elementType, T.NumericType):
            return df.withColumn(name, c.cast("array<double>"))
        if want in ("array", "set") and kind == "array":
            return df if want == "array" else df.withColumn(name, F.sort_array(F.array_distinct(c)))
        raise Refused("WrongType", f"{table}.{name} is {want}, not {kind}")

    def violations(self, t: Table, df: DataFrame | None = None) -> DataFrame:
        """Rows that break a declaration, with the reason."""
        df = self.store.frame(t) if df is None else df
        why: list[Column] = []
        sc = Scope(self, df, "id", t.name)
        for name, f in t.fields.items():
            if "." in name:
                continue
            c = F.col(f"`{name}`") if name in df.columns else F.lit(None)
            if f.get("required"):
                why.append(F.when(c.isNull(), F.lit(f"MissingRequiredField {name}")))
            if name not in df.columns:
                continue
            kind = f.get("type") or ""
            if kind.startswith("vector<"):
                why.append(F.when(c.isNotNull() & (F.size(c) != int(kind[7:-1])), F.lit(f"WrongDimension {name}")))
            if kind.startswith("one of"):
                allowed = [x.strip().strip("'") for x in kind[7:].split(",")]
                why.append(F.when(c.isNotNull() & ~c.isin(*allowed), F.lit(f"WrongType {name}")))
            if f.get("assert"):
                holds = Scope(self, df, "id", t.name, values={"value": c}).condition(parse_expression(f["assert"]))
                why.append(F.when(c.isNotNull() & ~holds, F.lit(f"AssertionFailed {name}")))
        if t.strict:
            extra = [x for x in df.columns if x != "id" and x not in t.fields and not x.startswith("_")]
            why += [F.when(sc.path([x]).isNotNull(), F.lit(f"UnknownField {x}")) for x in extra]
        reason = F.coalesce(*why) if why else F.lit(None).cast("string")
        return df.withColumn("_why", reason.cast("string")).where("_why is not null")

    def check_unique(self, t: Table, new: DataFrame, old: DataFrame | None) -> None:
        for name, ix in self.defs("indexes").items():
            if ix["table"] != t.name or ix["use"] != "UNIQUE":
                continue
            keys = [f[0] for f in ix["fields"]]
            if any(k not in new.columns for k in keys):
                continue
            there = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
            twice = new.where(there).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
            clash = None
            if old is not None and all(k in old.columns for k in keys):
                rest = old.join(new.select("id"), "id", "left_anti")
                clash = rest.join(new.where(there).select(*keys), keys, "left_semi")
            if twice.limit(1).count() or (clash is not None and clash.limit(1).count()):
                raise Refused("UniqueViolation", name)

    def check_references(self, t: Table, new: DataFrame) -> None:
        for name, f in t.fields.items():
            target = f.get("references")
            if not target or name not in new.columns:
                continue
            kind = same_kind(new.schema[name].dataType)
            c = F.col(name)["id"] if kind == "record" else F.col(name).cast("string")
            df, identity = self.frame(target)
            missing = new.where(F.col(name).isNotNull()).join(df.select(F.col(identity).cast("string").alias("_there")), c == F.col("_there"), "left_anti")
            if missing.limit(1).count():
                raise Refused("DanglingReference", f"{t.name}.{name}")

    def matched(self, t: Table, s: Node) -> DataFrame:
        """The rows that a statement names, as they are."""
        df, _ = self.frame(t.name)
        sc = Scope(self, df, "id", t.name)
        if s.id is not None:
            df = df.where(sc.compare("=", F.col("id"), sc.column(s.id)))
        if s.low is not None:
            df = df.where(sc.compare(">=", F.col("id"), sc.column(s.low)) & sc.compare("<=" if s.closed else "<", F.col("id"), sc.column(s.high)))
        if s.where is not None:
            df = df.where(sc.condition(s.where))
        if s.limit is not None:
            df = df.orderBy("id").limit(int(self.number(s.limit)))
        return df

    def do_update(self, s: Node) -> Answer:
        t = self.writable(s.table)
        if not t.parts:
            if s.id is not None:
                raise Refused("Unknown", t.name)
            return Answer("rows", self.store.frame(t))
        before = written(self.matched(t, s), "before")
        if s.id is not None and s.where is None and not before.limit(1).count():
            raise Refused("Unknown", f"{t.name}:{self.constant(s.id)}")
        sc = Scope(self, before, "id", t.name)
        if s.value is not None:
            new = self.object_row(sc.with_(before), s.value)
            new = before.select("id").crossJoin(new.drop("id").limit(1)) if not _names(s.value) else before.select("id", *(sc.column(v).alias(k) for k, v in s.value.fields if k != "id"))
        elif s.merge is not None:
            new = before
            if s.merge.kind != "object":
                raise Refused("NotAnObject")
            new = self.assigned(before, sc, _flat(s.merge))
        else:
            new = self.assigned(before, sc, s.sets)
        self.refuse_engine_fields(t, [p[0] for p, _ in s.sets or []] + ([k for k, _ in s.value.fields] if s.value is not None and s.value.kind == "object" else []))
        new = written(self.prepared(t, no_void(new)), "new")
        self.check_unique(t, new, self.store.frame(t))
        self.check_references(t, new)
        self.store.rewrite(t, before.select("id"), new)
        self.changed(t, before, new)
        if s.answer == "NONE":
            return Answer("ok")
        return Answer("rows", before if s.answer == "BEFORE" else new)

    def assigned(self, df: DataFrame, sc: Scope, sets: list[tuple[list, Node]]) -> DataFrame:
        """Routes set to values of the row before; a route that isn't there is made."""
        out: dict[str, Column] = {}
        for route, e in sets:
            if route[0] == "id":
                raise Refused("IdentityIsFixed")
            v = sc.column(e)
            head = route[0]
            if len(route) == 1:
                out[head] = v
                continue
            base = out.get(head, F.col(f"`{head}`") if head in df.columns else F.lit(None))
            t = df.schema[head].dataType if head in df.columns else T.NullType()
            out[head] = _with(base, t, route[1:], v)
        return df.withColumns(out) if out else df

    def do_delete(self, s: Node) -> Answer:
        t = self.writable(s.table)
        if t.kind == "bucket" and s.id is not None:
            s.id = Node("lit", value=str(self.constant(s.id)), type="string")
        if not t.parts:
            if s.id is not None:
                raise Refused("Unknown", t.name)
            return Answer("ok")
        before = written(self.matched(t, s), "before")
        if s.id is not None and not before.limit(1).count():
            raise Refused("Unknown", f"{t.name}:{self.constant(s.id)}")
        self.before_delete(t, before)
        self.store.rewrite(t, before.select("id"))
        self.changed(t, before, None)
        return Answer("rows", before) if s.answer == "BEFORE" else Answer("ok", value=before.count())

    def before_delete(self, t: Table, gone: DataFrame) -> None:
        """References to rows that go: reject, cascade or unset, as the referring field says. Edges go with their ends."""
        ids = gone.select(F.col("id").cast("string").alias("_gone"))
        for other in list(self.tables.values()):
            for name, f in other.fields.items():
                if f.get("references") != t.name or not other.parts or name not in other.type.fieldNames():
                    continue
                df = self.store.frame(other)
                c = F.col(name)["id"] if same_kind(df.schema[name].dataType) == "record" else F.col(name).cast("string")
                hit = written(df.join(ids, c == F.col("_gone"), "left_semi"), "referring")
                if not hit.limit(1).count():
                    continue
                how = f.get("on_delete") or "reject"
                if how == "reject":
                    raise Refused("Referenced", f"{other.name}.{name}")
                if how == "cascade":
                    self.before_delete(other, hit)
                    self.store.rewrite(other, hit.select("id"))
                    self.changed(other, hit, None)
                else:
                    new = written(hit.withColumn(name, F.lit(None).cast(hit.schema[name].dataType)), "unset")
                    self.store.rewrite(other, hit.select("id"), new)
                    self.changed(other, hit, new)
            if other.kind == "edge" and other.parts:
                ends = [c for c, k in (("src", "from"), ("dst", "to")) if other.options.get(k) == t.name]
                for c in ends:
                    hit = written(self.store.frame(other).join(ids, F.col(c).cast("string") == F.col("_gone"), "left_semi"), "edges")
                    if hit.limit(1).count():
                        self.store.rewrite(other, hit.select("id"))

    def do_truncate(self, s: Node) -> Answer:
        t = self.writable(s.table)
        before = self.store.frame(t) if t.parts else None
        if before is not None:
            self.before_delete(t, before)
        self.store.clear(t)
        if before is not None:
            self.changed(t, before, None)
        return Answer("ok")

    # ---- edges

    def do_relate(self, s: Node) -> Answer:
        t = self.tables.get(s.edge)
        if t is None or t.kind != "edge":
            raise Refused("Unknown", s.edge)
        for r, key in ((s.source, "from"), (s.target, "to")):
            if t.options.get(key) not in (None, r.table):
                raise Refused("WrongEndpoint", f"{s.edge} is {key} {t.options[key]}")
            df, identity = self.frame(r.table)
            if not df.where(F.col(identity).cast("string") == F.lit(str(self.constant(r.id)))).limit(1).count():
                raise Refused("Unknown", f"{r.table}:{self.constant(r.id)}")
        a, b = str(self.constant(s.source.id)), str(self.constant(s.target.id))
        one = self.spark.range(1).select()
        row = self.object_row(Scope(self, one, None), s.value) if s.value is not None else one
        new = row.select(F.lit(f"{a}->{b}").alias("id"), F.lit(a).alias("src"), F.lit(b).alias("dst"), "*")
        return self.put(t, new, "update")

    def do_unrelate(self, s: Node) -> Answer:
        t = self.table(s.edge, "edge")
        i = f"{self.constant(s.source.id)}->{self.constant(s.target.id)}"
        return self.do_delete(Node("delete", table=t.name, id=Node("lit", value=i, type="string")))

    # ---- keys and files

    def do_get(self, s: Node) -> Answer:
        return Answer("value", value=self.space(s.key.table).get(self.constant(s.key.id)))

    def do_ttl(self, s: Node) -> Answer:
        return Answer("value", value=self.space(s.key.table).ttl(self.constant(s.key.id)))

    def do_set_key(self, s: Node) -> Answer:
        space, key = self.space(s.key.table), self.constant(s.key.id)
        have = space.entry(key)
        if (s.absent and have is not None) or (s.present and have is None) or (s.expected is not None and (have is None or have[0] != self.constant(s.expected))):
            return Answer("value", value=False)
        space.put(key, self.constant(s.value), self.now_micros() + s.expire if s.expire is not None else None)
        return Answer("value", value=True)

    def do_incr(self, s: Node) -> Answer:
        space, key = self.space(s.key.table), self.constant(s.key.id)
        have = space.entry(key)
        v = have[0] if have else 0
        if not isinstance(v, (int, float)) or isinstance(v, bool):
            raise Refused("NotANumber", str(key))
        v += self.constant(s.by)
        space.put(key, v, have[1] if have else None)
        return Answer("value", value=v)

    def do_expire(self, s: Node) -> Answer:
        space, key = self.space(s.key.table), self.constant(s.key.id)
        have = space.entry(key)
        if have is not None:
            space.put(key, have[0], self.now_micros() + s.after, gone=s.after <= 0)
        return Answer("value", value=have is not None)

    def do_persist(self, s: Node) -> Answer:
        space, key = self.space(s.key.table), self.constant(s.key.id)
        have = space.entry(key)
        if have is not None and have[1] is not None:
            space.put(key, have[0])
        return Answer("value", value=have is not None and have[1] is not None)

    def do_del(self, s: Node) -> Answer:
        space, key = self.space(s.key.table), self.constant(s.key.id)
        have = space.entry(key)
        gone = have is not None and (s.expected is None or have[0] == self.constant(s.expected))
        if gone:
            space.put(key, None, gone=True)
        return Answer("value", value=gone)

    def do_keys(self, s: Node) -> Answer:
        return Answer("keys", value=self.space(s.space).keys(s))

    def do_list(self, s: Node) -> Answer:
        return Answer("value", value=spaces.list_op(self, s))

    def do_hash(self, s: Node) -> Answer:
        return Answer("value", value=spaces.hash_op(self, s))

    def do_members(self, s: Node) -> Answer:
        return Answer("value", value=spaces.members_op(self, s))

    def do_scores(self, s: Node) -> Answer:
        return Answer("value", value=spaces.scores_op(self, s))

    def _bucket(self, s: Node) -> tuple[Table, str]:
        return self.table(s.file.table, "bucket"), str(self.constant(s.file.id))

    def do_put(self, s: Node) -> Answer:
        t, path = self._bucket(s)
        data = self.constant(s.value)
        data = data.encode() if isinstance(data, str) else bytes(data)
        if s.start is not None:
            old = self.file(t, path) or b""
            at = int(self.number(s.start))
            if at > len(old):
                raise Refused("PastTheEnd", str(at))
            data = old[:at] + data + old[at + len(data) :]
        if t.options.get("max") is not None and len(data) > t.options["max"]:
            raise Refused("FileTooLarge", str(len(data)))
        new = self.spark.createDataFrame([(path, bytearray(data), len(data))], "id string, content binary, size long")
        return self.put(t, new, "update", "NONE")

    def file(self, t: Table, path: str, start: int = 0, size: int | None = None) -> bytes | None:
        if not t.parts:
            return None
        c = F.col("content")
        piece = F.substring(c, start + 1, size) if size is not None else F.substring(c, start + 1, 2**31 - 1)
        rows = self.store.frame(t).where(F.col("id") == F.lit(path)).select(piece.alias("b")).collect()
        return bytes(rows[0]["b"]) if rows else None

    def do_read_file(self, s: Node) -> Answer:
        t, path = self._bucket(s)
        data = self.file(t, path, int(self.number(s.start or 0)), None if s.limit is None else int(self.number(s.limit)))
        if data is None:
            raise Refused("Unknown", path)
        return Answer("value", value=data)


def _names(value: Node) -> bool:
    return value.kind == "object" and any(x.kind == "path" for _, v in value.fields for x in v.walk())


def _flat(value: Node, base: tuple = ()) -> list[tuple[list, Node]]:
    """A deep merge as routes."""
    out: list[tuple[list, Node]] = []
    for k, v in value.fields:
        out += _flat(v, (*base, k)) if v.kind == "object" and v.fields else [([*base, k], v)]
    return out


def _with(c: Column, t: T.DataType, route: list, v: Column) -> Column:
    """A struct with a value at a route."""
    if not isinstance(t, T.StructType):
        return reduce(lambda x, n: F.struct(x.alias(n)), reversed(route), v)
    name, rest = route[0], route[1:]
    inner = v if not rest else _with(c[name] if name in t.fieldNames() else F.lit(None), t[name].dataType if name in t.fieldNames() else T.NullType(), rest, v)
    fields = [(inner if f.name == name else c[f.name]).alias(f.name) for f in t.fields]
    return F.struct(*fields, *([] if name in t.fieldNames() else [inner.alias(name)]))


def _without(c: Column, many: bool, name: str) -> Column:
    return F.transform(c, lambda x: x.dropFields(name)) if many else c.dropFields(name)
