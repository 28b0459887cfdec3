"""Topics and their groups, queues, and consumers that carry a topic or a broker's messages into tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written
from .errors import Refused
from .parser import Node
from .planner import Scope, no_void
from .store import Table

#: Records that one claim may take.
MOST_CLAIMED = 500
ENGINE_FIELDS = ("claimed_until", "attempts", "claimant")


def numbered(d: DataFrame, start: int) -> tuple[DataFrame, int]:
    """Rows with dense positions from start on, in the order that they have, and how many: counts a partition, then offsets; no task gets all rows."""
    held = written(d.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    counts = sorted((r["_pid"], r["n"]) for r in held.groupBy("_pid").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for pid, n in counts:
        before[pid], total = total, total + n
    if not total:
        return held.drop("_pid", "_at").withColumn("position", F.lit(None).cast("long")), 0
    offsets = d.sparkSession.createDataFrame(sorted(before.items()), "_pid int, _before long")  # a row a partition
    rank = F.row_number().over(Window.partitionBy("_pid").orderBy("_at"))
    out = held.withColumn("_n", rank).join(F.broadcast(offsets), "_pid").withColumn("position", F.lit(start - 1).cast("long") + F.col("_before") + F.col("_n"))
    return out.drop("_pid", "_at", "_n", "_before"), total


class Flows:
    # ---- topics

    def publish(self, t: Table, rows: DataFrame, identity: Any, answer: str | None = None):
        from .session import Answer

        span, on = t.options.get("deduplicate"), t.options.get("on")
        rows = no_void(rows)
        if identity is not None:
            rows = rows.withColumn("id", F.lit(str(identity)))
        elif "id" not in rows.columns:
            rows = rows.withColumn("id", F.uuid())
        rows = rows.withColumn("id", F.col("id").cast("string"))
        if span:
            key = on or "id"
            if key not in rows.columns:
                raise Refused("MissingKey", key)
            rows = rows.dropDuplicates([key])
            if t.parts:
                floor = F.lit(self.now_micros() - int(span))
                recent = self.store.frame(t).where(F.unix_micros(F.col("appended").cast("timestamp")) >= floor).select(F.col(key).alias("_seen"))
                rows = rows.join(recent, F.col(key) == F.col("_seen"), "left_anti")
        elif identity is not None and t.parts and self.store.frame(t).where(F.col("id") == F.lit(str(identity))).limit(1).count():
            raise Refused("RecordExists", str(identity))
        new, n = numbered(self.prepared(t, rows), int(t.options["next"]))
        if n:
            new = written(new.withColumn("appended", F.lit(self.now()).cast("timestamp_ntz")), "messages")
            self.store.append(t, new)
            t.options["next"] = int(t.options["next"]) + n
            self.changed(t, None, new)
        return Answer("rows", new.select("position") if answer == "POSITION" else new)

    def messages(self, t: Table) -> DataFrame:
        d = self.store.frame(t)
        if "position" not in d.columns:
            return self.spark.createDataFrame([], "id string, position long, appended timestamp_ntz")
        if t.options.get("retain_us"):
            d = d.where(F.unix_micros(F.col("appended").cast("timestamp")) >= F.lit(self.now_micros() - int(t.options["retain_us"])))
        return d.where(F.col("position") >= int(t.options.get("first", 1)))

    def _position(self, t: Table, v: Any) -> int:
        if isinstance(v, str):
            r = self.messages(t).where(F.col("id") == F.lit(v)).select("position").first()
            if r is None:
                raise Refused("Unknown", v)
            return r[0]
        return int(self.number(v))

    def group(self, topic: str, name: str, must: bool = True) -> dict | None:
        g = self.defs("groups").get(f"{topic}/{name}")
        if g is None and must:
            raise Refused("NotAGroup", name)
        return g

    def do_read_topic(self, s: Node):
        from .session import Answer

        t = self.table(s.topic, "topic")
        d = self.messages(t)
        n = int(self.number(s.limit)) if s.limit is not None else None
        if s.group is not None:
            g = self.group(s.topic, s.group, must=False)
            if g is not None:
                if s.after is not None:
                    raise Refused("AfterOnGroup")
                return Answer("rows", self.hand_out(t, g, s, n))
            if s.member is not None:
                raise Refused("NotAGroup", s.group)
            places = self.defs("offsets")
            key = f"{s.topic}/{s.group}"
            d = d.where(F.col("position") > F.lit(places.get(key, 0))).orderBy("position")
            got = written(d.limit(n) if n is not None else d, "read")
            last = got.agg(F.max("position")).first()[0]
            if last is not None:
                places[key] = last
            return Answer("rows", got.orderBy("position"))
        if s.after is not None:
            d = d.where(F.col("position") > F.lit(self._position(t, s.after)))
        if s.since is not None:
            d = d.where(F.col("appended") >= F.lit(self.constant(s.since)).cast("timestamp_ntz"))
        d = d.orderBy("position")
        return Answer("rows", d.limit(n) if n is not None else d)

    def hand_out(self, t: Table, g: dict, s: Node, n: int | None) -> DataFrame:
        """Due messages first, then new ones while there is room; what was delivered often enough goes to the dead letters."""
        if s.member is not None and g["members"] and s.member not in g["members"]:
            raise Refused("NotAMember", s.member)
        now, held = self.now_micros(), g["held"]
        if s.held:
            mine = [int(p) for p, h in held.items() if s.member is None or h["member"] == s.member]
            return self.messages(t).where(F.col("position").isin(mine)).orderBy("position")
        due = sorted(int(p) for p, h in held.items() if h["until"] is not None and h["until"] <= now)
        spent = [p for p in due if g["deliveries"] and held[str(p)]["count"] >= g["deliveries"]]
        if spent and g["dead"]:
            letters = self.messages(t).where(F.col("position").isin(spent)).drop("appended").withColumnRenamed("position", "was_at")
            self.publish(self.tables[g["dead"]], letters.drop("id"), None)
        for p in spent:
            del held[str(p)]
        due = [p for p in due if p not in spent]
        room = max(0, g["in_flight"] - len(held))
        most = n if n is not None else g["in_flight"]
        again = due[:most]
        fresh = [r[0] for r in self.messages(t).where(F.col("position") > F.lit(g["at"])).orderBy("position").select("position").limit(min(room, most - len(again))).collect()] if most > len(again) and room else []
        if fresh:
            g["at"] = fresh[-1]
        until = now + g["deadline"] if g["deadline"] is not None else None
        for p in again + fresh:
            held[str(p)] = {"until": until, "count": held.get(str(p), {"count": 0})["count"] + 1, "member": s.member}
        return self.messages(t).where(F.col("position").isin(again + fresh)).orderBy("position")

    def do_ack(self, s: Node):
        from .session import Answer

        g = self.group(s.topic, s.group)
        settled = [p for p in s.positions if g["held"].pop(str(int(self.number(p))), None) is not None]
        return Answer("value", value=len(settled))

    def do_nack(self, s: Node):
        from .session import Answer

        g = self.group(s.topic, s.group)
        n = 0
        for p in s.positions:
            h = g["held"].get(str(int(self.number(p))))
            if h is not None:
                h["until"] = self.now_micros() + int(s.delay or 0)
                n += 1
        return Answer("value", value=n)

    def do_hand(self, s: Node):
        from .session import Answer

        g = self.group(s.topic, s.group)
        after = int(self.number(s.after)) if s.after is not None else 0
        mine = sorted(int(p) for p, h in g["held"].items() if int(p) > after and (s.member is None or h["member"] == s.member))
        mine = mine[: int(self.number(s.limit))] if s.limit is not None else mine
        for p in mine:
            g["held"][str(p)]["member"] = s.to
        return Answer("rows", self.messages(self.table(s.topic)).where(F.col("position").isin(mine)).orderBy("position"))

    def do_alter_group(self, s: Node):
        g = self.group(s.topic, s.name)
        if s.start is not None:
            g["at"], g["held"] = int(self.number(s.start)), {}
        elif s.add:
            g["members"] = sorted({*g["members"], s.member})
        else:
            if s.member not in g["members"]:
                raise Refused("Unknown", s.member)
            g["members"].remove(s.member)
            for h in g["held"].values():
                if h["member"] == s.member:
                    h["until"] = self.now_micros()

    def do_trim(self, s: Node):
        from .session import Answer

        t = self.table(s.topic, "topic")
        d = self.messages(t)
        if s.keep is not None:
            keep = int(self.number(s.keep))
            first = max(int(t.options["next"]) - keep, int(t.options.get("first", 1)))
        else:
            first = self._position(t, s.before)
        gone = d.where(F.col("position") < first).count()
        t.options["first"] = first
        if gone:
            self.store.rewrite(t, self.store.frame(t).where(F.col("position") < first).select("id"))
        return Answer("value", value=gone)

    # ---- queues

    def refuse_engine_fields(self, t: Table, names: list[str]) -> None:
        if t.kind == "queue" and any(n in ENGINE_FIELDS for n in names):
            raise Refused("QueueFieldIsTheEngines", t.name)

    def claimable(self, t: Table) -> DataFrame:
        d = self.store.frame(t)
        for c, kind in (("claimed_until", "timestamp_ntz"), ("attempts", "long"), ("claimant", "string")):
            if c not in d.columns:
                d = d.withColumn(c, F.lit(None).cast(kind))
        now = F.lit(self.now()).cast("timestamp_ntz")
        free = F.col("claimed_until").isNull() | (F.col("claimed_until") <= now)
        if t.options.get("attempts"):
            free &= F.coalesce(F.col("attempts"), F.lit(0)) < int(t.options["attempts"])
        nb = t.options.get("not_before")
        if nb and nb in d.columns:
            free &= F.col(nb).isNull() | (F.col(nb).cast("timestamp_ntz") <= now)
        return d.where(free)

    def do_claim(self, s: Node):
        """The head of the queue, or a record by name, under a hold that lapses."""
        from .session import Answer

        t = self.table(s.row.table if s.row is not None else s.table)
        if t.kind != "queue":
            raise Refused("NotAQueue", t.name)
        if s.row is not None:
            i = self.constant(s.row.id)
            if not t.parts or not self.store.frame(t).where(F.col("id") == F.lit(i)).limit(1).count():
                raise Refused("Unknown", f"{t.name}:{i}")
            d, n = self.claimable(t).where(F.col("id") == F.lit(i)), 1
        else:
            n = int(self.number(s.n))
            if n > MOST_CLAIMED:
                raise Refused("ClaimAboveCeiling", str(n))
            if not t.parts:
                return Answer("rows", self.store.frame(t))
            d = self.claimable(t)
            if s.where is not None:
                d = d.where(Scope(self, d, "id", t.name).condition(s.where))
        p = t.options.get("priority")
        order = ([F.col(p).desc_nulls_last()] if p and p in d.columns else []) + [F.col("id")]
        taken = written(d.orderBy(*order).limit(n), "claim")
        until = F.lit(self.now_micros() + int(t.options["timeout"]))
        held = taken.withColumns({"claimed_until": F.timestamp_micros(until).cast("timestamp_ntz"), "attempts": F.coalesce(F.col("attempts"), F.lit(0)).cast("long") + 1, "claimant": F.lit(self.consumer).cast("string")})
        held = written(held, "held")
        if held.limit(1).count():
            self.store.rewrite(t, taken.select("id"), held)
        return Answer("rows", held.orderBy(*order))

    def do_release(self, s: Node):
        from .session import Answer

        t = self.table(s.row.table if s.row is not None else s.table, "queue")
        if not t.parts:
            return Answer("value", value=0)
        d = self.store.frame(t)
        if "claimed_until" not in d.columns:
            return Answer("value", value=0)
        who = s.consumer or self.consumer
        if s.row is not None:
            d = d.where((F.col("id") == F.lit(self.constant(s.row.id))) & F.col("claimed_until").isNotNull())
            if s.consumer is not None:
                d = d.where(F.col("claimant").eqNullSafe(F.lit(s.consumer)))
        else:
            if who is None:
                raise Refused("NoConsumer")
            d = d.where((F.col("claimant") == F.lit(who)) & (F.col("claimed_until") > F.lit(self.now()).cast("timestamp_ntz")))
        hit = written(d, "released")
        n = hit.count()
        if n:
            free = hit.withColumns({"claimed_until": F.lit(None).cast("timestamp_ntz"), "claimant": F.lit(None).cast("string")})
            self.store.rewrite(t, hit.select("id"), free)
        return Answer("value", value=n) if s.row is None else Answer("ok")

    # ---- consumers

    def drain(self, name: str) -> int:
        """Carry a topic consumer's new messages into its table: upserts by identity, and the position moves with them, so a message counts once."""
        c = self.defs("consumers").get(name)
        if c is None or "from" not in c:
            raise Refused("Unknown", name)
        src = self.table(c["from"], "topic")
        d = written(self.messages(src).where(F.col("position") > F.lit(c["at"])), "drained")
        last = d.agg(F.max("position")).first()[0]
        if last is None:
            return 0
        n = self.carry(d, c)
        c["at"] = last
        self.store.save(self.catalog)
        return n

    def carry(self, d: DataFrame, c: dict) -> int:
        """Messages to rows: mapped fields, an identity; those without one stop the consumer or are set aside."""
        i = c["identity"] or "id"
        names = {a: b or a for a, b in c["map"]}
        ident = F.col(i) if i in d.columns else F.lit(None).cast("string")
        rows = d.select(ident.alias("id"), *(F.col(a).alias(b) if a in d.columns else F.lit(None).cast("string").alias(b) for a, b in names.items()), F.col("position"))
        bad = rows.where("id is null")
        if bad.limit(1).count():
            if c["failure"] != "quarantine":
                raise Refused("ConsumerStopped", "a message has no identity")
            c.setdefault("quarantined", []).extend(r[0] for r in bad.select("position").orderBy("position").limit(1000).collect())
        newest = rows.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*names.values()), "position").alias("r")).select("id", "r.*") if names else rows.where("id is not null").select("id").distinct()
        out = written(newest, "carried")
        if out.limit(1).count():
            self.put(self.table(c["into"]), out, "update")
        return out.count()

    def kafka_stream(self, name: str, schema: str, checkpoint: str, options: dict[str, str] | None = None):
        """A streaming query for a Kafka consumer: JSON by schema, at least once, upserted by identity; a text that can't be read follows the failure rule."""
        c = self.defs("consumers").get(name)
        if c is None or "brokers" not in c:
            raise Refused("Unknown", name)
        source = self.spark.readStream.format("kafka").option("kafka.bootstrap.servers", ",".join(c["brokers"])).option("subscribe", c["topic"])
        for k, v in (options or {}).items():
            source = source.option(k, v)
        return self.stream_into(source.load().select(F.col("value").cast("string").alias("value"), F.col("offset").alias("position")), c, schema, checkpoint)

    def stream_into(self, messages: DataFrame, c: dict, schema: str, checkpoint: str):
        """value (JSON text) and position of a stream into the consumer's table, a batch at a time."""

        def batch(d: DataFrame, _: int) -> None:
            read = d.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("m"), "position")
            self.carry(read.select("m.*", "position"), c)
            self.store.save(self.catalog)

        return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
