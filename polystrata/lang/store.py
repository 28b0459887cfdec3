"""Stored tables: lists of Parquet folders, versions of which stay readable.

Inserts add a folder. Updates and deletes rewrite only the folders that hold a
row they touch. A column that comes later reads as absent in older folders.
The catalog is a JSON text in the same place, so another session goes on with it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import new_dir, remove_dir
from .errors import Refused


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both, or a refusal."""
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = a.fieldNames() + [n for n in b.fieldNames() if n not in a.fieldNames()]
        return T.StructType([T.StructField(n, merged(a[n].dataType, b[n].dataType) if n in a.fieldNames() and n in b.fieldNames() else (a if n in a.fieldNames() else b)[n].dataType) for n in names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.DoubleType) or isinstance(b, T.DoubleType):
            return T.DoubleType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            return T.DecimalType(38, max(x.scale if isinstance(x, T.DecimalType) else 0 for x in (a, b)))
        return T.LongType()
    raise Refused("KindsDiffer", f"{a.simpleString()} and {b.simpleString()}")


def stored_type(t: T.DataType) -> T.DataType | None:
    """What Parquet can hold: parts without a type are left out, durations are microseconds elsewhere."""
    if isinstance(t, T.NullType):
        return None
    if isinstance(t, T.ArrayType):
        return T.ArrayType(stored_type(t.elementType) or T.StringType())
    if isinstance(t, T.StructType):
        fields = [(f.name, stored_type(f.dataType)) for f in t.fields]
        return T.StructType([T.StructField(n, x) for n, x in fields if x is not None]) if any(x is not None for _, x in fields) else T.StringType()
    if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
        return T.LongType()
    if isinstance(t, T.FloatType):
        return T.DoubleType()
    return t


def cast_to(c: Column, a: T.DataType, b: T.DataType) -> Column:
    """The value in a wider type."""
    if a == b:
        return c
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        parts = [(cast_to(c[f.name], a[f.name].dataType, f.dataType) if f.name in a.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name) for f in b.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType) and isinstance(b.elementType, T.StructType) and isinstance(a.elementType, T.StructType):
        return F.transform(c, lambda x: cast_to(x, a.elementType, b.elementType))
    if isinstance(a, (T.StructType, T.ArrayType)) and isinstance(b, T.StringType):
        return F.to_json(c)
    return c.cast(b)


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*((cast_to(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


@dataclass
class Table:
    name: str
    kind: str
    schema: str = ""
    parts: list[str] = field(default_factory=list)
    history: list[tuple[int, list[str], str]] = field(default_factory=list)
    fields: dict[str, dict] = field(default_factory=dict)
    strict: bool = False
    options: dict = field(default_factory=dict)

    @property
    def type(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema)) if self.schema else T.StructType([])


class Store:
    def __init__(self, spark: SparkSession, root: str | None):
        self.spark = spark
        self.root = root or new_dir(spark, "store")
        self.number = 0

    # ---- frames

    def frame(self, t: Table, version: int | None = None, parts: list[str] | None = None, with_part: bool = False) -> DataFrame:
        schema, held = t.type, t.parts if parts is None else parts
        if version is not None:
            seen = [h for h in t.history if h[0] <= version]
            if not seen:
                raise Refused("NoSuchVersion", str(version))
            held = seen[-1][1]
            schema = T.StructType.fromJson(json.loads(seen[-1][2])) if seen[-1][2] else T.StructType([])
        if not schema.fields:
            schema = T.StructType([T.StructField("id", T.StringType())])
        if not held:
            d = self.spark.createDataFrame([], schema)
            return d.withColumn("_part", F.lit("")) if with_part else d
        d = self.spark.read.schema(schema).parquet(*held)
        return d.withColumn("_part", F.regexp_extract(F.input_file_name(), r"(part-[0-9a-f]{32})", 1)) if with_part else d

    def _note(self, t: Table) -> None:
        self.number += 1
        t.history.append((self.number, list(t.parts), t.schema))

    def _write(self, d: DataFrame, t: Table) -> str:
        path = f"{self.root.rstrip('/')}/{t.name}/part-{uuid.uuid4().hex}"
        if t.options.get("partition_by") in d.columns:
            d = d.repartition(F.col(t.options["partition_by"])).sortWithinPartitions(t.options["partition_by"])
        d.write.parquet(path)
        return path

    def fit(self, t: Table, new: T.StructType) -> None:
        """Widen the table's schema for rows of another one; folders of a type that changed are written anew."""
        kept = T.StructType([T.StructField(f.name, x) for f in new.fields if (x := stored_type(f.dataType)) is not None])
        old = t.type
        wide = merged(old, kept) if old.fields else kept
        changed = [f.name for f in old.fields if _differs(f.dataType, wide[f.name].dataType)]
        if changed and t.parts:
            d = conformed(self.frame(t), wide)
            t.parts = [self._write(d, t)]
        t.schema = wide.json()

    def append(self, t: Table, new: DataFrame) -> None:
        self.fit(t, new.schema)
        t.parts = [*t.parts, self._write(conformed(new, t.type), t)]
        self._note(t)

    def replace(self, t: Table, rows: DataFrame) -> None:
        self.fit(t, rows.schema)
        t.parts = [self._write(conformed(rows, t.type), t)]
        self._note(t)

    def rewrite(self, t: Table, touched: DataFrame, extra: DataFrame | None = None) -> None:
        """Take out the rows whose id is in touched (id), and add others; folders without such rows stay as they are."""
        hit = self.frame(t, with_part=True).join(touched.select("id"), "id", "left_semi").select("_part").distinct().collect()
        names = {r[0] for r in hit}
        affected = [p for p in t.parts if any(p.endswith(n) for n in names if n)]
        rest = self.frame(t, parts=affected).join(touched.select("id"), "id", "left_anti") if affected else None
        if extra is not None:
            self.fit(t, extra.schema)
            extra = conformed(extra, t.type)
            rest = extra if rest is None else conformed(rest, t.type).unionByName(extra)
        added = [self._write(rest, t)] if rest is not None else []
        t.parts = [p for p in t.parts if p not in affected] + added
        self._note(t)

    def clear(self, t: Table) -> None:
        t.parts = []
        self._note(t)

    def drop(self, t: Table) -> None:
        remove_dir(self.spark, f"{self.root.rstrip('/')}/{t.name}")

    # ---- the catalog

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, catalog: dict) -> None:
        text = json.dumps({"number": self.number, "catalog": catalog}, default=lambda x: asdict(x) if isinstance(x, Table) else sorted(x))
        fs, p = self._file("catalog.json.new")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, final = self._file("catalog.json")
        fs.delete(final, False)
        fs.rename(p, final)

    def load(self) -> dict | None:
        fs, p = self._file("catalog.json")
        if not fs.exists(p):
            return None
        reader = self.spark.sparkContext._jvm.java.util.Scanner(fs.open(p), "UTF-8").useDelimiter("\\A")
        text = reader.next()
        reader.close()
        held = json.loads(text)
        self.number = held["number"]
        return held["catalog"]


def _differs(a: T.DataType, b: T.DataType) -> bool:
    """Whether a stored value of type a can't be read as b; more fields of a struct can."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return any(_differs(f.dataType, b[f.name].dataType) for f in a.fields)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _differs(a.elementType, b.elementType)
    return a != b
