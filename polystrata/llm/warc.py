"""WARC archives with a two-level capture index: sorted, compressed key blocks and a sparse directory for binary search."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path, new_dir, ship, written

#: Bytes at which an archive is closed and the next begun; lines of an index block.
ARCHIVE_BYTES, BLOCK_LINES = 64 << 20, 1000
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels reversed, lower case, then the path and query: com,example,www)/a?b. Null: '-'."""
    if url is None:
        return "-"
    try:
        p = urlsplit(url.strip())
        host, port = p.hostname or "", p.port
    except ValueError:
        return _CONTROL.sub("", url)
    if not host:
        return _CONTROL.sub("", url)
    tail = (p.path or "/") + ("?" + p.query if p.query else "")
    return _CONTROL.sub("", ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _value(x: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", x)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """One record, uncompressed. `first` makes it a revisit of that page."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {i}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": _value(url) if url else "urn:x-none",
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if first is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(first), "X-Refers-To-Page": str(first)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def gzipped(data: bytes, level: int = 5) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Record:
    head: dict[str, str]
    payload: bytes | None  # None for a revisit

    @property
    def page_id(self) -> int | None:
        return int(self.head["x-page-id"]) if self.head["x-page-id"] else None


def parse(data: bytes) -> Record:
    """A record of bytes that are one gzip member. Wrong lengths and digests raise ValueError."""
    raw = zlib.decompress(data, 31)
    top, sep, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    n = int(head["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    if head["warc-type"] == "revisit":
        return Record(head, None)
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if head["warc-payload-digest"] != "sha1:" + digest(payload):
        raise ValueError("the payload doesn't have its digest")
    return Record(head, payload)


def read_range(path: str, at: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        return f.read(size)


def _archiver(folder: str, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        out, lines, at, name = None, [], 0, ""

        def close() -> pd.DataFrame:
            out.close()
            os.rename(name + ".open", name)
            return pd.DataFrame(lines, columns=["key", "page_id", "file", "at", "size"])

        for pdf in batches:
            for page, url, html, first in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["html"], pdf["first"].astype("Int64")):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"  # a task that runs again writes other files
                    out, lines, at = open(name + ".open", "wb"), [], 0
                page, first = (None if x is pd.NA else int(x) for x in (page, first))
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                url = url if isinstance(url, str) else None
                data = gzipped(record(page, url, payload, first, date))
                out.write(data)
                lines.append((url_key(url), page, name, at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def _blocks(folder: str):
    """Write sorted lines as an index part: compressed blocks, and beside them the part's directory, a line a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/{uuid.uuid4().hex}.cdx.gz"
        rest: list[str] = []
        directory: list[tuple[str, int, int]] = []
        at, first, last = 0, None, None
        with open(name, "wb") as out:

            def put(lines: list[str]) -> None:
                nonlocal at
                data = gzipped("\n".join(lines).encode())
                out.write(data)
                directory.append((json.loads(lines[0])[0], at, len(data)))
                at += len(data)

            for pdf in batches:
                for key, page, file, pos, size in zip(pdf["key"], pdf["page_id"].astype("Int64"), pdf["file"], pdf["at"], pdf["size"]):
                    first, last = key if first is None else first, key
                    rest.append(json.dumps([key, None if page is pd.NA else int(page), file, int(pos), int(size)]))
                    if len(rest) == BLOCK_LINES:
                        put(rest)
                        rest = []
            if rest:
                put(rest)
        if directory:
            with open(name + ".dir", "w") as f:
                f.writelines(json.dumps(x) + "\n" for x in directory)
            yield pd.DataFrame({"part": [name], "first_key": [first], "last_key": [last], "blocks": [[{"at": a, "size": s} for _, a, s in directory]]})

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html, ...) -> the index's parts: part, first_key, last_key, blocks.

    One record a row. Of records with equal payloads of at least `min_bytes`
    bytes those with the smallest page_id are responses and the others revisit
    it. Null html is an empty payload; null urls have the key '-'; rows with a
    null page_id are responses. Other columns are ignored.

    Archives and index live in the shared folder. A file gets its name when its
    task begins and counts only once its lines are in the table of lines, so a
    task that is lost and run again leaves nothing behind but an unused file.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = local_path(new_dir(spark, "warc"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary"))))
    copied = p.where("sha is not null").groupBy("sha").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("sha", "low")
    p = p.join(copied, "sha", "left").select("page_id", "url", "html", F.when(F.col("page_id") > F.col("low"), F.col("low")).alias("first"))
    lines = written(p.mapInPandas(_archiver(folder, date), "key string, page_id long, file string, at long, size long"), "warc-lines")
    in_order = lines.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")
    return written(in_order.mapInPandas(_blocks(folder), "part string, first_key string, last_key string, blocks array<struct<at:long,size:long>>"), "warc-parts")


def read_archives(parts: DataFrame) -> DataFrame:
    """Every record, read back through the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    blocks = parts.select("part", F.explode("blocks").alias("b")).select("part", "b.at", "b.size")
    blocks = blocks.repartition(max(12, parts.sparkSession.sparkContext.defaultParallelism * 2), "part", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, at, size in zip(pdf["part"], pdf["at"], pdf["size"]):
                rows = []
                lines = [json.loads(x) for x in zlib.decompress(read_range(part, at, size), 31).decode().split("\n")]
                for _, _, file, pos, n in sorted(lines, key=lambda x: (x[2], x[3])):
                    r = parse(read_range(file, pos, n))
                    if r.payload is not None and len(r.payload) != int(r.head["x-payload-length"]):
                        raise ValueError(f"page {r.page_id}: the payload isn't whole")
                    first = r.head.get("x-refers-to-page")
                    rows.append((r.page_id, int(r.head["x-payload-length"]), r.head["warc-payload-digest"][5:], r.head["warc-type"], int(first) if first else None))
                yield pd.DataFrame({c: pd.Series([x[i] for x in rows], dtype=t) for i, (c, t) in enumerate((("page_id", "Int64"), ("payload_bytes", "int64"), ("payload_digest", "object"), ("record_type", "object"), ("refers_to", "Int64")))})

    return blocks.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


class CaptureIndex:
    """Look-ups by url: bisect the parts' key ranges, then a part's directory, then read single blocks and records.

    Holds one entry a part (as many as the index has partitions) and the
    directories of the parts asked last.
    """

    def __init__(self, parts: DataFrame):
        rows = sorted(parts.select("first_key", "last_key", "part").collect())
        self.first, self.last, self.part = ([r[i] for r in rows] for i in range(3))
        self.directories: dict[str, list] = {}
        self.blocks_read = 0

    def lookup(self, url: str | None) -> list[Record]:
        key, out = url_key(url), []
        for p in range(bisect_left(self.last, key), bisect_right(self.first, key)):
            part = self.part[p]
            if part not in self.directories:
                if len(self.directories) > 64:
                    self.directories.clear()
                with open(part + ".dir") as f:
                    self.directories[part] = [json.loads(x) for x in f]
            d = self.directories[part]
            keys = [x[0] for x in d]
            for _, at, size in d[max(0, bisect_left(keys, key) - 1) : bisect_right(keys, key)]:
                self.blocks_read += 1
                for line in zlib.decompress(read_range(part, at, size), 31).decode().split("\n"):
                    k, _, file, pos, n = json.loads(line)
                    if k == key:
                        out.append(parse(read_range(file, pos, n)))
        return out
