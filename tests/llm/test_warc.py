import base64
import hashlib

import pytest

from polystrata.llm import warc


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rows += [(5000, rows[0][1], rows[3][2]), (5001, None, None), (5002, "http://a.b/\r\nX: y", ""), (5003, "no host", "é" * 300_000), (None, "http://c.d", "null id")]
    want, low = {}, {}
    for i, _, h in rows:
        raw = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[i] = (len(raw), d)
        if i is not None:
            low[d] = min(low.get(d, i), i)
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    parts = warc.write_archives(df)
    got = {r.page_id: tuple(r)[1:] for r in warc.read_archives(parts).collect()}
    assert got == {i: (n, d, *(("revisit", low[d]) if i is not None and low[d] < i else ("response", None))) for i, (n, d) in want.items()}
    index = warc.CaptureIndex(parts)
    for i, u, h in rows:
        assert i in [r.page_id for r in index.lookup(u)]
    assert index.lookup("http://nowhere.example/") == [] and index.lookup(rows[1][1])[0].payload.decode() == rows[1][2]
    small_only = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(df, min_bytes=1)).collect()}
    assert small_only[5002] == "response" and small_only[5000] == "revisit"
    assert warc.read_archives(warc.write_archives(df.limit(0))).collect() == []


def test_keys_and_damage():
    assert warc.url_key("HTTP://User@WWW.Example.com:8080/A?b=1#c") == "com,example,www:8080)/A?b=1"
    assert warc.url_key(None) == "-"
    data = warc.gzipped(warc.record(1, "http://x.y", b"abc", None, "2024-01-01T00:00:00Z"))
    assert warc.parse(data).payload == b"abc"
    with pytest.raises(ValueError):
        warc.parse(warc.gzipped(warc.record(1, "http://x.y", b"abc", None, "d").replace(b"abc", b"abd")))
