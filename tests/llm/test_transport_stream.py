import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from polystrata.llm import transport_stream as ts


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 300))
def test_round_trip(seed, times):
    payload = (seed * times)[: 400_000]
    payload += b"\xff" * ((-len(payload)) % 576 or (0 if payload else 576))
    data = ts.write_stream(payload)
    s = ts.read_stream(data)
    assert s.payload() == payload and len(data) % 188 == 0
    assert (s.lost_sync, s.discontinuities, s.bad_sections) == (0, 0, 0)
    assert s.programs == {1: 0x100} and s.streams == {0x101: 6}
    assert [u[1] for u in s.units] == [90000 + 3600 * i for i in range(len(s.units))]
    assert [i for i, u in enumerate(s.units) if u[2]] == list(range(0, len(s.units), 8)) and s.clocks == [u[1] - 3600 for u in s.units if u[2]]


def test_every_size_of_a_unit():
    for n in range(1, 800):
        made = ts._packets(5, b"\x01" * n, 3, None)
        assert len(made) % 188 == 0
        assert len(ts._packets(5, b"\x01" * n, 3, 9)) % 188 == 0


def test_damage_is_counted():
    data = bytearray(ts.write_stream(b"x" * 576 * 40))
    del data[188 * 10 : 188 * 11]
    data[188 * 20] = 0
    data[200] ^= 1
    s = ts.read_stream(bytes(data) + b"zz")
    assert s.discontinuities == 2 and s.lost_sync == 2 and s.bad_sections >= 1
    assert ts.read_stream(b"").units == []
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_documents(spark):
    rows = [(1, None, 3), (2, "", 4), (None, "é" * 100_000, 5), (3, "a" * 576, 5), (4, "a" * 576, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in ts.read_media(ts.store_documents(df)).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (((-len(raw)) % 576) or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_bytes % 188 == 0 and r.access_points[0].pts == 90000
    assert got[3].asDict() | {"doc_id": 4} == got[4].asDict()
    assert ts.read_media(ts.store_documents(df.limit(0))).collect() == []
