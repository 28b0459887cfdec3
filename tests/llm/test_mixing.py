from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, floor

import pytest

from polystrata.llm import mixing


def brute(blocks, weights):
    """The order of (source, block) by simulating earliest deadline first in fractions; sources of weight 0 after the others."""
    out = []
    for tier in ({s: w for s, w in weights.items() if w}, {s: Fraction(1) for s, w in weights.items() if not w}):
        order = sorted(tier, key=lambda s: (s is not None, s or ""))
        fluid = lambda v: sum(min(tier[s] * v, blocks[s]) for s in order)  # noqa: E731, B023
        done = Counter()
        for t in range(sum(blocks[s] for s in order)):
            due, _, s = min((ceil(fluid((done[s] + 1) / tier[s])), i, s) for i, s in enumerate(order) if done[s] < blocks[s] and floor(fluid(done[s] / tier[s])) <= t)
            assert due > t
            out.append((s, done[s]))
            done[s] += 1
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    return df, mixing.mix(df, **more).collect()


def test_against_simulation(spark):
    sizes = {"a": 900, "b": 130, "c": 61, "d": 1, None: 77, "": 5}
    rows = [(None if i == 3 else i, s, "x") for s, n in sizes.items() for i in range(n)] + [(1, "a", "x")]
    sizes["a"] += 1
    for weights in ({"a": 1.0, "b": 3.0, "c": 2.0}, {"a": 0.0, "b": 0.5, "c": 0.25, "d": 0.0, None: 2.0, "": 1.0}):
        df, got = run(spark, rows, weights=weights, block_rows=4)
        assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, s, _ in rows)
        least = min(weights.values())
        seen = list(dict.fromkeys((r.source, r.block) for r in sorted(got, key=lambda r: (r.slot, r.place))))
        assert seen == brute({s: ceil(n / 4) for s, n in sizes.items()}, {s: Fraction(weights.get(s, least)) for s in sizes})
        places = defaultdict(list)
        for r in got:
            places[r.source, r.block].append(r.place)
        assert all(sorted(p) == list(range(len(p))) and len(p) <= 4 for p in places.values())


def test_less_than_a_block_off(spark):
    for sizes, weights in (({"a": 1600, "b": 800, "c": 700}, {"a": 16.0, "b": 7.0, "c": 5.0}), ({"a": 7920, "b": 80}, {"a": 0.99, "b": 0.01})):
        rows = [(i, s, "") for s, n in sizes.items() for i in range(n)]
        df, got = run(spark, rows, weights=weights, block_rows=4)
        order = [s for (s, _), _ in sorted({(r.source, r.block): r.slot for r in got}.items(), key=lambda x: x[1])]
        w, seen = sum(weights.values()), Counter()
        first_end = min(sizes[s] / 4 / weights[s] for s in sizes) * w
        for t, s in enumerate(order[: floor(first_end)], 1):
            seen[s] += 1
            assert all(abs(seen[x] - t * weights[x] / w) < 1 for x in weights)


def test_blocks_are_bounded(spark):
    df = spark.createDataFrame([(i, "s" if i % 3 else None) for i in range(500)], "doc_id long, source string")
    got = mixing.mix(df, block_rows=4, most_blocks=10).collect()
    assert len({(r.source, r.block) for r in got}) == 11 and max(r.place for r in got) == 49
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mix(df, weights={"s": bad})


def test_buckets_change_nothing_but_the_order(spark):
    df = spark.createDataFrame([(i, "s" if i % 3 else None) for i in range(500)], "doc_id long, source string")
    for n in (20_000, 7):
        got = mixing.ranked(df, "source", [df.doc_id], n).collect()
        for s in ("s", None):
            assert sorted(r._asdict()["_rank"] if hasattr(r, "_asdict") else r["_rank"] for r in got if r.source == s) == list(range(sum(1 for r in got if r.source == s)))
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.laid_out(mixing.mix(df)).count() == 500
