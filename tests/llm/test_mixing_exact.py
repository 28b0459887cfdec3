from collections import Counter
from math import ceil

from polystrata.llm import mixing


def off(order, blocks, weight):
    """The most that a source's blocks are off their share of the given weights, in any prefix of the order; sources that end leave their share to the others."""
    had, fluid, worst = Counter(), dict.fromkeys(blocks, 0.0), 0.0
    for s in order:
        had[s] += 1
        left = 1.0
        while left > 1e-12:
            act = [x for x in blocks if fluid[x] < blocks[x] - 1e-9]
            if not act:
                break
            w = sum(weight[x] for x in act)
            step = min([left, *((blocks[x] - fluid[x]) * w / weight[x] for x in act)])
            for x in act:
                fluid[x] += step * weight[x] / w
            left -= step
        worst = max(worst, *(abs(had[x] - fluid[x]) for x in blocks))
    return worst


def test_within_a_block_of_the_given_weights(spark):
    hot = {"h": 4000, **{f"s{i:02}": 400 for i in range(19)}}
    for sizes, weights in ((hot, None), ({"a": 3000, "b": 40, None: 500, "": 7}, {"a": 1.0, "b": 0.01, None: 0.37, "": 0.2})):
        rows = [(i, s) for s, n in sizes.items() for i in range(n)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, block_rows=4).collect()
        assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
        at = {(r.source, r.block): r.slot for r in got}
        assert sorted(at.values()) == list(range(len(at)))
        blocks = {s: ceil(n / 4) for s, n in sizes.items()}
        order = [s for (s, _), _ in sorted(at.items(), key=lambda x: x[1])]
        assert off(order, blocks, weights or {s: n**0.5 for s, n in sizes.items()}) < 1 + 1e-6
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).collect() == []
