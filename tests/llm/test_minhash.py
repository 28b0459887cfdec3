import random

from polystrata.llm.components import components
from polystrata.llm.minhash import near_duplicates, plan_bands

from .brute import near_dup

SCHEMA = "doc_id long, text string, u string, h int"


def check(spark, rows, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), k, percent).collect()}
    want = near_dup(rows, k, percent)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_against_all_pairs(spark):
    r = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice([3, 30, 120]))]
        for _ in range(25):
            t = list(base)
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "É x"), (1006, "é x"), (1007, "big " * 50000)]
    check(spark, rows, 3, 85)


def test_edges_of_input(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (2, "q r s t u v")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("2", 1, False), ("None", None, True)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(7, 7), (100, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 300)}


def test_bands_meet_their_bound():
    for p in (70, 80, 85, 95):
        b, r = plan_bands(p)
        assert (1 - (p / 100) ** r) ** b <= 1e-6
