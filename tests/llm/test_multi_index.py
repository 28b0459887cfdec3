import numpy as np
import pytest

from polystrata.llm import multi_index
from polystrata.llm.multi_index import near_vectors, visit


def brute(rows, cosine):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        a = np.array(v, np.float32).astype(float)
        ok[k] = (i, a / np.linalg.norm(a), (label, len(v)))
    n, parent = {k: 0 for k in range(len(rows))}, {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a, label) in ok.items():
        for m, (j, b, other) in ok.items():
            if m != k and label == other and a @ b >= cosine:
                n[k] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((str(r[0]), n[k], None if r[0] is None else find(r[0])) for k, r in enumerate(rows))


def test_against_all_pairs(spark):
    r = np.random.default_rng(1)
    rows = []
    for g in range(60):
        c = r.normal(size=16)
        for _ in range(r.integers(1, 30)):
            rows.append((len(rows), [float(x) for x in (c + 0.25 * r.normal(size=16)).astype(np.float32)], int(g % 3)))
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [1.0] * 15 + [None], 1), (9004, rows[0][1], None), (None, rows[0][1], 0), (3, rows[3][1], rows[3][2]), (9005, [1e30 * x for x in rows[5][1]], rows[5][2])]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = sorted((str(x.vec_id), x.n_links, x.component_id) for x in near_vectors(df, 0.93, centroids=6).collect())
    want = brute(rows, 0.93)
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert found <= there and found >= 0.995 * there and len(got) == len(want)
    assert sum(a == b for a, b in zip(got, want)) >= 0.99 * len(want)
    assert near_vectors(df.limit(0)).collect() == []


def test_traversal_is_in_order():
    r = np.random.default_rng(2)
    a, b = r.random(9), r.random(7)
    got = visit(a, b, 0.8)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and {*got} == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.8}


def test_widths_are_apart(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (np.eye(6)[i % 6][:w] + 0.1 * r.normal(size=w)).astype(np.float32)], 1) for i, w in enumerate([6] * 90 + [5] * 60 + [1] * 9 + [2] * 3)]
    rows += [(500, [1.0] * 64, 1), (501, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((str(x.vec_id), x.n_links, x.component_id) for x in near_vectors(df, 0.93).collect())
    assert got == brute(rows, 0.93) and sum(x[1] for x in got) > 500


def test_widths_that_the_sample_misses_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SAMPLE", 40)
    rows = [(i, [1.0, float(i % 7), float(i % 3)][: 2 + (i % 50 == 0)], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((str(x.vec_id), x.n_links, x.component_id) for x in near_vectors(df, 0.93).collect()) == brute(rows, 0.93)


@pytest.mark.parametrize("dims", [2, 4, 8, 64])
def test_recall_at_64_components_and_large_codebooks(spark, dims):
    """Data of few dimensions, with as many centroids as some 16 million rows would have."""
    r = np.random.default_rng(dims)
    flat = r.normal(size=(dims, 64)) if dims < 64 else np.eye(64)
    centre = r.normal(size=(1500, dims)) @ flat
    near = centre[r.integers(0, len(centre), 2500)]
    noise = r.normal(size=(2500, dims)) @ flat
    near = near + 0.33 * noise * (np.linalg.norm(near, axis=1) / np.linalg.norm(noise, axis=1))[:, None]
    v = np.concatenate([centre, near]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in x], 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    there = int((u @ u.T >= 0.93).sum()) - len(v)
    found = sum(x.n_links for x in near_vectors(df, 0.93, centroids=128).collect())
    assert there > 1000 and 0.97 * there <= found <= there
