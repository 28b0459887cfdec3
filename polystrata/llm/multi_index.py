"""Embedding near-duplicates by an inverted multi-index: two codebooks, a product grid of cells, multi-sequence traversal."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written
from .components import components

#: Members, and queries, that one task compares at once.
BLOCK = 1024
#: Rows, taken by hash of the id, that codebooks are fitted on; every row is indexed.
SAMPLE = 20_000


def fit_codebook(a: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids of at most k distinct rows."""
    a = np.unique(a, axis=0)
    r = np.random.default_rng(seed)
    c = a[r.choice(len(a), min(k, len(a)), replace=False)].copy() if len(a) else np.zeros((1, a.shape[1]))
    for _ in range(rounds):
        own = distances(a, c).argmin(axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = a[own == i].mean(axis=0)
    return np.unique(c, axis=0)


def distances(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ c.T + (c * c).sum(axis=1)


def borders(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance from each row to the border between its own cell and each other cell of a codebook."""
    own = d.argmin(axis=1)
    gap = np.sqrt(np.maximum(distances(c, c), 0))[own]
    return np.where(gap > 1e-12, np.maximum(d - d.min(axis=1)[:, None], 0) / (2 * np.maximum(gap, 1e-12)), 0.0) ** 2


def visit(left: np.ndarray, right: np.ndarray, stop: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: cells (i, j) by growing left[i] + right[j], while the sum is at most `stop`."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, out = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, []
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > stop and out:
            break
        out.append((int(a[i]), int(b[j])))
        for x in ((i + 1, j), (i, j + 1)):
            if x[0] < len(a) and x[1] < len(b) and x not in seen:
                seen.add(x)
                heapq.heappush(heap, (left[a[x[0]]] + right[b[x[1]]], *x))
    return out


def stop_for(cosine: float, width: int, recall: float) -> float:
    """How far over borders to look: a partner at the threshold, displaced by 2 - 2 cos in any direction, lies beyond with probability 1 - recall."""
    return 2 * (2 - 2 * cosine) / width * math.log(1 / (1 - recall))


def needed_stop(u: np.ndarray, books: tuple[np.ndarray, np.ndarray], cosine: float, recall: float, most: int = 1000, seed: int = 11) -> float:
    """The stop by which a traversal from either side finds `recall` of made partners, with the codebooks as they are.

    Data of few dimensions displaces partners in few directions, so partners are
    made from the data: of up to `most` sample vectors each is moved, to just
    the threshold, in the direction of one of its ten nearest sample vectors.
    What lies at the threshold in one cell needs no traversal at all; the bound
    2 - 2 cos is enough for any partner.
    """
    r = np.random.default_rng(seed)
    q = u[r.choice(len(u), min(most, len(u)), replace=False)]
    near = np.argsort(-(q @ u.T), axis=1)[:, 1:11]
    if not near.shape[1]:
        return 2 - 2 * cosine
    d = u[near[np.arange(len(q)), r.integers(0, near.shape[1], len(q))]] - q
    d -= (d * q).sum(axis=1)[:, None] * q  # along the sphere
    norm = np.sqrt((d * d).sum(axis=1))
    q, d = q[norm > 1e-9], d[norm > 1e-9] / norm[norm > 1e-9, None]
    if not len(q):
        return 2 - 2 * cosine
    p, half = cosine * q + math.sqrt(1 - cosine * cosine) * d, u.shape[1] // 2

    def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a))
        for x, y, c in ((a[:, :half], b[:, :half], books[0]), (a[:, half:], b[:, half:], books[1])):
            out += borders(distances(x, c), c)[np.arange(len(a)), distances(y, c).argmin(axis=1)]
        return out

    return float(min(2 - 2 * cosine, np.quantile(np.minimum(cost(q, p), cost(p, q)), recall)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


Grid = tuple[tuple[np.ndarray, np.ndarray], float]  # two codebooks, and the stop of a traversal


def _whole_grid(width: int) -> Grid:
    """One cell: vectors of a width that the sample doesn't hold are all compared."""
    return (np.zeros((1, width // 2)), np.zeros((1, width - width // 2))), 0.0


def _indexer(grids: dict[int, Grid]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, part in pdf.groupby(pdf["embedding"].map(len)):
                books, stop = grids.get(width) or _whole_grid(width)
                half, k2 = width // 2, len(books[1])
                raw = np.stack(part["embedding"].to_numpy())
                u = _unit(raw)
                parts = [borders(distances(x, c), c) for x, c in zip((u[:, :half], u[:, half:]), books)]
                home = distances(u[:, :half], books[0]).argmin(axis=1) * k2 + distances(u[:, half:], books[1]).argmin(axis=1)
                visits = [np.array(sorted({h, *(i * k2 + j for i, j in visit(p, q, stop))}), np.int32) for p, q, h in zip(*parts, home.tolist())]
                yield pd.DataFrame({"row": part["row"], "vec_id": part["vec_id"], "label": part["label"], "width": width, "cell": home.astype(np.int32), "visits": visits, "v": [x.tobytes() for x in raw]})

    return run


def _pieces(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable within the bipartite links of a block, for its queries and its members."""
    a, b = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(a, np.where(hit, b[None, :], top).min(axis=1, initial=top))
        nb = np.minimum(b, np.where(hit, na[:, None], top).min(axis=0, initial=top))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def _matcher(cosine: float, dtype: str):
    def block(g: pd.DataFrame, out: list) -> None:
        q, m = g[g["query"].to_numpy(bool)], g[~g["query"].to_numpy(bool)]
        if not len(q) or not len(m):
            return
        load = lambda x: _unit(np.frombuffer(b"".join(x["v"]), dtype).reshape(len(x), -1))
        hit = (load(q) @ load(m).T >= cosine) & (q["row"].to_numpy()[:, None] != m["row"].to_numpy()[None, :])
        qi, mi = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(qi):
            return
        hit, q, m = hit[np.ix_(qi, mi)], q.iloc[qi], m.iloc[mi]
        # a member is credited here only if its own traversal doesn't come by the query's cell
        seen = np.array([np.isin(q["cell"].to_numpy(), x) for x in m["visits"]]).T
        back = (hit & ~seen).sum(axis=0)
        ra, rb = _pieces(hit, q["vec_id"].to_numpy(np.int64), m["vec_id"].to_numpy(np.int64))
        out += zip(q["row"], q["vec_id"], hit.sum(axis=1), ra)
        out += zip(m["row"], m["vec_id"], back, rb)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            keys = pdf[["label", "width", "at", "qb", "mb"]].to_numpy()
            bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            out: list = []
            for s, e in zip(bounds[:-1], bounds[1:]):
                block(pdf.iloc[s:e], out)
            rest = pdf.iloc[bounds[-1] :]
            yield pd.DataFrame(out, columns=["row", "vec_id", "n", "root"])
        if rest is not None and len(rest):
            out = []
            block(rest, out)
            yield pd.DataFrame(out, columns=["row", "vec_id", "n", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.99, centroids: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) -> vec_id, n_links, component_id, kept: one row for each input row.

    Vectors of equal, not null labels and of equal widths are linked when their
    cosine, in double precision, is at least `cosine`. Each width has its own
    grid, its codebooks fitted on that width's part of SAMPLE rows; their size
    grows with the square root of the rows, so that cells keep their mean size,
    as far as the sample can fit it (a centroid for 8 rows of it). Every row is
    indexed and is a query. A traversal goes on as far as `recall` of partners
    displaced by the threshold's distance need, at random or as needed_stop()
    measures. Links are verified, so none is below the threshold.

    Cells are cut into blocks of BLOCK members and as many queries; a block
    emits counts and its pieces' smallest ids, never pairs.

    Null, empty, zero and non-finite vectors and those with a null label or id
    are linked with nothing; with a null id the component is null and the row
    is kept. Repeated rows are rows of their
    own: copies are linked with each other and share their id's component.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    element = vectors.schema["embedding"].dataType.elementType
    dtype, kind = ("<f4", "array<float>") if isinstance(element, T.FloatType) else ("<f8", "array<double>")
    v = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    v = written(v.withColumn("good", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad, F.lit(False))), "vectors")
    count = v.where("good").count()
    plain = v.select("row", "vec_id")
    if count:
        good = v.where("good").select("row", "vec_id", "label", "embedding")
        sample: dict[int, list] = {}
        for r in good.orderBy(F.xxhash64("vec_id", "row")).limit(SAMPLE).select("embedding").collect():
            sample.setdefault(len(r[0]), []).append(r[0])
        grids: dict[int, Grid] = {}
        for width, found in sample.items():
            u, half = _unit(np.array(found)), width // 2
            share = count * len(found) / min(count, SAMPLE)
            k = centroids or max(4, min(len(found) // 8, round(math.sqrt(share / 1000))))
            books = (fit_codebook(u[:, :half], k), fit_codebook(u[:, half:], k))
            grids[width] = books, max(stop_for(cosine, width, recall), needed_stop(u, books, cosine, recall))
        schema = "row long, vec_id long, label long, width int, cell int, visits array<int>, v binary"
        index = written(good.mapInPandas(_indexer(grids), schema), "index")
        askers = index.select("label", "width", F.explode("visits").alias("at"))
        sizes = index.groupBy("label", "width", F.col("cell").alias("at")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mbs"))
        sizes = sizes.join(askers.groupBy("label", "width", "at").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qbs")), ["label", "width", "at"])
        spot = lambda n: F.pmod(F.hash("row"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        none = F.lit(None).cast("array<int>")
        asked = index.withColumn("at", F.explode("visits")).join(sizes, ["label", "width", "at"]).select("label", "width", "at", spot("qbs").alias("qb"), every("mbs").alias("mb"), "row", "vec_id", "cell", none.alias("visits"), "v", F.lit(True).alias("query"))
        held = index.withColumn("at", F.col("cell")).join(sizes, ["label", "width", "at"]).select("label", "width", "at", every("qbs").alias("qb"), spot("mbs").alias("mb"), "row", "vec_id", "cell", "visits", "v", F.lit(False).alias("query"))
        blocks = asked.unionByName(held).repartition("label", "width", "at", "qb", "mb").sortWithinPartitions("label", "width", "at", "qb", "mb")
        found = written(blocks.mapInPandas(_matcher(cosine, dtype), "row long, vec_id long, n long, root long"), "found")
        linked = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
        plain = plain.join(found.groupBy("row").agg(F.sum("n").alias("n_links")), "row", "left").join(linked, F.col("vec_id") == F.col("node"), "left")
    else:
        plain = plain.withColumns({"n_links": F.lit(0), "component": F.lit(None).cast("long")})
    return plain.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
