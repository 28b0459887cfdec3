import duckdb
import pytest

from polystrata.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    d = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, d)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as from '{d}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    order = sorted(names)
    assert sorted(got.columns) == order
    assert sorted((tuple(r) for r in got.select(*order).collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in order) for r in want.fetchall()), key=repr)


def test_near_vectors_sql_on_rows_with_links(spark, tmp_path):
    import random

    r = random.Random(6)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in base[i % 12]], i % 3 % 2) for i in range(150)] + [(150, None, 1), (151, [0.0] * 8, 0), (152, base[0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op5_multi_index_near_dedup"]).fetchall())
    got = sorted(tuple(x) for x in queries.op5_multi_index_near_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want and sum(x[1] for x in want) > 100
