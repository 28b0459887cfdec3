import math

import duckdb
import pytest

from polystrata.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    d = "/root/testdata/sf0.01"
    df = catalog.queries()[name](spark, d)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{d}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    assert norm(tuple(r) for r in df.select(*order).collect()) == norm(tuple(r[cols.index(c)] for c in order) for r in want.fetchall())
