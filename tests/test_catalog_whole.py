from polystrata.plans import catalog


def test_joins_have_every_row(spark):
    d = "/root/testdata/sf0.01"
    keys = lambda t, c: {r[0] for r in spark.read.parquet(f"{d}/{t}.parquet").select(c).collect()}
    got = catalog.queries()["full_join_whole"](spark, d).collect()
    assert {r.c_custkey for r in got} - {None} == keys("customer", "c_custkey") and {r.s_suppkey for r in got} - {None} == keys("supplier", "s_suppkey")
    assert any(r.c_custkey is None for r in got) and any(r.s_suppkey is None for r in got) and any(None not in r for r in got)
    rich = {r[0] for r in spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 9000").select("c_custkey").collect()}
    pairs = catalog.queries()["self_join_whole"](spark, d).collect()
    assert any(r.one not in rich and r.other not in rich for r in pairs)
