from polystrata.streaming import rollup


def test_stream_with_late_rows_equals_batch(spark, tmp_path):
    schema = "ts timestamp, k string, v long"
    parts = [["('2024-01-01 00:00:10', 'a', 1)", "('2024-01-01 00:07:00', 'a', 5)"], ["('2024-01-01 00:00:30', 'a', 9)", "('2023-12-31 23:59:59', 'b', 2)"]]
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    for rows in parts:  # the second file is late for the first one's windows
        spark.sql(f"select cast(col1 as timestamp) ts, col2 k, cast(col3 as long) v from values {', '.join(rows)}").write.mode("append").parquet(src)
        rollup.keep(spark.readStream.schema(schema).parquet(src), "ts", "k", "v", "5 minutes", out, mark).awaitTermination()
    got = sorted(tuple(r) for r in rollup.current(spark, out, "k").collect())
    assert got == sorted(tuple(r) for r in rollup.rollup(spark.read.parquet(src), "ts", "k", "v", "5 minutes").collect()) and len(got) == 3
