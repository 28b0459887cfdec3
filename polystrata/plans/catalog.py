"""The registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import ranking as R
from ..operators import relational as J
from .. import values as V

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query of tables by name, with its DuckDB SQL; without one where SQL can't say it, and tests hold it against plain code."""

    def add(f):
        register(f.__name__, f, sql)
        return f

    return add


def register(name: str, f, sql: str | None, raw: bool = False) -> None:
    """f takes a function that reads a table by name or, raw, the session and the folder."""
    _Q[name] = f if raw else lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
    if sql is not None:
        _SQL[name] = sql


def _all() -> None:
    from . import functions, language, streams  # noqa: F401 - register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


rnd = lambda c, n=4: F.round(c, n)
_SUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query(f"""SELECT l_returnflag, l_linestatus, {_SUM.format('l_quantity')} AS sum_qty, {_SUM.format('l_extendedprice')} AS sum_price,
 round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    d = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(exact("l_quantity").alias("sum_qty"), exact("l_extendedprice").alias("sum_price"), rnd(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size FROM orders
 WHERE o_orderpriority LIKE '%URGENT%' AND o_orderstatus IN ('O', 'F')""")
def filter_project(t):
    d = t("orders").where(V.truthy(F.col("o_orderpriority").like("%URGENT%")) & F.col("o_orderstatus").isin("O", "F"))
    return d.select("o_orderkey", "o_orderpriority", F.when(V.gt(F.col("o_totalprice"), F.lit(200000)), "big").otherwise("small").alias("size"))


@query("""SELECT n_name, c_custkey IS NOT NULL AS matched, count(*) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def left_join(t):
    c = t("customer").where("c_acctbal > 5000")
    return t("nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", F.col("c_custkey").isNotNull().alias("matched")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_custkey <= 300) FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON c_custkey = s_suppkey""")
def full_join(t):
    return t("customer").where("c_custkey <= 300").join(t("supplier").where("s_suppkey % 2 = 0"), F.col("c_custkey") == F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@query("""SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON floor(c_acctbal) = floor(s_acctbal)""")
def full_join_whole(t):
    return t("customer").join(t("supplier"), F.floor("c_acctbal") == F.floor("s_acctbal"), "full").select("c_custkey", "s_suppkey")


@query(f"""SELECT r_name, count(*) AS n, {_SUM.format('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def n_way_join(t):
    d = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.groupBy("r_name").agg(F.count("*").alias("n"), exact("o_totalprice").alias("total"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def semi_join(t):
    o = t("orders").where("o_totalprice > 300000")
    return t("customer").join(o, F.col("c_custkey").eqNullSafe(F.col("o_custkey")), "left_semi").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_join(t):
    return t("customer").join(t("orders"), F.col("c_custkey").eqNullSafe(F.col("o_custkey")), "left_anti").select("c_custkey")


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view')
 SELECT p.event_id, v.ts AS r_ts, v.event_id AS r_event_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(t):
    e = t("events")
    return J.asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", "ts", ["event_id"]).select("event_id", "r_ts", "r_event_id")


@query("""SELECT user_id, count(value) AS n, median(value) AS med, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 4) AS dev, min(value) AS low, max(value) AS high, count(DISTINCT event_type) AS kinds
 FROM events GROUP BY user_id HAVING count(*) > 5""")
def folds(t):
    g = t("events").groupBy("user_id").agg(F.count("value").alias("n"), F.median("value").alias("med"), rnd(F.var_samp("value")).alias("variance"), rnd(F.stddev_samp("value")).alias("dev"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("event_type").alias("kinds"), F.count("*").alias("_all"))
    return g.where("_all > 5").drop("_all")


@query("SELECT coalesce(sum(o_custkey), 0) AS total FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0")
def fold_over_nothing(t):
    return A.fold_all(t("orders").where("o_totalprice < 0"), A.total("o_custkey").alias("total"))


@query("""WITH l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
 SELECT user_id, round(sum(CASE WHEN value >= p THEN value - p WHEN p IS NOT NULL THEN value END), 4) AS increase,
  round(sum(CASE WHEN value >= p THEN value - p WHEN p IS NOT NULL THEN value END) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 8) AS rate, round(arg_max(value, ts) - arg_min(value, ts), 4) AS delta
 FROM l GROUP BY user_id HAVING count(*) > 1""")
def counter_folds(t):
    d = A.counter_folds(t("events"), ["user_id"], "value", "ts", "event_id").where("increase is not null")
    return d.select("user_id", rnd("increase").alias("increase"), rnd("rate", 8).alias("rate"), rnd("delta").alias("delta"))


@query("""WITH k AS (SELECT event_type, CAST(ceil(ln(value) / ln(1.01 / 0.99)) AS BIGINT) AS b FROM events WHERE value >= 1e-9),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM k)
 SELECT event_type, round(2 * pow(1.01 / 0.99, b) / (1.01 / 0.99 + 1), 4) AS quantile FROM r WHERE i = floor(0.9 * (n - 1))""")
def approx_quantile(t):
    return A.quantile_sketch(t("events").where("value >= 1e-9"), ["event_type"], "value", 0.9).select("event_type", rnd("quantile").alias("quantile"))


_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)"


@query(f"""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr,
 lag(o_totalprice) OVER w AS before, lead(o_orderkey, 2) OVER w AS later, first_value(o_orderkey) OVER {_W} AS first, last_value(o_orderkey) OVER {_W} AS last, count(*) OVER {_W} AS running
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_functions(t):
    w, r = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return t("orders").select(
        "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(r).cast("long").alias("rk"), F.dense_rank().over(r).cast("long").alias("dr"), F.lag("o_totalprice").over(w).alias("before"),
        F.lead("o_orderkey", 2).over(w).alias("later"), F.first("o_orderkey").over(run).alias("first"), F.last("o_orderkey").over(run).alias("last"), F.count("*").over(run).alias("running"),
    )


@query("""((SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 20""")
def set_operations(t):
    k = lambda table, c, where="true": t(table).where(where).select(F.col(c).alias("k"))
    return J.combine(k("customer", "c_nationkey"), ("union", k("supplier", "s_nationkey")), ("except", k("nation", "n_nationkey", "n_regionkey = 1")), ("intersect", k("nation", "n_nationkey", "n_nationkey < 20")))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5""")
def page_by_offset(t):
    return t("orders").orderBy(*V.ordered(F.col("o_totalprice").desc(), identity="o_orderkey")).offset(5).limit(10).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 250000.0 OR (o_totalprice = 250000.0 AND o_orderkey > 7) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def page_by_cursor(t):
    d = J.after(t("orders"), [("o_totalprice", False), ("o_orderkey", True)], (250000.0, 7))
    return d.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("""SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def time_buckets(t):
    return t("events").groupBy("event_type", A.bucket(F.col("ts"), 21600).alias("bucket")).agg(F.count("*").alias("n"), rnd(F.sum("value"), 2).alias("total"))


_FILL = """WITH g AS (SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS w, count(*)::DOUBLE AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03' GROUP BY 1, 2),
 s AS (SELECT k.event_type, w FROM (SELECT DISTINCT event_type FROM g) k, generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-02 23:50:00', INTERVAL 10 MINUTE) x(w)),
 f AS (SELECT s.event_type, s.w, g.n, last_value(CASE WHEN g.n IS NOT NULL THEN s.w END IGNORE NULLS) OVER a AS pw, last_value(g.n IGNORE NULLS) OVER a AS pn,
   first_value(CASE WHEN g.n IS NOT NULL THEN s.w END IGNORE NULLS) OVER b AS nw, first_value(g.n IGNORE NULLS) OVER b AS nn FROM s LEFT JOIN g USING (event_type, w)
   WINDOW a AS (PARTITION BY s.event_type ORDER BY s.w ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY s.event_type ORDER BY s.w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_type, w, round(coalesce(n, {}), 4) AS n FROM f"""


def _counts(t):
    d = t("events").where("ts >= timestamp_ntz'2024-01-02' and ts < timestamp_ntz'2024-01-03'")
    return d.groupBy("event_type", A.bucket(F.col("ts"), 600).alias("w")).agg(F.count("*").cast("double").alias("n"))


@query(_FILL.format("pn"))
def fill_previous(t):
    return A.fill(_counts(t), "event_type", "w", "n", "2024-01-02", "2024-01-03", 600, "previous").withColumn("n", rnd("n"))


@query(_FILL.format("pn + (nn - pn) * (epoch_us(w) - epoch_us(pw)) / (epoch_us(nw) - epoch_us(pw))"))
def fill_linear(t):
    return A.fill(_counts(t), "event_type", "w", "n", "2024-01-02", "2024-01-03", 600, "linear").withColumn("n", rnd("n"))


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_by(t):
    return A.latest_by(t("events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")


@query("""SELECT doc_id, unnest(string_split(source || '/' || lang, '/')) AS part FROM documents""")
def split_on(t):
    return J.split_on(t("documents").select("doc_id", F.split(F.concat_ws("/", "source", "lang"), "/", -1).alias("part")), "part")


@query("""SELECT doc_id, length(text) AS len, lower(source) AS low, upper(lang) AS up, replace(source, 'src', 's') AS rep, starts_with(source, 'src1') AS sw, nullif(strpos(text, '.'), 0) - 1 AS dot, sha256(text) AS sha, md5(source) AS md, reverse(source) AS rev FROM documents""")
def string_functions(t):
    return t("documents").select(
        "doc_id", F.char_length("text").cast("long").alias("len"), F.lower("source").alias("low"), F.upper("lang").alias("up"), F.replace("source", F.lit("src"), F.lit("s")).alias("rep"), F.startswith("source", F.lit("src1")).alias("sw"),
        (F.nullif(F.instr("text", "."), F.lit(0)) - 1).cast("long").alias("dot"), F.sha2("text", 256).alias("sha"), F.md5("source").alias("md"), F.reverse("source").alias("rev"),
    )


@query("""SELECT vec_id, round(1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)
 ORDER BY 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), vec_id LIMIT 10""")
def exact_knn(t):
    e = t("embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one row: the query vector
    return R.nearest(e.crossJoin(q), "vec_id", R.cosine(F.col("embedding"), F.col("q")), 10).select("vec_id", rnd("distance", 6).alias("distance"))


_TOK = r"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: x = '{}')"


@query(f"""WITH f AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS len, len({_TOK.format('erhe')}) AS f0, len({_TOK.format('inthat')}) AS f1 FROM documents),
 s AS (SELECT count(*) AS n, avg(len) AS avg, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM f)
 SELECT doc_id, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / avg)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / avg)), 6) AS score FROM f, s WHERE f0 > 0 OR f1 > 0""")
def bm25(t):
    return R.bm25(t("documents"), "doc_id", "text", ["erhe", "inthat"]).select("doc_id", rnd("score", 6).alias("score"))


@query("""WITH a AS (SELECT p_partkey, 2.0 / (60 + row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)) AS s FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= 100),
 b AS (SELECT p_partkey, 1.0 / (60 + row_number() OVER (ORDER BY p_size, p_partkey)) AS s FROM part QUALIFY row_number() OVER (ORDER BY p_size, p_partkey) <= 100)
 SELECT p_partkey, round(sum(s), 8) AS score FROM (FROM a UNION ALL FROM b) GROUP BY 1""")
def rank_fusion(t):
    return J.fuse(t("part"), [(F.col("p_retailprice").desc(), 2.0), (F.col("p_size").asc(), 1.0)], "p_partkey").select("p_partkey", rnd("score", 8).alias("score"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || (o_orderkey % 97) AS dst FROM orders UNION SELECT DISTINCT 'p' || (o_orderkey % 97), 'c' || o_custkey FROM orders),
 r AS (SELECT 'c1' AS node, 0 AS steps UNION SELECT dst, steps + 1 FROM r JOIN e ON src = node WHERE steps < 3) SELECT node, min(steps) AS steps FROM r WHERE node <> 'c1' GROUP BY node""")
def graph_depth(t):
    o = t("orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("p"), F.col("o_orderkey") % 97).alias("dst")).distinct()
    return R.reach(o.unionByName(o.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), ["c1"], 3)


@query("""SELECT a.c_custkey AS one, b.c_custkey AS other FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment WHERE a.c_custkey < b.c_custkey AND a.c_acctbal > 9000 AND b.c_acctbal > 9000""")
def self_join(t):
    c = t("customer").where("c_acctbal > 9000")
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("a.c_mktsegment") == F.col("b.c_mktsegment")))
    return pairs.where("a.c_custkey < b.c_custkey").select(F.col("a.c_custkey").alias("one"), F.col("b.c_custkey").alias("other"))


@query("""SELECT a.c_custkey AS one, b.c_custkey AS other FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND floor(a.c_acctbal / 100) = floor(b.c_acctbal / 100) WHERE a.c_custkey < b.c_custkey""")
def self_join_whole(t):
    c = t("customer").withColumn("hundreds", F.floor(F.col("c_acctbal") / 100))
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("a.c_mktsegment") == F.col("b.c_mktsegment")) & (F.col("a.hundreds") == F.col("b.hundreds")))
    return pairs.where("a.c_custkey < b.c_custkey").select(F.col("a.c_custkey").alias("one"), F.col("b.c_custkey").alias("other"))


@query("""SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 400000) RIGHT JOIN customer ON o_custkey = c_custkey""")
def right_join(t):
    return t("orders").where("o_totalprice > 400000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("""SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, CAST(floor(epoch(ts)) AS BIGINT) AS unix FROM events""")
def time_functions(t):
    n = lambda c: c.cast("long")
    return t("events").select("event_id", n(F.year("ts")).alias("y"), n(F.month("ts")).alias("m"), n(F.dayofmonth("ts")).alias("d"), n(F.hour("ts")).alias("h"), n(F.minute("ts")).alias("mi"), n(F.second("ts")).alias("s"), F.unix_timestamp("ts").alias("unix"))


@query("""SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS root, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS log, abs(c_acctbal) AS abs, floor(c_acctbal)::BIGINT AS low, ceil(c_acctbal)::BIGINT AS high,
 trunc(c_acctbal)::BIGINT AS cut, sign(c_acctbal)::BIGINT AS sign, c_custkey % 7 AS rest FROM customer""")
def math_functions(t):
    x = F.col("c_acctbal")
    return t("customer").select(
        "c_custkey", rnd(F.when(x >= 0, F.sqrt(x)), 6).alias("root"), rnd(F.when(x > 0, F.ln(x)), 6).alias("log"), F.abs(x).alias("abs"), F.floor(x).cast("long").alias("low"), F.ceil(x).cast("long").alias("high"),
        F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long").alias("cut"), F.signum(x).cast("long").alias("sign"), (F.col("c_custkey") % 7).alias("rest"),
    )


@query("""SELECT o_custkey, to_json(list_sort(list(DISTINCT o_orderstatus))) AS kinds, count(*) AS n, max(len(o_orderpriority)) AS longest, list_contains(list(o_orderstatus), 'P') AS has_p FROM orders GROUP BY 1""")
def array_functions(t):
    g = t("orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("l"), F.count("*").alias("n"), F.max(F.char_length("o_orderpriority")).cast("long").alias("longest"))
    return g.select("o_custkey", F.to_json(F.sort_array(F.array_distinct("l"))).alias("kinds"), "n", "longest", F.array_contains("l", "P").alias("has_p"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS absent FROM events""")
def document_paths(t):
    v = F.try_parse_json("props")
    return t("events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.missing", "string").isNull().alias("absent"))


@query("""SELECT vec_id FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1) AS q FROM embeddings WHERE label = 3) ORDER BY list_distance(e, q), vec_id LIMIT 5""")
def filtered_knn(t):
    e = t("embeddings")
    q = F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("q")).limit(1))  # one row: the query vector
    return R.nearest(e.where("label = 3").crossJoin(q), "vec_id", R.euclidean(F.col("embedding"), F.col("q")), 5).select("vec_id")


@query("""SELECT o_orderkey, o_custkey <> 5 OR o_custkey IS NULL AS other, coalesce(nullif(o_orderstatus, 'O'), 'none') AS status, NOT coalesce(nullif(o_totalprice, 0) > 1000, false) AS low FROM orders""")
def absence_rules(t):
    price = F.nullif(F.col("o_totalprice"), F.lit(0.0))
    return t("orders").select("o_orderkey", V.ne(F.col("o_custkey"), F.lit(5)).alias("other"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("O")), F.lit("none")).alias("status"), V.negate(V.gt(price, F.lit(1000))).alias("low"))
