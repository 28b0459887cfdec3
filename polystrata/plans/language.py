"""Queries in the query language over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang import Session
from .catalog import query, register

IDENTITIES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": None}


def session(t) -> Session:
    """A session in which every test table can be read."""
    spark = t("region").sparkSession
    s = Session(spark)
    for name, identity in IDENTITIES.items():
        s.attach(name, t(name), identity, "ts" if name == "events" else "o_orderdate" if name == "orders" else None)
    return s


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()}) if digits else df


def statement(name: str, text: str, sql: str, **digits: int) -> None:
    """Registers a script's last read; `digits` rounds columns as the SQL does."""
    register(name, lambda t: rounded(session(t).frame_of(text), digits), sql)


statement("ql_filter", "SELECT o_orderkey, o_totalprice * 2 AS twice, IF o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size FROM orders WHERE o_orderstatus IN ['O', 'F'] AND NOT (o_orderpriority LIKE '%URGENT%') AND o_totalprice >= 100000",
          "SELECT o_orderkey, o_totalprice * 2 AS twice, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size FROM orders WHERE o_orderstatus IN ('O', 'F') AND NOT o_orderpriority LIKE '%URGENT%' AND o_totalprice >= 100000")
statement("ql_star_omit", "SELECT *, n_nationkey * 10 AS tens OMIT n_regionkey FROM nation WHERE n_name != 'NATION_3'",
          "SELECT n_nationkey, n_name, (n_nationkey * 10)::BIGINT AS tens FROM nation WHERE n_name <> 'NATION_3'")
statement("ql_record", "SELECT c_name, c_acctbal FROM customer:17", "SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 17")
statement("ql_span", "SELECT c_custkey FROM customer:10..=40 ORDER BY c_custkey DESC LIMIT 7 START 2", "SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 10 AND 40 ORDER BY 1 DESC LIMIT 7 OFFSET 2")
statement("ql_only", "SELECT n_name FROM ONLY nation WHERE n_nationkey = 7", "SELECT n_name FROM nation WHERE n_nationkey = 7")
statement("ql_inner_join", "SELECT o.o_orderkey AS k, c.c_name AS who FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000",
          "SELECT o_orderkey AS k, c_name AS who FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
statement("ql_left_join", "SELECT n.n_name AS n, c.c_custkey AS c FROM nation AS n LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000 LIMIT ALL) AS c ON n.n_nationkey = c.c_nationkey",
          "SELECT n_name AS n, c_custkey AS c FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON n_nationkey = c_nationkey")
statement("ql_right_join", "SELECT s.s_suppkey AS s, n.n_name AS n FROM supplier AS s RIGHT JOIN nation AS n ON s.s_nationkey = n.n_nationkey", "SELECT s_suppkey AS s, n_name AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
statement("ql_full_join", "SELECT c.c_custkey AS c, s.s_suppkey AS s FROM customer AS c FULL OUTER JOIN supplier AS s ON c.c_custkey = s.s_suppkey", "SELECT c_custkey AS c, s_suppkey AS s FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
statement("ql_n_way_join", "SELECT r.r_name AS region, count(*) AS n, max(o.o_totalprice) AS most FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
          "SELECT r_name AS region, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
statement("ql_self_join", "SELECT a.n_name AS one, b.n_name AS other FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
          "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
statement("ql_groups", "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS who, sum(o_orderkey) AS keys, mean(o_totalprice) AS m, median(o_totalprice) AS mid, stddev(o_totalprice) AS dev, sum(o_orderkey) / count(*) AS ratio FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING n > 10",
          "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS who, sum(o_orderkey)::BIGINT AS keys, round(avg(o_totalprice), 2) AS m, round(median(o_totalprice), 2) AS mid, round(stddev_samp(o_totalprice), 2) AS dev, round(sum(o_orderkey) / count(*), 2) AS ratio FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 10",
          m=2, mid=2, dev=2, ratio=2)
statement("ql_fold", "SELECT count(*) AS n, min(c_acctbal) AS low, max(c_name) AS last FROM customer WHERE c_mktsegment ILIKE 'b%'", "SELECT count(*) AS n, min(c_acctbal) AS low, max(c_name) AS last FROM customer WHERE c_mktsegment ILIKE 'b%' HAVING count(*) > 0")
statement("ql_fold_of_nothing", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 1000000000", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 1000000000 HAVING count(*) > 0")
statement("ql_windows", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rn, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS running, lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS before, count(*) OVER (PARTITION BY o_orderstatus) AS every FROM orders",
          "SELECT o_orderkey, row_number() OVER w AS rn, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running, lag(o_orderkey, 1, -1) OVER w AS before, count(*) OVER (PARTITION BY o_orderstatus) AS every FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
statement("ql_set_operations", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 INTERSECT SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 20 ORDER BY k DESC LIMIT 5",
          "SELECT k FROM (((SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 20) ORDER BY k DESC LIMIT 5")
statement("ql_with", "WITH rich AS (SELECT * FROM customer WHERE c_acctbal > 5000), far AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) SELECT c_custkey FROM rich WHERE c_nationkey IN (SELECT n_nationkey FROM far)",
          "WITH rich AS (SELECT * FROM customer WHERE c_acctbal > 5000) SELECT c_custkey FROM rich WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
statement("ql_not_in", "SELECT c_custkey FROM customer WHERE NOT (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000))", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
statement("ql_scalar_read", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) AS m FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
statement("ql_buckets", "SELECT time::bucket(ts, 6h) AS w, event_type AS kind, count(*) AS n FROM events GROUP BY time::bucket(ts, 6h), event_type", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS w, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
statement("ql_fill", "SELECT time::bucket(ts, 1h) AS w, count(*) AS n, max(event_id) AS last FROM events WHERE user_id < 10 GROUP BY time::bucket(ts, 1h) FILL PREVIOUS FROM datetime '2024-01-02T00:00:00Z' TO datetime '2024-01-04T00:00:00Z'",
          """WITH g AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n, max(event_id) AS last FROM events WHERE user_id < 10 GROUP BY 1), s AS (SELECT w FROM generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-03 23:00:00', INTERVAL 1 HOUR) x(w))
 SELECT w, coalesce(n, 0) AS n, last_value(last IGNORE NULLS) OVER (ORDER BY w ROWS UNBOUNDED PRECEDING) AS last FROM s LEFT JOIN g USING (w)""")  # fmt: skip
statement("ql_latest", "SELECT user_id, event_id FROM events LATEST BY user_id", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
statement("ql_counters", "SELECT user_id, increase(value, ts) AS inc, delta(value, ts) AS d FROM events GROUP BY user_id",
          "WITH l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, CASE WHEN count(*) > 1 THEN round(sum(CASE WHEN value >= p THEN value - p WHEN p IS NOT NULL THEN value END), 4) END AS inc, CASE WHEN count(*) > 1 THEN round(arg_max(value, ts) - arg_min(value, ts), 4) END AS d FROM l GROUP BY 1",
          inc=4, d=4)
statement("ql_functions", "SELECT p_partkey, string::upper(p_brand) AS b, string::len(p_name) AS n, math::floor(p_retailprice) AS f, p_retailprice + p_size AS more, array::len(string::split(p_type, ' ')) AS words, -p_size AS neg, p_size % 7 AS rest FROM part",
          "SELECT p_partkey, upper(p_brand) AS b, length(p_name) AS n, floor(p_retailprice) AS f, p_retailprice + p_size AS more, len(string_split(p_type, ' ')) AS words, -p_size AS neg, (p_size % 7)::BIGINT AS rest FROM part")
statement("ql_document_paths", "LET $least = 50; SELECT event_id, type::int(json::parse(props).k) AS k FROM events WHERE json::parse(props).k >= $least", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
statement("ql_cursor", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC AFTER orders:100 LIMIT 20",
          "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < (SELECT o_totalprice FROM orders WHERE o_orderkey = 100) OR (o_totalprice = (SELECT o_totalprice FROM orders WHERE o_orderkey = 100) AND o_orderkey > 100) ORDER BY 2 DESC, 1 LIMIT 20")
statement("ql_fuse", "SELECT p_partkey FROM part ORDER BY FUSE (p_retailprice DESC WEIGHT 2, p_size) DEPTH 50 LIMIT 20",
          """WITH a AS (SELECT p_partkey, 2.0 / (60 + row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)) AS s FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= 50),
 b AS (SELECT p_partkey, 1.0 / (60 + row_number() OVER (ORDER BY p_size, p_partkey)) AS s FROM part QUALIFY row_number() OVER (ORDER BY p_size, p_partkey) <= 50)
 SELECT p_partkey FROM (FROM a UNION ALL FROM b) GROUP BY 1 ORDER BY sum(s) DESC, 1 LIMIT 20""")  # fmt: skip
statement("ql_knn", "LET $q = (SELECT embedding FROM ONLY embeddings:0).embedding; SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY vector::cosine(embedding, $q) LIMIT 5",
          "SELECT vec_id FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings WHERE label = 3) ORDER BY 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), vec_id LIMIT 5")
statement("ql_matches", "DEFINE ANALYZER plain FILTERS lowercase; DEFINE FIELD text ON documents ANALYZER plain; SELECT doc_id FROM documents WHERE text MATCHES 'erhe NOT inthat'",
          r"SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents) WHERE list_contains(t, 'erhe') AND NOT list_contains(t, 'inthat')")
statement("ql_search", "DEFINE ANALYZER plain FILTERS lowercase; DEFINE SEARCH both ON documents FIELDS text ANALYZER plain ON benchmark FIELDS text ANALYZER plain; SELECT search::table_name() AS t, count(*) AS n FROM SEARCH both MATCHES 'erhe' GROUP BY search::table_name()",
          r"""SELECT t, count(*) AS n FROM (SELECT 'documents' AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents UNION ALL SELECT 'benchmark', regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark) WHERE list_contains(w, 'erhe') GROUP BY 1""")  # fmt: skip
statement("ql_insert_update", "DEFINE TABLE kept (name string, key int) ; INSERT INTO kept (id, name, key) SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_acctbal > 8000; UPDATE kept SET key = key + 100 WHERE key < 5; DELETE FROM kept WHERE key = 7 LIMIT ALL; UPSERT kept:0 = { name: 'none', key: -1 }; SELECT * FROM kept",
          "SELECT c_custkey AS id, c_name AS name, (CASE WHEN c_nationkey < 5 THEN c_nationkey + 100 ELSE c_nationkey END)::BIGINT AS key FROM customer WHERE c_acctbal > 8000 AND c_nationkey <> 7 AND c_custkey <> 0 UNION ALL SELECT 0, 'none', -1")
statement("ql_on_conflict", "DEFINE COLLECTION k; INSERT INTO k (id, v) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10; INSERT INTO k (id, v) SELECT n_nationkey, 'new' AS v FROM nation WHERE n_nationkey < 15 ON CONFLICT DO NOTHING; INSERT INTO k (id, v) SELECT n_nationkey, 'newer' AS v FROM nation WHERE n_nationkey < 3 ON CONFLICT DO UPDATE; SELECT * FROM k",
          "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey < 3 THEN 'newer' WHEN n_nationkey < 10 THEN n_name ELSE 'new' END AS v FROM nation WHERE n_nationkey < 15")
statement("ql_materialized_view", "DEFINE COLLECTION o; INSERT INTO o (id, who, total) SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey < 50; DEFINE VIEW per MATERIALIZED AS SELECT who, count(*) AS n, max(total) AS most FROM o GROUP BY who; INSERT INTO o (id, who, total) SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey >= 50 AND o_custkey < 60; DELETE FROM o WHERE who = 7; UPDATE o SET total = 1.5 WHERE who = 9; SELECT who, n, most FROM per",
          "SELECT o_custkey AS who, count(*) AS n, max(CASE WHEN o_custkey = 9 THEN 1.5 ELSE o_totalprice END) AS most FROM orders WHERE o_custkey < 60 AND o_custkey <> 7 GROUP BY 1")
statement("ql_rollup", "DEFINE SERIES s RETAIN 36500d TIME at; INSERT INTO s (id, at, k, v) SELECT event_id, ts, event_type, value FROM events WHERE user_id < 20; DEFINE ROLLUP r FROM s WINDOW 1d BY k COMPUTE count(*) AS n, max(v) AS high RETAIN 36500d; INSERT INTO s (id, at, k, v) SELECT event_id, ts, event_type, value FROM events WHERE user_id >= 20 AND user_id < 40; DELETE FROM s WHERE v < 10; SELECT window, k, n, high FROM r",
          "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window, event_type AS k, count(*) AS n, max(value) AS high FROM events WHERE user_id < 40 AND value >= 10 GROUP BY 1, 2")
statement("ql_feed", "DEFINE COLLECTION o; DEFINE TOPIC log; DEFINE FEED f ON o INTO log; INSERT INTO o (id, v) SELECT n_nationkey, n_regionkey FROM nation; UPDATE o SET v = 9 WHERE v = 1; DELETE FROM o WHERE v = 2; SELECT op, key FROM log",
          "SELECT 'create' AS op, n_nationkey::VARCHAR AS key FROM nation UNION ALL SELECT 'update', n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'delete', n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 2")
statement("ql_graph", "DEFINE GRAPH g; DEFINE EDGE lies IN g FROM nation TO region; RELATE nation:1->lies->region:1; RELATE nation:2->lies->region:1; RELATE nation:1->lies->region:3; SELECT r_name FROM nation:1->lies->region", "SELECT r_name FROM region WHERE r_regionkey IN (1, 3)")
statement("ql_history", "DEFINE COLLECTION h; INSERT INTO h (id, v) SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM h WHERE v = 2; SELECT * FROM h VERSION 1", "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS v FROM nation")
statement("ql_split", "SELECT r.r_name AS r, r.r_regionkey AS k FROM region AS r JOIN nation AS n ON r.r_regionkey = n.n_regionkey WHERE n.n_name CONTAINS '1' ORDER BY k", "SELECT r_name AS r, r_regionkey AS k FROM region JOIN nation ON r_regionkey = n_regionkey WHERE contains(n_name, '1')")


@query("""SELECT a.event_id AS p, b.event_id AS v FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'purchase'""")
def ql_asof(t):
    s = session(t).attach("views", t("events").where("event_type = 'view'"), "event_id", "ts")
    return s.frame_of("SELECT a.event_id AS p, b.event_id AS v FROM events AS a ASOF JOIN views AS b ON a.user_id = b.user_id WHERE a.event_type = 'purchase'")
