"""Queries over the function library and the operators of search, graph, place and gaps, each with its SQL.

Absences come from nullif and outer joins, as the tables hold none.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import call
from ..operators import aggregate as A
from ..operators import geo as G
from ..operators import ranking as R
from ..operators import relational as J
from ..operators import search as S
from .catalog import exact, query, rnd

L = F.lit


@query(r"""WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s, ' ' || c_name || E'\t' AS n FROM customer)
 SELECT c_custkey, trim(n, E' \t') AS trimmed, ltrim(n, E' \t') AS front, rtrim(n, E' \t') AS back, substring(s, 3, 4) AS cut, to_json(string_split(s, 'I')) AS parts, replace(s, 'I', '.') AS rep, ends_with(s, 'Y') AS ew,
  contains(s, 'UTO') AS has, nullif(strpos(s, 'O'), 0) - 1 AS at, reverse(s) AS rev, s || '/' || c_custkey AS joined, length(s) AS len FROM c""")
def fn_text(t):
    s, n = F.nullif(F.col("c_mktsegment"), L("BUILDING")), F.concat(L(" "), F.col("c_name"), L("\t"))
    return t("customer").select(
        "c_custkey", call("string::trim", n).alias("trimmed"), call("string::trim_start", n).alias("front"), call("string::trim_end", n).alias("back"), call("string::slice", s, L(2), L(4)).alias("cut"), F.to_json(call("string::split", s, L("I"))).alias("parts"),
        call("string::replace", s, L("I"), L(".")).alias("rep"), call("string::ends_with", s, L("Y")).alias("ew"), call("string::contains", s, L("UTO")).alias("has"), call("string::index_of", s, L("O")).alias("at"), call("string::reverse", s).alias("rev"),
        call("string::concat", s, L("/"), F.col("c_custkey").cast("string")).alias("joined"), call("string::len", s).alias("len"),
    )


@query(r"""SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(replace(text, E'\r\n', E'\n'), E'\n$', ''), E'\n'), 2, 3), E'\n') AS lines FROM documents""")
def fn_lines(t):
    return t("documents").select("doc_id", call("string::lines", F.col("text"), L(1), L(2)).alias("lines"))


@query("""WITH c AS (SELECT c_custkey, nullif(c_nationkey, 3) AS k, c_acctbal AS x FROM customer)
 SELECT c_custkey, round(pow(k, 2), 6) AS pw, round(exp(k / 10.0), 6) AS ex, round(x) AS near, CASE WHEN k IS NOT NULL THEN least(k, 7) END AS low, CASE WHEN k IS NOT NULL THEN greatest(k, 7) END AS high, sign(k - 5)::BIGINT AS sg, abs(k - 9)::BIGINT AS ab,
  trunc(x / 7) AS cut, floor(x) AS fl, ceil(x) AS ce FROM c""")
def fn_math(t):
    d = t("customer").select("c_custkey", F.nullif(F.col("c_nationkey"), L(3)).alias("k"), F.col("c_acctbal").alias("x"))
    k, x = F.col("k"), F.col("x")
    return d.select(
        "c_custkey", rnd(call("math::pow", k, L(2)), 6).alias("pw"), rnd(call("math::exp", k / 10.0), 6).alias("ex"), call("math::round", x, of=d).alias("near"), call("math::min", k, L(7)).alias("low"), call("math::max", k, L(7)).alias("high"), call("math::sign", k - 5).alias("sg"),
        call("math::abs", k - 9, of=d).alias("ab"), call("math::trunc", x / 7, of=d).alias("cut"), call("math::floor", x, of=d).alias("fl"), call("math::ceil", x, of=d).alias("ce"),
    )


_LISTS = """WITH o AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS a, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
"""


def _lists(t):
    return t("orders").groupBy(F.col("o_custkey").alias("k")).agg(A.collect(F.col("o_orderkey"), F.col("o_orderkey")).alias("a"), F.nullif(A.collect(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), F.col("o_orderkey")), F.array().cast("array<bigint>")).alias("f"))


@query(_LISTS + """SELECT k, len(f) AS n, f[1] AS one, f[-1] AS last, CASE WHEN f IS NOT NULL THEN to_json(list_reverse(f)) END AS rev, CASE WHEN f IS NOT NULL THEN to_json(list_slice(f, 2, 3)) END AS cut, CASE WHEN f IS NOT NULL THEN array_to_string(f, '-') END AS joined, list_min(f) AS low, list_max(f) AS high, coalesce(list_sum(f), NULL)::BIGINT AS total, f[2] AS second, f[-2] AS before,
 (nullif(coalesce(list_position(a, f[2]), 0), 0) - 1)::BIGINT AS at, CASE WHEN f IS NOT NULL THEN to_json(list_concat(f, a)) END AS both, CASE WHEN f IS NOT NULL THEN to_json(list_append(f, k)) END AS more, CASE WHEN f IS NOT NULL THEN to_json(list_distinct(list_concat(f, a)).list_sort()) END AS dist, CASE WHEN f IS NOT NULL THEN to_json(flatten([f, a])) END AS flat FROM o""")
def fn_arrays(t):
    d = _lists(t)
    f, a = F.col("f"), F.col("a")
    arr = lambda c: F.to_json(c)
    return d.select(
        "k", call("array::len", f).alias("n"), call("array::first", f).alias("one"), call("array::last", f).alias("last"), arr(call("array::reverse", f)).alias("rev"), arr(call("array::slice", f, L(1), L(2))).alias("cut"), call("array::join", f, L("-")).alias("joined"),
        call("array::min", f).alias("low"), call("array::max", f).alias("high"), call("array::sum", f, of=d).alias("total"), call("array::at", f, L(1)).alias("second"), call("array::at", f, L(-2)).alias("before"), call("array::index_of", a, call("array::at", f, L(1))).alias("at"),
        arr(call("array::concat", f, a)).alias("both"), arr(call("array::append", f, F.col("k"))).alias("more"), arr(call("array::sort", call("array::distinct", call("array::concat", f, a)))).alias("dist"), arr(call("array::flatten", F.array(f, a))).alias("flat"),
    )


@query(_LISTS + """SELECT k, len(list_distinct(a)) AS n, to_json(list_sort(list_distinct(list_concat(a, [k, 1])))) AS either, CASE WHEN f IS NOT NULL THEN to_json(list_sort(list_intersect(a, f))) END AS both, CASE WHEN f IS NOT NULL THEN to_json(list_sort(list_filter(a, lambda x: NOT list_contains(f, x)))) END AS rest FROM o""")
def fn_sets(t):
    f, a = F.col("f"), F.col("a")
    return _lists(t).select("k", call("set::len", a).alias("n"), F.to_json(call("set::union", a, F.array("k", L(1).cast("long")))).alias("either"), F.to_json(call("set::intersect", a, f)).alias("both"), F.to_json(call("set::difference", a, f)).alias("rest"))


@query("""WITH s AS (SELECT c_nationkey AS k, c_mktsegment AS m, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS s FROM customer GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, m) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM s)
 SELECT k, max(s) FILTER (m = 'BUILDING') AS score, max(i) FILTER (m = 'BUILDING') AS rank, coalesce(string_agg(m, ',' ORDER BY i) FILTER (i >= n - 2), '') AS top, coalesce(string_agg(m, ',' ORDER BY i) FILTER (s >= 0 AND s <= 20000), '') AS mid,
  coalesce(string_agg(m, ',' ORDER BY 2 * s, m) FILTER (m <> 'NONE'), '') AS twice FROM r GROUP BY k""")
def fn_scores(t):
    s = t("customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("member")).agg(exact("c_acctbal").alias("score"))
    from ..functions.collections import ranked

    d = s.groupBy("k").agg(ranked(F.collect_list(F.struct("member", "score"))).alias("r"))
    r, names = F.col("r"), lambda x: F.array_join(F.transform(x, lambda e: e["member"]), ",")
    return d.select(
        "k", call("scores::score", r, L("BUILDING")).alias("score"), call("scores::rank", r, L("BUILDING")).alias("rank"), names(call("scores::range", r, L(-2), L(-1))).alias("top"), names(call("scores::between", r, L(0.0), L(20000.0))).alias("mid"),
        names(call("scores::intersect", call("scores::union", r, F.slice(r, 1, 0)), r)).alias("twice"),
    )


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS ty FROM events)
 SELECT event_id, 'a,k' AS keys, to_json([CAST(event_id % 5 AS BIGINT), k]) AS vals, 2::BIGINT AS n, true AS has, k AS got, NULL::BIGINT AS missing, '{"a":' || (event_id % 5) || ',"k":7,"z":' || event_id || '}' AS merged FROM e""")
def fn_objects(t):
    k = F.try_variant_get(call("json::parse", F.col("props")), "$.k", "long")
    d = t("events").select("event_id", F.create_map(L("k"), k, L("a"), F.col("event_id") % 5).alias("o"), F.struct(L(7).cast("long").alias("k"), F.col("event_id").alias("z")).alias("p"))
    o, p = F.col("o"), F.col("p")
    m = call("object::merge", o, p, of=d)
    return d.select(
        "event_id", F.array_join(call("object::keys", o, of=d), ",").alias("keys"), F.to_json(call("object::values", o, of=d)).alias("vals"), call("object::len", o, of=d).alias("n"), call("object::has", o, L("k"), of=d).alias("has"), call("object::get", o, L("k"), of=d).alias("got"),
        call("object::get", o, L("q"), of=d).alias("missing"), call("json::encode", m, of=d.select(o, p)).alias("merged"),
    )


@query("""SELECT event_id, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS again, time_bucket(INTERVAL 90 MINUTE, ts) AS b, CAST(floor(epoch(ts)) AS BIGINT) AS u, epoch_us(ts + to_microseconds(CAST(round(value * 1e6) AS BIGINT))) AS later FROM events""")
def fn_time(t):
    u = call("time::unix", F.col("ts"))
    later = F.col("ts") + call("duration::from_secs", rnd(F.col("value"), 6))
    return t("events").select("event_id", call("time::from_unix", u).alias("again"), call("time::bucket", F.col("ts"), F.expr("interval '90' minute")).alias("b"), u.alias("u"), F.unix_micros(later.cast("timestamp")).alias("later"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS i, CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS f, o_orderstatus = 'F' AS b, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE 'string' END AS kind, 'number' AS num, o_orderdate AS d, lower(md5(o_orderkey::VARCHAR)) AS raw FROM orders""")
def fn_casts(t):
    d = t("orders").withColumn("s", F.nullif(F.col("o_orderstatus"), L("P"))).withColumn("iso", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    uuid = call("type::uuid", F.md5(F.col("o_orderkey").cast("string")))
    return d.select(
        "o_orderkey", call("type::int", F.col("o_orderkey").cast("string")).alias("i"), call("type::float", F.col("o_totalprice").cast("string")).alias("f"), call("type::bool", F.when(F.col("o_orderstatus") == "F", "true").otherwise("false")).alias("b"), call("type::of", F.col("s"), of=d).alias("kind"),
        call("type::of", F.col("o_totalprice"), of=d).alias("num"), call("type::datetime", F.col("iso"), of=d).alias("d"), F.replace(uuid, L("-"), L("")).alias("raw"),
    )


@query("""SELECT doc_id, sha1(text) AS s1, base64(encode(text)) AS b64, lower(hex(encode(source))) AS hx, decode(from_base64(base64(encode(source)))) AS back, decode(unhex(hex(encode(source)))) AS back2, NULL::VARCHAR AS bad, NULL::VARCHAR AS odd FROM documents""")
def fn_encodings(t):
    s = F.col("source")
    text = lambda b: F.decode(b, "UTF-8")
    b64 = call("encoding::base64", F.col("text").cast("binary"))
    return t("documents").select(
        "doc_id", call("crypto::sha1", F.col("text")).alias("s1"), b64.alias("b64"), call("encoding::hex", s.cast("binary")).alias("hx"), text(call("encoding::base64_decode", call("encoding::base64", s.cast("binary")))).alias("back"), text(call("encoding::hex_decode", call("encoding::hex", s.cast("binary")))).alias("back2"),
        text(call("encoding::base64_decode", L("Zg"))).alias("bad"), text(call("encoding::hex_decode", L("abc"))).alias("odd"),
    )


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id""")
def fn_vectors(t):
    a, b = t("embeddings").alias("a"), t("embeddings").alias("b")
    j = a.join(b, F.col("a.vec_id") + 1 == F.col("b.vec_id"))
    return j.select("a.vec_id", rnd(call("vector::dot", F.col("a.embedding"), F.col("b.embedding")), 5).alias("dot"), rnd(call("vector::euclidean", F.col("a.embedding"), F.col("b.embedding")), 5).alias("dist"))


# ---- read clauses


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def anti_join_rows(t):
    return t("customer").join(t("orders").where("o_totalprice > 250000"), F.col("c_custkey").eqNullSafe(F.col("o_custkey")), "left_anti").select("c_custkey")


@query("""SELECT o_orderstatus, coalesce(sum(nullif(o_custkey, o_custkey)), 0)::BIGINT AS nothing, count(nullif(o_orderpriority, '1-URGENT')) AS some, avg(nullif(o_custkey, o_custkey)) AS mean FROM orders GROUP BY 1""")
def folds_over_absences(t):
    none = F.nullif(F.col("o_custkey"), F.col("o_custkey"))
    return t("orders").groupBy("o_orderstatus").agg(A.total(none).alias("nothing"), F.count(F.nullif(F.col("o_orderpriority"), L("1-URGENT"))).alias("some"), F.avg(none).alias("mean"))


@query("""WITH o AS (SELECT o_orderkey, nullif(o_custkey % 50, 7) AS k FROM orders) SELECT o_orderkey, k FROM o WHERE k < 9 OR k IS NULL OR (k = 9 AND o_orderkey > 100) ORDER BY k DESC NULLS LAST, o_orderkey LIMIT 5000""")
def cursor_over_absences(t):
    d = t("orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 50, L(7)).alias("k"))
    return J.after(d, [("k", False), ("o_orderkey", True)], (9, 100)).orderBy(F.col("k").desc(), "o_orderkey").limit(5000)


@query("""SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier""")
def union_all(t):
    return J.combine(t("customer").select(F.col("c_custkey").alias("k")), ("union_all", t("supplier").select(F.col("s_suppkey").alias("k"))))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN [] ELSE string_split(source, 'c') END AS p FROM documents)
 SELECT doc_id, unnest(p) AS p FROM d WHERE p IS NOT NULL UNION ALL SELECT doc_id, NULL FROM d WHERE p IS NULL""")
def split_on_absences(t):
    p = F.when(F.col("doc_id") % 3 == 2, F.split("source", "c", -1)).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>"))
    return J.split_on(t("documents").select("doc_id", p.alias("p")), "p")


@query("""SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1""")
def collect_in_order(t):
    g = t("orders").groupBy("o_custkey").agg(A.collect(F.col("o_orderkey"), F.struct("o_orderdate", "o_orderkey")).alias("l"))
    return g.select("o_custkey", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("keys"))


@query("""SELECT o_orderkey, lag(o_totalprice, 2, -1) OVER w AS before, coalesce(lead(o_orderkey, 1) OVER w, o_custkey) AS next, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running,
 max(o_orderkey) OVER (PARTITION BY o_custkey) AS most, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_defaults(t):
    w, every = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey")
    whole = every.orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t("orders").select(
        "o_orderkey", F.lag("o_totalprice", 2, -1.0).over(w).alias("before"), F.coalesce(F.lead("o_orderkey", 1).over(w), F.col("o_custkey")).alias("next"), F.sum("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.max("o_orderkey").over(every).alias("most"), F.last("o_orderkey").over(whole).alias("last"),
    )


@query("""WITH g AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n, round(avg(value), 6) AS v FROM events WHERE user_id < 20 GROUP BY 1, 2),
 s AS (SELECT k.event_type, w FROM (SELECT DISTINCT event_type FROM g) k, generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-04 23:00:00', INTERVAL 1 HOUR) x(w))
 SELECT s.event_type, s.w, coalesce(g.n, 0) AS n, CASE WHEN g.n IS NULL THEN -1.5 ELSE g.v END AS v FROM s LEFT JOIN g USING (event_type, w)""")
def fill_values(t):
    g = t("events").where("user_id < 20").groupBy("event_type", A.bucket(F.col("ts"), 3600).alias("w")).agg(F.count("*").alias("n"), rnd(F.avg("value"), 6).alias("v"))
    return A.fill_windows(g, ["event_type"], "w", {"n": "count", "v": -1.5}, "2024-01-02", "2024-01-05", 3600)


@query("""SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def fetch_reference(t):
    d = J.fetch(t("orders").select("o_orderkey", F.col("o_custkey").alias("who")), "who", t("customer"), "c_custkey")
    return d.select("o_orderkey", "who.c_name", "who.c_nationkey")


@query("""SELECT l.o AS o, string_agg(p_name, '|' ORDER BY i) AS parts FROM (SELECT o, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM (SELECT l_orderkey AS o, list_sort(list(l_partkey)) AS k FROM lineitem GROUP BY 1)) l JOIN part ON p_partkey = l.k GROUP BY 1""")
def fetch_array(t):
    d = t("lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    return J.fetch(d, "parts", t("part").select("p_partkey", "p_name"), "p_partkey").select("o", F.array_join(F.transform("parts", lambda p: p["p_name"]), "|").alias("parts"))


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 3""")
def only_and_omit(t):
    return J.only(J.omit(t("nation").where("n_nationkey = 3"), "n_regionkey"))


# ---- search: tokens are lower-case runs of letters and digits

_T = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_AN = S.Analyzer(("lowercase",))


@query(f"""WITH d AS (SELECT doc_id, {_T} AS t FROM documents) SELECT doc_id, list_contains(t, 'erhe') AND list_contains(t, 'inthat') AS both, list_contains(t, 'erhe') OR list_contains(t, 'inthat') AS either, list_contains(t, 'erhe') AND NOT list_contains(t, 'inthat') AS not_it,
 len(list_filter(t, lambda x: starts_with(x, 'ere'))) > 0 AS pre, len(list_filter(t, lambda x: contains(x, 'that'))) > 0 AS inf FROM d""")
def matches_words(t):
    m = lambda q, mode="term": S.matches(_AN, F.col("text"), q, mode)
    return t("documents").select("doc_id", m("erhe inthat").alias("both"), m("erhe OR inthat").alias("either"), m("erhe NOT inthat").alias("not_it"), m("ere", "prefix").alias("pre"), m("that", "infix").alias("inf"))


@query(f"""WITH d AS (SELECT doc_id, {_T} AS t FROM documents), w AS (SELECT doc_id, t[5] AS a, t[6] AS b FROM d WHERE doc_id = 11), e AS (SELECT d.doc_id, array_to_string(t, ' ') AS s, a, b FROM d, w WHERE w.doc_id = 11) SELECT doc_id FROM e WHERE contains(' ' || s || ' ', ' ' || a || ' ' || b || ' ')""")
def matches_phrase(t):
    d = t("documents")
    words = _AN.spans(d.where("doc_id = 11").select("text").first()[0])[4:6]
    return d.where(S.matches(_AN, F.col("text"), f'"{words[0][2]} {words[1][2]}"')).select("doc_id")


@query(r"""WITH tok AS (SELECT 'documents' AS table_name, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS body, regexp_extract_all(lower(source), '[\p{L}\p{N}]+') AS head FROM documents
  UNION ALL SELECT 'benchmark', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), NULL FROM benchmark),
 f AS (SELECT *, len(body) AS lb, coalesce(len(head), 0) AS lh, len(list_filter(body, lambda x: x = 'src1')) AS b0, coalesce(len(list_filter(head, lambda x: x = 'src1')), 0) AS h0, len(list_filter(body, lambda x: x = 'erhe')) AS b1, coalesce(len(list_filter(head, lambda x: x = 'erhe')), 0) AS h1 FROM tok),
 s AS (SELECT count(*) AS n, avg(lb) AS ab, avg(lh) FILTER (table_name = 'documents') AS ah, count(*) FILTER (b0 + h0 > 0) AS d0, count(*) FILTER (b1 + h1 > 0) AS d1 FROM f),
 w AS (SELECT *, b0 / (0.25 + 0.75 * lb / ab) + 3 * h0 / (0.25 + 0.75 * lh / ah) AS w0, b1 / (0.25 + 0.75 * lb / ab) + 3 * h1 / (0.25 + 0.75 * lh / ah) AS w1 FROM f, s WHERE b0 + h0 + b1 + h1 > 0)
 SELECT table_name, id, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * w0 * 2.2 / (1.2 + w0) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * w1 * 2.2 / (1.2 + w1), 6) AS score FROM w""")
def search_bm25f(t):
    members = [S.Member("documents", t("documents"), "doc_id", {"text": 1.0, "source": 3.0}), S.Member("benchmark", t("benchmark"), "item_id", {"text": 1.0})]
    # OR would make one word of two variants; here any row that holds one of two words is asked for
    return S.rank(members, _AN, "src1 erhe", all_rows=True).where("score > 0").select("table_name", "id", rnd("score", 6).alias("score"))


@query(r"""SELECT term, count(*) AS documents FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM documents) WHERE starts_with(term, 'er') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def search_complete(t):
    return S.complete(t("documents"), ["text"], _AN, "er")


@query(r"""SELECT lang, count(*) AS n FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'erhe') GROUP BY 1""")
def search_facets(t):
    d = t("documents")
    return S.facets(d, S.rank([S.Member("documents", d, "doc_id", {"text": 1.0})], _AN, "erhe"), "doc_id", ["lang"])


# ---- graph


def _trade(t):
    o = t("orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    l = t("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    key = lambda k, c: F.concat(L(k), F.col(c).cast("string"))
    return o.select(key("c", "c").alias("src"), key("o", "o").alias("dst")), l.select(key("o", "o").alias("src"), key("p", "p").alias("dst"))


@query("""SELECT DISTINCT 'p' || l2.l_partkey AS node FROM orders a JOIN lineitem l ON l.l_orderkey = a.o_orderkey JOIN lineitem m ON m.l_partkey = l.l_partkey JOIN lineitem l2 ON l2.l_orderkey = m.l_orderkey WHERE a.o_custkey = 7""")
def graph_multi_hop(t):
    orders, parts = _trade(t)
    start = t("customer").where("c_custkey = 7").select(F.concat(L("c"), F.col("c_custkey").cast("string")).alias("node"))
    return R.walk(start, [(orders, False), (parts, False), (parts, True), (parts, False)])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, 1.0 + n_nationkey % 4 AS w FROM nation UNION SELECT n_nationkey, (n_nationkey + 1) % 25, 2.5 FROM nation),
 r AS (SELECT 0 AS node, 0.0::DOUBLE AS cost, 0 AS steps, [0] AS path UNION ALL SELECT dst, cost + w, steps + 1, list_append(path, dst) FROM r JOIN e ON src = node WHERE steps < 6),
 b AS (SELECT * FROM r WHERE node = 17 ORDER BY cost, steps, path LIMIT 1) SELECT unnest(path)::INT AS node, unnest(range(len(path)))::INT AS at, cost::DOUBLE AS cost, steps::INT AS steps FROM b""")
def graph_path_to(t):
    n = t("nation").select(F.col("n_nationkey").alias("src"))
    e = n.select("src", ((F.col("src") * 7 + 3) % 25).alias("dst"), (F.col("src") % 4 + 1.0).alias("w")).unionByName(n.select("src", ((F.col("src") + 1) % 25).alias("dst"), L(2.5).alias("w")))
    return R.path_to(e, 0, 17, 6, "w")


# ---- place: positions are made from keys


def _spots(t):
    return t("customer").select("c_custkey", (F.col("c_custkey") * 7919 % 3600 / 10.0 - 180).alias("lon"), (F.col("c_custkey") * 104729 % 1800 / 10.0 - 90).alias("lat"))


_SPOTS = "WITH s AS (SELECT c_custkey, c_custkey * 7919 % 3600 / 10.0 - 180 AS lon, c_custkey * 104729 % 1800 / 10.0 - 90 AS lat FROM customer)"


@query(_SPOTS + """ SELECT least(floor((lon + 180) * 64 / 360), 63)::BIGINT AS x, least(floor((lat + 90) * 64 / 180), 63)::BIGINT AS y, count(*) AS n FROM s GROUP BY 1, 2""")
def geo_cells(t):
    return _spots(t).groupBy(G.cell_place(F.col("lon"), F.col("lat"), 6).alias("c")).agg(F.count("*").alias("n")).select("c.x", "c.y", "n")


@query(_SPOTS + """ SELECT c_custkey, n_nationkey FROM s, nation WHERE lon BETWEEN n_nationkey * 12 - 170 AND n_nationkey * 12 - 155 AND lat BETWEEN n_nationkey - 30 AND n_nationkey + 10""")
def geo_place_join(t):
    k = F.col("n_nationkey")
    corner = lambda x, y: F.array((k * 12 + x).cast("double"), (k + y).cast("double"))
    ring = F.array(corner(-170, -30), corner(-155, -30), corner(-155, 10), corner(-170, 10), corner(-170, -30))
    zones = t("nation").select("n_nationkey", F.to_json(F.struct(L("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("zone"))
    return G.place_join(_spots(t), zones, "lon", "lat", "zone").select("c_custkey", "n_nationkey")


@query(None)
def geo_radius(t):
    return G.within_radius(_spots(t), "lon", "lat", (2.35, 48.85), 1_000_000.0).select("c_custkey", rnd("metres", 1).alias("metres"))


@query(None)
def geo_nearest(t):
    return G.nearest_places(_spots(t), "c_custkey", "lon", "lat", (2.35, 48.85), 10).select("c_custkey", rnd("metres", 1).alias("metres"))


@query(None)
def matches_fuzzy(t):
    return t("documents").where(S.matches(_AN, F.col("text"), "inthta", "fuzzy")).select("doc_id")


@query(None)
def search_marks(t):
    stemmed = S.Analyzer(("lowercase", "ascii", "stemmer"))
    d = t("benchmark")
    return d.select("item_id", F.size(S.highlight(stemmed, F.col("text"), "the OR that")).alias("marks"), S.snippet(stemmed, F.col("text"), "the OR that")["start"].alias("start"))


@query(None)
def approx_distinct(t):
    return t("events").groupBy("event_type").agg(A.approx_distinct(F.col("user_id")).alias("users"), A.approx_distinct(F.col("value")).alias("kinds"))
