"""Named queries over the sample tables, each with the SQL that another engine can check it by.

Sums are rounded and integers widened on both sides, so that the order of additions and the engines' integer types don't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import library, scalar, timeops
from skein.operators import aggregates, changes, recursion, space
from skein.plans.engine import Engine
from skein.sources.files import parquet
from skein.streaming import changelog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": [], "events": ["event_id"]}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    for name, key in KEYS.items():
        e.register(name, parquet(spark, sf_dir, name), key)
    return e


def sql(name: str, dialect: str, oracle: str | None = None) -> None:
    """A query in the dialect; without an oracle the dialect's text is plain SQL for both engines."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).sql(dialect)
    ORACLES[name] = oracle or dialect


def frame(name: str, oracle: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


FLAGSHIP = """SELECT o.o_orderpriority AS o_orderpriority, COUNT(*) AS n, SUM(l.l_quantity) AS q
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_shipdate >= CAST('1995-01-01' AS DATETIME) GROUP BY o.o_orderpriority HAVING COUNT(*) > 10 ORDER BY n DESC, o_orderpriority LIMIT 10"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(FLAGSHIP)


sql("flagship", FLAGSHIP, FLAGSHIP.replace("DATETIME", "TIMESTAMP"))

# scans and predicates
sql("scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM SEQSCAN lineitem WHERE l_quantity > 45 AND l_discount <= 0.02", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02")
sql("index_hint", "SELECT p_partkey FROM part INDEXED BY pk WHERE p_size == 10", "SELECT p_partkey FROM part WHERE p_size = 10")
sql("multi_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 300000.0 OR o_orderkey IN (1, 2, 3)")
sql("in_loop", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 5, 9)")
sql("empty_in", "SELECT COUNT(*) AS n FROM nation WHERE n_nationkey IN ()", "SELECT COUNT(*) AS n FROM nation WHERE false")
sql("not_empty_in", "SELECT COUNT(*) AS n FROM nation WHERE n_nationkey NOT IN ()", "SELECT COUNT(*) AS n FROM nation")
sql("between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000.0 AND 20000.0 AND o_orderkey NOT BETWEEN 10 AND 5000")
sql("is_null", "SELECT event_id FROM events WHERE props IS NOT NULL AND value IS NOT NULL")
sql("three_valued", "SELECT COUNT(*) AS n FROM nation WHERE (n_nationkey > 3 AND UNKNOWN) OR NOT (n_regionkey = 1 OR n_nationkey = 0)", "SELECT COUNT(*) AS n FROM nation WHERE (n_nationkey > 3 AND NULL) OR NOT (n_regionkey = 1 OR n_nationkey = 0)")
sql("row_compare", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) = (1, 1) OR (n_regionkey, n_nationkey) > (3, 10)")
sql("like_escape", "SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%' AND p_name NOT LIKE '%!%%' ESCAPE '!'")
sql("regexp", "SELECT p_partkey FROM part WHERE p_name REGEXP '^[a-m].*e'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*e')")
sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("values", "VALUES (1, 'a'), (2, 'b')", 'SELECT * FROM (VALUES (1, \'a\'), (2, \'b\')) v("COLUMN_1", "COLUMN_2")')
sql("subquery_scan", "SELECT q.k AS k, q.n AS n FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) AS q WHERE q.n > 40")
sql("default_names", "SELECT n_nationkey + 1, n_nationkey FROM nation", 'SELECT n_nationkey + 1 AS "COLUMN_1", n_nationkey FROM nation')

# expressions
sql("int_division", "SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS r, (0 - p_size) / 7 AS m FROM part", "SELECT p_partkey, p_size // 7 AS q, p_size % 7 AS r, CAST((0 - p_size) // 7 AS BIGINT) AS m FROM part")
sql("bit_operators", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, p_size << 2 AS l, p_size >> 1 AS r, ~p_size AS inv FROM part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, CAST(p_size AS BIGINT) << 2 AS l, CAST(p_size AS BIGINT) >> 1 AS r, ~p_size AS inv FROM part")
sql("concat", "SELECT n_nationkey, n_name || '-' || 'x' AS s FROM nation")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders")
sql("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' END AS s FROM part")
sql("casts", "SELECT p_partkey, CAST(p_retailprice AS INTEGER) AS i, CAST(p_size AS TEXT) AS t, CAST('12' AS INTEGER) AS n FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS t, CAST(12 AS BIGINT) AS n FROM part")
sql("collate_equal", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment COLLATE \"unicode_ci\" = 'building'", "SELECT COUNT(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'")
sql("array_subscript", "SELECT n_nationkey, [n_nationkey, n_regionkey, 7][2] AS b, [1, 2][5] AS none FROM nation", "SELECT n_nationkey, n_regionkey AS b, CAST(NULL AS INTEGER) AS none FROM nation")
sql("map_subscript", "SELECT n_nationkey, {'a': n_nationkey, 'b': 5}['a'] AS a, {'a': 1}['z'] AS none FROM nation", "SELECT n_nationkey, n_nationkey AS a, CAST(NULL AS INTEGER) AS none FROM nation")
sql("likelihood", "SELECT COUNT(*) AS n FROM orders WHERE LIKELY(o_totalprice > 100000.0) AND LIKELIHOOD(o_orderstatus = 'O', 0.5)", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'O'")

# joins
sql("inner_join", "SELECT c.c_custkey AS c_custkey, n.n_name AS n_name FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2")
sql("left_join", "SELECT c.c_custkey AS c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000.0 GROUP BY c.c_custkey")
sql("comma_join", "SELECT n.n_name AS n_name, r.r_name AS r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
sql("cross_join", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b")
sql("natural_join", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) AS a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) AS b")
sql("natural_left_join", "SELECT * FROM (SELECT r_regionkey AS k, r_name FROM region) AS a NATURAL LEFT JOIN (SELECT n_regionkey AS k, n_name FROM nation WHERE n_nationkey < 4) AS b")
sql("using_join", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) AS a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) AS b USING (k)")
sql("theta_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("self_join", "SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
sql("nested_from", "SELECT r.r_name AS r_name, COUNT(*) AS n FROM region r JOIN (SELECT n_regionkey AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey) AS x ON x.k = r.r_regionkey GROUP BY r.r_name")
sql("transitive", "SELECT COUNT(*) AS n FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_custkey = 7")
sql("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000.0)")
sql("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
sql("in_table", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
sql("exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9900.0)")
sql("not_exists", "SELECT n_nationkey FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000.0)")
sql("scalar_subquery", "SELECT COUNT(*) AS n FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)")
sql("correlated", "SELECT COUNT(*) AS n FROM lineitem l WHERE l.l_quantity > (SELECT AVG(i.l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")

# aggregates
sql("group_by_having", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 5")
sql("avg_int", "SELECT p_brand, AVG(p_size) AS a, MAX(p_size) / AVG(p_size) AS b FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) // count(p_size) AS BIGINT) AS a, CAST(max(p_size) // (sum(p_size) // count(p_size)) AS BIGINT) AS b FROM part GROUP BY p_brand")
sql("total", "SELECT TOTAL(p_size) AS t, TOTAL(NULL) AS z, SUM(p_size) AS s FROM part", "SELECT CAST(sum(p_size) AS DOUBLE) AS t, 0.0::DOUBLE AS z, CAST(sum(p_size) AS BIGINT) AS s FROM part")
sql("count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS c, COUNT(o_custkey) AS n, COUNT(*) AS m FROM orders")
sql("min_max", "SELECT c_nationkey, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi, MIN(c_name) AS first_name FROM customer GROUP BY c_nationkey")
sql("bare_column", "SELECT p_brand, MAX(p_partkey) AS k, p_name FROM part GROUP BY p_brand", "SELECT p_brand, max(p_partkey) AS k, max_by(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand")
sql("group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name) AS s, GROUP_CONCAT(n_name, '; ') AS t FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS s, string_agg(n_name, '; ' ORDER BY n_name) AS t FROM nation GROUP BY n_regionkey")
sql("group_by_alias", "SELECT SUBSTR(o_orderpriority, 1, 1) AS p, COUNT(*) AS n FROM orders GROUP BY p")
sql("group_by_ordinal", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
sql("empty_aggregate", "SELECT COUNT(*) AS n, MIN(p_size) AS lo, TOTAL(p_size) AS t FROM part WHERE p_partkey < 0", "SELECT count(*) AS n, min(p_size) AS lo, 0.0::DOUBLE AS t FROM part WHERE p_partkey < 0")
sql("case_aggregate", "SELECT l_returnflag, SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS big FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM lineitem GROUP BY l_returnflag")

# order and limits
sql("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
sql("limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
sql("limit_subquery", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT COUNT(*) FROM region)")
sql("order_ordinal", "SELECT n_name, n_regionkey FROM nation ORDER BY 2 DESC, 1 LIMIT 7")

# sets and recursion
sql("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 3")
sql("compound_order", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region EXCEPT SELECT 3 ORDER BY k LIMIT 12")
sql("cte", "WITH big AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT k FROM big WHERE n > 15) SELECT COUNT(*) AS n FROM top")
sql("recursive_cte", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n, n * n AS sq FROM s", "WITH RECURSIVE s(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n, n * n AS sq FROM s")


@frame("recursive_union", "WITH RECURSIVE e AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS s, c_custkey AS t FROM customer), r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t) SELECT s, t FROM r")
def _recursive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = parquet(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("s"), F.col("c_custkey").alias("t"))
    return recursion.closure(edges, "s", "t")


# scalar functions
sql("text_functions", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, LENGTH(p_name) AS n, CHAR_LENGTH(p_name) AS c, REPLACE(p_name, 'a', 'xy') AS r FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INTEGER) AS n, CAST(length(p_name) AS INTEGER) AS c, replace(p_name, 'a', 'xy') AS r FROM part")
sql("substr_rules", "SELECT p_partkey, SUBSTR(p_name, 0, 2) AS a, SUBSTR(p_name, -1, 1) AS b, SUBSTR(p_name, -1, 10) AS c, SUBSTR(p_name, 3) AS d FROM part", "SELECT p_partkey, substr(p_name, 1, 1) AS a, '' AS b, substr(p_name, 1, 8) AS c, substr(p_name, 3) AS d FROM part")
sql("trim_position", "SELECT p_partkey, TRIM(BOTH 'a' FROM p_name) AS b, TRIM(LEADING 'ab' FROM p_name) AS l, POSITION('e', p_name) AS p FROM part", "SELECT p_partkey, trim(p_name, 'a') AS b, ltrim(p_name, 'ab') AS l, CAST(position('e' IN p_name) AS INTEGER) AS p FROM part")
sql("char_unicode", "SELECT n_nationkey, CHAR(1103, 65 + n_nationkey) AS c, UNICODE(n_name) AS u FROM nation", "SELECT n_nationkey, chr(1103) || chr(65 + n_nationkey) AS c, unicode(n_name) AS u FROM nation")
sql("quote_typeof", "SELECT n_nationkey, QUOTE(n_name || 'it''s') AS q, TYPEOF(n_name) AS t, TYPEOF(n_nationkey) AS i, TYPEOF(1.5) AS d FROM nation", "SELECT n_nationkey, '''' || replace(n_name || 'it''s', '''', '''''') || '''' AS q, 'string' AS t, 'integer' AS i, 'double' AS d FROM nation")
sql("greatest_least", "SELECT p_partkey, GREATEST(p_size, 25) AS g, LEAST(p_size, 25) AS l, GREATEST('x', 5, TRUE) AS m, LEAST('x', 5) AS k FROM part", "SELECT p_partkey, greatest(p_size, 25) AS g, least(p_size, 25) AS l, 'x' AS m, 5 AS k FROM part")
sql("null_functions", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 2), 99) AS c, IFNULL(NULLIF(n_name, 'X'), 'none') AS i FROM nation", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 2), 99) AS c, coalesce(nullif(n_name, 'X'), 'none') AS i FROM nation")
sql("round_abs", "SELECT s_suppkey, ABS(s_acctbal) AS a, ROUND(s_acctbal, 1) AS r, ROUND(s_suppkey) AS i, ROUND(s_acctbal, -3) AS z FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal, 1) AS r, s_suppkey AS i, round(s_acctbal, 0) AS z FROM supplier")
sql("hex_blob", "SELECT n_nationkey, HEX(x'00ff41') AS h, HEX(ZEROBLOB(2)) AS z FROM nation", "SELECT n_nationkey, '00FF41' AS h, '0000' AS z FROM nation")
sql("soundex", "SELECT SOUNDEX('Robert') AS a, SOUNDEX('Rupert') AS b", "SELECT 'R163' AS a, 'R163' AS b")
sql("printf", "SELECT n_nationkey, PRINTF('%05d|%s|%.2f', n_nationkey, n_name, 1.5) AS s FROM nation", "SELECT n_nationkey, printf('%05d|%s|%.2f', n_nationkey, n_name, 1.5) AS s FROM nation")


# key and range access
def _space(spark: SparkSession, sf_dir: str, name: str = "orders") -> space.Space:
    return space.Space(parquet(spark, sf_dir, name), KEYS[name])


frame("key_get", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 42")(lambda s, d: _space(s, d).get([42]).select("o_orderkey", "o_custkey"))
for _it, _op in (("GE", ">="), ("GT", ">"), ("LE", "<="), ("LT", "<"), ("EQ", "="), ("REQ", "=")):
    frame(f"range_{_it.lower()}", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey {_op} 1000")(lambda s, d, it=_it: _space(s, d).select([1000], it).select("o_orderkey", "o_totalprice"))
frame("key_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 10")(lambda s, d: _space(s, d).select(after=[100], limit=10).select("o_orderkey"))
frame("key_page_down", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 900 AND o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 10")(lambda s, d: _space(s, d).select([900], "LE", after=[500], limit=10).select("o_orderkey"))
frame("key_offset_limit", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 50 ORDER BY o_orderkey LIMIT 5 OFFSET 7")(lambda s, d: _space(s, d).select([50], "GE", offset=7, limit=5).select("o_orderkey"))
frame("key_count", "SELECT count(*) AS n FROM orders WHERE o_orderkey > 777")(lambda s, d: _space(s, d).count([777], "GT"))
frame("key_min", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1")(lambda s, d: _space(s, d).min().select("o_orderkey", "o_custkey"))
frame("key_max", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")(lambda s, d: _space(s, d).max().select("o_orderkey", "o_custkey"))
frame("key_quantile", "SELECT quantile_disc(l_quantity, 0.9) AS quantile FROM lineitem WHERE l_quantity >= 5 AND l_quantity < 40")(lambda s, d: space.Space(parquet(s, d, "lineitem"), ["l_quantity"]).quantile(0.9, [5.0], [40.0]))
frame("key_offset_of", "SELECT count(*) AS n FROM orders WHERE o_orderkey < 333")(lambda s, d: _space(s, d).offset_of([333]))
frame("key_random")(lambda s, d: _space(s, d).random(7).select("o_orderkey"))
frame("next_prefix", "SELECT c_custkey, c_name FROM customer WHERE c_name > 'Customer#000000' AND NOT starts_with(c_name, 'Customer#000000')")(lambda s, d: space.Space(parquet(s, d, "customer"), ["c_name"]).select(["Customer#000000"], "NP").select("c_custkey", "c_name"))
frame("previous_prefix", "SELECT c_custkey, c_name FROM customer WHERE c_name < 'Customer#00000002'")(lambda s, d: space.Space(parquet(s, d, "customer"), ["c_name"]).select(["Customer#00000002"], "PP").select("c_custkey", "c_name"))
frame("compound_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 500 OR (l_orderkey = 500 AND l_linenumber >= 2)")(lambda s, d: space.Space(parquet(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select([500, 2], "GE").select("l_orderkey", "l_linenumber"))
frame("hash_gt", "SELECT s_suppkey FROM supplier WHERE s_suppkey > 50")(lambda s, d: space.hash_select(parquet(s, d, "supplier"), ["s_suppkey"], "GT", [50]).select("s_suppkey"))
for _it, _test in (("BITS_ALL_SET", "= 5"), ("BITS_ANY_SET", "<> 0"), ("BITS_ALL_NOT_SET", "= 0")):
    frame(_it.lower(), f"SELECT event_id, user_id FROM events WHERE user_id & 5 {_test}")(lambda s, d, it=_it: space.bits(parquet(s, d, "events"), "user_id", it, 5).select("event_id", "user_id"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x1"), (F.col("p_size") + 5).cast("double").alias("x2"), (F.col("p_partkey") % 50).cast("double").alias("y1"), (F.col("p_partkey") % 50 + 3).cast("double").alias("y2"))


for _it, _test in (("GE", "x1 <= 20 AND x2 >= 22 AND y1 <= 10 AND y2 >= 11"), ("LE", "x1 >= 10 AND x2 <= 30 AND y1 >= 10 AND y2 <= 30"), ("OVERLAPS", "x1 <= 22 AND x2 >= 20 AND y1 <= 11 AND y2 >= 10"), ("LT", "x1 > 10 AND x2 < 30 AND y1 > 10 AND y2 < 30"), ("GT", "x1 < 20 AND x2 > 22 AND y1 < 10 AND y2 > 11")):
    _k = [10.0, 10.0, 30.0, 30.0] if _it in ("LE", "LT") else [20.0, 10.0, 22.0, 11.0]
    frame(f"box_{_it.lower()}", f"SELECT p_partkey FROM (SELECT p_partkey, p_size AS x1, p_size + 5 AS x2, p_partkey % 50 AS y1, p_partkey % 50 + 3 AS y2 FROM part) b WHERE {_test}")(lambda s, d, it=_it, k=_k: space.box(_boxes(s, d), ["x1", "y1"], ["x2", "y2"], it, k).select("p_partkey"))
frame("box_neighbor", "SELECT p_partkey FROM part ORDER BY (p_size - 20.5) ** 2 + (p_partkey - 300.25) ** 2, p_size, p_partkey LIMIT 9")(
    lambda s, d: space.box(parquet(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_partkey").cast("double").alias("y")), ["x", "y"], ["x", "y"], "NEIGHBOR", [20.5, 300.25], 9).select("p_partkey")
)
frame("knn", "SELECT vec_id FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x * x)) AS d FROM embeddings) e ORDER BY d, vec_id LIMIT 10")(
    lambda s, d: parquet(s, d, "embeddings").select("vec_id", F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)").alias("d")).orderBy("d", "vec_id").limit(10).select("vec_id")
)
frame("multikey", "SELECT key, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS key FROM part) p GROUP BY key")(lambda s, d: space.multikey(parquet(s, d, "part").withColumn("w", F.split("p_name", " ")), "w").groupBy("key").agg(F.count(F.lit(1)).alias("n")))
frame("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda s, d: parquet(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")))
frame("merger", "SELECT o_orderkey FROM orders ORDER BY o_orderkey")(
    lambda s, d: space.merge([parquet(s, d, "orders").where(F.pmod("o_orderkey", F.lit(3)) == i).select("o_orderkey") for i in range(3)], ["o_orderkey"])
)


# changes
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("lsn"), F.lit(1).alias("replica_id"), F.expr("if(event_id % 7 = 0, 'DELETE', 'REPLACE')").alias("op"), F.col("user_id").alias("key"), "value")


frame("compaction", "SELECT key, lsn, value FROM (SELECT user_id AS key, event_id AS lsn, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) x WHERE r = 1")(lambda s, d: changes.compact(_log(s, d), ["key"], "lsn").select("key", "lsn", "value"))
frame("replay", "SELECT key, value, lsn FROM (SELECT user_id AS key, event_id AS lsn, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) x WHERE r = 1 AND lsn % 7 <> 0")(lambda s, d: changelog.replay(_log(s, d)))
frame("latest_by_key", "SELECT user_id AS key, max(event_id) AS lsn, max_by(value, event_id) AS value FROM events GROUP BY user_id")(lambda s, d: changelog.latest(_log(s, d)).select("key", "lsn", "value"))
frame("upsert_add", "SELECT s_suppkey AS k, CAST(s_nationkey + coalesce(q, 0) AS BIGINT) AS v FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS q FROM lineitem GROUP BY 1) l ON l_suppkey = s_suppkey UNION SELECT l_suppkey, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")(
    lambda s, d: changes.add_up(parquet(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("v")), parquet(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.lit(1).alias("d")), ["k"], "v", "d")
)


def _changed(*statements: str, then: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        for x in statements:
            e.sql(x)
        return e.sql(then)

    return run


frame("insert_ignore", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'NEW'")(_changed("INSERT OR IGNORE INTO nation VALUES (1, 'AGAIN', 1), (100, 'NEW', 2)", then="SELECT n_nationkey, n_name FROM nation"))
frame("replace_into", "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'AGAIN' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'NEW'")(_changed("REPLACE INTO nation VALUES (1, 'AGAIN', 1), (100, 'NEW', 2)", then="SELECT n_nationkey, n_name FROM nation"))
frame("insert_select", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")(_changed("INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1", then="SELECT r_regionkey, r_name FROM region"))
frame("update", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_acctbal < 0 THEN 'poor' ELSE s_name END AS s_name FROM supplier")(_changed("UPDATE supplier SET s_acctbal = 0.0, s_name = 'poor' WHERE s_acctbal < 0.0", then="SELECT s_suppkey, s_acctbal, s_name FROM supplier"))
frame("update_row_form", "SELECT n_nationkey, CASE WHEN n_regionkey = 4 THEN n_nationkey ELSE n_regionkey END AS n_regionkey, CASE WHEN n_regionkey = 4 THEN 'x' ELSE n_name END AS n_name FROM nation")(_changed("UPDATE nation SET (n_regionkey, n_name) = (n_nationkey, 'x') WHERE n_regionkey = 4", then="SELECT n_nationkey, n_regionkey, n_name FROM nation"))
frame("delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)")(_changed("DELETE FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000.0", then="SELECT o_orderkey FROM orders"))
frame("truncate", "SELECT count(*) AS n FROM region WHERE false")(_changed("TRUNCATE TABLE region", then="SELECT COUNT(*) AS n FROM region"))
frame("create_insert", "SELECT * FROM (VALUES (1, 'a', 5), (2, 'b', 7)) t(id, s, n)")(_changed("CREATE TABLE made (id INT PRIMARY KEY, s TEXT NOT NULL, n INT DEFAULT 5, CHECK (n > 0))", "INSERT INTO made (id, s) VALUES (1, 'a')", "INSERT INTO made VALUES (2, 'b', 7)", then="SELECT id, s, n FROM made"))
frame("create_view", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")(_changed("CREATE VIEW per_region AS SELECT r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", then="SELECT r_name, n FROM per_region"))
frame("alter_table", "SELECT r_regionkey, r_name, CAST(NULL AS BIGINT) AS extra FROM region")(_changed("ALTER TABLE region ADD COLUMN extra INT", "ALTER TABLE region RENAME TO area", then="SELECT r_regionkey, r_name, extra FROM area"))
frame("row_count", "SELECT count(*) AS row_count FROM nation WHERE n_regionkey = 1")(lambda s, d: engine(s, d).sql("UPDATE nation SET n_name = 'x' WHERE n_regionkey = 1"))
frame("delete_range", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey >= 100 AND o_orderkey < 900)")(lambda s, d: changes.delete_range(parquet(s, d, "orders"), "o_orderkey", 100, 900).select("o_orderkey"))
frame("foreign_key_check", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)")(lambda s, d: changes.dangling(parquet(s, d, "nation"), ["n_regionkey"], parquet(s, d, "region").where("r_regionkey < 3"), ["r_regionkey"]).select("n_nationkey"))
frame("sequence", "SELECT o_orderkey, 10 + 5 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS id FROM orders")(lambda s, d: changes.sequence(parquet(s, d, "orders").select("o_orderkey"), "id", 10, 5, order_by=["o_orderkey"]))

# times, digests and text
frame("time_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(dayofweek(o_orderdate) AS INTEGER) AS dow, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(minute(o_orderdate) AS INTEGER) AS min, CAST(second(o_orderdate) AS INTEGER) AS sec, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS epoch FROM orders")(
    lambda s, d: parquet(s, d, "orders").select("o_orderkey", *timeops.parts(F.col("o_orderdate").cast("timestamp")))
)
frame("strftime", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d at %H:%M') AS s FROM orders")(lambda s, d: parquet(s, d, "orders").select("o_orderkey", timeops.strftime(F.col("o_orderdate"), "%Y/%m/%d at %H:%M").alias("s")))
frame("interval_add", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 14 MONTH + INTERVAL 10 DAY + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS t FROM orders")(
    lambda s, d: parquet(s, d, "orders").select("o_orderkey", timeops.strftime(timeops.add(F.col("o_orderdate").cast("timestamp"), timeops.interval(year=1, month=2, week=1, day=3, hour=4)), "%F %T").alias("t"))
)
frame("datetime_subtract", "SELECT event_id, CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000) AS BIGINT) AS sec FROM events")(
    lambda s, d: parquet(s, d, "events").select("event_id", timeops.subtract(F.col("ts").cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))["sec"].alias("sec"))
)
frame("digests", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation")(lambda s, d: parquet(s, d, "nation").select("n_nationkey", F.md5("n_name").alias("m"), F.sha1("n_name").alias("s1"), F.sha2("n_name", 256).alias("s2")))
# Values worked out apart from Spark: 32-bit Murmur3 of the names with seed 13, and exact products.
MURMURS = "(0, 3827324810), (1, 2076108547), (2, 1731083339), (3, 956148646), (4, 3479074564), (5, 3444145510), (6, 3525910711), (7, 3851820256), (8, 402994268), (9, 4184186858), (10, 2151432065), (11, 3989809450), (12, 2607145599), (13, 3880017571), (14, 3193145205), (15, 2861627681), (16, 1881117266), (17, 3799403960), (18, 863036386), (19, 2878308120), (20, 3399459601), (21, 2015132852), (22, 2099147234), (23, 3245191671), (24, 734016439)"
PRODUCTS = "(0, '1219326311370217952261850327337448558754610577554336229223321140070'), (1, '1219326311370217952261850327337448558853376009664212772434308794391'), (2, '1219326311370217952261850327337448558952141441774089315645296448712'), (3, '1219326311370217952261850327337448559050906873883965858856284103033'), (4, '1219326311370217952261850327337448559149672305993842402067271757354'), (5, '1219326311370217952261850327337448559248437738103718945278259411675'), (6, '1219326311370217952261850327337448559347203170213595488489247065996'), (7, '1219326311370217952261850327337448559445968602323472031700234720317'), (8, '1219326311370217952261850327337448559544734034433348574911222374638'), (9, '1219326311370217952261850327337448559643499466543225118122210028959'), (10, '12193263113702179522618503273374485588533760096642127724343087943910'), (11, '12193263113702179522618503273374485588632525528752004267554075598231'), (12, '12193263113702179522618503273374485588731290960861880810765063252552'), (13, '12193263113702179522618503273374485588830056392971757353976050906873'), (14, '12193263113702179522618503273374485588928821825081633897187038561194'), (15, '12193263113702179522618503273374485589027587257191510440398026215515'), (16, '12193263113702179522618503273374485589126352689301386983609013869836'), (17, '12193263113702179522618503273374485589225118121411263526820001524157'), (18, '12193263113702179522618503273374485589323883553521140070030989178478'), (19, '12193263113702179522618503273374485589422648985631016613241976832799'), (20, '12193263113702179522618503273374485589521414417740893156452964487120'), (21, '12193263113702179522618503273374485589620179849850769699663952141441'), (22, '12193263113702179522618503273374485589718945281960646242874939795762'), (23, '12193263113702179522618503273374485589817710714070522786085927450083'), (24, '12193263113702179522618503273374485589916476146180399329296915104404')"
frame("murmur", f"SELECT n_nationkey, CAST(h AS BIGINT) AS h FROM nation JOIN (VALUES {MURMURS}) t(k, h) ON k = n_nationkey")(lambda s, d: parquet(s, d, "nation").select("n_nationkey", scalar.murmur(F.col("n_name")).alias("h")))
JUMP = """WITH RECURSIVE r(c_custkey, k, b, j) AS (SELECT c_custkey, c_custkey::UHUGEINT, -1::BIGINT, 0::BIGINT FROM customer
 UNION ALL SELECT c_custkey, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((((k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT) // 8589934592::UHUGEINT) + 1::UHUGEINT AS DOUBLE))) AS BIGINT) FROM r WHERE j < 16)
SELECT c_custkey, CAST(max(b) AS BIGINT) AS shard FROM r GROUP BY c_custkey"""
frame("consistent_hash", JUMP)(lambda s, d: parquet(s, d, "customer").select("c_custkey", scalar.consistent(16)(F.col("c_custkey")).alias("shard")))
frame("justify", "SELECT n_nationkey, rpad(n_name, greatest(20, length(n_name))::INTEGER, '.') AS l, lpad(n_name, greatest(20, length(n_name))::INTEGER, '.') AS r FROM nation")(lambda s, d: parquet(s, d, "nation").select("n_nationkey", scalar.ljust(F.col("n_name"), 20, ".").alias("l"), scalar.rjust(F.col("n_name"), 20, ".").alias("r")))
frame("big_decimal", f"SELECT n_nationkey, p FROM nation JOIN (VALUES {PRODUCTS}) t(k, p) ON k = n_nationkey")(lambda s, d: parquet(s, d, "nation").select("n_nationkey", scalar.big_decimal("*")(F.concat(F.lit("1234567890123456789012345678901234567"), F.col("n_nationkey").cast("string")), F.lit("98765432109876543210987654321")).alias("p")))
frame("tumbling", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY 1")(lambda s, d: changelog.windows(parquet(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "10 minutes").select(timeops.strftime(F.col("start"), "%F %T").alias("start"), "n"))
frame("user_function", "SELECT n_nationkey, n_nationkey * 3 + 1 AS v FROM nation")(lambda s, d: _with_function(engine(s, d)).sql("SELECT n_nationkey, triple(n_nationkey) AS v FROM nation"))


def _with_function(e: Engine) -> Engine:
    e.function("triple", "int", "x * 3 + 1", ["x:int"])
    return e


@frame("user_aggregate", "SELECT p_brand, CAST(sum(p_size * p_size) AS BIGINT) AS v FROM part GROUP BY p_brand")
def _user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = aggregates.Aggregate("bigint", zero="0L", step="state + x * x", merge="state + other")
    return aggregates.fold(parquet(spark, sf_dir, "part"), ["p_brand"], "cast(p_size as bigint)", squares, "v")


@frame("user_aggregate_ordered", "SELECT o_custkey, string_agg(o_orderpriority, '/' ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey")
def _user_aggregate_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state that keeps its inputs' order: pieces carry their keys, and the final function puts them in line."""
    pieces = "array<struct<k: bigint, s: string>>"
    line = aggregates.Aggregate(pieces, zero=f"cast(array() as {pieces})", step="concat(state, array(x))", merge="concat(state, other)", final="array_join(transform(array_sort(state), p -> p.s), '/')")
    return aggregates.fold(parquet(spark, sf_dir, "orders"), ["o_custkey"], "named_struct('k', o_orderkey, 's', o_orderpriority)", line, "v")


frame("view_after_insert", "SELECT count(*) AS n FROM (SELECT r_regionkey FROM region WHERE r_regionkey > 2 UNION ALL SELECT 10)")(_changed("CREATE VIEW late AS SELECT r_regionkey FROM region WHERE r_regionkey > 2", "INSERT INTO region VALUES (10, 'NEW')", then="SELECT COUNT(*) AS n FROM late"))
frame("autoincrement", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS id, n_name AS s FROM nation")(_changed("CREATE TABLE made (id INT PRIMARY KEY AUTOINCREMENT, s TEXT)", "INSERT INTO made (s) SELECT n_name FROM nation ORDER BY n_nationkey", then="SELECT id, s FROM made"))
frame("update_row_expressions", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN coalesce(NULL, 7) ELSE n_regionkey END AS n_regionkey, CASE WHEN n_regionkey = 1 THEN replace(n_name, 'A', ',') ELSE n_name END AS n_name FROM nation")(_changed("UPDATE nation SET (n_regionkey, n_name) = (COALESCE(NULL, 7), REPLACE(n_name, 'A', ',')) WHERE n_regionkey = 1", then="SELECT n_nationkey, n_regionkey, n_name FROM nation"))
frame("literal_with_keyword", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'a WHERE b; SET (c)' ELSE n_name END AS n_name FROM nation WHERE n_name <> 'x WHERE y'")(_changed("UPDATE nation SET n_name = 'a WHERE b; SET (c)' WHERE n_regionkey = 2", "DELETE FROM nation WHERE n_name = 'x WHERE y'", then="SELECT n_nationkey, n_name FROM nation"))
frame("insert_ignore_unique", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 21, 'FRESH'")(_changed("CREATE UNIQUE INDEX by_name ON region (r_name)", "INSERT OR IGNORE INTO region VALUES (20, 'ASIA'), (21, 'FRESH'), (22, 'FRESH')", then="SELECT r_regionkey, r_name FROM region"))
frame("on_conflict_replace", "SELECT CAST(max(n_nationkey) AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r FROM nation GROUP BY n_regionkey")(_changed("CREATE TABLE last (k INT PRIMARY KEY, r INT UNIQUE ON CONFLICT REPLACE)", "INSERT INTO last SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_nationkey", then="SELECT k, r FROM last"))
frame("trigger_update", "SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(count(n_nationkey) AS BIGINT) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")(
    _changed(
        "CREATE TABLE tally (k INT PRIMARY KEY, n INT)",
        "INSERT INTO tally SELECT r_regionkey, 0 FROM region",
        "CREATE TABLE copy (k INT PRIMARY KEY, r INT)",
        "CREATE TRIGGER count_them AFTER INSERT ON copy FOR EACH ROW BEGIN UPDATE tally SET n = n + 1 WHERE k = NEW.r; END",
        "INSERT INTO copy SELECT n_nationkey, n_regionkey FROM nation",
        then="SELECT k, n FROM tally",
    )
)
sql("like_function", "SELECT p_partkey FROM part WHERE LIKE('%a%', p_name)", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%'")
frame("row_count_function", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")(_changed("DELETE FROM nation WHERE n_regionkey = 1", then="SELECT ROW_COUNT() AS n"))


def _with_table_function(e: Engine) -> Engine:
    e.table_function("of_region", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = r", ["r:int"], ["n_nationkey:int", "n_name:string"])
    return e


frame("table_function", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3")(lambda s, d: _with_table_function(engine(s, d)).sql("SELECT n_nationkey, n_name FROM of_region(3)"))
frame("in_function", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")(lambda s, d: _with_table_function(engine(s, d)).sql("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM of_region(1))"))
frame("page_after_null", "SELECT DISTINCT nullif(c_nationkey, 3) AS k FROM customer WHERE nullif(c_nationkey, 3) IS NOT NULL ORDER BY k LIMIT 7")(lambda s, d: space.Space(parquet(s, d, "customer").selectExpr("nullif(c_nationkey, 3) AS k").distinct(), ["k"]).select(after=[None], limit=7).select("k"))
frame("ordered_recursion", "SELECT * FROM (VALUES (1, 0), (2, 1), (4, 2), (5, 2), (3, 1)) t(n, level)")(
    lambda s, d: recursion.iterate(s.createDataFrame([(1, 0)], "n int, level int"), lambda f: f.selectExpr("explode(array(n * 2, n * 2 + 1)) AS n", "level + 1 AS level").where("level < 3"), distinct=False, order_by=["level DESC", "n"], limit=5)
)


frame("trigger", "SELECT CAST(n_nationkey + 99 AS BIGINT) AS k, n_name AS n FROM nation WHERE n_nationkey + 99 > 100")(
    _changed(
        "CREATE TABLE seen (k INT, n TEXT)",
        "CREATE TRIGGER tr AFTER INSERT ON region FOR EACH ROW WHEN NEW.r_regionkey > 100 BEGIN INSERT INTO seen VALUES (NEW.r_regionkey, NEW.r_name); END",
        "INSERT INTO region SELECT n_nationkey + 99, n_name FROM nation",
        then="SELECT k, n FROM seen",
    )
)
frame("rollback", "SELECT n_nationkey, n_name FROM nation")(_changed("START TRANSACTION", "DELETE FROM nation WHERE n_nationkey > 3", "ROLLBACK", then="SELECT n_nationkey, n_name FROM nation"))
frame("savepoint", "SELECT n_nationkey FROM nation WHERE n_nationkey <= 20")(_changed("START TRANSACTION", "DELETE FROM nation WHERE n_nationkey > 20", "SAVEPOINT a", "DELETE FROM nation WHERE n_nationkey > 3", "ROLLBACK TO a", "COMMIT", then="SELECT n_nationkey FROM nation"))
frame("table_info", "SELECT 'n_nationkey' AS name, 1 AS pk UNION ALL SELECT 'n_name', 0 UNION ALL SELECT 'n_regionkey', 0")(lambda s, d: engine(s, d).sql("PRAGMA table_info(nation)").select("name", "pk"))
frame("show_create_table")(lambda s, d: engine(s, d).sql("SHOW CREATE TABLE nation"))
frame("explain")(lambda s, d: engine(s, d).sql("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey = 3"))
frame("random_functions")(lambda s, d: engine(s, d).sql("SELECT RANDOM() AS r, LENGTH(RANDOMBLOB(20)) AS b, LENGTH(UUID()) AS u, TYPEOF(NOW()) AS t"))

# the function library
frame("string_library", "SELECT p_partkey, string_split(p_name, ' ') AS parts, starts_with(p_name, 'Par') AS st, ends_with(p_name, '7') AS en, trim(p_name, 'Pa17') AS bare, lower(hex(p_name)) AS h FROM part")(
    lambda s, d: parquet(s, d, "part").select("p_partkey", library.split(F.col("p_name"), " ").alias("parts"), library.startswith(F.col("p_name"), "Par").alias("st"), library.endswith(F.col("p_name"), "7").alias("en"), library.strip(F.col("p_name"), "Pa17").alias("bare"), library.to_hex(F.col("p_name")).alias("h"))
)
frame("utf8_library", "SELECT n_nationkey, substr(n_name, 2, 3) AS a, right(n_name, 4) AS b, regexp_matches(left(n_name, 1), '^[A-Z]$') AS up, regexp_matches(right(n_name, 1), '^[0-9]$') AS digit FROM nation")(
    lambda s, d: parquet(s, d, "nation").select("n_nationkey", library.sub(F.col("n_name"), 2, 4).alias("a"), library.sub(F.col("n_name"), -4).alias("b"), library.isupper(F.left("n_name", F.lit(1))).alias("up"), library.isdigit(F.right("n_name", F.lit(1))).alias("digit"))
)
frame("base64_library", "SELECT c_custkey, base64(encode(c_name)) AS b, rtrim(translate(base64(encode(c_name)), '+/', '-_'), '=') AS u, c_name AS back FROM customer")(
    lambda s, d: parquet(s, d, "customer").select("c_custkey", library.base64(F.col("c_name")).alias("b"), library.base64(F.col("c_name"), urlsafe=True).alias("u"), library.from_base64(library.base64(F.col("c_name"), urlsafe=True)).cast("string").alias("back"))
)
frame("uri_library", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/:?#]*)', 1) AS host, nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages")(
    lambda s, d: parquet(s, d, "pages").select("page_id", library.uri(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.host", "u.path")
)
frame("decimal_library", "SELECT s_suppkey, round(sqrt(s_suppkey), 6) AS r, round(ln(s_suppkey), 6) AS l, round(log10(s_suppkey), 6) AS t, CAST(s_suppkey AS BIGINT) * s_suppkey * s_suppkey AS p, s_suppkey || '.50' AS e, s_suppkey || '.5' AS m FROM supplier WHERE s_suppkey > 0")(
    lambda s, d: parquet(s, d, "supplier").where("s_suppkey > 0").select(
        "s_suppkey",
        *[F.round(library.decimal_math(op)(F.col("s_suppkey").cast("string")).cast("double"), 6).alias(n) for op, n in (("sqrt", "r"), ("ln", "l"), ("log10", "t"))],
        library.decimal_math("pow")(F.col("s_suppkey").cast("string"), F.lit("3")).cast("bigint").alias("p"),
        library.decimal_math("rescale", 2)(F.concat(F.col("s_suppkey").cast("string"), F.lit(".5"))).alias("e"),
        library.decimal_math("trim")(F.concat(F.col("s_suppkey").cast("string"), F.lit(".5000"))).alias("m"),
    )
)
frame("tuple_library", "SELECT p_partkey, [p_size, 7, 8, p_size] AS t, 1 AS f, list_filter([1, 4], lambda i: true) AS a FROM part WHERE p_size NOT IN (5, 6)")(
    lambda s, d: parquet(s, d, "part").where("p_size NOT IN (5, 6)").select("p_partkey", F.array("p_size", F.lit(5), F.lit(6), "p_size").alias("x"), "p_size").select(
        "p_partkey", library.transform(F.col("x"), 2, 2, F.lit(7), F.lit(8)).alias("t"), library.find(F.col("x"), F.col("p_size")).cast("int").alias("f"), library.findall(F.col("x"), F.col("p_size")).alias("a")
    )
)
frame("histogram", "SELECT bound, count(q) AS n, sum(count(q)) OVER (ORDER BY coalesce(bound, 1e9)) AS up_to FROM (VALUES (10.0, 0.0), (20.0, 10.0), (40.0, 20.0), (NULL, 40.0)) b(bound, low) LEFT JOIN (SELECT l_quantity AS q FROM lineitem) l ON q > low AND q <= coalesce(bound, 1e9) GROUP BY bound")(lambda s, d: library.histogram(parquet(s, d, "lineitem"), "l_quantity", [10, 20, 40]))
frame("latency", "SELECT count(value) AS n, min(value) AS min, max(value) AS max, avg(value) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events")(lambda s, d: library.latency(parquet(s, d, "events"), "value", [0.5, 0.99]))
frame("space_upgrade", "SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey * 10 AS n_regionkey FROM nation")(lambda s, d: engine(s, d).upgrade("nation", lambda df: df.select("n_nationkey", F.lower("n_name").alias("n_name"), (F.col("n_regionkey") * 10).alias("n_regionkey"))))
