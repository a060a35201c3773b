"""Named queries over the test tables, in the MySQL dialect, each with the DuckDB SQL it must agree with.

Read-only queries are one statement. Those that change tables are a script over tables of their own, filled from the
test tables, and end in a query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import relational as r
from quarry.plans.lexer import SqlError
from quarry.session import Session, scratch
from quarry.streaming import windows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
CASE_SENSITIVE = "utf8mb4_bin"


def session(spark: SparkSession, sf_dir: str, collation: str = CASE_SENSITIVE) -> Session:
    s = Session(spark, collation_name=collation)
    for t in TABLES:
        s.attach(t, f"{sf_dir}/{t}.parquet")
    return s


@dataclass(frozen=True)
class Query:
    sql: str
    oracle: str = ""  # the same text if DuckDB reads it so
    collation: str = CASE_SENSITIVE

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return session(spark, sf_dir, self.collation).script(self.sql)[-1]


QUERIES: dict[str, Query] = {
    # the flagship: join, filter, group, order, page
    "flagship": Query(
        """SELECT c.c_mktsegment AS segment, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, ROUND(AVG(l.l_quantity), 6) AS avg_quantity
           FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
           WHERE o.o_orderdate >= '1995-01-01' AND l.l_quantity BETWEEN 5 AND 45
           GROUP BY segment HAVING n > 10 ORDER BY revenue DESC, segment LIMIT 5""",
    ),
    "pricing_summary": Query(
        """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
                  ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n
           FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""
    ),
    # predicates
    "filter_compare": Query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F' AND NOT o_orderpriority = '5-LOW'"),
    "filter_between": Query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.09"),
    "filter_in": Query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 49) OR p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size < 5"),
    "filter_not_in_null": Query("SELECT COUNT(*) AS n FROM part WHERE p_size NOT IN (1, 2, NULL)"),
    "filter_like": Query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_' AND p_type NOT LIKE 'S%'"),
    "filter_is_true": Query("SELECT COUNT(*) AS n, SUM(CASE WHEN (s_acctbal > 0) IS TRUE THEN 1 ELSE 0 END) AS t, SUM(CASE WHEN (NULLIF(s_nationkey, 3) > 5) IS NOT TRUE THEN 1 ELSE 0 END) AS f FROM supplier", "SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN (s_acctbal > 0) IS TRUE THEN 1 ELSE 0 END) AS BIGINT) AS t, CAST(SUM(CASE WHEN (NULLIF(s_nationkey, 3) > 5) IS NOT TRUE THEN 1 ELSE 0 END) AS BIGINT) AS f FROM supplier"),
    "filter_null_safe": Query("SELECT n_nationkey, NULLIF(n_regionkey, 1) <=> NULL AS was_null, NULLIF(n_regionkey, 1) <=> 2 AS is_two FROM nation", "SELECT n_nationkey, NULLIF(n_regionkey, 1) IS NOT DISTINCT FROM NULL AS was_null, NULLIF(n_regionkey, 1) IS NOT DISTINCT FROM 2 AS is_two FROM nation"),
    "filter_three_valued": Query("SELECT n_nationkey, (NULLIF(n_regionkey, 0) > 1) AND FALSE AS a, (NULLIF(n_regionkey, 0) > 1) OR TRUE AS o, NOT (NULLIF(n_regionkey, 0) > 1) AS x FROM nation"),
    "filter_truth": Query("SELECT n_nationkey FROM nation WHERE n_regionkey AND LEFT(n_name, n_nationkey % 2)", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0 AND length(left(n_name, n_nationkey % 2)) > 0"),
    "case_forms": Query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o_totalprice > 250000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' END AS size FROM orders"),
    "arithmetic": Query("SELECT p_partkey, p_size + 1 AS a, p_size - 3 AS b, p_size * 2 AS c, ROUND(p_size / 4, 6) AS d, p_size % 4 AS e, p_size / (p_size - p_size) AS z, p_size % 0 AS m FROM part", "SELECT p_partkey, p_size + 1 AS a, p_size - 3 AS b, p_size * 2 AS c, ROUND(p_size / 4, 6) AS d, p_size % 4 AS e, CAST(NULL AS DOUBLE) AS z, CAST(NULL AS INTEGER) AS m FROM part"),
    # scalar functions
    "fn_conditional": Query("SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS a, IFNULL(NULLIF(n_name, 'NATION_1'), 'none') AS b, IF(n_regionkey > 2, 'high', 'low') AS c, ISNULL(NULLIF(n_regionkey, 2)) AS d, GREATEST(n_regionkey, 2, n_nationkey) AS g, LEAST(NULLIF(n_regionkey, 1), 3) AS l FROM nation", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS a, COALESCE(NULLIF(n_name, 'NATION_1'), 'none') AS b, CASE WHEN n_regionkey > 2 THEN 'high' ELSE 'low' END AS c, NULLIF(n_regionkey, 2) IS NULL AS d, GREATEST(n_regionkey, 2, n_nationkey) AS g, CASE WHEN n_regionkey = 1 THEN NULL ELSE LEAST(n_regionkey, 3) END AS l FROM nation"),
    "fn_string": Query("SELECT c_custkey, CONCAT(c_name, '-', c_mktsegment) AS a, CONCAT_WS('/', c_name, NULLIF(c_mktsegment, 'BUILDING'), 'x') AS b, LOWER(c_name) AS c, UCASE(c_name) AS d, LENGTH(CONCAT(c_name, 'é')) AS e, CHAR_LENGTH(CONCAT(c_name, 'é')) AS f, REVERSE(c_name) AS g, REPLACE(c_name, 'Cust', 'X') AS h, LEFT(c_name, 4) AS i, RIGHT(c_name, 3) AS j FROM customer", "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, concat_ws('/', c_name, NULLIF(c_mktsegment, 'BUILDING'), 'x') AS b, lower(c_name) AS c, upper(c_name) AS d, CAST(strlen(c_name || 'é') AS BIGINT) AS e, length(c_name || 'é') AS f, reverse(c_name) AS g, replace(c_name, 'Cust', 'X') AS h, left(c_name, 4) AS i, right(c_name, 3) AS j FROM customer"),
    "fn_substring": Query("SELECT p_partkey, SUBSTRING(p_name, 2, 3) AS a, SUBSTR(p_name, -3) AS b, MID(p_name, 0, 2) AS c, SUBSTRING(p_name, 3) AS d, SUBSTRING(p_name, -99, 2) AS e FROM part", "SELECT p_partkey, substr(p_name, 2, 3) AS a, right(p_name, 3) AS b, '' AS c, substr(p_name, 3) AS d, left(p_name, 2) AS e FROM part"),
    "fn_trim_pad": Query("SELECT s_suppkey, TRIM(CONCAT('\\t ', s_name, ' \\n')) AS a, LTRIM(CONCAT('  ', s_name)) AS b, RTRIM(CONCAT(s_name, '  ')) AS c, LPAD(s_suppkey, 5, '0') AS d, RPAD(s_name, 3, '*') AS e, LPAD('ab', 5, '') AS f, REPEAT('xy', s_suppkey % 3) AS g, CONCAT('[', SPACE(2), ']') AS h FROM supplier", "SELECT s_suppkey, s_name AS a, s_name AS b, s_name AS c, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS d, left(s_name, 3) AS e, CAST(NULL AS VARCHAR) AS f, repeat('xy', s_suppkey % 3) AS g, '[  ]' AS h FROM supplier"),
    "fn_locate": Query("SELECT c_custkey, LOCATE('1', c_name) AS a, LOCATE('0', c_name, 12) AS b, INSTR(c_name, 'zz') AS c, ASCII(c_mktsegment) AS d, ASCII('é') AS e, ASCII('') AS f FROM customer", "SELECT c_custkey, instr(c_name, '1') AS a, CASE WHEN instr(substr(c_name, 12), '0') > 0 THEN instr(substr(c_name, 12), '0') + 11 ELSE 0 END AS b, instr(c_name, 'zz') AS c, CAST(ascii(c_mktsegment) AS BIGINT) AS d, CAST(195 AS BIGINT) AS e, CAST(0 AS BIGINT) AS f FROM customer"),
    "fn_math": Query("SELECT s_suppkey, ABS(s_acctbal) AS a, CEIL(s_acctbal) AS b, FLOOR(s_acctbal) AS c, ROUND(SQRT(ABS(s_acctbal)), 6) AS d, SQRT(-1 - ABS(s_acctbal)) AS e, SIGN(s_acctbal) AS f, ROUND(EXP(s_suppkey / 1000), 6) AS g, ROUND(PI(), 6) AS h, POW(s_suppkey, 2) AS i FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal) AS b, floor(s_acctbal) AS c, round(sqrt(abs(s_acctbal)), 6) AS d, CAST(NULL AS DOUBLE) AS e, CAST(sign(s_acctbal) AS BIGINT) AS f, round(exp(s_suppkey / 1000), 6) AS g, round(pi(), 6) AS h, pow(s_suppkey, 2) AS i FROM supplier"),
    "fn_logarithms": Query("SELECT p_partkey, ROUND(LN(p_size), 6) AS a, ROUND(LOG2(p_size), 6) AS b, ROUND(LOG10(p_size), 6) AS c, ROUND(LOG(p_size), 6) AS d, ROUND(LOG(3, p_size), 6) AS e, LOG(1, p_size) AS f, LN(p_size - p_size) AS g FROM part", "SELECT p_partkey, round(ln(p_size), 6) AS a, round(log2(p_size), 6) AS b, round(log10(p_size), 6) AS c, round(ln(p_size), 6) AS d, round(ln(p_size) / ln(3), 6) AS e, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS DOUBLE) AS g FROM part"),
    "fn_round_truncate": Query("SELECT o_orderkey, ROUND(o_totalprice, 1) AS a, ROUND(o_totalprice, -3) AS b, ROUND(o_totalprice) AS c, TRUNCATE(o_totalprice, 0) AS d, TRUNCATE(-o_totalprice, -2) AS e FROM orders", "SELECT o_orderkey, round(o_totalprice, 1) AS a, round(o_totalprice, -3) AS b, round(o_totalprice) AS c, trunc(o_totalprice) AS d, -floor(o_totalprice / 100) * 100 AS e FROM orders"),
    "fn_mod_zero": Query("SELECT p_partkey, MOD(p_size, 7) AS a, MOD(-p_size, 7) AS b, MOD(p_size, 0) AS c FROM part", "SELECT p_partkey, p_size % 7 AS a, (-p_size) % 7 AS b, CAST(NULL AS INTEGER) AS c FROM part"),
    "fn_date_parts": Query("SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, QUARTER(o_orderdate) AS q, HOUR(o_orderdate) AS h, MINUTE(o_orderdate) AS mi, SECOND(o_orderdate) AS s, DAYOFYEAR(o_orderdate) AS dy, DAYOFWEEK(o_orderdate) AS dw, WEEKDAY(o_orderdate) AS wd FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, dayofyear(o_orderdate) AS dy, dayofweek(o_orderdate) + 1 AS dw, isodow(o_orderdate) - 1 AS wd FROM orders"),
    "fn_date_arith": Query("SELECT o_orderkey, DATE(o_orderdate) AS a, DATE_ADD(o_orderdate, INTERVAL 3 DAY) AS b, o_orderdate - INTERVAL 2 HOUR AS c, DATE_SUB(o_orderdate, INTERVAL 1 MONTH) AS d, o_orderdate + INTERVAL 1 YEAR AS e, DATEDIFF('1998-01-01', o_orderdate) AS f, LAST_DAY(o_orderdate) AS g FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, o_orderdate + INTERVAL 3 DAY AS b, o_orderdate - INTERVAL 2 HOUR AS c, o_orderdate - INTERVAL 1 MONTH AS d, o_orderdate + INTERVAL 1 YEAR AS e, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS f, last_day(o_orderdate) AS g FROM orders"),
    "fn_date_format": Query("SELECT event_id, DATE_FORMAT(ts, '%Y-%m-%d %H:%i:%s') AS a, DATE_FORMAT(ts, '%W, %e %M %y') AS b, DATE_FORMAT(ts, 'day %j of %%') AS c, MONTHNAME(ts) AS d, DAYNAME(ts) AS e FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%A, ') || day(ts) || strftime(ts, ' %B %y') AS b, strftime(ts, 'day %j of %%') AS c, monthname(ts) AS d, dayname(ts) AS e FROM events"),
    "fn_json_extract": Query("SELECT event_id, JSON_EXTRACT(props, '$.k') AS k, JSON_TYPE(JSON_EXTRACT(props, '$.k')) AS t, JSON_VALID(props) AS v, JSON_LENGTH(props) AS n FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'INTEGER' WHEN 'BIGINT' THEN 'INTEGER' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(props, '$.k') END AS t, CAST(json_valid(props) AS BIGINT) AS v, CAST(len(json_keys(props)) AS BIGINT) AS n FROM events"),
    "fn_json_build": Query("SELECT n_nationkey, JSON_OBJECT('name', n_name, 'key', n_nationkey) AS o, JSON_ARRAY(n_nationkey, n_name, NULL, TRUE) AS a, JSON_SET('{\"a\": 1}', '$.b', n_regionkey, '$.a', 'x') AS s, JSON_REMOVE('[1, 2, 3]', '$[1]') AS r, JSON_KEYS('{\"z\": 1, \"b\": 2}') AS k, JSON_DEPTH('[[1]]') AS d, JSON_CONTAINS_PATH('{\"a\": {\"b\": 1}}', 'one', '$.x', '$.a.b') AS c FROM nation", "SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS o, '[' || n_nationkey || ',\"' || n_name || '\",null,true]' AS a, '{\"a\":\"x\",\"b\":' || n_regionkey || '}' AS s, '[1,3]' AS r, '[\"b\",\"z\"]' AS k, CAST(3 AS BIGINT) AS d, CAST(1 AS BIGINT) AS c FROM nation"),
    "fn_json_edit": Query("SELECT n_nationkey, JSON_INSERT('{\"a\": 1}', '$.a', 9, '$.c', n_name) AS i, JSON_REPLACE('{\"a\": 1}', '$.a', n_regionkey, '$.q', 1) AS r, JSON_QUOTE(n_name) AS q, JSON_UNQUOTE(JSON_EXTRACT(JSON_OBJECT('x', n_name), '$.x')) AS u FROM nation", "SELECT n_nationkey, '{\"a\":1,\"c\":\"' || n_name || '\"}' AS i, '{\"a\":' || n_regionkey || '}' AS r, '\"' || n_name || '\"' AS q, n_name AS u FROM nation"),
    # joins
    "join_inner": Query("SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "join_left_on_where": Query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 WHERE c.c_nationkey < 5"),
    "join_right": Query("SELECT o.o_orderkey, c.c_name FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'"),
    "join_cross": Query("SELECT r.r_name, n.n_nationkey FROM region r CROSS JOIN nation n"),
    "join_theta": Query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_chain": Query("SELECT r.r_name, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice), 2) AS total FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name"),
    "join_derived": Query("SELECT c.c_name, t.n, t.total FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey WHERE t.n > 3"),
    "join_full": Query("SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 0"),
    "join_using": Query("SELECT a.n_name, b.n_regionkey AS other FROM nation a JOIN nation b USING (n_nationkey)"),
    "semi_exists": Query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)"),
    "anti_not_exists": Query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"),
    "in_subquery": Query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)"),
    "not_in_subquery_null": Query("SELECT COUNT(*) AS n FROM nation WHERE n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 2) FROM region WHERE r_regionkey < 3)"),
    "row_in": Query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O')) AND l_quantity < 3"),
    # aggregation
    "agg_global": Query("SELECT COUNT(*) AS n, COUNT(NULLIF(p_size, 1)) AS k, SUM(p_size) AS s, ROUND(AVG(p_size), 6) AS a, MIN(p_name) AS lo, MAX(p_retailprice) AS hi FROM part", "SELECT COUNT(*) AS n, COUNT(NULLIF(p_size, 1)) AS k, CAST(SUM(p_size) AS BIGINT) AS s, ROUND(AVG(p_size), 6) AS a, MIN(p_name) AS lo, MAX(p_retailprice) AS hi FROM part"),
    "agg_empty": Query("SELECT COUNT(*) AS n, SUM(p_retailprice) AS s, AVG(p_retailprice) AS a, MIN(p_name) AS m FROM part WHERE p_size > 1000"),
    "agg_distinct": Query("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus"),
    "group_expression": Query("SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate)"),
    "group_alias": Query("SELECT p_size % 5 AS p_brand, COUNT(*) AS n FROM part GROUP BY p_brand", "SELECT p_size % 5 AS p_brand, COUNT(*) AS n FROM part GROUP BY p_size % 5"),
    "group_ordinal": Query("SELECT l_returnflag, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2"),
    "having_alias": Query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n >= 20"),
    "having_aggregate": Query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 2000000 AND MAX(o_totalprice) < 400000"),
    "agg_of_derived": Query("SELECT ROUND(AVG(n), 6) AS mean, MAX(n) AS most FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey) t"),
    "agg_expressions": Query("SELECT l_returnflag, ROUND(SUM(l_extendedprice * l_discount) / COUNT(*), 6) AS a, ROUND(SUM(l_extendedprice * l_tax), 2) AS b, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS c FROM lineitem GROUP BY l_returnflag"),
    "group_rollup": Query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "group_concat": Query("SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    # windows
    "win_row_number": Query("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders"),
    "win_rank": Query("SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part"),
    "win_partition_total": Query("SELECT s_suppkey, COUNT(*) OVER (PARTITION BY s_nationkey) AS n, ROUND(SUM(s_acctbal) OVER (PARTITION BY s_nationkey), 2) AS total, MIN(s_acctbal) OVER (PARTITION BY s_nationkey) AS lo, MAX(s_acctbal) OVER (PARTITION BY s_nationkey) AS hi FROM supplier"),
    "win_running": Query("SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS s, ROUND(AVG(p_size) OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS a FROM part", "SELECT p_partkey, CAST(SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s, ROUND(AVG(p_size) OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS a FROM part"),
    "win_star": Query("SELECT *, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation"),
    "win_distinct": Query("SELECT DISTINCT o_orderstatus, COUNT(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders"),
    "win_lag_frame": Query("SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders"),
    # order and page
    "order_mixed": Query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey LIMIT 20"),
    "order_expression": Query("SELECT s_suppkey FROM supplier ORDER BY ABS(s_acctbal) DESC, s_suppkey LIMIT 7"),
    "order_hidden": Query("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 9"),
    "order_nulls": Query("SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 3), n_nationkey DESC LIMIT 8", "SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 3) NULLS FIRST, n_nationkey DESC LIMIT 8"),
    "page_comma": Query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5"),
    "page_offset": Query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10 OFFSET 3"),
    "top_n": Query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15"),
    "distinct_rows": Query("SELECT DISTINCTROW l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    # set operations
    "union_all": Query("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer"),
    "union_distinct": Query("SELECT s_nationkey AS k FROM supplier UNION SELECT n_regionkey FROM nation"),
    "union_mixed": Query("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region"),
    "union_order_limit": Query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region ORDER BY k DESC, name LIMIT 6"),
    "union_derived": Query("SELECT COUNT(*) AS n FROM (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region) t"),
    "intersect_except": Query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region"),
    # CTEs and subqueries
    "cte_several": Query("WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey FROM a WHERE n > 10) SELECT COUNT(*) AS n FROM b"),
    "cte_columns": Query("WITH t (k, label) AS (SELECT r_regionkey, r_name FROM region) SELECT x.k, y.label FROM t x JOIN t y ON x.k = y.k"),
    "cte_shadow": Query("WITH nation AS (SELECT r_regionkey AS k FROM region) SELECT COUNT(*) AS n, MAX(k) AS m FROM nation"),
    "cte_recursive": Query("WITH RECURSIVE d AS (SELECT DATE('1995-01-28') AS day, 1 AS n UNION ALL SELECT DATE(DATE_ADD(day, INTERVAL 1 DAY)), n + 1 FROM d WHERE n < 9) SELECT d.day, COUNT(o.o_orderkey) AS orders FROM d LEFT JOIN orders o ON DATE(o.o_orderdate) = d.day GROUP BY d.day", "WITH RECURSIVE d AS (SELECT DATE '1995-01-28' AS day, 1 AS n UNION ALL SELECT CAST(day + INTERVAL 1 DAY AS DATE), n + 1 FROM d WHERE n < 9) SELECT d.day, COUNT(o.o_orderkey) AS orders FROM d LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = d.day GROUP BY d.day"),
    "cte_recursive_tree": Query("WITH RECURSIVE t AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM nation n JOIN t ON n.n_nationkey = t.k * 2 OR n.n_nationkey = t.k * 2 + 1) SELECT k, depth FROM t"),
    "scalar_subquery": Query("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) * 1.2 FROM part)"),
    "correlated_scalar": Query("SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c"),
    "correlated_compare": Query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_quantity > (SELECT 1.5 * AVG(x.l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)"),
    "correlated_two_levels": Query("SELECT r.r_regionkey FROM region r WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey % 5 = r.r_regionkey))"),
    "derived_nested": Query("SELECT t.k, COUNT(*) AS n FROM (SELECT u.s_nationkey % 5 AS k FROM (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) u) t GROUP BY t.k"),
    # collations: text is equal whatever its case
    "collation_equal": Query("SELECT n_nationkey FROM nation WHERE n_name = 'nation_7' OR n_name LIKE 'NATION__1%'", "SELECT n_nationkey FROM nation WHERE lower(n_name) = 'nation_7' OR n_name ILIKE 'NATION__1%'", "utf8mb4_general_ci"),
    "collation_group": Query("SELECT LOWER(k) AS k, n FROM (SELECT k, COUNT(*) AS n FROM (SELECT c_mktsegment AS k FROM customer UNION ALL SELECT LOWER(c_mktsegment) FROM customer) u GROUP BY k) t", "SELECT lower(c_mktsegment) AS k, 2 * COUNT(*) AS n FROM customer GROUP BY 1", "utf8mb4_general_ci"),
    "collation_join": Query("SELECT COUNT(*) AS n FROM nation a JOIN (SELECT LOWER(n_name) AS name FROM nation) b ON a.n_name = b.name", "SELECT COUNT(*) AS n FROM nation", "utf8mb4_general_ci"),
    # definitions and changes
    "view_nested": Query("CREATE VIEW a AS SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_nationkey > 3; CREATE VIEW b (region, n) AS SELECT r, COUNT(*) FROM a GROUP BY r; SELECT region, n FROM b", "SELECT n_regionkey AS region, COUNT(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1"),
    "create_as_select": Query("CREATE TABLE t AS SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey; SELECT k, n FROM t WHERE n > 5", "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 5"),
    "insert_select": Query("CREATE TABLE t (k INT PRIMARY KEY, name VARCHAR(30), x INT DEFAULT 5); INSERT INTO t (k, name) SELECT n_nationkey, n_name FROM nation UNION SELECT 100 + r_regionkey, r_name FROM region; SELECT * FROM t", "SELECT n_nationkey AS k, n_name AS name, 5 AS x FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, 5 FROM region"),
    "insert_ignore": Query("CREATE TABLE t (k INT PRIMARY KEY, src VARCHAR(10)); INSERT INTO t SELECT r_regionkey, 'region' FROM region; INSERT IGNORE INTO t SELECT n_nationkey, 'nation' FROM nation; SELECT * FROM t", "SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (SELECT r_regionkey FROM region) THEN 'region' ELSE 'nation' END AS src FROM nation"),
    "replace_into": Query("CREATE TABLE t (k INT PRIMARY KEY, src VARCHAR(10)); INSERT INTO t SELECT n_nationkey, 'old' FROM nation; REPLACE INTO t SELECT r_regionkey, 'new' FROM region; SELECT * FROM t", "SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (SELECT r_regionkey FROM region) THEN 'new' ELSE 'old' END AS src FROM nation"),
    "upsert": Query("CREATE TABLE t (k INT PRIMARY KEY, n INT); INSERT INTO t SELECT r_regionkey, 10 FROM region; INSERT INTO t SELECT n_nationkey, 1 FROM nation ON DUPLICATE KEY UPDATE n = n + VALUES(n); SELECT * FROM t", "SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (SELECT r_regionkey FROM region) THEN 11 ELSE 1 END AS n FROM nation"),
    "update_expression": Query("CREATE TABLE t AS SELECT c_custkey AS k, c_acctbal AS b, c_mktsegment AS s FROM customer; UPDATE t SET b = b + 1, s = CONCAT(s, '!') WHERE k % 3 = 0; SELECT k, ROUND(b, 2) AS b, s FROM t", "SELECT c_custkey AS k, ROUND(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS b, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '!' ELSE c_mktsegment END AS s FROM customer"),
    "update_join": Query("CREATE TABLE t AS SELECT n_nationkey AS k, n_regionkey AS r, 'none' AS label FROM nation; CREATE TABLE u AS SELECT r_regionkey AS r, r_name AS name FROM region WHERE r_regionkey < 3; UPDATE t JOIN u ON u.r = t.r SET t.label = u.name; SELECT k, label FROM t", "SELECT n_nationkey AS k, COALESCE(r_name, 'none') AS label FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3"),
    "delete_where": Query("CREATE TABLE t AS SELECT o_orderkey AS k, o_orderstatus AS s FROM orders; DELETE FROM t WHERE s IN ('F', 'P'); SELECT k, s FROM t", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus NOT IN ('F', 'P')"),
    "delete_several": Query("CREATE TABLE a AS SELECT n_nationkey AS k, n_regionkey AS r FROM nation; CREATE TABLE b AS SELECT r_regionkey AS r FROM region; DELETE a, b FROM a JOIN b ON a.r = b.r WHERE b.r > 2; SELECT k, 'a' AS t FROM a UNION ALL SELECT r, 'b' FROM b", "SELECT n_nationkey AS k, 'a' AS t FROM nation WHERE n_regionkey <= 2 UNION ALL SELECT r_regionkey, 'b' FROM region WHERE r_regionkey <= 2"),
    "fk_cascade": Query("CREATE TABLE p (k INT PRIMARY KEY); INSERT INTO p SELECT r_regionkey FROM region; CREATE TABLE c (k INT PRIMARY KEY, r INT, FOREIGN KEY (r) REFERENCES p (k) ON DELETE CASCADE); INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE k = 1; SELECT k, r FROM c", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey <> 1"),
    "fk_set_null": Query("CREATE TABLE p (k INT PRIMARY KEY); INSERT INTO p SELECT r_regionkey FROM region; CREATE TABLE c (k INT PRIMARY KEY, r INT, FOREIGN KEY (r) REFERENCES p (k) ON DELETE SET NULL); INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE k > 2; SELECT k, r FROM c", "SELECT n_nationkey AS k, CASE WHEN n_regionkey > 2 THEN NULL ELSE n_regionkey END AS r FROM nation"),
    "transaction_rollback": Query("CREATE TABLE t AS SELECT r_regionkey AS k FROM region; BEGIN; DELETE FROM t WHERE k = 0; SAVEPOINT s; DELETE FROM t; ROLLBACK TO s; COMMIT; SELECT k FROM t", "SELECT r_regionkey AS k FROM region WHERE r_regionkey <> 0"),
    "alter_table": Query("CREATE TABLE t AS SELECT n_nationkey AS k, n_name AS name FROM nation; ALTER TABLE t ADD COLUMN extra INT DEFAULT 3 AFTER k, RENAME COLUMN name TO label; SELECT k, extra, label FROM t", "SELECT n_nationkey AS k, 3 AS extra, n_name AS label FROM nation"),
    "insert_auto_increment": Query("CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, r INT, note VARCHAR(9) DEFAULT 'new', UNIQUE KEY u (r, note)); INSERT INTO t (r) VALUES (7), (NULL), (NULL); INSERT INTO t SET r = 9, note = DEFAULT; SELECT id, r, note FROM t", "SELECT * FROM (VALUES (1, 7, 'new'), (2, NULL, 'new'), (3, NULL, 'new'), (4, 9, 'new')) v(id, r, note)"),
    "decimal_exact": Query("CREATE TABLE m (id INT PRIMARY KEY, amount DECIMAL(20,2)); INSERT INTO m VALUES (1, 0.1), (2, 0.2), (3, 12345678901234567.89); SELECT SUM(amount) AS s, COUNT(*) AS n FROM m WHERE amount > 0.15", "SELECT CAST(12345678901234568.09 AS DECIMAL(30,2)) AS s, 2 AS n"),
    "json_column": Query("CREATE TABLE j (id BIGINT, body JSON); INSERT INTO j SELECT event_id, props FROM events; SELECT id, body->>'$.k' AS k FROM j", "SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events"),
    "truncate_rename": Query("CREATE TABLE a AS SELECT r_regionkey AS k FROM region; TRUNCATE TABLE a; RENAME TABLE a TO b; INSERT INTO b VALUES (5); SELECT k FROM b", "SELECT 5 AS k"),
    "locking_read": Query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1 FOR UPDATE", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1"),
    "update_limit": Query("CREATE TABLE t (k INT PRIMARY KEY, x INT); INSERT INTO t SELECT n_nationkey, 0 FROM nation; UPDATE t SET x = 1 ORDER BY k DESC LIMIT 4; SELECT k, x FROM t", "SELECT n_nationkey AS k, CASE WHEN n_nationkey > (SELECT MAX(n_nationkey) - 4 FROM nation) THEN 1 ELSE 0 END AS x FROM nation"),
    "fk_update_cascade": Query("CREATE TABLE p (k INT PRIMARY KEY); INSERT INTO p SELECT r_regionkey FROM region; CREATE TABLE c (k INT PRIMARY KEY, r INT, FOREIGN KEY (r) REFERENCES p (k) ON UPDATE CASCADE); INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; UPDATE p SET k = k + 100 WHERE k < 2; SELECT k, r FROM c", "SELECT n_nationkey AS k, CASE WHEN n_regionkey < 2 THEN n_regionkey + 100 ELSE n_regionkey END AS r FROM nation"),
    "upsert_second_key": Query("CREATE TABLE t (k INT PRIMARY KEY, e VARCHAR(30) UNIQUE, n INT); INSERT INTO t VALUES (1, 'a', 1); INSERT INTO t VALUES (10, 'x', 1), (11, 'x', 1), (1, 'y', 1), (12, 'a', 1), (13, NULL, 1), (14, NULL, 1) ON DUPLICATE KEY UPDATE n = n + VALUES(n); SELECT k, e, n FROM t", "SELECT * FROM (VALUES (1, 'a', 3), (10, 'x', 2), (13, NULL, 1), (14, NULL, 1)) v(k, e, n)"),
    "upsert_repeated": Query("CREATE TABLE t (k INT PRIMARY KEY, n INT); INSERT INTO t SELECT n_regionkey, 1 FROM nation ON DUPLICATE KEY UPDATE n = n + 1; SELECT k, n FROM t", "SELECT n_regionkey AS k, CAST(COUNT(*) AS INTEGER) AS n FROM nation GROUP BY 1"),
    "upsert_hot_key": Query("CREATE TABLE t (k INT PRIMARY KEY, n BIGINT, last VARCHAR(30), total DOUBLE); INSERT INTO t VALUES (3, 1000, 'old', 0), (-1, 7, 'left', 0); INSERT INTO t SELECT o_custkey % 4, 1, o_orderstatus, 0 FROM orders ORDER BY o_orderkey ON DUPLICATE KEY UPDATE n = n + VALUES(n), last = IF(n % 2 = 0, 'even', 'odd'); SELECT k, n, last FROM t", "SELECT k, n + o AS n, CASE WHEN (n + o) % 2 = 0 THEN 'even' ELSE 'odd' END AS last FROM (SELECT CAST(o_custkey % 4 AS INTEGER) AS k, COUNT(*) AS n, CASE WHEN o_custkey % 4 = 3 THEN 1000 ELSE 0 END AS o FROM orders GROUP BY o_custkey % 4) t UNION ALL SELECT -1, 7, 'left'"),
    "decimal_whole": Query("CREATE TABLE m (id INT PRIMARY KEY, x DECIMAL(20,2)); INSERT INTO m VALUES (1, 12345678901234567.89), (2, -1.15), (3, 1.15), (4, NULL), (5, -3); SELECT id, CAST(CEIL(x) AS CHAR) AS c, CAST(FLOOR(x) AS CHAR) AS f, CAST(TRUNCATE(x, 1) AS CHAR) AS t, CAST(TRUNCATE(x, 2) AS CHAR) AS u, CAST(ABS(x) AS CHAR) AS a FROM m", "SELECT * FROM (VALUES (1, '12345678901234568', '12345678901234567', '12345678901234567.8', '12345678901234567.89', '12345678901234567.89'), (2, '-1', '-2', '-1.1', '-1.15', '1.15'), (3, '2', '1', '1.1', '1.15', '1.15'), (4, NULL, NULL, NULL, NULL, NULL), (5, '-3', '-3', '-3.0', '-3.00', '3.00')) v(id, c, f, t, u, a)"),
    "unique_by_bytes": Query("CREATE TABLE u (a VARCHAR(9) UNIQUE); INSERT INTO u VALUES ('a'), ('A'); INSERT IGNORE INTO u VALUES ('a'), ('B'); SELECT a FROM u", "SELECT * FROM (VALUES ('a'), ('A'), ('B')) v(a)"),
    "unique_by_letters": Query("CREATE TABLE u (a VARCHAR(9) UNIQUE, n INT); INSERT INTO u VALUES ('a', 1); INSERT IGNORE INTO u VALUES ('A', 2), ('B', 3); SELECT n FROM u", "SELECT * FROM (VALUES (1), (3)) v(n)", "utf8mb4_general_ci"),
    "view_elsewhere": Query("CREATE TABLE t AS SELECT 1 AS a; CREATE VIEW w AS SELECT a FROM t; CREATE DATABASE o; USE o; CREATE TABLE t AS SELECT 99 AS a; SELECT a FROM quarry.w", "SELECT 1 AS a"),
    "json_by_table": Query("CREATE TABLE j (id INT, body JSON); CREATE TABLE v (id INT, body VARCHAR(20)); INSERT INTO j VALUES (1, '[1]'); INSERT INTO v VALUES (1, 'plain'); SELECT JSON_ARRAY(w.body) AS x, JSON_ARRAY(j.body) AS y FROM v AS w JOIN j ON w.id = j.id", "SELECT '[\"plain\"]' AS x, '[[1]]' AS y"),
    "update_one_file": Query("CREATE TABLE t (k INT PRIMARY KEY, x INT); INSERT INTO t SELECT n_nationkey, 0 FROM nation; INSERT INTO t SELECT 100 + r_regionkey, 0 FROM region; UPDATE t SET x = 1 WHERE k = 102; DELETE FROM t WHERE k = 103; SELECT k, x FROM t", "SELECT n_nationkey AS k, 0 AS x FROM nation UNION ALL SELECT 100 + r_regionkey, CASE WHEN r_regionkey = 2 THEN 1 ELSE 0 END FROM region WHERE r_regionkey <> 3"),
    "information_tables": Query("CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(9) DEFAULT 'x') COMMENT = 'c'; SELECT TABLE_NAME AS name, TABLE_TYPE AS kind, TABLE_COMMENT AS note FROM information_schema.tables WHERE TABLE_SCHEMA = 'quarry'", "SELECT 't' AS name, 'BASE TABLE' AS kind, 'c' AS note"),
    "no_table": Query("SELECT 1 + 1 AS two, 'a' AS a, NULL AS n", "SELECT 2 AS two, 'a' AS a, NULL AS n"),
    "comments_and_literals": Query("SELECT n_nationkey AS k, \"it's\" AS q -- tail\n FROM nation # more\n /* and more */ WHERE n_nationkey < 3", "SELECT n_nationkey AS k, 'it''s' AS q FROM nation WHERE n_nationkey < 3"),
    "agg_limit_zero": Query("SELECT COUNT(*) AS n FROM nation LIMIT 0", "SELECT COUNT(*) AS n FROM nation LIMIT 0"),
    "win_case_blind": Query("SELECT n, COUNT(*) OVER (PARTITION BY s) AS c FROM (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'A' END AS s FROM nation) t", "SELECT n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN (SELECT COUNT(*) FROM nation WHERE n_nationkey % 2 = 0) ELSE (SELECT COUNT(*) FROM nation WHERE n_nationkey % 2 = 1) END AS c FROM nation"),
    "point_get_const": Query("CREATE TABLE t (k INT PRIMARY KEY, name VARCHAR(30) UNIQUE, r INT, KEY by_r (r)); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation; SELECT name, r FROM t WHERE k = 7", "SELECT n_name AS name, n_regionkey AS r FROM nation WHERE n_nationkey = 7"),
    "point_get_unique": Query("CREATE TABLE t (k INT PRIMARY KEY, name VARCHAR(30) UNIQUE, r INT, KEY by_r (r)); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation; SELECT k, r FROM t WHERE name = 'NATION_7'", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_name = 'NATION_7'"),
    "index_ref": Query("CREATE TABLE t (k INT PRIMARY KEY, name VARCHAR(30) UNIQUE, r INT, KEY by_r (r)); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation; SELECT r, k FROM t WHERE r = 2 AND k > 5", "SELECT n_regionkey AS r, n_nationkey AS k FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5"),
    "index_order": Query("CREATE TABLE t (k INT PRIMARY KEY, name VARCHAR(30) UNIQUE, r INT, KEY by_r (r)); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation; SELECT k FROM t WHERE k BETWEEN 4 AND 19 ORDER BY k DESC LIMIT 5", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey BETWEEN 4 AND 19 ORDER BY 1 DESC LIMIT 5"),
    "select_in_parentheses": Query("(SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey DESC LIMIT 3) UNION ALL (SELECT r_regionkey FROM region)"),
    "operators_more": Query("SELECT p_partkey, (p_size > 10) XOR (p_size < 20) AS x, p_size DIV 7 AS d, p_size MOD 7 AS m, p_size & 12 AS a, p_name REGEXP '^P' AS r, CAST(p_size AS CHAR) AS c, p_size > 40 || p_size < 3 AS o FROM part", "SELECT p_partkey, (p_size > 10) <> (p_size < 20) AS x, CAST(p_size // 7 AS BIGINT) AS d, p_size % 7 AS m, p_size & 12 AS a, regexp_matches(p_name, '^P') AS r, CAST(p_size AS VARCHAR) AS c, p_size > 40 OR p_size < 3 AS o FROM part"),
    "now_precision": Query("SELECT NOW() <= NOW(6) AS a, SECOND(NOW(0)) BETWEEN 0 AND 59 AS b, DATE(NOW()) = CURDATE() AS c, DATEDIFF(CURRENT_DATE(), CURDATE()) AS d", "SELECT TRUE AS a, TRUE AS b, TRUE AS c, CAST(0 AS BIGINT) AS d"),
    "fn_date_letters": Query("SELECT event_id, DATE_FORMAT(ts, '%c %d %e %k %l %h %I %p') AS a, DATE_FORMAT(ts, '%S %s %f %T') AS b, DATE_FORMAT(ts, '%r') AS c, DATE_FORMAT(ts, '%a %b %w %j') AS d, DATE_FORMAT(ts, '%H%i') AS e FROM events", "SELECT event_id, month(ts) || strftime(ts, ' %d ') || day(ts) || ' ' || hour(ts) || ' ' || ((hour(ts) + 11) % 12 + 1) || strftime(ts, ' %I %I %p') AS a, strftime(ts, '%S %S %f %H:%M:%S') AS b, strftime(ts, '%I:%M:%S %p') AS c, strftime(ts, '%a %b %w %j') AS d, strftime(ts, '%H%M') AS e FROM events"),
    "json_paths": Query("SELECT JSON_EXTRACT('{\"a\": [1, {\"b\": 2}], \"c d\": 3}', '$.a[*]') AS a, JSON_EXTRACT('{\"a\": [1, {\"b\": 2}], \"c d\": 3}', '$.\"c d\"') AS b, JSON_EXTRACT('{\"x\": 1, \"b\": [2]}', '$.*') AS c, JSON_EXTRACT('[1, [2]]', '$[1][0]', '$[9]') AS d, JSON_CONTAINS_PATH('{\"a\": 1}', 'all', '$.a', '$.b') AS e", "SELECT '[1,{\"b\":2}]' AS a, '3' AS b, '[[2],1]' AS c, '[2]' AS d, CAST(0 AS BIGINT) AS e"),
    "json_read": Query("SELECT event_id, JSON_KEYS(props) AS keys, JSON_LENGTH(props, '$.k') AS n, JSON_DEPTH(props) AS d, JSON_UNQUOTE(JSON_EXTRACT(props, '$.k')) AS k, JSON_TYPE(props) AS t FROM events", "SELECT event_id, replace(CAST(to_json(list_sort(json_keys(props))) AS VARCHAR), ' ', '') AS keys, CASE WHEN json_exists(props, '$.k') THEN CAST(1 AS BIGINT) END AS n, CAST(2 AS BIGINT) AS d, json_extract_string(props, '$.k') AS k, 'OBJECT' AS t FROM events"),
    "subqueries_in_changes": Query("CREATE TABLE t (k INT PRIMARY KEY, x BIGINT); INSERT INTO t VALUES ((SELECT MAX(r_regionkey) FROM region), 1), (50, (SELECT COUNT(*) FROM nation)); INSERT INTO t SET k = (SELECT 60), x = 0; UPDATE t SET x = (SELECT COUNT(*) FROM region) WHERE k IN (SELECT r_regionkey FROM region); INSERT INTO t VALUES (60, 5) ON DUPLICATE KEY UPDATE x = VALUES(x) + (SELECT MAX(n_nationkey) FROM nation); SELECT k, x FROM t", "SELECT CAST((SELECT MAX(r_regionkey) FROM region) AS INTEGER) AS k, (SELECT COUNT(*) FROM region) AS x UNION ALL SELECT 50, (SELECT COUNT(*) FROM nation) UNION ALL SELECT 60, CAST(5 + (SELECT MAX(n_nationkey) FROM nation) AS BIGINT)"),
    "compact_and_collect": Query("CREATE TABLE t (k INT PRIMARY KEY); INSERT INTO t SELECT n_nationkey FROM nation; INSERT INTO t VALUES (100), (101); DELETE FROM t WHERE k IN (3, 100); COMPACT TABLE t; GC MVCC; SELECT k FROM t", "SELECT CAST(n_nationkey AS INTEGER) AS k FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 101"),
    "collect_in_transaction": Query("CREATE TABLE t (k INT); BEGIN; INSERT INTO t VALUES (1), (2); GC MVCC; COMMIT; GC MVCC; SELECT k FROM t", "SELECT * FROM (VALUES (1), (2)) v(k)"),
    "databases": Query("CREATE DATABASE o; CREATE TABLE o.t (a INT); CREATE DATABASE p; DROP DATABASE p; DROP DATABASE IF EXISTS q; SHOW DATABASES", "SELECT * FROM (VALUES ('information_schema'), ('o'), ('quarry')) v(\"Database\")"),
    "index_definitions": Query("CREATE TABLE t (a INT, b INT, c INT); CREATE UNIQUE INDEX u ON t (a, b); CREATE INDEX i ON t (b); CREATE INDEX j ON t (c); DROP INDEX i ON t; SELECT INDEX_NAME AS name, COLUMN_NAME AS col, SEQ_IN_INDEX AS place, NON_UNIQUE AS many FROM information_schema.statistics WHERE TABLE_SCHEMA = 'quarry'", "SELECT * FROM (VALUES ('u', 'a', 1, 0), ('u', 'b', 2, 0), ('j', 'c', 1, 1)) v(name, col, place, many)"),
    "drop_tables": Query("CREATE TABLE a (x INT); CREATE TABLE b (x INT); CREATE TABLE c (x INT); DROP TABLE a, b; DROP TABLE IF EXISTS z; SHOW TABLES", "SELECT 'c' AS Tables_in_quarry"),
    "create_like": Query("CREATE TABLE t (a INT PRIMARY KEY AUTO_INCREMENT, b INT DEFAULT 4); INSERT INTO t (b) VALUES (1); CREATE TABLE u LIKE t; INSERT INTO u (a) VALUES (NULL), (NULL); SELECT a, b FROM u", "SELECT * FROM (VALUES (1, 4), (2, 4)) v(a, b)"),
    "auto_increment_many": Query("CREATE TABLE t (id BIGINT PRIMARY KEY AUTO_INCREMENT, k BIGINT); INSERT INTO t (k) SELECT o_orderkey FROM orders; SELECT MIN(id) AS lo, MAX(id) AS hi, COUNT(DISTINCT id) AS n, COUNT(DISTINCT k) AS k FROM t", "SELECT CAST(1 AS BIGINT) AS lo, COUNT(*) AS hi, COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS k FROM orders"),
    "isolation_level": Query("SET SESSION TRANSACTION ISOLATION LEVEL READ COMMITTED; SELECT @@transaction_isolation AS level", "SELECT 'READ-COMMITTED' AS level"),
    "session_settings": Query("SET NAMES utf8mb4 COLLATE utf8mb4_bin; SET foreign_key_checks = 0; SELECT @@collation_connection AS c, @@foreign_key_checks AS f, DATABASE() AS d", "SELECT 'utf8mb4_bin' AS c, 0 AS f, 'quarry' AS d"),
    "show_variables": Query("SHOW VARIABLES LIKE 'tx_iso%'", "SELECT 'tx_isolation' AS Variable_name, 'REPEATABLE-READ' AS Value"),
    "show_collation": Query("SHOW COLLATION LIKE 'latin1%'", "SELECT * FROM (VALUES ('latin1_swedish_ci', 'latin1'), ('latin1_general_ci', 'latin1'), ('latin1_bin', 'latin1')) v(\"Collation\", Charset)"),
    "show_character_sets": Query("SHOW CHARACTER SET WHERE Charset = 'ascii'", "SELECT 'ascii' AS Charset, 'ascii_general_ci' AS \"Default collation\""),
    "show_engines": Query("SHOW ENGINES", "SELECT 'Quarry' AS Engine, 'DEFAULT' AS Support, 'versioned Parquet tables' AS Comment, 'YES' AS Transactions"),
    "show_columns": Query("CREATE TABLE t (a INT PRIMARY KEY AUTO_INCREMENT, b VARCHAR(9) NOT NULL DEFAULT 'x', c DECIMAL(8,2) UNIQUE, d INT COMMENT 'note', KEY (d)); SHOW FULL COLUMNS FROM t", "SELECT * FROM (VALUES ('a', 'int', 'NO', 'PRI', NULL, 'auto_increment', ''), ('b', 'varchar(9)', 'NO', '', '''x''', '', ''), ('c', 'decimal(8,2)', 'YES', 'UNI', NULL, '', ''), ('d', 'int', 'YES', 'MUL', NULL, '', 'note')) v(Field, Type, \"Null\", \"Key\", \"Default\", Extra, Comment)"),
    "show_index": Query("CREATE TABLE t (a INT PRIMARY KEY, b INT, UNIQUE KEY u (b, a)); SHOW INDEX FROM t", "SELECT * FROM (VALUES ('t', 0, 'PRIMARY', 1, 'a', 'A', 'BTREE', ''), ('t', 0, 'u', 1, 'b', 'A', 'BTREE', ''), ('t', 0, 'u', 2, 'a', 'A', 'BTREE', '')) v(\"Table\", Non_unique, Key_name, Seq_in_index, Column_name, \"Collation\", Index_type, Index_comment)"),
    "show_create": Query("CREATE TABLE t (a INT PRIMARY KEY, b INT DEFAULT 2, CHECK (b > 0)); SHOW CREATE TABLE t", "SELECT 't' AS \"Table\", 'CREATE TABLE `t` (' || chr(10) || '  `a` int NOT NULL,' || chr(10) || '  `b` int DEFAULT 2,' || chr(10) || '  PRIMARY KEY (`a`),' || chr(10) || '  CONSTRAINT `check_1` CHECK (b > 0)' || chr(10) || ')' AS \"Create Table\""),
    "information_schemata": Query("CREATE DATABASE o; SELECT SCHEMA_NAME AS name FROM information_schema.schemata", "SELECT * FROM (VALUES ('o'), ('quarry')) v(name)"),
    "information_rows": Query("CREATE TABLE t AS SELECT n_nationkey AS k FROM nation; INSERT INTO t VALUES (100), (101); DELETE FROM t WHERE k < 3; UPDATE t SET k = k + 1; SELECT TABLE_ROWS AS n, DATA_LENGTH > 0 AS stored FROM information_schema.tables WHERE TABLE_NAME = 't'", "SELECT COUNT(*) - 1 AS n, TRUE AS stored FROM nation"),
    "information_constraints": Query("CREATE TABLE p (k INT PRIMARY KEY); CREATE TABLE c (k INT UNIQUE, p INT, CONSTRAINT f FOREIGN KEY (p) REFERENCES p (k) ON DELETE CASCADE, CONSTRAINT s CHECK (k > 0)); SELECT CONSTRAINT_NAME AS name, TABLE_NAME AS t, CONSTRAINT_TYPE AS kind FROM information_schema.table_constraints", "SELECT * FROM (VALUES ('PRIMARY', 'p', 'PRIMARY KEY'), ('k', 'c', 'UNIQUE'), ('f', 'c', 'FOREIGN KEY'), ('s', 'c', 'CHECK')) v(name, t, kind)"),
    "information_references": Query("CREATE TABLE p (k INT PRIMARY KEY); CREATE TABLE c (p INT, CONSTRAINT f FOREIGN KEY (p) REFERENCES p (k) ON DELETE CASCADE); SELECT r.DELETE_RULE AS d, r.UPDATE_RULE AS u, k.COLUMN_NAME AS own, k.REFERENCED_TABLE_NAME AS parent, k.REFERENCED_COLUMN_NAME AS theirs FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON k.CONSTRAINT_NAME = r.CONSTRAINT_NAME", "SELECT 'CASCADE' AS d, 'RESTRICT' AS u, 'p' AS own, 'p' AS parent, 'k' AS theirs"),
    "information_views": Query("CREATE VIEW v AS SELECT n_name FROM nation; SELECT v.TABLE_NAME AS name, v.IS_UPDATABLE AS u, t.TABLE_TYPE AS kind FROM information_schema.views v JOIN information_schema.tables t ON t.TABLE_NAME = v.TABLE_NAME", "SELECT 'v' AS name, 'NO' AS u, 'VIEW' AS kind"),
    "information_checks": Query("CREATE TABLE t (a INT, CONSTRAINT c CHECK (a > 1)); SELECT CONSTRAINT_NAME AS name, CHECK_CLAUSE AS clause FROM information_schema.check_constraints", "SELECT 'c' AS name, 'a > 1' AS clause"),
    "information_sets": Query("SELECT (SELECT COUNT(*) FROM information_schema.collations) AS c, (SELECT COUNT(*) FROM information_schema.character_sets) AS s, (SELECT ENGINE FROM information_schema.engines) AS e", "SELECT CAST(13 AS BIGINT) AS c, CAST(5 AS BIGINT) AS s, 'Quarry' AS e"),
    "information_empty": Query("SELECT COUNT(*) AS n FROM information_schema.routines UNION ALL SELECT COUNT(*) AS n FROM information_schema.parameters UNION ALL SELECT COUNT(*) AS n FROM information_schema.triggers UNION ALL SELECT COUNT(*) AS n FROM information_schema.events UNION ALL SELECT COUNT(*) AS n FROM information_schema.partitions UNION ALL SELECT COUNT(*) AS n FROM information_schema.files UNION ALL SELECT COUNT(*) AS n FROM information_schema.tablespaces UNION ALL SELECT COUNT(*) AS n FROM information_schema.user_privileges UNION ALL SELECT COUNT(*) AS n FROM information_schema.schema_privileges UNION ALL SELECT COUNT(*) AS n FROM information_schema.table_privileges", "SELECT CAST(0 AS BIGINT) AS n FROM range(10)"),
    "ci_range": Query("SELECT n_nationkey AS k FROM nation WHERE n_name BETWEEN 'nation_1' AND 'Nation_2'", "SELECT n_nationkey AS k FROM nation WHERE lower(n_name) BETWEEN 'nation_1' AND 'nation_2'", "utf8mb4_general_ci"),
    "ci_in": Query("SELECT c_mktsegment IN ('building', 'Machinery') AS hit, COUNT(*) AS n FROM customer GROUP BY 1", "SELECT lower(c_mktsegment) IN ('building', 'machinery') AS hit, COUNT(*) AS n FROM customer GROUP BY 1", "utf8mb4_general_ci"),
    "ci_distinct": Query("SELECT COUNT(DISTINCT k) AS n FROM (SELECT c_mktsegment AS k FROM customer UNION ALL SELECT LOWER(c_mktsegment) FROM customer) t", "SELECT COUNT(DISTINCT c_mktsegment) AS n FROM customer", "utf8mb4_general_ci"),
    "ci_order": Query("SELECT k FROM (SELECT n_nationkey AS k, IF(n_nationkey % 2 = 0, n_name, LOWER(n_name)) AS name FROM nation) t ORDER BY name, k LIMIT 6", "SELECT n_nationkey AS k FROM nation ORDER BY lower(n_name), 1 LIMIT 6", "utf8mb4_general_ci"),
    "ci_pricing": Query("SELECT LOWER(l_returnflag) AS f, LOWER(l_linestatus) AS s, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'a' GROUP BY l_returnflag, l_linestatus", "SELECT lower(l_returnflag) AS f, lower(l_linestatus) AS s, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE lower(l_returnflag) <> 'a' GROUP BY 1, 2", "utf8mb4_general_ci"),
    "ci_case": Query("SELECT c_custkey, CASE c_mktsegment WHEN 'building' THEN 1 WHEN 'Machinery' THEN 2 ELSE 3 END AS k, NULLIF(c_mktsegment, 'building') IS NULL AS b, LOCATE('u', c_mktsegment) AS l FROM customer", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS k, c_mktsegment = 'BUILDING' AS b, instr(c_mktsegment, 'u') AS l FROM customer", "utf8mb4_general_ci"),
    "ci_window": Query("SELECT k, RANK() OVER (PARTITION BY s ORDER BY k) AS r FROM (SELECT c_custkey AS k, IF(c_custkey % 2 = 0, c_mktsegment, LOWER(c_mktsegment)) AS s FROM customer) t", "SELECT c_custkey AS k, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer", "utf8mb4_general_ci"),
    "ci_update": Query("CREATE TABLE t (k INT PRIMARY KEY, s VARCHAR(30)); INSERT INTO t SELECT c_custkey, c_mktsegment FROM customer; UPDATE t SET k = -k WHERE s = 'building'; DELETE FROM t WHERE s IN ('MACHINERY', 'household'); SELECT k FROM t", "SELECT CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN -c_custkey ELSE c_custkey END AS INTEGER) AS k FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD')", "utf8mb4_general_ci"),
    "show_tables": Query("CREATE TABLE one (a INT); CREATE VIEW two AS SELECT a FROM one; SHOW FULL TABLES", "SELECT 'one' AS Tables_in_quarry, 'BASE TABLE' AS Table_type UNION ALL SELECT 'two', 'VIEW'"),
    "information_columns": Query("CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(9)); SELECT COLUMN_NAME AS name, DATA_TYPE AS kind, COLUMN_KEY AS mark FROM information_schema.columns WHERE TABLE_NAME = 't'", "SELECT 'a' AS name, 'int' AS kind, 'PRI' AS mark UNION ALL SELECT 'b', 'varchar', ''"),
}



def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: r.scan(spark, f"{sf_dir}/{t}.parquet") for t in TABLES}


def api_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames(spark, sf_dir)
    rows = r.join(r.keep(t["orders"], "o_totalprice > 1000"), t["customer"], "o_custkey = c_custkey")
    return r.top(r.aggregate(rows, ["c_mktsegment"], n="count(1)", total="round(sum(o_totalprice), 2)"), 3, "total DESC", "c_mktsegment")


def api_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)["customer"]
    spelled = r.project(rows, k="c_custkey", segment="CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END")
    return r.distinct_first(spelled, ["segment"], "k")


def api_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.first_match(r.project(frames(spark, sf_dir)["orders"], customer="o_custkey", key="o_orderkey", price="o_totalprice"), ["customer"], "key")


def api_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames(spark, sf_dir)
    counts = [r.aggregate(r.join(t["customer"], t["orders"], "o_custkey = c_custkey AND o_totalprice > 200000", how), [], how=f"'{how}'", n="count(1)") for how in ("inner", "left", "right", "full", "left_semi", "left_anti")]
    return r.union(*counts, r.aggregate(r.join(t["region"], t["nation"], "", "cross"), [], how="'cross'", n="count(1)"))


def api_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.windowed(frames(spark, sf_dir)["part"], ["p_brand"], ["p_size DESC", "p_partkey"], place="row_number()", running="sum(p_size)")
    return r.page(r.ordered(found.select("p_partkey", "place", "running"), "p_partkey"), 50, 10)


def api_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the program's own, written once, and read twice."""
    marks = r.source(spark, [(0, "low"), (2, "middle"), (4, "high")], "k long, mark string")
    kept = r.materialize(r.join(frames(spark, sf_dir)["nation"], marks, "n_regionkey = k"), f"{scratch(spark)}/marks")
    return r.union(r.aggregate(kept, ["mark"], n="count(1)"), r.aggregate(kept, ["'all'"], n="count(1)"), distinct=True)


def filled(spark: SparkSession, sf_dir: str) -> Session:
    s = session(spark, sf_dir)
    s.script("CREATE TABLE t (k INT PRIMARY KEY, name VARCHAR(30) UNIQUE, r INT, KEY by_r (r)); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return s


def explain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = filled(spark, sf_dir)
    plans = [s.sql(f"EXPLAIN SELECT * FROM t WHERE {w}") for w in ("k = 7", "name = 'NATION_3'", "k > 20", "r = 1", "r + k = 3")]
    return r.union(*(p.select("table", "type", "key", "rows") for p in plans))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("SELECT n_nationkey, ? AS mark FROM nation WHERE n_regionkey = ? AND n_name <> ? LIMIT ?", ["it's", 1, "NATION_1", 100])


def dump_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = filled(spark, sf_dir)
    s.sql(f"EXPORT DATABASE quarry TO '{s.store.root}/dump'")
    dump = [row["value"] for part in ("definitions", "data/t") for row in spark.read.text(f"{s.store.root}/dump/{part}").collect()]
    other = Session(spark, collation_name=CASE_SENSITIVE)
    other.restore("\n".join(dump))
    return other.sql("SELECT k, name, r FROM t")


def backup_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = filled(spark, sf_dir)
    s.sql(f"BACKUP MVCC TO '{s.store.root}/backup'")
    s.script("DELETE FROM t WHERE k > 3; CREATE TABLE more (a INT)")
    s.sql(f"RESTORE MVCC FROM '{s.store.root}/backup'")
    s.sql("INSERT INTO t VALUES (100, 'new', 1)")
    return s.sql("SELECT k, name, r FROM t")


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What constraints refuse, by error number; a statement that fails changes nothing."""
    s = filled(spark, sf_dir)
    s.script("CREATE TABLE c (k INT PRIMARY KEY, kind ENUM('a', 'b'), body JSON, r INT NOT NULL, short VARCHAR(3), FOREIGN KEY (r) REFERENCES t (k), CHECK (k < 100)); INSERT INTO c VALUES (1, 'a', '{}', 1, 'abc')")
    tried = [
        "INSERT INTO t VALUES (200, 'fresh', 1), (7, 'other', 1)", "INSERT INTO c VALUES (2, 'z', '{}', 1, 'x')", "INSERT INTO c VALUES (2, 'a', '{', 1, 'x')", "INSERT INTO c VALUES (2, 'a', '{}', NULL, 'x')",
        "INSERT INTO c VALUES (2, 'a', '{}', 1, 'long')", "INSERT INTO c VALUES (2, 'a', '{}', 999, 'x')", "INSERT INTO c VALUES (200, 'a', '{}', 1, 'x')", "DELETE FROM t WHERE k < 3", "UPDATE t SET k = 5", "DROP TABLE t",
    ]
    told = []
    for n, text in enumerate(tried):
        try:
            s.sql(text)
        except SqlError as e:
            told.append((n, str(e)[:6]))
    left = s.sql("SELECT (SELECT COUNT(*) FROM t) AS t, (SELECT COUNT(*) FROM c) AS c").first()
    return r.source(spark, [*told, (98, str(left["t"])), (99, str(left["c"]))], "n int, told string")


_KINDS = "SELECT '{}' AS how, COUNT(*) AS n FROM customer {} JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000"
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "api_pipeline": (api_pipeline, "SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY total DESC, 1 LIMIT 3"),
    "api_distinct_first": (api_distinct_first, "SELECT MIN(c_custkey) AS k, arg_min(CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END, c_custkey) AS segment FROM customer GROUP BY lower(c_mktsegment)"),
    "api_first_match": (api_first_match, "SELECT o_custkey AS customer, MIN(o_orderkey) AS key, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1"),
    "api_joins": (api_joins, " UNION ALL ".join(_KINDS.format(a, b) for a, b in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("left_semi", "SEMI"), ("left_anti", "ANTI"))) + " UNION ALL SELECT 'cross', COUNT(*) FROM region, nation"),
    "api_materialize": (api_materialize, "WITH m AS (SELECT CASE n_regionkey WHEN 0 THEN 'low' WHEN 2 THEN 'middle' ELSE 'high' END AS mark FROM nation WHERE n_regionkey IN (0, 2, 4)) SELECT mark, COUNT(*) AS n FROM m GROUP BY 1 UNION SELECT 'all', COUNT(*) FROM m"),
    "explain_keys": (explain_keys, "SELECT v.*, CAST(25 AS BIGINT) AS rows FROM (VALUES ('t', 'const', 'PRIMARY'), ('t', 'const', 'name'), ('t', 'range', 'PRIMARY'), ('t', 'ref', 'by_r'), ('t', 'ALL', NULL)) v(\"table\", type, key)"),
    "prepared": (prepared, "SELECT n_nationkey, 'it''s' AS mark FROM nation WHERE n_regionkey = 1 AND n_name <> 'NATION_1' LIMIT 100"),
    "dump_and_restore": (dump_and_restore, "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation"),
    "backup_and_restore": (backup_and_restore, "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation UNION ALL SELECT 100, 'new', 1"),
    "refused": (refused, "SELECT * FROM (VALUES (0, '(1062)'), (1, '(1265)'), (2, '(3140)'), (3, '(1048)'), (4, '(1406)'), (5, '(1452)'), (6, '(3819)'), (7, '(1451)'), (8, '(1062)'), (9, '(3730)'), (98, '25'), (99, '1')) v(n, told)"),
    "api_windows": (api_windows, "SELECT p_partkey, row_number() OVER w AS place, CAST(SUM(p_size) OVER w AS BIGINT) AS running FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) ORDER BY p_partkey LIMIT 50 OFFSET 10"),
}

#: Event-time operations, beyond what the dialect has.
WINDOWS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "events_tumbling": (windows.tumbling, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2"),
    "events_sessions": (
        windows.sessions,
        """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
                s AS (SELECT user_id, ts, SUM(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
           SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM s GROUP BY user_id, k""",
    ),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **{k: q for k, (q, _) in {**FRAMES, **WINDOWS}.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: q.oracle or q.sql for k, q in QUERIES.items()}, **{k: sql for k, (_, sql) in {**FRAMES, **WINDOWS}.items()}}
