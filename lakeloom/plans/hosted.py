"""Relational queries over lake tables. Each is SQL that Spark and the check's engine read alike, or a pair of texts."""

from __future__ import annotations

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

#: name: SQL, or (Spark's SQL, the check's SQL).
QUERIES: dict[str, str | tuple[str, str]] = {
    # Shapes of the decision-support benchmark, over the columns that are there.
    "tpch_q1": """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
 round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q3": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q4": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'
 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""",
    "tpch_q5": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey AND r_name = 'ASIA' GROUP BY n_name""",
    "tpch_q6": """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""",
    "tpch_q7": """SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
 JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_nationkey < 3 AND n2.n_nationkey < 3 GROUP BY 1, 2, 3""",
    "tpch_q10": """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
 WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q12": """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'N') GROUP BY l_linestatus""",
    "tpch_q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%LOW%' GROUP BY c_custkey) AS x GROUP BY c_count""",
    "tpch_q14": """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "tpch_q15": """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY l_suppkey)
 SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total = (SELECT max(total) FROM revenue)""",
    "tpch_q17": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """SELECT c_name, c_custkey, o_orderkey, o_totalprice, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
 WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice""",
    "tpch_q19": """SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 10 AND 20 AND l_quantity BETWEEN 10 AND 20)""",
    "tpch_q22": """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey""",
    "tpch_q8": """SELECT year(o_orderdate) AS o_year, round(sum(CASE WHEN n2.n_regionkey = 2 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM part JOIN lineitem ON p_partkey = l_partkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
 WHERE r_name = 'AMERICA' AND p_size < 30 GROUP BY 1""",
    "tpch_q21": """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R'
 AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    # Shapes of the click-log benchmark, over events.
    "clicks_count": "SELECT count(*) AS n, CAST(sum(value) AS DECIMAL(20, 2)) AS s, round(avg(user_id), 6) AS mean FROM events WHERE event_type <> 'view'",
    "clicks_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type",
    "clicks_top_users": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "clicks_user_type": "SELECT user_id, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY user_id, event_type HAVING count(*) > 2 ORDER BY n DESC, user_id, event_type LIMIT 50",
    "clicks_like": "SELECT event_type, count(*) AS n, min(props) AS low FROM events WHERE props LIKE '%7%' AND props NOT LIKE '%3%' AND event_type <> '' GROUP BY event_type",
    "clicks_by_minute": "SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' GROUP BY date_trunc('minute', ts)",
    "clicks_lookup": "SELECT event_id, ts, value FROM events WHERE user_id = 46 ORDER BY ts, event_id LIMIT 10 OFFSET 3",
    "clicks_wide_sums": "SELECT " + ", ".join(f"CAST(sum(user_id + {k}) AS BIGINT) AS s{k}" for k in range(20)) + " FROM events",
    "clicks_buckets": "SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'middle' ELSE 'high' END AS size, length(props) AS width, count(*) AS n FROM events GROUP BY 1, 2",
    # Operators one by one.
    "distinct_on": ("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) AS x WHERE nth = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    "join_range": "SELECT a.s_suppkey AS a_key, b.c_custkey AS b_key FROM supplier a JOIN customer b ON b.c_acctbal BETWEEN a.s_acctbal - 1 AND a.s_acctbal + 1",
    "filter_predicates": """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS kind FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 AND l_returnflag IN ('A', 'R') AND NOT (l_discount < 0.02 OR l_tax = 0.0) AND l_linestatus IS NOT NULL AND l_orderkey <> 7""",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%OM%' AND p_name NOT LIKE 'b%'",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_full": "SELECT a.n_nationkey AS a_key, b.s_suppkey AS b_key FROM nation a FULL OUTER JOIN supplier b ON a.n_nationkey = b.s_nationkey AND b.s_acctbal > 0",
    "join_natural": ("SELECT n_name, n_regionkey FROM (SELECT n_name, n_regionkey FROM nation) AS a NATURAL JOIN (SELECT r_regionkey AS n_regionkey FROM region WHERE r_regionkey < 3) AS b",) * 2,
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 4",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "cte_shadow": "WITH orders AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers, 'from orders, today' AS made FROM orders GROUP BY n",
    "join_in": "SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_lateral": "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS t",
    "aggregate": "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, bool_and(o_totalprice > 0) AS pos, bool_or(o_totalprice > 400000) AS big FROM orders GROUP BY o_orderstatus",
    "aggregate_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) > 10",
    "aggregate_lists": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey"),
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "window_functions": """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following,
 count(*) OVER (PARTITION BY o_custkey) AS of_customer, round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 3) AS mean FROM orders""",
    "sort_limit": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 25 OFFSET 5",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "cte": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT avg(s) AS m FROM a) SELECT o_custkey FROM a, b WHERE s > 2 * m",
    "string_functions": ("""SELECT c_custkey, concat(c_name, '-', c_mktsegment) AS a, substr(c_name, 3, 4) AS b, length(c_name) AS c, replace(c_name, '0', 'o') AS d, contains(c_name, '12') AS e, endswith(c_name, '7') AS f, split(c_name, '#')[0] AS g,
 regexp_extract(c_name, '([0-9]+)', 1) AS h, regexp_replace(c_name, '[0-9]', 'x') AS i, md5(c_name) AS j, rpad(c_mktsegment, 12, '.') AS k, repeat('ab', 3) AS l, octet_length(c_name) AS m FROM customer""",
 """SELECT c_custkey, concat(c_name, '-', c_mktsegment) AS a, substr(c_name, 3, 4) AS b, length(c_name)::INT AS c, replace(c_name, '0', 'o') AS d, contains(c_name, '12') AS e, ends_with(c_name, '7') AS f, string_split(c_name, '#')[1] AS g,
 regexp_extract(c_name, '([0-9]+)', 1) AS h, regexp_replace(c_name, '[0-9]', 'x', 'g') AS i, md5(c_name) AS j, rpad(c_mktsegment, 12, '.') AS k, repeat('ab', 3) AS l, strlen(c_name)::INT AS m FROM customer"""),
    "date_functions": ("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, extract(QUARTER FROM o_orderdate) AS q, date_trunc('month', o_orderdate) AS t, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS n, make_date(year(o_orderdate), 1, 1) AS f, o_orderdate + INTERVAL '3' DAY AS later FROM orders""",
 """SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, extract(QUARTER FROM o_orderdate)::INT AS q, date_trunc('month', o_orderdate) AS t, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS n, make_date(year(o_orderdate), 1, 1) AS f, o_orderdate + INTERVAL 3 DAY AS later FROM orders"""),
    "math_functions": ("SELECT p_partkey, power(p_size, 2) AS a, round(p_retailprice / 3, 4) AS b, p_size % 7 AS c, p_partkey div 3 AS d, abs(p_size - 20) AS e, round(pi(), 6) AS f, p_size & 6 AS g FROM part",
 "SELECT p_partkey, power(p_size, 2) AS a, round(p_retailprice / 3, 4) AS b, p_size % 7 AS c, p_partkey // 3 AS d, abs(p_size - 20) AS e, round(pi(), 6) AS f, p_size & 6 AS g FROM part"),
    "list_functions": ("SELECT n_nationkey, array_contains(array(1, 2, n_regionkey), 3) AS a, array_join(flatten(array(array('x'), array(n_name))), '+') AS b, size(array(1, 2, 3)) AS c, named_struct('k', n_nationkey).k AS d, element_at(map('a', n_regionkey), 'a') AS e FROM nation",
 "SELECT n_nationkey, list_contains([1, 2, n_regionkey], 3) AS a, array_to_string(flatten([['x'], [n_name]]), '+') AS b, len([1, 2, 3])::INT AS c, struct_pack(k := n_nationkey).k AS d, MAP {'a': n_regionkey}['a'] AS e FROM nation"),
    "json_functions": ("SELECT event_id, get_json_object(props, '$.k') AS k, props IS NULL AS none FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NULL AS none FROM events"),
    "unnest": ("SELECT r_regionkey, explode(sequence(1, r_regionkey + 1)) AS i FROM region", "SELECT r_regionkey, unnest(range(1, r_regionkey + 2))::INT AS i FROM region"),
    "range_source": ("SELECT id AS i FROM range(100) WHERE id % 7 = 0", "SELECT range AS i FROM range(100) WHERE range % 7 = 0"),
    "events_by_hour": ("SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY event_type, date_trunc('hour', ts)",) * 2,
}
