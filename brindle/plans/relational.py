"""Filters, projections, predicates, subqueries and whole queries."""

from pyspark.sql import functions as F

from brindle.operators.windows import qualify
from brindle.plans import query, sql
from brindle.sources import table
from pyspark.sql import Window

sql("q1_pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM {lineitem} WHERE l_shipdate <= CAST('1998-09-02' AS TIMESTAMP_NTZ) GROUP BY l_returnflag, l_linestatus""",
"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")

DATE = ("CAST('1998-03-15' AS TIMESTAMP_NTZ)", "TIMESTAMP '1998-03-15'")
Q3 = """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE_ AND l_shipdate > DATE_
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10"""
sql("q3_shipping_priority", Q3.replace("DATE_", DATE[0]), Q3.replace("DATE_", DATE[1]))
sql("q5_regional_revenue", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
sql("q6_revenue_change", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
sql("q10_returned_items", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
sql("q14_promo_share", """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""")
sql("q18_large_orders", """
SELECT c_name, c_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice, qty
FROM (SELECT l_orderkey, round(sum(l_quantity), 2) AS qty FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey""", """
SELECT c_name, c_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice, round(sum(l_quantity), 2) AS qty
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
GROUP BY c_name, c_custkey, o_orderkey, o_totalprice""")
sql("q19_disjunctive_predicate", """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 1 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 20 AND 30)""")

sql("p01_projection", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity * 2 AS twice FROM {lineitem}")
sql("p02_filter_between", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus <> 'P'")
sql("p03_like", "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE 'S%' AND p_brand NOT LIKE '%1'")
sql("p04_ilike", "SELECT p_partkey, p_type FROM {part} WHERE p_type ILIKE 'pro%'")
sql("p05_like_any", "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE ANY ('PROMO%', '%ARD')", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%' OR p_type LIKE '%ARD'")
sql("p06_regex", "SELECT c_custkey, c_name FROM {customer} WHERE c_name RLIKE '[02468]$'", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[02468]$')")
sql("p07_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE p_type WHEN 'PROMO' THEN 1 ELSE 0 END AS promo FROM {part}")
sql("p08_null_safe_equality", "SELECT a, b, a <=> b AS same FROM (VALUES (1, 1), (1, NULL), (NULL, NULL), (2, 3)) AS t(a, b)", "SELECT a, b, a IS NOT DISTINCT FROM b AS same FROM (VALUES (1, 1), (1, NULL), (NULL, NULL), (2, 3)) AS t(a, b)")
sql("p09_not_in_with_null", "SELECT count(*) AS n FROM {nation} WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 3 THEN NULL ELSE r_regionkey END FROM {region})")
sql("p10_exists", "SELECT o_orderkey FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)")
sql("p11_in_having", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING count(*) > 12)")
sql("p12_correlated_scalar", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
sql("p13_greatest_least", "SELECT greatest(a, b, c) AS g, least(a, b, c) AS l FROM (VALUES (1, 2, 3), (1, NULL, 0), (CAST(NULL AS INT), NULL, NULL)) AS t(a, b, c)")
sql("p14_cte", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 20000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
sql("p15_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql("p16_pipe_syntax", "FROM {lineitem} |> WHERE l_quantity > 40 |> AGGREGATE count(*) AS n GROUP BY l_returnflag |> EXTEND n * 2 AS twice", "SELECT l_returnflag, count(*) AS n, count(*) * 2 AS twice FROM lineitem WHERE l_quantity > 40 GROUP BY l_returnflag")


@query("p17_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def p17_qualify(spark, sf_dir):
    """The dearest order of each customer."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return qualify(table(spark, sf_dir, "orders"), place, "_q = 1").select("o_custkey", "o_orderkey")


sql("o01_sort_nulls", "SELECT a, row_number() OVER (ORDER BY a DESC NULLS LAST) AS place FROM (VALUES (3), (NULL), (1), (2)) AS t(a) ORDER BY a DESC NULLS LAST", "SELECT a, CAST(row_number() OVER (ORDER BY a DESC NULLS LAST) AS INT) AS place FROM (VALUES (3), (NULL), (1), (2)) AS t(a)")
sql("o02_limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 25 OFFSET 100")
sql("o03_top_k", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")

sql("u01_union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql("u02_union_all", "SELECT n_name AS name, n_nationkey AS k FROM {nation} UNION ALL SELECT r_name, r_regionkey FROM {region}")
sql("u03_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
sql("u04_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
sql("u05_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT r_regionkey FROM {region}")
sql("u06_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT n_nationkey FROM {nation} WHERE n_regionkey > 1")


@query("u07_union_by_name", "SELECT n_nationkey AS k, n_name AS name, NULL::INT AS region FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region")
def u07_union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    b = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    return a.unionByName(b, allowMissingColumns=True)

# the same operators where nulls come from the tables' own values
sql("p08_null_safe_join", "SELECT c_custkey, n_name FROM (SELECT c_custkey, nullif(c_nationkey, 5) AS k FROM {customer}) c JOIN (SELECT n_name, nullif(n_nationkey, 5) AS k FROM {nation}) n ON c.k <=> n.k",
    "SELECT c_custkey, n_name FROM (SELECT c_custkey, nullif(c_nationkey, 5) AS k FROM customer) c JOIN (SELECT n_name, nullif(n_nationkey, 5) AS k FROM nation) n ON c.k IS NOT DISTINCT FROM n.k")
sql("p13_greatest_least_of_columns", "SELECT event_id, greatest(nullif(value, 6.55D), user_id / 2.0D, CAST(NULL AS DOUBLE)) AS g, least(CASE WHEN event_type = 'click' THEN value END, CASE WHEN user_id < 9 THEN 3.5D END) AS l FROM {events}",
    "SELECT event_id, greatest(nullif(value, 6.55::DOUBLE), user_id / 2.0::DOUBLE, CAST(NULL AS DOUBLE)) AS g, least(CASE WHEN event_type = 'click' THEN value END, CASE WHEN user_id < 9 THEN 3.5::DOUBLE END) AS l FROM events")
# LIMIT ALL: without it Spark ends a recursion beyond a million rows with an error
sql("p15_recursive_tree", "WITH RECURSIVE t(k, depth) AS (SELECT p_partkey, 0 FROM {part} WHERE p_partkey = 1 UNION ALL SELECT p_partkey, depth + 1 FROM t JOIN {part} ON p_partkey div 2 = k AND p_partkey > 1) SELECT depth, count(*) AS n, max(k) AS last FROM (SELECT * FROM t LIMIT ALL) GROUP BY depth",
    "WITH RECURSIVE t(k, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 1 UNION ALL SELECT p_partkey, depth + 1 FROM t JOIN part ON p_partkey // 2 = k AND p_partkey > 1) SELECT depth, count(*) AS n, max(k) AS last FROM t GROUP BY depth")
sql("o01_sort_nulls_in_groups", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, nullif(o_orderpriority, '1-URGENT') ASC NULLS LAST, o_orderkey) AS place FROM {orders}",
    "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, nullif(o_orderpriority, '1-URGENT') ASC NULLS LAST, o_orderkey) AS INT) AS place FROM orders")
