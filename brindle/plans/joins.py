"""Joins of every kind."""

from pyspark.sql import functions as F

from brindle.operators.joins import asof_join, asof_join_matches, interval_join, range_join, salted_join
from brindle.plans import query, sql
from brindle.sources import table

sql("j01_inner_small_side", "SELECT c_custkey, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
sql("j02_inner_merge", "SELECT /*+ MERGE(l) */ o_orderkey, l_linenumber, l_quantity FROM {orders} o JOIN {lineitem} l ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
sql("j03_inner_shuffle_hash", "SELECT /*+ SHUFFLE_HASH(o) */ o_orderkey, l_linenumber FROM {orders} o JOIN {lineitem} l ON o_orderkey = l_orderkey WHERE l_discount > 0.08", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount > 0.08")
sql("j04_left_outer", "SELECT o_orderkey, l_linenumber, l_quantity FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey")
sql("j04_right_outer", "SELECT o_orderkey, c_custkey FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey")
sql("j04_full_outer", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM (SELECT * FROM {orders} WHERE o_totalprice > 20000) a FULL JOIN (SELECT * FROM {orders} WHERE o_orderstatus = 'F') b ON a.o_orderkey = b.o_orderkey")
sql("j05_left_semi", "SELECT s_suppkey FROM {supplier} LEFT SEMI JOIN {lineitem} ON s_suppkey = l_suppkey AND l_quantity > 49", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE s_suppkey = l_suppkey AND l_quantity > 49)")
sql("j06_left_anti", "SELECT o_orderkey FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)")
sql("j07_cross", "SELECT n_name, r_name FROM {nation} CROSS JOIN {region}")
sql("j08_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM {nation} a JOIN {region} b ON a.n_regionkey < b.r_regionkey")
sql("j13_using", "SELECT o_orderkey, n FROM {orders} JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) c USING (o_orderkey)")
sql("j14_lateral", "SELECT r_name, n FROM {region}, LATERAL (SELECT count(*) AS n FROM {nation} WHERE n_regionkey = r_regionkey) t")
sql("j16_self_join", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("j09_range_join", """
SELECT p_partkey, low, name FROM part JOIN (SELECT c_custkey AS name, c_acctbal AS low, c_acctbal + 50 AS high FROM customer) r
ON p_retailprice >= low AND p_retailprice <= high""")
def j09_range_join(spark, sf_dir):
    ranges = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_acctbal").alias("low"), (F.col("c_acctbal") + 50).alias("high"))
    return range_join(table(spark, sf_dir, "part"), ranges, "p_retailprice", "low", "high", columns=["p_partkey", "low", "name"])


@query("j09_interval_join", """
SELECT a.event_id AS purchase, b.event_id AS click FROM events a JOIN events b ON a.user_id = b.user_id
AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts WHERE a.event_type = 'purchase' AND b.event_type = 'click'""")
def j09_interval_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "ts")
    right = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("click_ts"))
    return interval_join(left, right, ["user_id"], "ts", "click_ts", "2 hours", "0 hours").select("purchase", "click")


#: Orders are moved by 25 years, so that their dates meet those of the events.
ASOF = """
SELECT o_orderkey, e.event_id, e.value FROM (SELECT o_orderkey, o_custkey AS user_id, o_orderdate + INTERVAL 25 YEAR AS placed FROM orders) o
ASOF LEFT JOIN events e ON o.user_id = e.user_id AND o.placed >= e.ts"""


def moved_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + interval 25 years").alias("placed"))


@query("j10_asof_join", ASOF)
def j10_asof_join(spark, sf_dir):
    return asof_join(moved_orders(spark, sf_dir), table(spark, sf_dir, "events"), ["user_id"], "placed", "ts", ["event_id", "value"]).select("o_orderkey", "event_id", "value")


@query("j11_asof_join_matches", ASOF)
def j11_asof_join_matches(spark, sf_dir):
    return asof_join_matches(moved_orders(spark, sf_dir), table(spark, sf_dir, "events"), ["user_id"], "o_orderkey", "placed", "ts", ["event_id", "value"]).select("o_orderkey", "event_id", "value")


@query("j12_asof_join_tolerance", f"SELECT o_orderkey, CASE WHEN e_ts >= placed - INTERVAL 1 DAY THEN event_id END AS event_id FROM ({ASOF.replace('e.value', 'e.ts AS e_ts, o.placed')}) t")
def j12_asof_join_tolerance(spark, sf_dir):
    return asof_join(moved_orders(spark, sf_dir), table(spark, sf_dir, "events"), ["user_id"], "placed", "ts", ["event_id"], tolerance="1 day").select("o_orderkey", "event_id")


@query("j17_salted_join", "SELECT l_returnflag, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def j17_salted_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    joined = salted_join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), orders, ["l_orderkey"], 8)
    return joined.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
