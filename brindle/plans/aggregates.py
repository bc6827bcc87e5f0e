"""Aggregations, grouping sets, statistics, sketches, pivots."""

from pyspark.sql import functions as F

from brindle.functions import sample_skewness
from brindle.functions.sketches import bitmaps, bitmaps_merged
from brindle.operators.scan import quantiles
from brindle.plans import query, sql
from brindle.scratch import folder
from brindle.sources import table

sql("a01_count_sum_avg", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM {orders} GROUP BY o_orderstatus")
sql("a02_min_max", "SELECT event_type, min(ts) AS first, max(ts) AS last, min(value) AS low, max(value) AS high FROM {events} GROUP BY event_type")
sql("a03_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey, l_partkey) AS pairs FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_suppkey, l_partkey)) AS pairs FROM lineitem GROUP BY l_returnflag")
sql("a05_filter_clause", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 30) AS large, count_if(l_discount = 0) AS full_price FROM {lineitem} GROUP BY l_linestatus", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 30) AS large, CAST(count_if(l_discount = 0) AS BIGINT) AS full_price FROM lineitem GROUP BY l_linestatus")
sql("a06_hash_aggregate", "SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM {lineitem} GROUP BY l_orderkey")
sql("a07_sort_aggregate", "SELECT o_custkey, max(o_orderpriority) AS p, min(o_orderstatus) AS s FROM {orders} GROUP BY o_custkey")
sql("a08_collect_list", "SELECT o_custkey, array_join(array_sort(collect_list(o_orderstatus)), '') AS s FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, array_to_string(list_sort(list(o_orderstatus)), '') AS s FROM orders GROUP BY o_custkey")
sql("a09_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql("a10_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n, CAST(grouping_id() AS BIGINT) AS g FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)", "SELECT n_regionkey, n_nationkey, count(*) AS n, CAST(grouping_id(n_regionkey, n_nationkey) AS BIGINT) AS g FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
sql("a11_cube", "SELECT p_brand, p_type, count(*) AS n, CAST(grouping_id() AS BIGINT) AS g FROM {part} GROUP BY CUBE (p_brand, p_type)", "SELECT p_brand, p_type, count(*) AS n, CAST(grouping_id(p_brand, p_type) AS BIGINT) AS g FROM part GROUP BY CUBE (p_brand, p_type)")
sql("a12_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) >= 15")
sql("a13_spread", "SELECT event_type, round(stddev(value), 6) AS sd, round(var_pop(value), 6) AS vp, round(corr(value, user_id), 6) AS c FROM {events} GROUP BY event_type")
sql("a15_kurtosis", "SELECT round(kurtosis(l_quantity), 6) AS k FROM {lineitem}", "SELECT round(kurtosis_pop(l_quantity), 6) AS k FROM lineitem")
sql("a19_regression", "SELECT round(covar_samp(l_extendedprice, l_quantity), 4) AS c, round(covar_pop(l_extendedprice, l_quantity), 4) AS cp, round(regr_slope(l_extendedprice, l_quantity), 6) AS s, round(regr_intercept(l_extendedprice, l_quantity), 4) AS i, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM {lineitem}")
sql("a20_mode_bool_and_max_by", "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS positive, max_by(o_orderkey, o_totalprice) AS dearest, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS m FROM {orders} GROUP BY o_orderstatus",
    """SELECT o_orderstatus, bool_and(o_totalprice > 0) AS positive, max_by(o_orderkey, o_totalprice) AS dearest,
    (SELECT p FROM (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) WHERE s = o_orderstatus ORDER BY n DESC, p LIMIT 1) AS m FROM orders GROUP BY o_orderstatus""")
sql("a21_bool_or_bit_xor_min_by", "SELECT o_orderstatus, bool_or(o_totalprice > 30000) AS any_large, bit_xor(o_orderkey) AS x, bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, min_by(o_orderkey, o_totalprice) AS cheapest, round(stddev_pop(o_totalprice), 4) AS sd FROM {orders} GROUP BY o_orderstatus")
sql("a21_collect_set", "SELECT o_custkey, array_join(array_sort(collect_set(o_orderpriority)), ',') AS p FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS p FROM orders GROUP BY o_custkey")
sql("a22_any_value", "SELECT k, any_value(v, true) AS v FROM (VALUES (1, NULL), (1, 5), (2, NULL), (3, 7)) AS t(k, v) GROUP BY k", "SELECT k, any_value(v) AS v FROM (VALUES (1, NULL), (1, 5), (2, NULL), (3, 7)) AS t(k, v) GROUP BY k")
sql("a22_any_value_that_is_not_null", "SELECT o_custkey, any_value(CASE WHEN o_orderstatus = 'F' THEN c_name END, true) AS name FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY o_custkey", "SELECT o_custkey, any_value(CASE WHEN o_orderstatus = 'F' THEN c_name END) AS name FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
sql("a23_ordered_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql("a24_array_agg", "SELECT n_regionkey, size(array_agg(n_nationkey)) AS n, array_max(array_agg(n_nationkey)) AS top FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, CAST(len(array_agg(n_nationkey)) AS INT) AS n, list_max(array_agg(n_nationkey)) AS top FROM nation GROUP BY n_regionkey")
sql("a26_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_orderkey FROM {lineitem}) PIVOT (count(l_orderkey) FOR l_linestatus IN ('O' AS open, 'F' AS full))", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_linestatus = 'F') AS full FROM lineitem GROUP BY l_returnflag")
sql("a27_unpivot", "SELECT * FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM {part}) UNPIVOT (v FOR what IN (size, price))", "SELECT p_partkey, what, v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR what IN (size, price))")
sql("a28_stack", "SELECT r_name, stack(2, 'key', r_regionkey, 'next', r_regionkey + 1) AS (what, v) FROM {region}", "SELECT r_name, 'key' AS what, r_regionkey AS v FROM region UNION ALL SELECT r_name, 'next', r_regionkey + 1 FROM region")


@query("a16_percentiles", "SELECT event_type, round(median(value), 6) AS m, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def a16_percentiles(spark, sf_dir):
    """Places of a running count, where Spark's percentile holds a group's distinct values in one task."""
    found = quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"m": 0.5, "p90": 0.9})
    return found.select("event_type", F.round("m", 6).alias("m"), F.round("p90", 6).alias("p90"))


@query("a17_percentile_disc", "SELECT CAST(quantile_disc(p_size, 0.25) AS INT) AS p25 FROM part")
def a17_percentile_disc(spark, sf_dir):
    return quantiles(table(spark, sf_dir, "part"), [], "p_size", {"p25": 0.25}, "disc").select(F.col("p25").cast("int").alias("p25"))


sql("a16_percentiles_by_spark", "SELECT event_type, round(median(value), 6) AS m, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90 FROM {events} GROUP BY event_type", "SELECT event_type, round(median(value), 6) AS m, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
sql("a17_percentile_disc_by_spark", "SELECT CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size) AS INT) AS p25 FROM {part}", "SELECT CAST(quantile_disc(p_size, 0.25) AS INT) AS p25 FROM part")


@query("a14_skewness", "SELECT event_type, round(skewness(value), 6) AS s FROM events GROUP BY event_type")
def a14_skewness(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(sample_skewness(F.col("value")), 6).alias("s"))


@query("a04_approx_count_distinct", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")
def a04_approx_count_distinct(spark, sf_dir):
    """Whether the estimate lies within 10 % of the exact count, for each group."""
    both = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.count_distinct("l_partkey").alias("exact"))
    return both.select("l_returnflag", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


@query("a18_approx_percentile", "SELECT event_type, true AS near FROM events GROUP BY event_type")
def a18_approx_percentile(spark, sf_dir):
    """Whether the estimates lie between neighbouring exact percentiles."""
    events = table(spark, sf_dir, "events")
    found = events.groupBy("event_type").agg(F.approx_percentile("value", 0.5, 10000).alias("m"), F.size(F.histogram_numeric("value", F.lit(5))).alias("bins"))
    found = found.join(quantiles(events, ["event_type"], "value", {"low": 0.48, "high": 0.52}), "event_type")
    return found.select("event_type", (F.col("m").between(F.col("low"), F.col("high")) & (F.col("bins") <= 5)).alias("near"))


@query("a25_sketches", "SELECT true AS hll, true AS theta, true AS kll, true AS bitmap")
def a25_sketches(spark, sf_dir):
    """Whether HyperLogLog, Theta, KLL and bitmap sketches agree with exact results."""
    items = table(spark, sf_dir, "lineitem")
    found = items.agg(
        F.expr("hll_sketch_estimate(hll_sketch_agg(l_partkey))").alias("hll"), F.expr("theta_sketch_estimate(theta_sketch_agg(l_partkey))").alias("theta"),
        F.expr("kll_sketch_get_quantile_bigint(kll_sketch_agg_bigint(l_partkey), 0.5D)").alias("kll"), F.expr("bitmap_count(bitmap_construct_agg(bitmap_bit_position(l_linenumber)))").alias("bitmap"),
    )
    # the exact results are of one row each
    counts = items.select(F.explode(F.array(F.struct(F.lit("part").alias("what"), F.col("l_partkey").alias("v")), F.struct(F.lit("line").alias("what"), F.col("l_linenumber").cast("long").alias("v")))).alias("x")).select("x.*").distinct()
    counts = counts.agg(F.count_if(F.col("what") == "part").alias("n"), F.count_if(F.col("what") == "line").alias("lines"))
    found = found.crossJoin(counts).crossJoin(quantiles(items, [], "l_partkey", {"low": 0.45, "high": 0.55}))
    near = lambda c: F.abs(F.col(c) - F.col("n")) <= 0.05 * F.col("n")
    return found.select(near("hll").alias("hll"), near("theta").alias("theta"), F.col("kll").between(F.col("low"), F.col("high")).alias("kll"), (F.col("bitmap") == F.col("lines")).alias("bitmap"))


@query("a25_sketches_by_day", """
WITH u AS (SELECT date_trunc('week', ts) AS week, user_id, bool_or(event_type = 'click') AS click, bool_or(event_type = 'purchase') AS purchase, bool_or(event_type = 'error') AS error, count(value) AS n FROM events GROUP BY ALL)
SELECT CAST(week AS DATE) AS week, count(*) AS users, count(*) FILTER (WHERE click AND purchase) AS buyers_who_click, count(*) FILTER (WHERE click AND NOT purchase AND NOT error) AS only_click,
CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY week""")
def a25_sketches_by_day(spark, sf_dir):
    """Bitmaps of the users of each day are stored, and weeks are put together from those.  Bitmaps are exact, where HyperLogLog and Theta
    sketches are estimates beyond some thousand users."""
    is_type = lambda *types: F.col("event_type").isin(*types)
    segments = {"c": is_type("click"), "p": is_type("purchase"), "cp": is_type("click", "purchase"), "pe": is_type("purchase", "error"), "cpe": is_type("click", "purchase", "error")}
    daily = bitmaps(table(spark, sf_dir, "events"), [F.to_date("ts").alias("day")], "user_id", "value", segments)
    where = folder(spark, "sketches")
    daily.write.parquet(where)
    weeks = bitmaps_merged(spark.read.schema(daily.schema).parquet(where), [F.date_trunc("week", "day").cast("date").alias("week")], list(segments))
    # what is in both, and in the first only, by the sizes of unions
    return weeks.select("week", F.col("items").alias("users"), (F.col("c") + F.col("p") - F.col("cp")).alias("buyers_who_click"), (F.col("cpe") - F.col("pe")).alias("only_click"), F.col("n"))