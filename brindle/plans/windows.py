"""Window functions and frames."""

from pyspark.sql import functions as F

from brindle.operators.scan import framed, running
from brindle.operators.windows import excluding, over_groups, sessions, sum_excluding_current, top_k
from brindle.plans import query, sql
from brindle.sources import table

sql("w01_row_number_rank_ntile", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, ntile(4) OVER w AS nt FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INT) AS rk, CAST(ntile(4) OVER w AS INT) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql("w02_dense_rank_cume_dist_first", "SELECT p_partkey, dense_rank() OVER w AS dr, round(cume_dist() OVER w, 9) AS cd, first_value(p_size) OVER w AS f FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
    "SELECT p_partkey, CAST(dense_rank() OVER w AS INT) AS dr, round(cume_dist() OVER w, 9) AS cd, first_value(p_size) OVER w AS f FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
sql("w03_percent_rank", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_type ORDER BY p_size), 9) AS pr FROM {part}")
sql("w04_lag_lead", "SELECT event_id, lag(event_id, 1, -1) OVER w AS before, lead(event_id, 2) OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
sql("w05_last_value_default_frame", "SELECT event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS l FROM {events}")
sql("w06_nth_value", "SELECT event_id, nth_value(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts) AS third FROM {events}")
sql("w07_ignore_nulls", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts) AS click FROM {events}",
    "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS click FROM events")
sql("w08_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS s FROM {events}")
sql("w09_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM {events}")
sql("w12_running_share", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM {orders}")


@query("w10_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def w10_groups_frame(spark, sf_dir):
    return over_groups(table(spark, sf_dir, "part"), ["p_brand"], "p_size", F.count("*"), 1, 1, "n").select("p_partkey", "n")


@query("w11_exclude_current_row", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 6) AS s FROM events")
def w11_exclude_current_row(spark, sf_dir):
    out = sum_excluding_current(table(spark, sf_dir, "events"), ["user_id"], ["ts"], "value", 2, 2, "s")
    return out.select("event_id", F.round("s", 6).alias("s"))


def excluded(name: str, kind: str, frame: str, exclude: str) -> None:
    """Quantities by supplier in the order of shipping dates, where several lines share a date."""
    key = ", l_orderkey, l_linenumber, l_partkey, l_extendedprice" if frame == "rows" and exclude == "current row" else ""
    text = f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {kind}(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate{key} {frame.upper()} BETWEEN 2 PRECEDING AND 3 FOLLOWING EXCLUDE {exclude.upper()}) AS x FROM lineitem"

    @query(name, text)
    def run(spark, sf_dir):
        order = ["l_shipdate", *key.split(", ")[1:]]
        return excluding(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, kind, F.col("l_quantity"), 2, 3, exclude, "x", frame).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "x")


excluded("w11_exclude_group_max", "max", "groups", "group")
excluded("w11_exclude_ties_min", "min", "groups", "ties")
excluded("w11_exclude_current_row_max", "max", "rows", "current row")
excluded("w11_exclude_no_others_count", "count", "groups", "no others")


@query("w11_exclude_rows_group", "SELECT event_id, max(value) OVER w AS x, min(value) OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts), event_id ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING EXCLUDE TIES) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING EXCLUDE GROUP)")
def w11_exclude_rows_group(spark, sf_dir):
    out = excluding(table(spark, sf_dir, "events"), ["user_id"], ["ts"], "max", F.col("value"), 4, 2, "group", "x")
    out = out.withColumn("day", F.date_trunc("day", "ts"))
    return excluding(out, ["user_id"], ["day", "event_id"], "min", F.col("value"), 4, 2, "ties", "y").select("event_id", "x", "y")


@query("w14_running_aggregates", "SELECT event_id, round(sum(value) OVER w, 4) AS total, count(*) OVER w AS n, max(value) OVER w AS top, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS click FROM events WINDOW w AS (PARTITION BY event_type = 'view' ORDER BY ts, event_id)")
def w14_running_aggregates(spark, sf_dir):
    """Two keys hold all events: each is dealt into chunks of time."""
    events = table(spark, sf_dir, "events").withColumn("view", F.col("event_type") == "view")
    aggregates = {"total": ("sum", F.col("value")), "n": ("count", F.lit(1)), "top": ("max", F.col("value")), "click": ("last", F.when(F.col("event_type") == "click", F.col("event_id")))}
    return running(events, ["view"], ["ts", "event_id"], aggregates).select("event_id", F.round("total", 4).alias("total"), "n", "top", "click")


@query("w15_rows_frame_of_hot_keys", "SELECT event_id, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS top, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type = 'view' ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)")
def w15_rows_frame_of_hot_keys(spark, sf_dir):
    """The frame of W8 where two keys hold all events."""
    events = table(spark, sf_dir, "events").withColumn("view", F.col("event_type") == "view")
    out = framed(events, ["view"], ["ts", "event_id"], {"total": ("sum", F.col("value")), "top": ("max", F.col("value")), "n": ("count", F.lit(1))}, 4, 2)
    return out.select("event_id", F.round("total", 4).alias("total"), "top", "n")


@query("o04_top_k_per_group", "SELECT c_nationkey, c_custkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) t WHERE rank <= 3")
def o04_top_k_per_group(spark, sf_dir):
    return top_k(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


SESSIONS = """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session"""


@query("w13_sessions", SESSIONS)
def w13_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours").select("user_id", "started", "n")


@query("t03_batch_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, count(*) AS n FROM events GROUP BY 1")
def t03_batch_tumbling(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("started"), "n")


@query("t04_batch_sliding", """
SELECT started, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS started FROM events, (VALUES (0), (1)) AS t(k)) GROUP BY started""")
def t04_batch_sliding(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("started"), "n")


@query("t05_batch_session", SESSIONS)
def t05_batch_session(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("started"), "n")
