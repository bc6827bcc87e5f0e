"""Sources and sinks."""

from pyspark.sql import functions as F

from brindle.plans import query, sql
from brindle.scratch import folder
from brindle.sources import FORMATS, parts, round_trip, table, text_round_trip, write_bucketed, write_partitioned
from brindle.sources.sequence import register
from brindle.streaming import arriving, events

sql("s01_parquet_scan", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_quantity > 49")
sql("s04_inline_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
sql("s04_range", "SELECT id * id AS sq FROM range(0, 1000, 3)", "SELECT range * range AS sq FROM range(0, 1000, 3)")
sql("s04_inline_rows_joined", "SELECT name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN (VALUES ('F', 'filled'), ('O', 'open'), ('P', 'partly')) AS s(code, name) ON o_orderstatus = code GROUP BY name")
sql("s04_range_joined", "SELECT r.id AS line, count(l_orderkey) AS n FROM range(0, 12) r LEFT JOIN {lineitem} ON l_linenumber = r.id GROUP BY r.id", "SELECT r.id AS line, count(l_orderkey) AS n FROM range(0, 12) r(id) LEFT JOIN lineitem ON l_linenumber = r.id GROUP BY r.id")
sql("s05_sample_rows", "SELECT count(*) AS n FROM (SELECT * FROM {customer} TABLESAMPLE (10 ROWS))", "SELECT count(*) AS n FROM (SELECT * FROM customer LIMIT 10)")


@query("s02_round_trips", " UNION ALL ".join(f"SELECT '{k}' AS format, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first, max(o_orderpriority) AS priority FROM orders" for k in FORMATS))
def s02_round_trips(spark, sf_dir):
    """All orders through every format."""
    orders, out = table(spark, sf_dir, "orders"), None
    for kind in FORMATS:
        own = round_trip(orders, kind).agg(F.lit(kind).alias("format"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first"), F.max("o_orderpriority").alias("priority"))
        out = own if out is None else out.unionByName(own)
    return out


@query("s02_text_lines", "SELECT c_name FROM customer")
def s02_text_lines(spark, sf_dir):
    return text_round_trip(table(spark, sf_dir, "customer"), "c_name")


@query("s06_python_source", "SELECT range AS i, range * 7 AS value FROM range(0, 1000)")
def s06_python_source(spark, sf_dir):
    register(spark)
    return spark.read.format("sequence").option("count", 1000).option("step", 7).load()


@query("s06_python_sink", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def s06_python_sink(spark, sf_dir):
    """Written by one Python source and read by it again."""
    parts.register(spark)
    orders, where = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), folder(spark, "parts")
    orders.write.format("brindle_parts").mode("append").save(where)
    return spark.read.format("brindle_parts").schema(orders.schema).load(where)


@query("s06_python_stream_sink", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def s06_python_stream_sink(spark, sf_dir):
    """A stream from the Python feed to the Python sink, whose batches count once each."""
    parts.register(spark)
    stream, where = arriving(events(spark, sf_dir), "ts").select("event_type", "value"), folder(spark, "parts")
    query = stream.writeStream.format("brindle_parts").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    out = spark.read.format("brindle_parts").schema(stream.schema).load(f"{where}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s08_dynamic_pruning", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY n_name")
def s08_dynamic_pruning(spark, sf_dir):
    """A table in folders by nation; which folders are read is known when the nations have been filtered."""
    customers = write_partitioned(table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey"), ["c_nationkey"])
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return customers.join(nations, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("s08_partitioned_write", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def s08_partitioned_write(spark, sf_dir):
    """The filter on the partition column reads one folder only."""
    return write_partitioned(table(spark, sf_dir, "orders"), ["o_orderstatus"]).filter("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("s08_bucketed_join", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def s08_bucketed_join(spark, sf_dir):
    """Both tables in buckets of the order's key: neither the join nor the aggregation shuffles."""
    orders = write_bucketed(table(spark, sf_dir, "orders"), "brindle_orders", "o_orderkey", 8)
    items = write_bucketed(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "brindle_items", "o_orderkey", 8)
    return orders.join(items, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"))
