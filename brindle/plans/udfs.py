"""User functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import udfs
from brindle.plans import query
from brindle.sources import table


#: Rows of a group that pandas holds at once, on average.
CHUNK_ROWS = 10_000


def chunked(df):
    """With a column `chunk`, which deals groups of any size into parts of about CHUNK_ROWS rows at most."""
    return df.withColumn("chunk", F.pmod(F.xxhash64(*df.columns), F.lit(max(1, -(-df.count() // CHUNK_ROWS)))))


@query("x01_python_udf", "SELECT c_custkey, left(split_part(c_name, '#', 1), 1) AS i FROM customer")
def x01_python_udf(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.initials("c_name").alias("i"))


@query("x02_pandas_udf", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def x02_pandas_udf(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(udfs.discounted("l_extendedprice", "l_discount"), 4).alias("net"))


@query("x03_pandas_aggregate", "SELECT event_type, round(max(value) - min(value), 6) AS s FROM events GROUP BY event_type")
def x03_pandas_aggregate(spark, sf_dir):
    """pandas reduces chunks of the groups, Spark combines them."""
    parts = chunked(table(spark, sf_dir, "events")).groupBy("event_type", "chunk").agg(udfs.highest("value").alias("high"), udfs.lowest("value").alias("low"))
    return parts.groupBy("event_type").agg(F.round(F.max("high") - F.min("low"), 6).alias("s"))


@query("x04_table_function", "SELECT r_regionkey, word, CAST(place - 1 AS INT) AS place FROM (SELECT r_regionkey, unnest(string_split(r_name, ' ')) AS word, generate_subscripts(string_split(r_name, ' '), 1) AS place FROM region)")
def x04_table_function(spark, sf_dir):
    spark.udtf.register("brindle_words", udfs.Words)
    return spark.sql("SELECT r_regionkey, word, at AS place FROM {region}, LATERAL brindle_words(r_name)", region=table(spark, sf_dir, "region"))


@query("x05_apply_in_pandas", "SELECT event_id, event_type, round(value - avg(value) OVER (PARTITION BY event_type), 6) AS centered FROM events")
def x05_apply_in_pandas(spark, sf_dir):
    """pandas gets chunks of the groups, each with the mean of its whole group.  The join and the groups have the same keys, none of them
    null, so that events are shuffled once."""
    events = chunked(table(spark, sf_dir, "events")).withColumn("type", F.struct("event_type"))
    whole = Window.partitionBy("type")
    means = events.groupBy("type", "chunk").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    means = means.select("type", "chunk", F.try_divide(F.sum("total").over(whole), F.sum("n").over(whole)).alias("mean"))
    out = events.join(means.hint("merge"), ["type", "chunk"]).groupBy("type", "chunk").applyInPandas(udfs.centered, "event_id long, event_type string, centered double")
    return out.select("event_id", "event_type", F.round("centered", 6).alias("centered"))


@query("x05_map_in_pandas", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def x05_map_in_pandas(spark, sf_dir):
    return table(spark, sf_dir, "customer").mapInPandas(udfs.positive, "c_custkey long, c_acctbal double")


@query("x06_sql_function", "SELECT p_partkey, round(p_retailprice * 1.19, 4) AS gross FROM part")
def x06_sql_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION brindle_gross(x DOUBLE) RETURNS DOUBLE RETURN round(x * 1.19D, 4)")
    return spark.sql("SELECT p_partkey, brindle_gross(p_retailprice) AS gross FROM {part}", part=table(spark, sf_dir, "part"))
