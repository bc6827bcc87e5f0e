"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.scratch import folder

#: Formats that need no extra module, with the options that keep every value.
FORMATS: dict[str, dict[str, str]] = {"parquet": {}, "orc": {}, "json": {"ignoreNullFields": "false"}, "csv": {"header": "true"}, "xml": {"rowTag": "row"}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """Written in a format and read back with the same schema."""
    spark, where = df.sparkSession, folder(df.sparkSession, kind)
    df.write.format(kind).options(**FORMATS[kind]).save(where)
    return spark.read.format(kind).schema(df.schema).options(**FORMATS[kind]).load(where)


def text_round_trip(df: DataFrame, column: str) -> DataFrame:
    """One string column as lines of text; values must not hold line ends."""
    where = folder(df.sparkSession, "text")
    df.select(column).write.text(where)
    return df.sparkSession.read.text(where).withColumnRenamed("value", column)


def write_partitioned(df: DataFrame, by: list[str]) -> DataFrame:
    """Written in a folder for each value of `by`, which later filters on them prune; one task writes a folder's files
    unless it is large."""
    where = folder(df.sparkSession, "partitioned")
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(where)
    return df.sparkSession.read.parquet(where)


def write_bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """A table in buckets of a key: later joins and aggregations by that key need no shuffle.  Its files lie in a new folder."""
    df.write.bucketBy(buckets, by).sortBy(by).mode("overwrite").option("path", folder(df.sparkSession, name)).saveAsTable(name)
    return df.sparkSession.table(name)
