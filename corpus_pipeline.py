"""A corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents.

Documents have doc_id (whole numbers), text, lang, source and n_chars, perhaps more columns, all of which stay.  Null or empty texts
are documents without words: they are scored and kept like others, are near-duplicates of each other, hold no test item, have
no place in the mix (it counts words), and so don't reach the last stage.  Null doc_ids are documents like others, told apart by
text and row.  Rows that repeat a doc_id and a text are near-duplicates: one stays.  A null source is a source of its own.  Long texts
are taken whole.  No documents give no documents; without labels no document is taken for toxic, and without a benchmark all are
clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import new_folder, remove, table
from brindle.llm.decontaminate import clean_documents
from brindle.llm.mixing import mixed_documents
from brindle.llm.sharding import sharded_documents
from brindle.llm.simhash import one_of_each
from brindle.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    model = fit(docs.select(docs["doc_id"].cast("long").alias("id"), "text"), table(spark, sf_dir, "labels"))
    return keep_clean(docs, model)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as the mix takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return sharded_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  A stage's input is deleted when its output is written."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


#: The stages are beyond SQL; tests compare each with a plain version.
ORACLE_SQL = None
