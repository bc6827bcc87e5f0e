"""Balanced shards of indivisible groups, by Karmarkar-Karp differencing.

Differencing keeps partial partitions: k bins and what they hold.  It takes the two with the largest spread, puts the
largest bin of one with the smallest of the other, and so on, until one is left.

1.  Documents with equal texts form a group; a partial aggregation sums up its bytes, so copies don't meet in a task.
2.  The largest groups, those above 1 / `bucket` of all bytes and so fewer than `bucket`, are differenced first.
3.  The other groups are dealt by hash into buckets of about as many.  A task differences one bucket at a time, together with
    its share of what the largest groups hold, so the buckets fill up what those leave uneven, and their bins keep
    the same order.  Neither a task nor the driver holds more than a bucket.
4.  Each document gets its group's shard, and a slot without gaps by sums over chunks.

Null texts count as empty, and so belong to the group of empty texts.  Repeated rows stay repeated, with slots of their
own.  A group larger than a k-th of all bytes can't be balanced; the other shards are then balanced among themselves.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks_for, cut, hash_chunk, ranks, table, text_key


def difference(partials: list[list[int]], k: int) -> list[list[int]]:
    """Differencing of partial partitions, each a list of at most k bin sums: the final bin (0 to k - 1, the fullest
    first) of each bin."""
    if not partials:
        return []
    nodes, heap = [], []  # a node: (its sums from the largest down, what each of its bins is made of)
    for i, sums in enumerate(partials):
        sums = [*sums, *[0] * (k - len(sums))]
        order = sorted(range(k), key=lambda b: -sums[b])
        nodes.append(([sums[b] for b in order], order))
        heap.append((-(sums[order[0]] - sums[order[-1]]), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = nodes[a][0], nodes[b][0]
        sums = [x[i] + y[k - 1 - i] for i in range(k)]
        order = sorted(range(k), key=lambda i: -sums[i])
        nodes.append(([sums[i] for i in order], (a, b, order)))
        heapq.heappush(heap, (-(sums[order[0]] - sums[order[-1]]), len(nodes) - 1))
    bins: dict[int, list[int]] = {len(nodes) - 1: list(range(k))}  # the final bin of each of the node's bins
    out: list[list[int]] = [[] for _ in partials]
    for n in range(len(nodes) - 1, -1, -1):
        own, made = bins.pop(n), nodes[n][1]
        if n < len(partials):
            final = [0] * k
            for place, b in enumerate(made):
                final[b] = own[place]
            out[n] = final[: len(partials[n])]
            continue
        a, b, order = made
        left, right = [0] * k, [0] * k
        for place, i in enumerate(order):
            left[i], right[k - 1 - i] = own[place], own[place]
        bins[a], bins[b] = left, right
    return out


def balance(groups: DataFrame, k: int, bucket: int = 16_384) -> DataFrame:
    """(h1, h2, shard) of groups (h1, h2, bytes), h1 and h2 being hashes."""
    spark = groups.sparkSession
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = total // bucket
    largest = groups.filter(F.col("bytes") > large).select("h1", "h2", "bytes").collect()  # fewer than `bucket` can be above
    largest.sort(key=lambda x: (-x["bytes"], x["h1"], x["h2"]))
    bins = [x[0] for x in difference([[x["bytes"]] for x in largest], k)]
    held = [0] * k
    for x, b in zip(largest, bins):
        held[b] += x["bytes"]
    first = spark.createDataFrame([(x["h1"], x["h2"], b) for x, b in zip(largest, bins)], "h1 long, h2 long, shard int")
    rest = groups.filter(F.col("bytes") <= large)
    buckets = max(1, -(-rest.count() // bucket))
    share = [x // buckets for x in held]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "h1", "h2"], ascending=[False, True, True])
        before, *own = difference([share, *([int(n)] for n in pdf["bytes"])], k)
        shard_of = {final: b for b, final in enumerate(before)}
        return pdf.assign(shard=[shard_of[x[0]] for x in own])[["h1", "h2", "shard"]]

    others = rest.withColumn("part", F.pmod("h1", F.lit(buckets))).groupBy("part").applyInPandas(fill, "h1 long, h2 long, shard int")
    return others.unionByName(first)


def placed_documents(docs: DataFrame, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, h1, h2, shard, slot) of each document, by the hashes of its text; equal texts share a shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2 = text_key(text)
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), h1.alias("h1"), h2.alias("h2")))
    groups = cut(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")))
    placed = rows.join(balance(groups, k), ["h1", "h2"]).withColumn("chunk", hash_chunk(F.col("id"), F.col("h1"), chunks=chunks_for(rows.count())))
    placed = ranks(cut(placed), ["shard"], "chunk", [F.col("id"), F.col("h1")], "slot")
    return placed.select("id", "size", "text_crc32", "h1", "h2", "shard", "slot")


def shard(docs: DataFrame, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each document; equal texts share a shard."""
    return placed_documents(docs, k, id_col, text_col).drop("h1", "h2")


def sharded_documents(docs: DataFrame, k: int = 8) -> DataFrame:
    """The rows of docs with their shard and slot; columns of docs with these names give way.  Texts are shuffled once."""
    docs = docs.drop("shard", "slot")
    h1, h2 = text_key(F.coalesce("text", F.lit("")))
    key = ["null", "id", "h1", "h2"]
    own = lambda id_: (id_.isNull().alias("null"), F.coalesce(id_, F.lit(0).cast("long")).alias("id"))
    # rows with the same identifier and text are told apart by a number
    number = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), *own(F.col("doc_id").cast("long")), h1.alias("h1"), h2.alias("h2")).withColumn("number", number(F.xxhash64("doc")))
    placed = placed_documents(docs.select("doc_id", "text"), k).select(*own(F.col("id")), "h1", "h2", "shard", "slot").withColumn("number", number("slot"))
    return whole.join(placed.hint("merge"), [*key, "number"]).select("doc.*", "shard", "slot")


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
