"""Line dedup: lines that many documents share stay in one of them.

1.  Each task turns its texts into rows (hash of the line's key, document, position); no text is shuffled for this.
2.  The rows are range-partitioned by (hash, document, position) and sorted by hash, document from the largest down,
    and position.  Since the ranges cut by document too, a line that a third of all documents hold lies in many
    partitions, not in one.
3.  Each partition streams its rows.  The first document of a key is the one that keeps it; a key is shared once enough
    documents have passed.  Until then only the rows of the documents behind the first are held, at most a partition's.
    Keys that lie across a partition's edge are at most one for each edge; their counts and largest documents come
    from an aggregation before, and reach the tasks with the function.
4.  Dropped positions become one compressed bitmap for each document that loses lines.
5.  Where the texts without these lines are wanted (apply_bitmaps), texts are joined with their bitmaps, which shuffles them once.

A line's key is the line without white space at its ends, A-Z lower-cased.  Null and empty texts are one empty line.
Rows with the same identifier count as one document; null identifiers count as one, the smallest.  Repeated rows get
the same bitmap.  Hashes have 128 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, slices, table, texts

KEY = ["h1", "h2"]
ROW = "h1 long, h2 long, id long, text_hash long, position int, n_lines int"


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key has at least min_chars code points."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in slices(batches):
            digests, at, position, count = [], [], [], []
            for i, data in enumerate(texts(column(batch, "text"))):
                own = data.split(b"\n")
                for k, line in enumerate(own):
                    if len(line) >= min_chars:
                        key = line.strip().lower()  # on bytes: ASCII white space, A-Z
                        if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars:
                            digests.append(xxh3_128_digest(key))
                            at.append(i)
                            position.append(k)
                            count.append(len(own))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), column(batch, "id").take(at), column(batch, "text_hash").take(at), pa.array(position, pa.int32()), pa.array(count, pa.int32())],
                ["h1", "h2", "id", "text_hash", "position", "n_lines"],
            )

    return docs.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, ROW)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_lines, n_dropped, keep) of each document that loses lines; keep is a zlib-compressed bitmap,
    first line in the lowest bit."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = F.col("id").desc_nulls_last()
    rows = line_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), min_chars)
    order = ["h1", "h2", down, "text_hash", "position"]
    rows = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("part", F.spark_partition_id()))

    key = F.struct(*KEY)
    ends = rows.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()  # a row for each partition
    ends = sorted((x["part"], tuple(x["first"]), tuple(x["last"])) for x in ends)
    across = sorted({a[2] for a, b in zip(ends, ends[1:]) if a[2] == b[1]})
    shared: dict[tuple[int, int], tuple[int | None, int]] = {}
    if across:
        keys = spark.createDataFrame(across, "h1 long, h2 long")
        per_doc = rows.join(F.broadcast(keys), KEY).groupBy(*KEY, "id").agg(F.lit(1).alias("_"))  # fewer keys than partitions
        found = per_doc.groupBy(*KEY).agg(F.max("id").alias("id"), F.count("*").alias("n")).collect()
        shared = {(x["h1"], x["h2"]): (x["id"], x["n"]) for x in found}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, held = None, []  # the last key: (key, documents so far, the first, the last); rows of it that are not decided
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = (column(batch, x).to_numpy() for x in KEY)
            ids = column(batch, "id")
            null, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_key | np.r_[True, (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])]
            goes_on = carried is not None and carried[0] == (int(h1[0]), int(h2[0]))
            if goes_on:
                new_doc[0] = carried[3] != (int(doc[0]), bool(null[0]))
            else:
                held = []  # of a key that too few documents hold
            start = np.flatnonzero(new_key)
            group = np.cumsum(new_key) - 1
            count = np.add.reduceat(new_doc, start, dtype=np.int64)
            first, first_null = doc[start], null[start]
            if goes_on:
                count[0] += carried[1]
                first[0], first_null[0] = carried[2]
            if shared:
                for g in np.flatnonzero(np.isin(h1[start], [k[0] for k in shared])):
                    if (entry := shared.get((int(h1[start[g]]), int(h2[start[g]])))) is not None:
                        first[g], first_null[g], count[g] = entry[0] or 0, entry[0] is None, max(entry[1], count[g])
            carried = (int(h1[-1]), int(h2[-1])), int(count[-1]), (int(first[-1]), bool(first_null[-1])), (int(doc[-1]), bool(null[-1]))
            rows = batch.select(["id", "text_hash", "position", "n_lines"])
            later = (doc != first[group]) | (null != first_null[group])
            if held and count[0] >= min_docs:
                yield from held
                held = []
            elif held and len(start) > 1:
                held = []
            open_ = (group == group[-1]) & (count[-1] < min_docs)
            if (wait := later & open_).any():
                held.append(rows.filter(pa.array(wait)))
            if (drop := later & (count[group] >= min_docs)).any():
                yield rows.filter(pa.array(drop))

    def bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, lost = [], []
            for n, at in zip(column(batch, "n_lines").to_pylist(), column(batch, "positions")):
                flags = np.ones(n, np.uint8)
                flags[at.values.to_numpy()] = 0
                keep.append(zlib.compress(np.packbits(flags, bitorder="little").tobytes()))
                lost.append(n - int(flags.sum()))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "text_hash"), column(batch, "n_lines"), pa.array(lost, pa.int32()), pa.array(keep, pa.binary())], ["id", "text_hash", "n_lines", "n_dropped", "keep"])

    dropped = rows.drop("part").mapInArrow(run, "id long, text_hash long, position int, n_lines int")
    lists = dropped.groupBy("id", "text_hash").agg(F.first("n_lines").alias("n_lines"), F.collect_set("position").alias("positions"))  # at most a document's lines
    return lists.mapInArrow(bitmaps, "id long, text_hash long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept) of each document; kept is its text without the dropped lines, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, lost, kept = [], [], []
            for data, keep in zip(texts(column(batch, "text")), column(batch, "keep")):
                keep = keep.as_py()
                if keep is None:
                    n.append(data.count(b"\n") + 1)
                    lost.append(0)
                    kept.append(data)
                else:
                    own = data.split(b"\n")
                    flags = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little", count=len(own))
                    n.append(len(own))
                    lost.append(len(own) - int(flags.sum()))
                    kept.append(b"\n".join(x for x, f in zip(own, flags) if f))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_lines", "n_dropped", "kept"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    b = bitmaps.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "keep")
    both = docs.join(b, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return both.select("id", "text", "keep").mapInArrow(run, "id long, n_lines long, n_dropped long, kept binary")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
s AS (SELECT line_key, max(doc_id) AS keeper FROM k WHERE length(line_key) >= 20 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, s.keeper IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM k LEFT JOIN s ON k.line_key = s.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
