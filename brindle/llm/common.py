"""What the operators of this subpackage share: shared folders, lineage cuts, text access and ranks."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and \t \n \v \f \r, which are also what bytes.split() and bytes.strip() take.
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: One word, as a regular expression of Java.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are taken apart in pieces of about this many bytes, so that a huge one needs little memory.
PIECE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir.  A temporary one stands in where that is unset and executors are
    threads of this process (local tests); on a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder: computed once, partitions and their order kept, safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet into the shared folder and read again: computed once and compressed, for what several steps read."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what written() made, once nothing will read it any more."""
    for df in tables:
        remove(df.sparkSession, df.written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each row, null as none.  One row at a time is copied out of Arrow's buffer."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from texts(chunk)
        return
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def words(data: bytes) -> Iterator[list[bytes]]:
    """Lists of the words of data, in order.  Cut at white space only, so a word is never split."""
    at = 0
    while at < len(data):
        space = SPACE.search(data, at + PIECE) if len(data) > at + 2 * PIECE else None
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def give_back() -> None:
    """Gives the process's free memory back to the system: the C library keeps what small arrays had."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives its free memory back at the end of a task; workers live on for other stages."""

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return own


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, without copies, so that what Python holds of each stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def identifier(df: DataFrame, name: str) -> Column:
    """A column of identifiers as long; other types than whole numbers are refused."""
    kind = df.schema[name].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"identifiers must be whole numbers, and {name} is {kind.simpleString()}: number the rows first, and join the names to the result")
    return F.col(name).cast("long")


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of df has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def text_key(col: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: together they tell texts apart (128 bits), in 16 bytes."""
    return F.xxhash64(col), F.xxhash64(F.lit("second"), col)


def chunks_for(rows: int, of: int = 100_000) -> int:
    """How many chunks, a power of two, so that a chunk of all rows has about `of`: windows over chunks don't grow with the table."""
    return 1 << max(4, (rows // of).bit_length())


def hash_chunk(*cols: Column, chunks: int) -> Column:
    """A chunk number from 0; splits hot groups into parts of bounded share."""
    return F.pmod(F.xxhash64(F.lit("chunk"), *cols), F.lit(chunks)).cast("int")


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows of df, by the smallest hashes of a column; the same for the same rows, whatever the partitions.

    A share of about 2 n / count is taken first, so that tasks send the driver a few candidates each, not n.
    """
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30))
    share = min(1.0, 2 * n / max(1, df.count()))
    return df.filter(draw <= int(share * (1 << 30))).orderBy(draw, key, *(c for c in df.columns if c != key)).limit(n)


def ranks(df: DataFrame, keys: list[str], chunk: str, order: list[Column], name: str, weight: Column | None = None) -> DataFrame:
    """Adds `name`: the sum of weight (1 for each row, if none) over the rows before this one in its group of keys,
    ordered by chunk and then by order.  Keys and chunk must not be null.

    No task sees a whole group: sums by (keys, chunk) come from a partial aggregation, are summed up over the
    few chunks of each group, and the rows are then numbered within (keys, chunk) only, in the same partitions as the join.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*keys, chunk).agg(F.sum(weight).alias("_n"))
    per = per.select(*keys, chunk, F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_from"))
    rows = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(weight).over(rows), F.lit(0).cast("long")))
    # a merge join: the size of exploded rows is underestimated, and they must not be broadcast
    return df.join(per.hint("merge"), [*keys, chunk]).withColumn(name, F.col("_from") + F.col("_in")).drop("_from", "_in")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): a row (node, root) for each linked node but the smallest of
    its component, which is the root.

    Alternating large-star and small-star rounds.  Minima come from partial aggregations and return by joins whose
    hot keys adaptive execution splits; both stars of a round are checkpointed.  No links give no rows.
    """
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last = cut(now), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # cut, since the small stars read it twice and would have it three times in their plan, which the driver holds
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            return spark.createDataFrame([], "node long, root long").unionByName(now.select(F.col("u").alias("node"), F.col("v").alias("root")))
        last = seen
