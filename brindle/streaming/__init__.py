"""Streams over tables: windows, deduplication, joins, state and timers, run until all rows are read.

Results go to Parquet through foreachBatch: appended rows as they come, complete results batch over batch.  Nothing passes
through the driver, and a batch that is run again overwrites what it wrote before, so that a stream that is stopped and
started again has each batch once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.scratch import folder
from brindle.sources import feed

#: Rows that a task of a stream reads at most.
TASK_ROWS = 1 << 17


def arriving(df: DataFrame, *order: str, batches: int = 4, checkpoint: str | None = None) -> DataFrame:
    """A stream of df's rows in an order, usually of time, in about `batches` micro-batches; nulls come first.

    The rows are sorted by many tasks, and each batch is read by many tasks (brindle.sources.feed); no task has more than a
    part of the range or TASK_ROWS rows.  checkpoint: the stream's checkpoint folder, if it is to go on where it was stopped.
    For watermarks, times must be timestamps with a zone.
    """
    spark = df.sparkSession
    where = folder(spark, "arriving")
    by = [F.col(c).asc_nulls_first() for c in order]
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(where)
    return replayed(spark, where, df.schema, batches, checkpoint)


def replayed(spark: SparkSession, where: str, schema, batches: int, checkpoint: str | None = None) -> DataFrame:
    """The rows of a folder of Parquet files, in the order of files and rows."""
    feed.register(spark)
    rows = spark.read.schema(schema).parquet(where).count()
    stream = spark.readStream.format("brindle_feed").schema(schema).option("rowsPerBatch", max(1, -(-rows // batches))).option("rowsPerTask", TASK_ROWS)
    return (stream.option("checkpoint", checkpoint) if checkpoint else stream).load(where)


def finish(stream: DataFrame, mode: str, timed: bool = False) -> DataFrame:
    """Runs the stream until all that is there is read; its rows (append, update) or its last result (complete).  timed: it has
    processing time."""
    return in_runs(stream.sparkSession, lambda _: stream, mode, timed=timed)


def read_all(query: StreamingQuery, timed: bool) -> None:
    """Waits until all rows are read.  A stream with processing time always has a next batch, since its timers may expire; it is done
    when a batch had no rows after others had some."""
    while timed and query.isActive and query.exception() is None:
        rows = [p["numInputRows"] for p in query.recentProgress]
        if any(rows) and not rows[-1]:
            return
        time.sleep(0.05)
    query.processAllAvailable()


def in_runs(spark: SparkSession, make: Callable[[str], DataFrame], mode: str, broken: tuple[int, ...] = (), progress: list | None = None, timed: bool = False) -> DataFrame:
    """The result of a stream that breaks off in each of the batches `broken`, after it has written its rows and before the batch
    is known to be done, and is started again from its checkpoint each time.  make gets the checkpoint's path and gives the
    stream.  progress: a list that gets what the runs report of their batches.
    """
    where = folder(spark, "stream")
    checkpoint, schema = f"{where}/checkpoint", None
    for k in [*broken, None]:
        stream = make(checkpoint)
        schema = stream.schema

        def write(batch: DataFrame, number: int, k: int | None = k) -> None:
            batch.write.mode("overwrite").parquet(f"{where}/rows/batch={0 if mode == 'complete' else number}")
            if number == k:
                raise InterruptedError(f"broken off in batch {k}")

        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).start()
        try:
            read_all(query, timed)
        except StreamingQueryException as e:
            if "broken off in batch" not in str(e):
                raise
        finally:
            if progress is not None:
                progress += query.recentProgress
            query.stop()
    return spark.read.schema(schema).parquet(f"{where}/rows").drop("batch")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with a time that watermarks take."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sliding(stream: DataFrame, width: str, slide: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"))


def by_session(stream: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def first_of_each(stream: DataFrame, keys: list[str], late: str = "60 days") -> DataFrame:
    """Rows without those that repeat a key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def clicks_before_purchases(stream: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """Stream-stream join: purchases with the clicks of the same user shortly before; state goes by both watermarks."""
    clicks = stream.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("click_user"), F.col("ts").alias("click_ts")).withWatermark("click_ts", late)
    purchases = stream.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("purchase_ts")).withWatermark("purchase_ts", late)
    near = f"user_id = click_user AND click_ts <= purchase_ts AND click_ts >= purchase_ts - interval {within}"
    return purchases.join(clicks, F.expr(near))


def with_static(stream: DataFrame, static: DataFrame) -> DataFrame:
    """Stream-static join: events with the segment of the customer of that number."""
    return stream.join(static.select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


#: Blocks of users that have their state together: a call of Python for each user would cost more than the sums.
BLOCKS = 1024
TOTALS = "users array<long>, n array<long>, total array<double>"


def in_blocks(stream: DataFrame) -> DataFrame:
    """The stream with a block for each user, by hash; the null user is alone."""
    return stream.select("user_id", "value", F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(BLOCKS))).alias("block"))


def add_events(batches: Iterator[pd.DataFrame], state: tuple | None) -> tuple[tuple, pd.DataFrame]:
    """A block's state (users, n, total) after the events, and the rows of the users that are in them."""
    names, parts = ["user_id", "n", "total"], []
    for pdf in batches:
        new = pdf.groupby("user_id", dropna=False)["value"].agg(["size", "sum"]).reset_index()
        parts.append(new.set_axis(names, axis=1))
    seen = pd.concat(parts)["user_id"]
    if state is not None:
        users = np.array([np.nan if u is None else u for u in state[0]], seen.dtype)
        parts.insert(0, pd.DataFrame({"user_id": users, "n": np.array(state[1], np.int64), "total": np.array(state[2], np.float64)}))
    now = pd.concat(parts).groupby("user_id", dropna=False)[["n", "total"]].sum().reset_index()
    users = [None if u != u else int(u) for u in now["user_id"].tolist()]
    out = pd.DataFrame({"user_id": pd.array(users, "Int64"), "n": now["n"], "total": now["total"]})
    return (users, now["n"].tolist(), now["total"].tolist()), out[now["user_id"].isin(seen)]


def count_events(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, rows = add_events(batches, state.get if state.exists else None)
    state.update(now)
    yield rows


def running_totals(stream: DataFrame) -> DataFrame:
    """Own state of the users, as a row for each micro-batch that a user is in."""
    return in_blocks(stream).groupBy("block").applyInPandasWithState(count_events, "user_id long, n long, total double", TOTALS, "update", GroupStateTimeout.NoTimeout)


class BlockTotals(StatefulProcessor):
    """The same with a named state variable."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, out = add_events(rows, self.state.get() if self.state.exists() else None)
        self.state.update(now)
        yield out

    def close(self) -> None:
        pass


class Totals(StatefulProcessor):
    """A user's state that is forgotten when it isn't written for ttl_ms; so each user has one of its own."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n long, total double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for pdf in rows:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals_named(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Needs the RocksDB state store."""
    kind = {"outputStructType": "user_id long, n long, total double", "outputMode": "Update"}
    if ttl_ms:
        return stream.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Totals(ttl_ms), timeMode="ProcessingTime", **kind)
    return in_blocks(stream).groupBy("block").transformWithStateInPandas(statefulProcessor=BlockTotals(), timeMode="None", **kind)


class Inactivity(StatefulProcessor):
    """A key's sessions, each given out when it is closed: by a later event of the key, or by a timer when the watermark has passed
    its last event by the gap.  The state is the open session; times are microseconds."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "started long, ended long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([pdf["us"].to_numpy() for pdf in rows]))
        edges = np.flatnonzero(np.diff(times) >= self.gap_ms * 1000) + 1
        found = [(int(x[0]), int(x[-1]), len(x)) for x in np.split(times, edges)]
        if self.state.exists():
            found.append(tuple(map(int, self.state.get())))
        merged: list[tuple[int, int, int]] = []
        for started, ended, n in sorted(found):
            if merged and started - merged[-1][1] < self.gap_ms * 1000:
                last = merged.pop()
                started, ended, n = last[0], max(last[1], ended), last[2] + n
            merged.append((started, ended, n))
        *closed, now = merged
        self.state.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now[1] // 1000 + self.gap_ms)
        if closed:
            yield self.rows_of(key, closed, "event")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            now = tuple(map(int, self.state.get()))
            self.state.clear()
            yield self.rows_of(key, [now], "timer")

    @staticmethod
    def rows_of(key, sessions: list[tuple[int, int, int]], by: str) -> pd.DataFrame:
        started, ended, n = zip(*sessions)
        return pd.DataFrame({"user_id": [key[0]] * len(n), "started": started, "ended": ended, "n": n, "closed_by": by})

    def close(self) -> None:
        pass


def closed_sessions(stream: DataFrame, gap_ms: int, late: str = "1 day") -> DataFrame:
    """Sessions of each user as they are closed.  Needs the RocksDB state store.  Times go to Python as microseconds, whatever the
    session's time zone."""
    out = stream.select("user_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Inactivity(gap_ms), outputStructType="user_id long, started long, ended long, n long, closed_by string", outputMode="Append", timeMode="EventTime"
    )
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def disordered(df: DataFrame, at: str, delay: Column, *then: str, batches: int = 10) -> DataFrame:
    """A stream of df's rows in the order in which they arrive, `delay` behind their time."""
    return arriving(df.withColumn("_arrival", F.col(at) + delay), "_arrival", *then, batches=batches).drop("_arrival")
