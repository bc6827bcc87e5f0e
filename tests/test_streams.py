"""The Python sink, the feed, recovery, timers and state that expires."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from brindle import streaming as S
from brindle.plans.streams import rocksdb
from brindle.scratch import folder
from brindle.sources import feed, parts
from brindle.sources.parts import filesystem, manifests, names_in

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def read_parts(spark, where, schema):
    return spark.read.format("brindle_parts").schema(schema).load(where)


def parts_left(where):
    fs, path = filesystem(where)
    return len(manifests(fs, path)), len([x for x in names_in(fs, path) if x.endswith(".parquet")])


def test_sink_appends_and_overwrites(spark):
    parts.register(spark)
    where = folder(spark, "parts")
    a = spark.createDataFrame([(1, None, START, [1.5, None]), (None, "é", None, None)], "i long, s string, t timestamp, a array<double>").repartition(2)
    b = spark.createDataFrame([(i, "x", START, []) for i in range(5000)], a.schema).repartition(3)
    write = lambda df, mode: df.write.format("brindle_parts").mode(mode).save(where)
    write(a, "append")
    write(b, "append")
    assert rows_of(read_parts(spark, where, a.schema)) == rows_of(a.union(b)) and parts_left(where)[0] == 2
    assert read_parts(spark, where, a.schema).select("s").distinct().count() == 3
    write(a, "overwrite")
    assert rows_of(read_parts(spark, where, a.schema)) == rows_of(a) and parts_left(where) == (1, 2)
    write(b.limit(0), "overwrite")
    assert rows_of(read_parts(spark, where, a.schema)) == []


def test_a_failed_task_leaves_nothing_to_be_seen(spark):
    parts.register(spark)
    where = folder(spark, "parts")
    good = spark.range(1000).repartition(4)
    good.write.format("brindle_parts").mode("append").save(where)
    before = parts_left(where)

    def fails(batches):
        for n, batch in enumerate(batches):
            yield batch
            if batch.column(0).to_pylist()[0] >= 750:
                raise RuntimeError("a broken task")

    bad = spark.range(0, 1000, 1, 4).mapInArrow(fails, "id long")
    with pytest.raises(Exception, match="a broken task"):
        bad.write.format("brindle_parts").mode("append").save(where)
    assert read_parts(spark, where, "id long").count() == 1000
    assert parts_left(where)[0] == before[0]
    parts.remove_unseen(where)
    assert parts_left(where) == before and read_parts(spark, where, "id long").count() == 1000


@pytest.mark.parametrize("batches,task", [(1, 1000), (3, 7), (20, 4)])
def test_feed_gives_each_row_once_in_order(spark, monkeypatch, batches, task):
    monkeypatch.setattr(S, "TASK_ROWS", task)
    df = spark.createDataFrame([(None if i % 17 == 0 else (i * 37) % 101, i, "x" * (i % 3)) for i in range(100)], "t int, i int, s string")
    stream = S.arriving(df, "t", batches=batches)
    seen = S.in_runs(spark, lambda _: stream.withColumn("task", F.spark_partition_id()), "append", progress=(progress := []))
    got = seen.collect()
    assert sorted((r["t"] or -1, r["i"], r["s"]) for r in got) == sorted((r["t"] or -1, r["i"], r["s"]) for r in df.collect())
    size = -(-100 // batches)
    counts = [p["numInputRows"] for p in progress if p["numInputRows"]]
    assert counts == [size] * (100 // size) + ([100 % size] if 100 % size else [])
    if task < size:
        assert len({r["task"] for r in got}) >= size // task


def test_feed_reads_by_row_groups(spark):
    """Slices that begin and end within row groups and files."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    where = folder(spark, "groups").removeprefix("file://")
    filesystem(where)[0].create_dir(where)
    for k in range(3):
        pq.write_table(pa.table({"i": list(range(100 * k, 100 * k + 100))}), f"{where}/part-{k}.parquet", row_group_size=9)
    from pyspark.sql.types import LongType, StructType

    reader = feed.FeedReader({"path": where, "rowsPerBatch": "70", "rowsPerTask": "13"}, StructType().add("i", LongType()))
    got, at = [], reader.initialOffset()
    while (end := reader.latestOffset()) != at:
        slices = reader.partitions(at, end)
        assert all(s.last - s.first <= 13 for s in slices)
        got += [x for s in slices for b in reader.read(s) for x in b.column(0).to_pylist()]
        at = end
    assert got == list(range(300))


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_broken_off_and_resumed(spark, mode):
    """A batch that was written and not ended is run again: its rows count once, also after several breaks in a row."""
    df = spark.createDataFrame([(START + timedelta(minutes=i), "ab"[i % 2]) for i in range(600)], "ts timestamp, event_type string")
    where = folder(spark, "rows")
    df.repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(where)
    make = lambda broken: S.in_runs(spark, lambda c: S.tumbling(S.replayed(spark, where, df.schema, 5, c), "1 hour", "1 hour"), mode, broken)
    assert rows_of(make((0, 3, 3))) == rows_of(make(()))


def test_other_failures_are_not_taken_for_breaks(spark):
    df = spark.createDataFrame([(1, 0)], "t int, i int")
    stream = S.arriving(df, "t").withColumn("x", F.expr("CASE WHEN i = 0 THEN raise_error('odd') END"))
    with pytest.raises(Exception, match="odd"):
        S.finish(stream, "append")


def test_late_rows_are_counted(spark):
    """Rows behind the watermark are dropped, and the stream says how many groups of them."""
    df = spark.createDataFrame([(START + timedelta(minutes=10 * i), i) for i in range(400)], "ts timestamp, i int")
    stream = S.disordered(df, "ts", F.expr("CASE WHEN i = 5 THEN INTERVAL '40' HOUR ELSE INTERVAL '0' HOUR END"), "i", batches=8)
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    out = S.in_runs(spark, lambda _: counts, "update", progress=(progress := []))
    kept = {r["window"]["start"]: r["n"] for r in out.groupBy("window").agg(F.max("n").alias("n")).collect()}
    assert sum(kept.values()) == 399 and min(kept.values()) >= 4
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) == 1


def test_sessions_close_by_events_and_by_timers(spark):
    rng = random.Random(3)
    data = sorted((START + timedelta(minutes=rng.randrange(6000)), rng.randrange(4)) for _ in range(300)) + [(START + timedelta(minutes=6000 + i), 9) for i in range(40)]
    data += [(START + timedelta(days=30), 9)]
    with rocksdb(spark):
        out = S.finish(S.closed_sessions(S.arriving(spark.createDataFrame(data, "ts timestamp, user_id long"), "ts", "user_id", batches=12), 30 * 60_000, "1 minute"), "append").collect()
    expected = []
    for k in range(4):
        times = sorted(t for t, u in data if u == k)
        for i, t in enumerate(times):
            if i == 0 or t - times[i - 1] >= timedelta(minutes=30):
                expected.append([k, t, t, 0])
            expected[-1][2:] = [t, expected[-1][3] + 1]
    expected.append([9, START + timedelta(minutes=6000), START + timedelta(minutes=6039), 40])  # the last event's session stays open
    naive = lambda t: t.replace(tzinfo=None)
    assert sorted((r["user_id"], naive(r["started"]), naive(r["ended"]), r["n"]) for r in out) == sorted((k, naive(a), naive(b), n) for k, a, b, n in expected)
    assert {r["closed_by"] for r in out} == {"event", "timer"}


@pytest.mark.parametrize("ttl,last", [(3_600_000, 6), (1, 2)])
def test_state_expires(spark, ttl, last):
    """Six rows of a key in three batches: a state that lives for an hour adds up, one that lives for a millisecond begins anew."""
    df = spark.createDataFrame([(i, 1, 1.0) for i in range(6)], "t int, user_id long, value double")
    with rocksdb(spark):
        out = S.finish(S.running_totals_named(S.arriving(df, "t", batches=3), ttl), "update", timed=True).collect()
    assert max(r["n"] for r in out) == last


def test_folders_are_pruned_while_the_query_runs(spark, sf_dir):
    from brindle.plans.io import s08_dynamic_pruning

    assert "dynamicpruning" in s08_dynamic_pruning(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("named", [False, True])
def test_totals_of_many_users_take_few_calls(spark, monkeypatch, named):
    """Users share their state by blocks, over micro-batches; a null user and large numbers are told apart."""
    monkeypatch.setattr(S, "BLOCKS", 3)
    big = 2**60
    rows = [(i, None if i % 50 == 0 else big + i % 40 if i % 3 else i % 40, float(i % 13)) for i in range(800)]
    stream = S.arriving(spark.createDataFrame(rows, "event_id long, user_id long, value double"), "event_id")
    with rocksdb(spark):
        out = S.finish((S.running_totals_named if named else S.running_totals)(stream), "update")
    got = {r["user_id"]: (r["n"], r["total"]) for r in out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total")).collect()}
    own = lambda u: [v for _, w, v in rows if w == u]
    assert got == {u: (len(own(u)), sum(own(u))) for u in {r[1] for r in rows}}
    wanted = spark.createDataFrame([(i, i) for i in range(9)], "user_id long, value long")
    assert S.in_blocks(wanted).select("block").distinct().count() <= 3
