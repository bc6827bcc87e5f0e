"""Streams, each run over all events in several micro-batches."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from brindle import streaming as S
from brindle.plans import query
from brindle.plans.windows import SESSIONS
from brindle.sources import table


def ntz(c: str) -> F.Column:
    return F.col(c).cast("timestamp_ntz")


def all_events(spark, sf_dir, checkpoint=None):
    return S.arriving(S.events(spark, sf_dir), "ts", "event_id", checkpoint=checkpoint)


@contextmanager
def rocksdb(spark):
    """The state store that named state needs."""
    key, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, own)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query("s09_file_stream", "SELECT event_id, event_type FROM events")
def s09_file_stream(spark, sf_dir):
    return S.finish(all_events(spark, sf_dir).select("event_id", "event_type"), "append")


@query("t02_tumbling_append", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL
HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""")
def t02_tumbling_append(spark, sf_dir):
    """Windows that the watermark has closed; it stands a day behind the last event."""
    out = S.finish(S.tumbling(all_events(spark, sf_dir), "1 hour"), "append")
    return out.select(ntz("window.start").alias("started"), "event_type", "n")


@query("t03_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def t03_tumbling(spark, sf_dir):
    return S.finish(S.tumbling(all_events(spark, sf_dir), "1 hour"), "complete").select(ntz("window.start").alias("started"), "event_type", "n")


@query("t04_sliding", "SELECT started, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS started FROM events, (VALUES (0), (1)) AS t(k)) GROUP BY started")
def t04_sliding(spark, sf_dir):
    return S.finish(S.sliding(all_events(spark, sf_dir), "2 hours", "1 hour"), "complete").select(ntz("window.start").alias("started"), "n")


@query("t05_session", SESSIONS)
def t05_session(spark, sf_dir):
    return S.finish(S.by_session(all_events(spark, sf_dir), "6 hours"), "complete").select("user_id", ntz("session_window.start").alias("started"), "n")


@query("t06_dedup_in_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def t06_dedup_in_watermark(spark, sf_dir):
    return S.finish(S.first_of_each(all_events(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query("t07_stream_stream_join", """
SELECT p.event_id AS purchase_id, c.event_id AS click_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 2 HOUR
WHERE p.event_type = 'purchase' AND c.event_type = 'click'""")
def t07_stream_stream_join(spark, sf_dir):
    return S.finish(S.clicks_before_purchases(all_events(spark, sf_dir), "2 hours"), "append").select("purchase_id", "click_id")


TOTALS = "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id"


@query("t08_state", TOTALS)
def t08_state(spark, sf_dir):
    out = S.finish(S.running_totals(all_events(spark, sf_dir)), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("t09_named_state", TOTALS)
def t09_named_state(spark, sf_dir):
    with rocksdb(spark):
        out = S.finish(S.running_totals_named(all_events(spark, sf_dir)), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("t10_late_events", "SELECT TIMESTAMP '2024-01-01 00:00:00' AS started, CAST(2 AS BIGINT) AS n")
def t10_late_events(spark, sf_dir):
    """Inline events in five micro-batches; the last one comes after its window has closed, and is dropped."""
    rows = [(minutes, "a") for minutes in (0, 10, 200, 210, 5)]
    events = spark.createDataFrame(rows, "minutes int, event_type string")
    events = events.withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01' + make_interval(0, 0, 0, 0, 0, minutes)").cast("timestamp"))
    where = S.folder(spark, "late")
    for minutes, _ in rows:
        events.filter(F.col("minutes") == minutes).coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(where)
    return S.finish(S.tumbling(stream, "1 hour", late="1 hour"), "append").select(ntz("window.start").alias("started"), "n")


@query("t11_stream_static_join", "SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment")
def t11_stream_static_join(spark, sf_dir):
    return S.finish(S.with_static(all_events(spark, sf_dir), table(spark, sf_dir, "customer")), "complete")


@query("t12_stopped_and_resumed", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL
HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""")
def t12_stopped_and_resumed(spark, sf_dir):
    """T2 broken off twice, between the writing of a batch and its end, and started again from its checkpoint: no row is lost or doubled."""
    rows = S.events(spark, sf_dir)
    where = S.folder(spark, "arriving")
    rows.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(where)
    out = S.in_runs(spark, lambda checkpoint: S.tumbling(S.replayed(spark, where, rows.schema, 6, checkpoint), "1 hour"), "append", broken=(1, 3))
    return out.select(ntz("window.start").alias("started"), "event_type", "n")


@query("t13_closed_sessions", """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m),
g AS (SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n, lead(min(ts)) OVER (PARTITION BY user_id ORDER BY session) AS next FROM s GROUP BY user_id, session)
SELECT user_id, started, ended, n FROM g WHERE next IS NOT NULL OR date_trunc('millisecond', ended) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""")
def t13_closed_sessions(spark, sf_dir):
    """Own state with event-time timers: what is still open at the end isn't given out."""
    with rocksdb(spark):
        out = S.finish(S.closed_sessions(all_events(spark, sf_dir), 6 * 3_600_000), "append")
    return out.select("user_id", ntz("started").alias("started"), ntz("ended").alias("ended"), "n")


@query("t10_disordered_events", """
WITH a AS (SELECT *, row_number() OVER (ORDER BY ts + CASE WHEN event_id % 5 = 0 THEN INTERVAL 5 DAY ELSE INTERVAL 0 DAY END, event_id) - 1 AS i, count(*) OVER () AS total FROM events),
b AS (SELECT *, i // ((total + 9) // 10) AS batch FROM a),
w AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS seen FROM b GROUP BY batch)
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, count(*) AS n FROM b JOIN w USING (batch)
WHERE seen IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > date_trunc('millisecond', seen) - INTERVAL 1 DAY GROUP BY 1""")
def t10_disordered_events(spark, sf_dir):
    """A fifth of the events arrives five days late, when the watermark has closed most of their windows.  It stands a day behind the
    latest event of the batches before the last one."""
    stream = S.disordered(S.events(spark, sf_dir), "ts", F.expr("CASE WHEN event_id % 5 = 0 THEN INTERVAL '5' DAY ELSE INTERVAL '0' DAY END"), "event_id")
    counts = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return S.finish(counts, "update").groupBy(ntz("window.start").alias("started")).agg(F.max("n").alias("n"))
