"""Operators on rows that the tables don't have: nulls, ties, late events, edges of ranges."""

import os
import random
import shutil
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle import streaming as S
from brindle.functions import cosine, dot, json_int, sample_skewness, word_count
from brindle.operators.joins import asof_join, asof_join_matches, interval_join, salted_join
from brindle.operators.windows import over_groups, qualify, sessions, sum_excluding_current, top_k
from brindle.sources import round_trip, write_bucketed, write_partitioned

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def events(spark, rows):
    return spark.createDataFrame([(k, at(m), v) for k, m, v in rows], "k string, ts timestamp_ntz, v int")


@pytest.mark.parametrize("equal", [True, False])
def test_asof_join(spark, equal):
    rng = random.Random(1)
    left = [(rng.choice("abc"), rng.randint(0, 60), i) for i in range(80)] + [(None, 5, 900), ("only left", 5, 901)]
    right = [(rng.choice("abd"), rng.randint(0, 60), i) for i in range(60)] + [(None, 1, 70)]
    found = asof_join(events(spark, left), events(spark, right).withColumnRenamed("v", "w"), ["k"], "ts", "ts", ["w"], allow_equal=equal).collect()
    best = {}
    for k, m, v in left:
        if k:
            ones = [(n, w) for j, n, w in right if j == k and (n <= m if equal else n < m)]
            best[v] = max(ones)[1] if ones else None
    assert len(found) == len(left)
    assert {x["v"]: x["w"] for x in found if x["k"]} == best
    if equal:
        other = asof_join_matches(events(spark, left), events(spark, right).withColumnRenamed("v", "w"), ["k"], "v", "ts", "ts", ["w"]).collect()
        assert {x["v"]: x["w"] for x in other if x["k"]} == best and len(other) == len(left)


def test_asof_join_tolerance(spark):
    left, right = events(spark, [("a", 10, 1), ("a", 30, 2)]), events(spark, [("a", 9, 7)]).withColumnRenamed("v", "w")
    assert {x["v"]: x["w"] for x in asof_join(left, right, ["k"], "ts", "ts", ["w"], tolerance="5 minutes").collect()} == {1: 7, 2: None}


def test_interval_join(spark):
    left, right = events(spark, [("a", 10, 1), (None, 10, 2)]), events(spark, [("a", 5, 1), ("a", 4, 2), ("a", 12, 3), ("b", 10, 4), (None, 10, 5)]).select("k", F.col("ts").alias("t"), F.col("v").alias("w"))
    assert sorted(x["w"] for x in interval_join(left, right, ["k"], "ts", "t", "5 minutes", "2 minutes").collect()) == [1, 3]


def test_salted_join(spark):
    large = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2)], "k string, i int")
    small = spark.createDataFrame([("hot", 1.0), ("hot", 2.0), ("cold", 3.0), (None, 4.0)], "k string, w double")
    assert sorted(salted_join(large, small, ["k"], 7).collect()) == sorted(large.join(small, "k").collect())
    small = small.unionByName(spark.createDataFrame([("nowhere", 5.0)], "k string, w double"))
    for how in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        assert sorted(map(str, salted_join(large, small, ["k"], 7, how).collect())) == sorted(map(str, large.join(small, "k", how).collect())), how


def test_windows(spark):
    df = events(spark, [("a", 0, 1), ("a", 0, 2), ("a", 5, None), ("a", 9, 4), ("b", 1, 9)])
    assert {(x["k"], x["v"]) for x in top_k(df, ["k"], [F.desc_nulls_last("v")], 2).collect()} == {("a", 4), ("a", 2), ("b", 9)}
    assert qualify(df, F.count("*").over(__import__("pyspark").sql.Window.partitionBy("k")), "_q = 1").count() == 1
    groups = over_groups(df, ["k"], "ts", F.count("*"), 1, 0, "n").collect()
    assert sorted((x["k"], x["ts"], x["n"]) for x in groups) == [("a", at(0), 2), ("a", at(0), 2), ("a", at(5), 3), ("a", at(9), 2), ("b", at(1), 1)]
    others = sum_excluding_current(df, ["k"], ["ts", "v"], "v", 1, 1, "s").collect()
    assert {(x["k"], x["v"]): x["s"] for x in others} == {("a", 1): 2, ("a", 2): 1, ("a", None): 6, ("a", 4): None, ("b", 9): None}
    found = sessions(df, ["k"], "ts", "5 minutes").collect()
    assert sorted((x["k"], x["started"], x["n"]) for x in found) == [("a", at(0), 2), ("a", at(5), 2), ("b", at(1), 1)]


def test_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0], " a  b\n", '{"k": 7}'), ([0.0, 0.0], [1.0, 1.0], None, "{}")], "a array<double>, b array<double>, t string, j string")
    rows = df.select(dot(F.col("a"), F.col("b")).alias("d"), cosine(F.col("a"), F.col("b")).alias("c"), word_count(F.col("t")).alias("w"), json_int(F.col("j"), "k").alias("k")).collect()
    assert [tuple(r) for r in rows] == [(1.0, pytest.approx(1 / 50**0.5), 2, 7), (0.0, None, None, None)]
    assert spark.range(2).agg(sample_skewness(F.col("id")).alias("s")).first()["s"] is None


def test_late_events_are_dropped(spark):
    """Windows close an hour behind the last event; what comes later for them is lost."""
    minutes = [0, 10, 200, 210, 5]  # the last one is late
    files = [spark.createDataFrame([(at(m), "a")], "ts timestamp, event_type string") for m in minutes]
    where = S.folder(spark, "late")
    for f in files:
        f.coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).parquet(where)
    found = S.finish(S.tumbling(stream, "1 hour", late="1 hour"), "append").collect()
    assert [(x["window"]["start"], x["n"]) for x in found] == [(at(0), 2)]


def test_writes(spark):
    df = spark.createDataFrame([(1, None, 1.5), (2, "a,\"b\"", None), (None, "é", 0.0)], "i bigint, s string, d double")
    for kind in ("parquet", "orc", "json", "csv", "xml"):
        assert sorted(map(str, round_trip(df, kind).collect())) == sorted(map(str, df.collect()))
    parts = write_partitioned(spark.range(100).withColumn("p", F.col("id") % 3), ["p"])
    assert "PartitionFilters: [isnotnull(p" in parts.filter("p = 1")._jdf.queryExecution().executedPlan().toString()
    a, b = (write_bucketed(spark.range(1000), f"bucketed_{x}", "id", 4) for x in "ab")
    assert "Exchange" not in a.hint("merge").join(b, "id")._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_pushed_down(spark, sf_dir):
    from brindle.catalog import QUERIES

    plan = QUERIES["s01_parquet_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_the_rest_works_without_the_text_operators(tmp_path):
    root = Path(__file__).parents[1]
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, check=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6


def test_query_vectors_meet_all_rows(spark, sf_dir):
    from brindle.plans.scalars import f14_query_vectors, query_blocks

    ids = [x[0] for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    expected = sorted((a, b) for a in ids if a % 100 == 0 for b in ids)
    assert sorted((x["vec_id"], x["other"]) for x in f14_query_vectors(spark, sf_dir).collect()) == expected
    queries, rows = spark.range(7).withColumnRenamed("id", "vec_id"), spark.range(5)
    assert sorted(tuple(x)[::-1] for x in query_blocks(queries, rows, 2).collect()) == [(q, r) for q in range(7) for r in range(5)]


def test_pandas_gets_chunks_of_groups(spark, tmp_path, monkeypatch):
    from brindle.plans import udfs

    monkeypatch.setattr(udfs, "CHUNK_ROWS", 10)
    rows = [(i, "a" if i % 3 else None, float(i * i % 97)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    values = {t: [v for _, s, v in rows if s == t] for t in ("a", None)}
    found = udfs.x05_apply_in_pandas(spark, str(tmp_path))
    assert "chunk" in found._jdf.queryExecution().executedPlan().toString()
    assert {x["event_id"]: x["centered"] for x in found.collect()} == {i: round(v - sum(values[t]) / len(values[t]), 6) for i, t, v in rows}
    spreads = udfs.x03_pandas_aggregate(spark, str(tmp_path))
    assert "chunk" in spreads._jdf.queryExecution().executedPlan().toString()
    assert {x["event_type"]: x["s"] for x in spreads.collect()} == {t: max(v) - min(v) for t, v in values.items()}


def test_recursion_has_no_limit_of_rows(spark, sf_dir):
    """Spark's limit is a million rows; here it is set below the number of parts."""
    from brindle.catalog import QUERIES

    spark.conf.set("spark.sql.cteRecursionRowLimit", 50)
    try:
        depths = QUERIES["p15_recursive_tree"](spark, sf_dir).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey > 0").count()
    assert sum(x["n"] for x in depths) == parts > 50


def test_query_products_by_tiles(spark):
    """Odd vectors, strips of three, and the same doubles as the column functions give."""
    from brindle.functions import cosine, dot
    from brindle.operators.products import query_products

    odd = [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0], None, [], [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 1.0], [-0.1, 0.7, 1e30], [1e-30, 0.3, -0.2]]
    a = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "q long, v array<float>").repartition(2)
    b = spark.createDataFrame([(None if i == 3 else i, x) for i, x in enumerate([*odd, *odd])], "r int, w array<float>").repartition(3)
    found = query_products(a, b, side=3)
    assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString() and found.rdd.getNumPartitions() >= 28
    shorter = F.size("v") != F.size("w")
    plain = a.crossJoin(b).select("q", "r", F.when(~shorter, dot(F.col("v"), F.col("w"))).alias("dot"), F.when(~shorter, cosine(F.col("v"), F.col("w"))).alias("cosine"))
    assert sorted(map(str, map(tuple, found.select("q", "r", "dot", "cosine").collect()))) == sorted(map(str, map(tuple, plain.collect())))


def test_rounded_products(spark):
    """As Spark's round does, or null: halves as doubles have them, values beside them, signs, and what has no decimal."""
    import random

    import numpy as np

    from brindle.operators.products import rounded

    rng = random.Random(4)
    values = [k / 20000 + d for k in range(-50, 50) for d in (0.0, 1e-17, -1e-15, 1e-9, -1e-9, 1e-6)] + [rng.uniform(-1, 1) for _ in range(2000)] + [rng.uniform(-80000, 80000) for _ in range(500)] + [-0.0, 1e-300, 89999.99999, 99999.0, 1e30]
    own = rounded(np.array([*values, float("nan"), float("inf"), 0.5]), np.array([False] * (len(values) + 2) + [True]), 4).to_pylist()
    theirs = spark.createDataFrame([(i, x) for i, x in enumerate(values[:-2])], "i int, x double").select("i", F.round("x", 4).cast("decimal(9, 4)").alias("x")).collect()
    assert all(own[r["i"]] in (None, r["x"]) for r in theirs) and sum(x is None for x in own) < 700
    assert own[-5:] == [None] * 5
