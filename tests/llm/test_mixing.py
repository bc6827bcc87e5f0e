"""Mixing: against a plain version in Python, and against its SQL; targets, limits, reruns."""

from collections import Counter
from hashlib import md5

import pytest
from compare import of_duckdb, of_spark, oracle, types_that_differ

from brindle.llm.mixing import OP9_SQL, mix, mixed_documents, op9_mix_sources, pack, slots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, chunk string, block long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 5, "c", 1) for i, t, s in rows], SCHEMA)


def plain_targets(sizes):
    """By rounds: what is above a cap is shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        free -= over
    return target


ROWS = [(i, "w " * (i % 97), f"src{i % 5}") for i in range(2000)] + [(5000 + i, "v " * 3, "tiny") for i in range(4)] + [(6000, None, "none"), (6001, "", "none"), (6002, "x " * 40_000, None), (7, "w " * 7, "src2"), (None, "a b c", "src1")]


def test_mix(spark):
    found = mix(documents(spark, ROWS)).collect()
    assert len(found) == len(ROWS)
    sizes, taken = {}, {}
    for i, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    key = lambda s: "n" if s is None else f"s{s}"
    targets = {key(s): t for s, t in plain_targets(sizes).items()}
    for x in found:
        assert 0 <= x["taken"] <= 3 * x["size"]
        assert x["target"] == pytest.approx(targets[x["source_key"]])
        taken[x["source_key"]] = taken.get(x["source_key"], 0) + x["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.5
    again = mix(documents(spark, ROWS)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def number(*what):
    return int(md5(":".join(["mix", *("none" if x is None else str(x) for x in what)]).encode()).hexdigest()[:15], 16)


def plain_mix(rows, shard_slots, block=128):
    """(id, text) with its taken words and first shard, by lists of all words and all slots."""
    sources = {}
    for i, t, s in rows:
        sources.setdefault(s, []).append((i, t or ""))
    targets = plain_targets({s: sum(len(t.split()) for _, t in own) for s, own in sources.items()})
    slots_of, owners = {}, {}
    for s, own in sources.items():
        key = "n" if s is None else f"s{s}"
        order = []
        for k, (i, t) in enumerate(own):
            h = number("text", md5(t.encode()).hexdigest())
            order.append((number("order", i, h), i is not None, i or 0, h, k))
        owners[s] = [k for *_, k in sorted(order) for _ in own[k][1].split()]
        size = len(owners[s])
        n, left, slots_of[s] = -(-size // block), int(targets[s] + 0.5), []
        while left:
            x = len(slots_of[s]) % n
            for r in range(16):
                other = (number("key", key, r) % n - x) % n
                x = other if md5(f"mix:bit:{key}:{r}:{max(x, other)}".encode()).hexdigest() < "8" else x
            words = range(x * block, min(size, (x + 1) * block))[:left]
            slots_of[s].append(words)
            left -= len(words)
    shards = max(1, -(-sum(map(len, slots_of.values())) // shard_slots))
    order = sorted((number("shard", key, k), key, k) for s, own in slots_of.items() for key in ["n" if s is None else f"s{s}"] for k in range(len(own)))
    out = []
    for s, own in sources.items():
        drawn = [at // shard_slots for at, (_, key, _) in enumerate(order) if key == ("n" if s is None else f"s{s}")]
        taken, first = Counter(), {}
        for words, shard in zip(slots_of[s], drawn):
            for w in words:
                taken[owners[s][w]] += 1
                first[owners[s][w]] = min(shard, first.get(owners[s][w], shard))
        out += [(t, taken[k], first.get(k)) for k, (_, t) in enumerate(own)]
    return shards, sorted(map(str, out))


def test_against_a_plain_version(spark):
    rows = [(i, f"{i} " + "w " * (i * 7 % 300), f"src{i % 5}") for i in range(300)] + [(900 + i, "v " * 3, "tiny") for i in range(4)] + [(950, "one", "single"), (951, None, "none"), (952, "", None), (953, "x y " * 999, None), (None, "a b c", "src1"), (None, "a b c", "src1"), (3, "again", "src3")]
    shards, expected = plain_mix(rows, 16)
    found = mix(documents(spark, rows), shard_slots=16).collect()
    by_hash = {number("text", md5((t or "").encode()).hexdigest()): t or "" for _, t, _ in rows}
    assert shards > 5 and sorted(str((by_hash[x["text_hash"]], x["taken"], x["first_shard"])) for x in found) == expected


@pytest.mark.parametrize("words", [(100, 140, 100), (1, 2, 500), (128, 256, 129), (5, 0, 7)])
def test_small_sources_meet_their_targets(spark, words):
    found = mix(documents(spark, [(i, "w " * n, f"s{i}") for i, n in enumerate(words)])).collect()
    assert all(abs(x["taken"] - x["target"]) <= 0.5 and x["taken"] <= 3 * x["size"] for x in found)


def test_every_slot_has_a_block(spark):
    _, sources = pack(documents(spark, ROWS))
    found = slots(sources, shard_slots=64).collect()
    for s in sources.collect():
        own = [x for x in found if x["source_key"] == s["source_key"]]
        assert sorted(x["slot"] for x in own) == list(range(s["slots"]))
        uses = Counter(x["block"] for x in own)
        assert not uses or set(uses.values()) <= {s["slots"] // s["blocks"], s["slots"] // s["blocks"] + 1} and set(uses) <= set(range(s["blocks"]))
    per_shard = Counter(x["shard"] for x in found)
    *full, last = (per_shard[k] for k in range(len(per_shard)))
    assert len(full) > 5 and set(full) == {64} and 0 < last <= 64
    # what a shard draws from a source goes about its share
    for s in sources.collect():
        counts = [sum(x["source_key"] == s["source_key"] and x["shard"] == k for x in found) for k in range(len(full))]
        share = s["slots"] / len(found)
        assert all(abs(n - 64 * share) <= 5 * (64 * share * (1 - share)) ** 0.5 + 1 for n in counts)


def test_mixed_documents(spark):
    rows = [(i, f"w{i} " * 50, f"src{i % 3}") for i in range(600)] + [(3, "w3 " * 50, "src0"), (None, "a " * 30, None)]
    own = documents(spark, rows).selectExpr("*", "'k' AS _key", "'t' AS times", "2 AS key", "'f' AS `of`", "1 AS doc", "3 AS shard")
    out = mixed_documents(own)
    assert out.columns == own.columns and {tuple(x)[-6:] for x in out.collect()} == {("k", "t", 2, "f", 1, 3)}
    words = {}
    for x in out.collect():
        words[x["source"]] = words.get(x["source"], 0) + len(x["text"].split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for s, t in plain_targets(sizes).items():
        assert abs(words.get(s, 0) - t) <= 0.12 * t + 100


def test_empty_tables(spark):
    assert mix(documents(spark, [])).collect() == []
    assert [x["taken"] for x in mix(documents(spark, [(1, None, "a"), (2, " ", None)])).collect()] == [0, 0]
    assert mixed_documents(documents(spark, [])).collect() == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    found = {x["doc_id"]: x for x in op9_mix_sources(spark, sf_dir).collect()}
    assert {i: x["size"] for i, x in found.items()} == {x["doc_id"]: len(x["text"].encode().split()) for x in docs}
    sizes = {}
    for x in docs:
        sizes[x["source"]] = sizes.get(x["source"], 0) + found[x["doc_id"]]["size"]
    targets = plain_targets(sizes)
    for x in docs:
        assert found[x["doc_id"]]["source_size"] == sizes[x["source"]]
        assert found[x["doc_id"]]["target"] == pytest.approx(targets[x["source"]])


def test_sql(spark, sf_dir):
    df, duck = op9_mix_sources(spark, sf_dir), oracle(sf_dir)
    assert of_spark(df) == of_duckdb(duck, OP9_SQL) and not types_that_differ(df, duck, OP9_SQL)


def test_the_plan_draws_shards_and_has_no_python(spark, sf_dir):
    plan = op9_mix_sources(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "shard" in op9_mix_sources(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_identifiers_are_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        mix(spark.createDataFrame([("a-1", "x", "s")], "doc_id string, text string, source string"))
