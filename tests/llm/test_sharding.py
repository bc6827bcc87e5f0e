"""Differencing and shards."""

import random
import zlib
from itertools import product

from brindle.llm.sharding import difference, op10_balanced_shards, shard, sharded_documents

SCHEMA = "doc_id long, text string, lang string, h1 string, shard int, slot long, bytes long, part int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", 9, 9, 9, 9) for i, t in rows], SCHEMA)


def sums_of(partials, found, k):
    out = [0] * k
    for own, bins in zip(partials, found):
        for s, b in zip(own, bins):
            out[b] += s
    return out


def test_differencing_is_a_partition():
    rng = random.Random(1)
    for k in (2, 3, 8):
        for n in (0, 1, 2, 5, 40):
            partials = [[rng.randint(0, 1000) for _ in range(rng.randint(1, k))] for _ in range(n)]
            found = difference(partials, k)
            assert [len(x) for x in found] == [len(x) for x in partials]
            assert all(len(set(x)) == len(x) for x in found)  # the bins of one partial stay apart
            assert sum(sums_of(partials, found, k)) == sum(map(sum, partials))


def test_differencing_is_tight():
    rng = random.Random(2)
    for _ in range(40):
        items = [rng.randint(1, 50) for _ in range(9)]
        best = min(abs(sum(x * s for x, s in zip(items, sign))) for sign in product((1, -1), repeat=9))
        a, b = sums_of([[x] for x in items], difference([[x] for x in items], 2), 2)
        assert abs(a - b) <= best + 40
    many = [[rng.randint(1, 100_000)] for _ in range(5000)]
    out = sums_of(many, difference(many, 8), 8)
    assert max(out) - min(out) <= 100


def plain_difference(items, k):
    """The bins' items, by merging lists: always the two partitions with the largest spread, the fullest bin with the emptiest."""
    parts = [[[x]] + [[] for _ in range(k - 1)] for x in items]
    while len(parts) > 1:
        parts.sort(key=lambda bins: max(map(sum, bins)) - min(map(sum, bins)))
        a, b = parts.pop(), parts.pop()
        parts.append([x + y for x, y in zip(sorted(a, key=sum), sorted(b, key=sum, reverse=True))])
    return sorted(sorted(own) for own in parts[0])


def test_against_plain_differencing():
    rng = random.Random(5)
    for k in (2, 3, 8):
        for n in (1, 5, 40, 150):
            items = rng.sample(range(1, 10**9), n)
            found = [x[0] for x in difference([[x] for x in items], k)]
            assert sorted(sorted(x for x, b in zip(items, found) if b == own) for own in range(k)) == plain_difference(items, k)


ROWS = [(i, f"text {i % 700} " * (i % 13)) for i in range(2500)] + [(None, "nobody"), (3, "three"), (3, "three"), (9000, None), (9001, ""), (9002, "ä" * 5000)]


def check(rows, found, k=8):
    assert sorted(str(x["id"]) for x in found) == sorted(str(i) for i, _ in rows)
    by = {}
    for x in found:
        by.setdefault(x["shard"], []).append(x["slot"])
    assert set(by) <= set(range(k))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((x["size"], x["text_crc32"]) for x in found) == sorted((size(t), zlib.crc32((t or "").encode())) for _, t in rows)
    groups = {}
    for x in found:
        groups.setdefault((x["text_crc32"], x["size"]), set()).add(x["shard"])
    assert all(len(s) == 1 for s in groups.values())
    totals = [0] * k
    for x in found:
        totals[x["shard"]] += x["size"]
    return totals


def test_shards(spark):
    totals = check(ROWS, shard(documents(spark, ROWS)).collect())
    assert max(totals) - min(totals) < 0.02 * max(totals)


def test_buckets(spark, monkeypatch):
    import brindle.llm.sharding as module

    plain = module.balance
    monkeypatch.setattr(module, "balance", lambda groups, k: plain(groups, k, bucket=50))  # more than ten buckets
    totals = check(ROWS, shard(documents(spark, ROWS)).collect())
    assert max(totals) - min(totals) < 0.01 * max(totals)  # though one group is half a shard


def test_sharded_documents(spark):
    """Whole rows, with the shards and slots of their identifiers and texts; repeated rows and names of its own."""
    rows = [*ROWS, (None, "nobody"), (None, None), (None, None)]
    own = documents(spark, rows).selectExpr("*", "'n' AS number", "'d' AS doc", "'i' AS id", "'u' AS `null`")
    found = sharded_documents(own)
    assert found.columns == [c for c in own.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    found = found.collect()
    assert sorted(str(tuple(x)[:2]) for x in found) == sorted(str(r) for r in rows) and {(x["number"], x["doc"], x["id"], x["null"], x["h1"]) for x in found} == {("n", "d", "i", "u", "x")}
    placed = sorted((str(x["id"]), x["text_crc32"], x["shard"], x["slot"]) for x in shard(own).collect())
    assert placed == sorted((str(x["doc_id"]), zlib.crc32((x["text"] or "").encode()), x["shard"], x["slot"]) for x in found)
    assert sharded_documents(documents(spark, [])).collect() == []


def test_empty_table(spark):
    assert shard(documents(spark, [])).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = op10_balanced_shards(spark, sf_dir)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    totals = check(rows, found.withColumnRenamed("doc_id", "id").collect())
    assert max(totals) - min(totals) < 0.03 * max(totals)


def plain_parts(parts, k):
    """Bins (sum, labels) by merging lists: the two partitions with the largest spread, the older of equal ones first."""
    full = lambda bins: sorted([*bins, *[(0, [])] * (k - len(bins))], key=lambda b: -b[0])
    made = {n: full(bins) for n, bins in enumerate(parts)}
    after = len(made)
    while len(made) > 1:
        a, b = sorted(made, key=lambda n: (made[n][-1][0] - made[n][0][0], n))[:2]
        x, y = made.pop(a), made.pop(b)
        made[after] = full([(x[i][0] + y[k - 1 - i][0], x[i][1] + y[k - 1 - i][1]) for i in range(k)])
        after += 1
    return next(iter(made.values()), full([]))


def test_query_against_a_plain_version(spark, sf_dir):
    """Every document's shard: the groups of equal texts by plain differencing, the small ones around what the large ones left."""
    from xxhash import xxh64_intdigest

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    k, rows = 8, [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len(t.encode()) + 1
    order = sorted(groups, key=lambda t: (-groups[t], signed(xxh64_intdigest(t.encode(), 42)), signed(xxh64_intdigest(t.encode(), xxh64_intdigest(b"second", 42)))))
    large = sum(groups.values()) // 16_384
    shards, held = {}, []
    for b, (n, own) in enumerate(plain_parts([[(groups[t], [t])] for t in order if groups[t] > large], k)):
        held.append(n)
        shards |= dict.fromkeys(own, b)
    rest = [t for t in order if groups[t] <= large]
    if rest:
        for _, own in plain_parts([[(n, [b]) for b, n in enumerate(held)], *([(groups[t], [t])] for t in rest)], k):
            b = next(x for x in own if isinstance(x, int))
            shards |= {t: b for t in own if isinstance(t, str)}
    found = {x["doc_id"]: x["shard"] for x in op10_balanced_shards(spark, sf_dir).collect()}
    assert found == {i: shards[t] for i, t in rows} and len(shards) > 100
