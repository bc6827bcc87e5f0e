"""SimHash against all pairs."""

import random

import numpy as np
from xxhash import xxh64_intdigest

from brindle.llm.simhash import close_lanes, bit_planes, fingerprint, near_duplicates, one_of_each, op3_simhash_near_dedup, similar_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, node long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, "k", 2) for i, t in rows], SCHEMA)


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=3):
    """(id, fingerprint) rows to the smallest id reachable, by all pairs."""
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, least[find(k)]) for k, (i, _) in enumerate(rows))


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "ti", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one TWO", "A b C", "a b c", "É é \x0b x\x1cy z", prose(rng, 500), "a " * 3000]
    assert [fingerprint((t or "").encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    long = prose(rng, 400_000)  # taken apart in pieces
    words = long.encode().split()
    h = np.array([xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    assert fingerprint(long.encode()) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 300, np.uint64)
    fp[100:200] = fp[0] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    for radius in (0, 1, 3, 4, 7, 8, 9, 24, 40, 63, 64):
        planes = bit_planes(fp, 300 // 64 + 2)
        for shift in (1, 63, 64, 65, 130, 299):
            lanes = np.zeros(planes.shape[1] * 64, np.uint8)
            lanes[: 300 - shift] = 1
            found = close_lanes(planes, shift, np.packbits(lanes, bitorder="little").view(np.uint64), radius)
            assert list(found) == list(np.flatnonzero(np.bitwise_count(fp[shift:] ^ fp[:-shift]) <= radius))


def test_components_and_hot_groups(spark):
    rng = random.Random(3)
    base = prose(rng, 300)
    rows = [(i, prose(rng, rng.randint(0, 40))) for i in range(150)] + [(200 + i, base) for i in range(60)]
    for i in range(120):  # a chain of near copies
        words = base.split()
        words[rng.randrange(300)] = "x"
        base = " ".join(words)
        rows.append((500 + i, base))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (200, rows[0][1])]
    found = near_duplicates(documents(spark, rows), cell=16).collect()  # cells much smaller than the hot buckets
    assert sorted((x["id"], x["component_id"]) for x in found) == plain_components([(i, plain_fingerprint(t)) for i, t in rows])


def test_null_ids_and_empty_table(spark):
    found = near_duplicates(documents(spark, [(None, "a b c d"), (7, "a b c d"), (None, "quite other words here"), (7, "a b c d")])).collect()
    assert sorted(str(x["component_id"]) for x in found) == ["7", "7", "7", "None"]
    assert near_duplicates(documents(spark, [])).collect() == []


def test_one_of_each(spark):
    rng = random.Random(5)
    texts = [prose(rng, 200) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, "only once and without a number")]
    own = documents(spark, rows).selectExpr("*", "'a' AS _key", "'b' AS doc", "'c' AS of", "'d' AS place")
    assert one_of_each(own).columns == own.columns and {tuple(x)[-4:] for x in one_of_each(own).collect()} == {("a", "b", "c", "d")}
    kept = one_of_each(documents(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted([str(i) for i in range(30)] + ["None"])


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_similarity_decides(spark):
    """Pairs on both sides of 0.8, which no radius of fingerprints tells apart, and groups larger than a cell."""
    rng = random.Random(8)
    rows = []
    for n in (30, 60, 120, 300):
        for share in (0.0, 0.01, 0.02, 0.022, 0.025, 0.03, 0.04, 0.08):
            base = prose(rng, n).split()
            other = list(base)
            for k in rng.sample(range(n), int(n * share)):
                other[k] = "changed"
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other + ["end"]))]
    hot = prose(rng, 100).split()
    for i in range(60):
        k = rng.randrange(100)
        rows.append((len(rows), " ".join(hot[:k] + [f"w{i}"] + hot[k + 1 :])))
    rows += [(5000, "too short"), (5001, "too  SHORT"), (5002, None), (5003, ""), (None, "nameless")]
    sets, group = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if x == b else x for x in group]
    expected = sorted((str(rows[i][0]), str(min((rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None), default=None))) for i in range(len(rows)))
    found = similar_documents(documents(spark, rows), cell=16).collect()
    assert sorted((str(x["id"]), str(x["component_id"])) for x in found) == expected
    kept = sorted(str(x["doc_id"]) for x in one_of_each(documents(spark, rows)).collect())
    assert kept == sorted({c for _, c in expected})


def test_small_sets_and_many_rounds(spark):
    """Sets of a few shingles, whose fingerprints lie far apart; a bucket in which many candidates are refused before one is a link."""
    rng = random.Random(11)
    rows = []
    for n in (5, 6, 7, 8, 9, 10, 14):
        for _ in range(12):
            base = prose(rng, n).split()
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, "end"])), (len(rows) + 2, " ".join(["begin", *base]))]
    template = prose(rng, 60).split()
    for i in range(40):  # neighbours are alike, others are not
        own = [f"v{i // 8}x{k}" if 6 * (i // 8) <= k < 6 * (i // 8) + 6 else w for k, w in enumerate(template)]
        rows.append((len(rows), " ".join(own + [f"e{i % 8}"])))
    sets, group = [grams(t) for _, t in rows], list(range(len(rows)))
    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((group[i], group[j]))
                group = [a if x == b else x for x in group]
    found = {x["id"]: x["component_id"] for x in similar_documents(documents(spark, rows), cell=8).collect()}
    missed = sum(found[i] != group[i] for i in range(len(rows)))
    assert links > 100 and all(group[i] == group[found[i]] for i in found) and missed <= 0.01 * len(rows)


def test_recall_against_all_pairs(spark, sf_dir):
    """All pairs of distinct texts of a table, found by shingles they share."""
    rows = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()
    sets, by = {x["doc_id"]: grams(x["text"]) for x in rows}, {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    shared = {}
    for ids in by.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] = shared.get((ids[b], ids[a]), 0) + 1
    links = [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    found = {x["id"]: x["component"] for x in similar_documents(spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string")).collect()}
    assert len(links) > 20 and sum(found[a] == found[b] for a, b in links) >= 0.99 * len(links)
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        group[b] = a
    assert len(set(found.values())) >= len({root(i) for i in sets})  # nothing else is united


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = op3_simhash_near_dedup(spark, sf_dir).collect()
    fps = {x["doc_id"]: plain_fingerprint(x["text"]) for x in rows}
    assert {x["doc_id"]: x["fingerprint"] for x in found} == {i: f"{fp:016x}" for i, fp in fps.items()}
    assert sorted((x["doc_id"], x["component_id"]) for x in found) == plain_components(list(fps.items()))
