"""Decontamination against plain edit distances."""

import random

import numpy as np

from brindle.llm.decontaminate import Items, clean_documents, contaminated, myers, op6_decontaminate, original_spans, pieces, plain

DOCS = "doc_id long, text string, lang string, source string, item_id string, distance int, start string"
ITEMS = "item_id long, text string, doc_id string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "i", 1, "s") for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "d") for i, t in rows], ITEMS)


def closest(item, text):
    """The least edit distance of item to any passage."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(max(1, len(text)))
        text[k : k + rng.randint(0, 1)] = rng.choice(["x", "", "yz"[: rng.randint(1, 1)]])
    return "".join(text)


def test_myers():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + edited(rng, item, 3) + "cab"
        least = closest(item, text)
        found = myers(item, text, 10)
        assert (found is None) == (least > 10) and (found is None or found[0] == least)
        if found:
            assert closest(item, text[: found[1]]) == least


def test_pieces():
    assert "".join(p for _, p in pieces("abcdefghij", 3)) == "abcdefghij" and len(pieces("abcdefghij", 3)) == 4


def test_nothing_within_the_budget_is_lost():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    tests = [(k, " ".join(word() for _ in range(rng.randint(10, 30)))) for k in range(6)]
    own = Items(tests, 0.1, 40)
    for _ in range(60):
        k = rng.randrange(6)
        text = plain(" ".join(word() for _ in range(20)) + " " + edited(rng, tests[k][1], rng.randint(0, len(tests[k][1]) // 8)) + " " + word())
        expected = [(i, d) for i, t in tests if (d := closest(t, text)) <= int(len(t) * 0.1)]
        assert [(i, d) for i, d, *_ in own.matches(text)] == expected


def test_spans():
    text = "Say: The  QUICK, brown-fox!"
    a = plain(text).index("quick brown")
    assert [text[x:y] for x, y in original_spans(text, [(a, a + len("quick brown"))])] == ["QUICK, brown"]


def test_spans_behind_letters_whose_lower_case_is_longer():
    item = "istanbul is where most of the people in this question live"
    for before in ("İ" * 12 + " before. ", "İ İ. İ, aİ bİ! ", "Xİ-Σ İ", ""):
        text = before + item.title() + " İ end"
        a = plain(text).index(item)
        assert [text[x:y].lower() for x, y in original_spans(text, [(a, a + len(item))])] == [item]


ITEM = "The passage of a test that nobody may learn by heart before it is asked for"


def test_documents(spark):
    rows = [(1, f"before. {ITEM.upper().replace(' ', ',  ')}! after"), (2, f"x {ITEM.replace('nobody', 'nobodi')} y"), (3, "quite another text " * 2000), (4, None), (5, ""), (None, ITEM), (1, ITEM), (6, "Tiny item"), (7, "a tiny item inside")]
    tests = [(10, ITEM), (11, "tiny item"), (12, None), (13, ""), (10, ITEM), (None, "a test without a number, which is long enough to be told")]
    found = contaminated(documents(spark, rows), items(spark, tests)).collect()
    assert sorted({(str(x["id"]), x["item_id"], x["distance"]) for x in found}) == [("1", 10, 0), ("2", 10, 1), ("6", 11, 0), ("7", 11, 0), ("None", 10, 0)]
    assert {x["id"]: x["few_words"] for x in found if x["item_id"] == 11} == {6: False, 7: True}
    few = contaminated(documents(spark, rows), items(spark, tests), block_chars=30).collect()  # a block for each item
    assert sorted(map(str, few)) == sorted(map(str, found))
    kept = clean_documents(documents(spark, rows), items(spark, tests))
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["3", "4", "5", "7"] and kept.columns == documents(spark, []).columns


def test_short_items_inside_documents(spark):
    tests = [(1, "What is the capital of Peru?"), (2, "Who is he?"), (3, "tiny item"), (4, "秘鲁的首都是什么")]
    rows = [(1, "asked: WHAT is the capital of Peru -- Lima"), (2, "so what is the capitol of peru then"), (3, "what is the capital of Peruvians"), (4, "and who is he now"), (5, "who is hers"), (6, "a tiny item inside"), (7, "tiny, item"), (8, "请问秘鲁的首都是什么呢"), (9, "nothing of that"), (10, "somewhat is the capital of peru")]
    found = contaminated(documents(spark, rows), items(spark, tests)).collect()
    assert sorted((x["id"], x["item_id"], x["distance"]) for x in found) == [(1, 1, 0), (2, 1, 1), (4, 2, 0), (6, 3, 0), (7, 3, 0), (8, 4, 0)]
    assert {x["id"]: (x["start"], x["end"]) for x in found}[1] == (7, 34)
    kept = clean_documents(documents(spark, rows), items(spark, tests))
    assert sorted(x["doc_id"] for x in kept.collect()) == [3, 5, 6, 9, 10]


def test_no_short_item_within_the_budget_is_lost():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    for _ in range(300):
        item = " ".join(word() for _ in range(rng.randint(3, 7)))[:39].strip()
        text = plain(word() + rng.choice(["", " "]) + edited(rng, item, rng.randint(0, 3)) + rng.choice(["", " "]) + word())
        if len(item.split()) < 3:
            continue
        words, at = [], 0
        for w in text.split():
            words.append((at, at + len(w)))
            at += len(w) + 1
        least = min(distance(item, text[a:b]) for k, (a, _) in enumerate(words) for _, b in words[k:])
        assert [d for _, d, *_ in Items([(1, item)], 0.08, 40).matches(text)] == ([least] if least <= int(len(item) * 0.08) else [])


def test_items_of_one_or_two_words(spark):
    """Found as whole words anywhere, without edits, and marked where the document has other words; against a plain search."""
    rng = random.Random(9)
    vocabulary = ["zanzibar", "quux", "zanzibars", "quu", "x", "the", "秘鲁", "鲁"]
    tests = [(1, "Zanzibar quux"), (2, "quux"), (3, "the"), (4, "秘鲁"), (5, "x")]
    rows = [(i, rng.choice([" ", "-", ""]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))) for i in range(200)]
    rows += [(900, "some text with zanzibar quux inside it"), (901, "ZANZIBAR, quux!"), (902, "zanzibar quuxes")]
    found = contaminated(documents(spark, rows), items(spark, tests)).collect()
    edge = lambda text, p: p in (0, len(text)) or " " in text[p - 1 : p + 1] or any("一" <= c <= "鿿" for c in text[p - 1 : p + 1])
    expected = set()
    for i, text in rows:
        text = plain(text)
        for k, item in tests:
            item = plain(item)
            if any(text.startswith(item, p) and edge(text, p) and edge(text, p + len(item)) for p in range(len(text))):
                expected.add((i, k, 0, text != item))
    assert {(x["id"], x["item_id"], x["distance"], x["few_words"]) for x in found} == expected and len(expected) > 100
    assert {(900, 1, 0, True), (901, 1, 0, False)} <= expected
    marked, others = {x[0] for x in expected}, {x[0] for x in expected if not x[3]}
    kept = {x["doc_id"] for x in clean_documents(documents(spark, rows), items(spark, tests)).collect()}
    assert kept == {i for i, _ in rows} - others
    strict = {x["doc_id"] for x in clean_documents(documents(spark, rows), items(spark, tests), few_words=True).collect()}
    assert strict == {i for i, _ in rows} - marked


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_empty_tables(spark):
    assert contaminated(documents(spark, []), items(spark, [(1, ITEM)])).collect() == []
    assert contaminated(documents(spark, [(1, ITEM)]), items(spark, [])).collect() == []
    assert clean_documents(documents(spark, [(1, ITEM)]), items(spark, [])).count() == 1


def least_distances(texts, item, budget):
    """The least edit distance of item to any passage of each text, all texts at once by numpy; separators cost more than budgets."""
    gap = "\0" * (budget + 1)
    joined, at = gap.join(texts), np.cumsum([0] + [len(t) + len(gap) for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    place, row = np.arange(len(codes) + 1), np.zeros(len(codes) + 1, int)
    for i, c in enumerate(item):
        new = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(np.concatenate(([i + 1], new)) - place) + place
    return [int(row[a : a + len(t) + 1].min()) for a, t in zip(at, texts)]


def test_query(spark, sf_dir, tmp_path):
    """Every distance, on the supplied tables and on some documents with edited items."""
    rng = random.Random(6)
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    tests = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").limit(12).collect()]
    for n in range(24):
        item = tests[n % 12][1]
        rows.append((10_000 + n, f"{rows[n][1][:300]} {edited(rng, item, n * len(item) // 200)} {rows[n][1][300:500]}"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(tests, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for folder, least in ((sf_dir, 1), (tmp_path, 5)):
        docs = [(x[0], plain(x[1])) for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        tests = [(x[0], plain(x[1])) for x in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
        expected = {}
        for k, item in tests:
            budget = int(len(item) * 0.08)
            expected |= {(i, k): d for (i, _), d in zip(docs, least_distances([t for _, t in docs], item, budget)) if d <= budget}
        assert {(x["doc_id"], x["item_id"]): x["distance"] for x in op6_decontaminate(spark, str(folder)).collect()} == expected
        assert len(set(expected.values())) >= least


def test_identifiers_are_numbers(spark):
    import pytest

    named = spark.createDataFrame([("gsm8k/9", ITEM)], "item_id string, text string")
    with pytest.raises(TypeError, match="whole numbers"):
        contaminated(documents(spark, [(1, ITEM)]), named)
    with pytest.raises(TypeError, match="whole numbers"):
        contaminated(spark.createDataFrame([("a-1", ITEM)], "doc_id string, text string"), items(spark, [(1, ITEM)]))
