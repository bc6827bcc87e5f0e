"""The filter audit against its SQL and a count of every document in every order."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from compare import of_duckdb, of_spark, oracle, types_that_differ

from brindle.llm import audit
from brindle.llm.audit import OP11_SQL, Lanes, interactions, mask_counts, measure, op11_filter_audit, scanned

WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def plain(text):
    words = WORD.findall(text)
    return len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text), len(text)


def measured(texts):
    data = [t.encode() for t in texts]
    m = measure(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    return list(zip(*(m[c].tolist() for c in ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points"))))


def some_texts(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "A", "the", "The", "word", "eightlet", "ninelette", "straße", "naïve", "日本語", "日本語のテキスト", "#tag", "50%", "x" * 63, "x" * 64, "x" * 65, "x" * 64 + "y", "Z" * 200, " ", " ", "\0", "é" * 40]
    gaps = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n", "　", ""]
    text = lambda k: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(k))
    return [rng.choice(["", " ", "\n"]) + text(rng.choice([0, 1, 2, 30, 99, 100, 101, 400])) for _ in range(n)]


def test_query_is_its_sql(spark, sf_dir):
    df, duck = op11_filter_audit(spark, sf_dir), oracle(sf_dir)
    rows = of_spark(df)
    assert rows == of_duckdb(duck, OP11_SQL) and len(rows[1]) == 2400
    assert not types_that_differ(df, duck, OP11_SQL)


@pytest.mark.parametrize("seed", range(3))
def test_counts(seed):
    texts = some_texts(seed)
    assert measured(texts) == [plain(t) for t in texts]
    assert measured([]) == [] and measured(["", "", ""]) == [(0, 0, 0, 0, 0)] * 3


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(audit, "PIECE", 100)
    texts = some_texts(7, 40) + ["w" * 1000 + " " + "w" * 1000, "no space " * 300, "é" * 500]
    for t in texts:
        assert measured([t]) == [plain(t)]
    data = pa.array(["skipped", *texts, "skipped"])[1:-1]
    expected = [sum(f << i for i, f in enumerate((w < 100, 100 * d < 80 * w, 100 * c > 10 * n, s > 0))) for w, d, c, s, n in map(plain, texts)]
    assert scanned(data).tolist() == expected == scanned(data.cast(pa.large_string())).tolist()


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(Lanes, "hashes", lambda self, start, length: (length % 2).astype(np.uint64))
    texts = some_texts(3, 60)
    assert measured(texts) == [plain(t) for t in texts]


def by_hand(docs, labels):
    rows = {}
    marks = lambda i, k: any(x[0] == i and x[k] == 1 for x in labels) and i is not None
    fails = []
    for i, text, _lang in docs:
        w, d, c, s, n = plain(text or "")
        early = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        fails.append({"A": w < 100, "B": 100 * d < 80 * w, "C": 100 * c > 10 * n, "D": s > 0, "E": early})
    for order in map("".join, permutations("ABCDE")):
        left = list(range(len(docs)))
        for step, x in enumerate(order, 1):
            gone = [k for k in left if fails[k][x]]
            left = [k for k in left if not fails[k][x]]
            for part in {d[2] or "" for d in docs}:
                own = lambda ks, part=part: [k for k in ks if (docs[k][2] or "") == part]
                everything = own(range(len(docs)))
                rows[part, order, step] = [
                    len(own(left)), len(own(gone)), sum(fails[k][x] for k in everything) - len(own(gone)), sum(fails[k][x] and sum(fails[k].values()) == 1 for k in everything),
                    sum(marks(docs[k][0], 1) for k in own(gone)), sum(marks(docs[k][0], 2) for k in own(gone)),
                ]
    for part, order, step in rows:
        rows[part, order, step].append(sum(rows[part, o, o.index(order[step - 1]) + 1][1] for o in map("".join, permutations("ABCDE"))))
    return rows


def test_odd_rows(spark):
    clean = " ".join(f"w{i}" for i in range(120))
    loud = " ".join(f"W{i}A" for i in range(120))
    docs = [
        (1, clean, "en"), (2, clean, "en"), (2, clean, "fr"), (3, None, None), (4, "", "en"), (5, "", ""), (None, clean, "en"), (None, None, "xx"), (None, loud, "en"), (6, loud, "en"),
        (6, loud, "en"), (7, loud, "en"), (8, clean + " #", "fr"), (9, "a " * 200, "fr"), (9, "b " * 200, "fr"), (-5, loud + " $ " * 100, "fr"), (10, loud + " $ " * 100, "fr"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (6, None, 1), (6, 0, 0), (9, 1, 1), (None, 1, 1), (10, 1, 0), (77, 1, 1)]
    frame = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in docs], "doc_id long, text string, lang string, mask string, n int")
    got = interactions(mask_counts(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == by_hand(docs, labels)
    assert len(got) == len({d[2] or "" for d in docs}) * 600


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert interactions(mask_counts(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
