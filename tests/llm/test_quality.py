"""Quality rules against plain counts."""

import random
import re
from collections import Counter

from compare import of_duckdb, of_spark, oracle

from brindle.llm.quality import OP7_SQL, apply_rules, op7_quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, h string, n_words int, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(t):
    t = t or ""
    w = WORD.findall(t)
    seen, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), [0] * len(w)
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            covered[i : i + 5] = [1] * 5
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, repeat = len(w), sum(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, None, "h", 1, "x") for i, t in texts], SCHEMA)


def test_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e " * 2, "x\n\nx\n x\nx ", "z " * 30_000, "\x0bq\x0c r\x1cs t", "ä#|ö <b> 100% & $"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "é\t", " ", "# "]) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    rows = [*enumerate(texts), (None, "a b c"), (3, "one")]
    found = apply_rules(documents(spark, rows)).collect()
    got = sorted(str((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"])) for x in found)
    assert got == sorted(str((i, *plain(t))) for i, t in rows)
    assert not any(x["kept"] and x["base_failed"] for x in found)


def test_columns_with_the_names_of_metrics(spark):
    text = "one two three four five six seven eight nine ten eleven"
    own = documents(spark, [(1, text)]).selectExpr("*", *(f"'{c}' AS {c}" for c in ("n_upper", "n_stop_words", "n_exclamations", "n_lines", "_words", "_at", "_text", "_", "__text", "hashes")))
    found = apply_rules(own).first()
    assert found["n_upper"] == "n_upper" and found["_words"] == "_words" and found["_"] == "_" and found["__text"] == "__text" and found["n_lines"] == "n_lines" and found["n_words"] == 11
    assert set(own.columns) < set(apply_rules(own).columns)


def test_rules(spark):
    rng = random.Random(2)
    clean = "It was the end of the day, and " + " ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) + rng.choice(["", " the", " of"]) for _ in range(60)) + "."
    rows = [(1, clean), (2, clean.upper()), (3, clean.replace(" ", " | ")), (4, clean.replace(" ", "!! ")), (5, re.sub(r" (the|of|and|it|was)\b", " qq", clean)), (6, "Gut ist das Haus am See der Stadt")]
    assert {x["doc_id"]: x["kept"] for x in apply_rules(documents(spark, rows)).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_no_user_functions(spark, sf_dir):
    plan = op7_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_empty_table(spark):
    assert apply_rules(documents(spark, [])).collect() == []


def test_query(spark, sf_dir):
    assert of_spark(op7_quality_rules(spark, sf_dir)) == of_duckdb(oracle(sf_dir), OP7_SQL)
