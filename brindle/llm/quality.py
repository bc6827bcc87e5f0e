"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Every metric is an expression of the text alone, so rules need no shuffle, no user function and no second pass; a rule
that is added to the table is one more comparison in the same projection.  Metrics that use one array several times are
stacked, one projection on the other, in the same stage.  Windows of words are compared by a 64-bit hash of their words' hashes,
within one document.

A null text counts as empty: it has no words and fails the base rule.  Identifiers may be null or repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_prefix, table

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?\"()"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on that the this to was were will with "
    "auf das dem den der des die ein eine für im in ist mit nicht sich sie und von zu "
    "au dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "con de del el en es la las lo los no para por que se su un una y"
).split()

#: A rule: (metric, least, most, words); None is no limit, and the rule holds for texts of at least so many words.
Rule = tuple[str, float | None, float | None, int]
RULES: tuple[Rule, ...] = (
    ("mean_word_chars", 1.5, 25.0, 0),
    ("symbols_per_word", None, 0.25, 0),
    ("exclamations_per_word", None, 0.5, 0),
    ("upper_share", None, 0.6, 30),
    ("stop_word_share", 0.05, None, 30),
    ("dup_line_share", None, 0.6, 0),
)


#: What apply_rules() adds.
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "exclamations_per_word", "upper_share", "stop_word_share", "dup_line_share", "base_failed", "kept")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(without(text, chars))).cast("long")


def measured(docs: DataFrame, text_col: str = "text", width: int = 5) -> DataFrame:
    """docs with the base counts and the metrics of RULES; each step's arrays are used by the next only."""
    p = free_prefix(docs)  # of names that docs doesn't have
    col = lambda name: F.col(p + name)
    out = docs.withColumn(f"{p}text", F.coalesce(F.col(text_col), F.lit(""))).withColumn(f"{p}words", F.filter(F.split(col("text"), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    text, words = col("text"), col("words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without(x, WHITE)) > 0)
    stop = lambda x: F.lower(without(x, MARKS)).isin(STOP_WORDS)
    out = out.select(
        *docs.columns,
        F.size(words).cast("long").alias(f"{p}n_words"),
        F.length(without(text, WHITE)).cast("long").alias(f"{p}word_chars"),
        count_of(text, SYMBOLS).alias(f"{p}n_symbols"),
        count_of(text, "!").alias(f"{p}n_exclamations"),
        count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias(f"{p}n_upper"),
        F.size(F.filter(words, stop)).cast("long").alias(f"{p}n_stop_words"),
        lines.alias(f"{p}lines"), F.transform(words, lambda x: F.xxhash64(x)).alias(f"{p}hashes"),
    )
    hashes = col("hashes")
    starts = F.sequence(F.lit(0), F.size(hashes) - width)
    windows = F.when(F.size(hashes) >= width, F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(f"{p}windows", windows)
    # most texts repeat no window, and need no sorting
    some = F.size(F.array_distinct(col("windows"))) < F.size(col("windows"))
    in_order = F.when(some, F.sort_array(F.transform(col("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn(f"{p}sorted", in_order).withColumn(f"{p}n_lines", F.size(col("lines")).cast("long")).withColumn(f"{p}n_dup_lines", (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("long"))
    own = col("sorted")
    repeated = F.filter(own, lambda x, k: F.coalesce(F.get(own, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(own, k - 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn(f"{p}at", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    at = col("at")
    covered = F.transform(at, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - x, F.lit(width))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    words_per = lambda c: F.try_divide(col(c), col("n_words"))
    return out.select(
        *docs.columns, *(col(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")), F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"),
        words_per("word_chars").alias("mean_word_chars"), words_per("n_symbols").alias("symbols_per_word"), words_per("n_exclamations").alias("exclamations_per_word"),
        F.try_divide(col("n_upper"), col("word_chars")).alias("upper_share"), words_per("n_stop_words").alias("stop_word_share"), F.try_divide(col("n_dup_lines"), col("n_lines")).alias("dup_line_share"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition: true if every rule holds.  A metric that is null (no words) passes."""
    sides = [(F.col(m) >= a, n) for m, a, _, n in rules if a is not None] + [(F.col(m) <= b, n) for m, _, b, n in rules if b is not None]
    return reduce(lambda a, b: a & b, (F.coalesce(x, F.lit(True)) | (F.col("n_words") < n) for x, n in sides), F.lit(True))


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with their metrics, base_failed and kept; columns of docs with these names give way."""
    if text_col in OUT:
        raise ValueError(f"{text_col} is the name of a column that is added")
    docs = docs.drop(*OUT)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured(docs, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The table of rules as a condition of SQL."""
    sides = [(f"{m} >= {a}", n) for m, a, _, n in rules if a is not None] + [(f"{m} <= {b}", n) for m, _, b, n in rules if b is not None]
    return " AND ".join(f"(coalesce({x}, true) OR n_words < {n})" for x, n in sides)


OP7_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
d AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(least(5, coalesce(next - i, 5))) AS BIGINT) AS n_repeat_words FROM d GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len([x for x in words if list_contains([{", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}], lower(translate(x, '{MARKS}', '')))]) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
x AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbols_per_word, n_exclamations / nullif(n_words, 0) AS exclamations_per_word,
    n_upper / nullif(word_chars, 0) AS upper_share, n_stop_words / nullif(n_words, 0) AS stop_word_share, n_dup_lines / nullif(n_lines, 0) AS dup_line_share,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules_sql()} AS kept FROM x
"""
