"""Line dedup against a plain version."""

import hashlib

from pyspark.sql import functions as F

from brindle.llm.lines import apply_bitmaps, keep_bitmaps, op8_line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, part string"


def plain_line_dedup(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """doc_id to (n_lines, n_dropped, kept_sha256)."""
    spaces = " \t\n\x0b\x0c\r"
    lower = {c: c + 32 for c in range(65, 91)}
    holders: dict[str, set[int]] = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(spaces).translate(lower), set()).add(i)
    out = {}
    for i, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if len(k := x.strip(spaces).translate(lower)) < 20 or len(holders[k]) < 3 or max(holders[k]) == i]
        out[i] = len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return out


def run(spark, rows, partitions=None):
    docs = spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], SCHEMA)
    out = apply_bitmaps(docs, keep_bitmaps(docs, partitions=partitions)).withColumn("sha", F.sha2("kept", 256))
    return {x["id"]: (x["n_lines"], x["n_dropped"], x["sha"]) for x in out.collect()}


def test_shared_lines(spark):
    long, other = "This line stands in many documents", "ÄÖÜ ein langer deutscher Satz, zweimal"
    rows = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\n{other if i < 2 else ''}\n{long}") for i in range(9)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a\n" * 3000 + long)]
    assert run(spark, rows) == plain_line_dedup(rows)


def test_a_hot_line_lies_across_partitions(spark):
    rows = [(i, "the very same line in all documents\n" + ("an other line, only in some\n" if i % 50 == 0 else "") + f"number {i}") for i in range(700)]
    assert run(spark, rows, partitions=7) == plain_line_dedup(rows)


def test_batches_change_nothing(spark):
    """Keys whose rows lie in many batches: one document's repeats, few documents, and many."""
    line, few, many = ("a line that one document repeats", "a line of two documents and of a third", "a line that all documents have")
    rows = [(i, "\n".join([many, f"own {i}"])) for i in range(40)] + [(100, "\n".join([line] * 50 + [few] * 30)), (99, "\n".join([few] * 40)), (98, few), (97, "\n".join([line] * 25))]
    rows += [(None, "\n".join([few, line] * 20)), (None, many)]
    expected = {k: v[:2] for k, v in plain_line_dedup([(-1 if i is None else i, t) for i, t in rows[:-2]] + [(-1, rows[-2][1])]).items()}
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = run(spark, rows[:-1], partitions=3)
            assert {-1 if k is None else k: v[:2] for k, v in found.items()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)


def test_null_and_repeated_ids(spark):
    line = "a line of more than twenty characters"
    found = run(spark, [(None, line), (1, line), (1, line), (2, line)])
    assert {k: v[1] for k, v in found.items()} == {None: 1, 1: 1, 2: 0}
    assert {k: v[1] for k, v in run(spark, [(1, line), (1, line), (1, line)]).items()} == {1: 0}


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_query(spark, sf_dir):
    docs = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {x[0]: tuple(x[1:]) for x in op8_line_dedup(spark, sf_dir).collect()}
    assert found == plain_line_dedup(docs) and sum(x[1] for x in found.values()) > 0
