"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Texts are scanned in Arrow's buffers.  A table gives each byte its classes (white space, capital, symbol, inside of a character);
prefix sums of the classes, read at the documents' offsets, are the counts of each document.  Words begin and end where
white space does; each is hashed by its 8-byte lanes, and the hashes are sorted by document.  Equal neighbours are
compared byte by byte before they count as one word; a document in which equal hashes hide different words is counted
anew by a set.  The filters become bits of a mask.

The rest is counting: documents by part, mask and labels are at most 32 groups a part, and every order and step is a sum over them.
A text that occurs before (filter E) is found by the smallest identifier of each text, joined by text and identifier, so that
no task has all copies of a text.  Texts are told apart by 128 bits.

A null text is empty; a null part is the part with the empty name.  A row with a null identifier never fails E and has no labels;
rows that repeat an identifier and a text don't fail E by each other.  A document is good or toxic if any label row of its
identifier says so.  A part needs no row for filters that remove nothing: all its orders and steps are there, with
zeros.  An empty table gives no rows.  Long texts are scanned in pieces, cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, SPACE, column, table, text_key, written

WHITE, CAPITAL, SYMBOL, INSIDE = 1, 2, 4, 8
CLASSES = np.zeros(256, np.uint8)
CLASSES[list(b" \t\n\x0b\x0c\r")] = WHITE
CLASSES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = CAPITAL
CLASSES[list(b"#$%&*|")] = SYMBOL
CLASSES[0x80:0xC0] = INSIDE  # of a character of several bytes
LETTERS = "ABCDE"
#: Words of more bytes are hashed and compared one by one.
LONG = 64
#: Odd multipliers of the word hash.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Lanes:
    """The words of some bytes, eight bytes at a time."""

    def __init__(self, padded: np.ndarray):
        self.bytes = padded
        self.at = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))

    def lane(self, start: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
        """Bytes k to k + 7 of words that have more than k, with zeros behind their ends."""
        left = np.minimum(length - k, 8).astype(np.uint64)
        return self.at[start + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))

    def word(self, start: int, length: int) -> bytes:
        return self.bytes[start : start + length].tobytes()

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        from xxhash import xxh64_intdigest

        out, on = length.astype(np.uint64) * MIX[0], np.arange(len(start))
        for k in range(0, LONG, 8):
            on = on[length[on] > k]
            if not len(on):
                return out
            x = (out[on] ^ self.lane(start[on], length[on], k)) * MIX[1]
            out[on] = (x ^ (x >> np.uint64(29))) * MIX[0]
        for i in on[length[on] > LONG]:
            out[i] = xxh64_intdigest(self.word(start[i], length[i]))
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words of these lengths at a and at b are the same."""
        out, on = np.ones(len(a), bool), np.arange(len(a))
        for k in range(0, LONG, 8):
            on = on[length[on] > k]
            if not len(on):
                return out
            out[on] &= self.lane(a[on], length[on], k) == self.lane(b[on], length[on], k)
        for i in on[length[on] > LONG]:
            out[i] = self.word(a[i], length[i]) == self.word(b[i], length[i])
        return out


def pieces(data: np.ndarray, n: int, whole: bool) -> Iterator[tuple[int, int]]:
    """Ends of pieces of the first n bytes, cut at white space; whole: one piece."""
    at = 0
    while at < n:
        space = None if whole else SPACE.search(data, min(n, at + PIECE), n)
        end = space.start() if space else n
        yield at, end
        at = end


def measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, n_distinct, n_capitals, n_symbols and n_points of the documents between bounds."""
    n, bounds = int(bounds[-1] - bounds[0]), (bounds - bounds[0]).astype(np.int64)
    docs = len(bounds) - 1
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    lanes, out = Lanes(padded), {c: np.zeros(docs, np.int64) for c in ("n_words", "n_capitals", "n_symbols", "n_inside")}
    starts, lengths, hashes = [], [], []
    for lo, hi in pieces(padded, n, docs > 1):
        classes, edges = CLASSES[padded[lo:hi]], np.clip(bounds, lo, hi) - lo
        white = (classes & WHITE) > 0

        def counted(flags: np.ndarray, edges=edges) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return sums[edges[1:]] - sums[edges[:-1]]

        out["n_capitals"] += counted((classes & CAPITAL) > 0)
        out["n_symbols"] += counted((classes & SYMBOL) > 0)
        out["n_inside"] += counted((classes & INSIDE) > 0)
        first, last = ~white, ~white
        cuts = edges[(edges > 0) & (edges < hi - lo)]
        after, before = white[:-1].copy(), white[1:].copy()
        after[cuts - 1] = before[cuts - 1] = True  # a document's end ends words
        first[1:] &= after
        last[:-1] &= before
        out["n_words"] += counted(first)
        start = np.flatnonzero(first)
        length = np.flatnonzero(last) + 1 - start
        starts.append(start + lo)
        lengths.append(length)
        hashes.append(lanes.hashes(starts[-1], length))
    out["n_distinct"] = distinct(lanes, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths, hashes)), out["n_words"])
    out["n_points"] = np.diff(bounds) - out.pop("n_inside")
    return out


def distinct(lanes: Lanes, start: np.ndarray, length: np.ndarray, hashes: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """How many different words each document has; its words lie one behind the other."""
    docs = len(n_words)
    doc, bits = np.repeat(np.arange(docs), n_words), max(1, (docs - 1).bit_length())
    key = doc.astype(np.uint64) << np.uint64(64 - bits) | hashes.astype(np.uint64) >> np.uint64(bits)
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[again], order[again + 1]
    same = length[a] == length[b]
    same[same] = lanes.equal(start[a[same]], start[b[same]], length[a[same]])
    out = n_words - np.bincount(doc[b], minlength=docs)
    ends = np.cumsum(n_words)
    for d in np.unique(doc[b[~same]]):
        own = range(int(ends[d] - n_words[d]), int(ends[d]))
        out[d] = len({lanes.word(start[i], length[i]) for i in own})
    return out


def masks(m: dict[str, np.ndarray]) -> np.ndarray:
    """Bit 0 to 3: whether a document fails A to D."""
    failed = m["n_words"] < 100, 100 * m["n_distinct"] < 80 * m["n_words"], 100 * m["n_capitals"] > 10 * m["n_points"], m["n_symbols"] > 0
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def scanned(texts: pa.Array) -> np.ndarray:
    """Masks of the texts of an Arrow array without nulls."""
    if not len(texts):
        return np.zeros(0, np.int32)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out, at = [], 0
    while at < len(texts):  # as many documents as a piece holds, or a longer one
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, "right")) - 1)
        out.append(masks(measure(data[bounds[at] : bounds[end]], bounds[at : end + 1])))
        at = end
    return np.concatenate(out)


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, k1, k2, mask) of each document: a key of its text, and which of the filters A to D it fails."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["id", "part", "k1", "k2"]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(scanned(column(batch, "text")))], [*names, "mask"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = (k.alias(f"k{i}") for i, k in enumerate(text_key(text), 1))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), *keys, text.alias("text"))
    return rows.mapInArrow(run, "id long, part string, k1 long, k2 long, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail these filters, E as bit 4, and how many of them are good or toxic."""
    flags = written(failed_filters(docs, id_col, text_col, part_col), "filter-masks")
    firsts = flags.groupBy("k1", "k2").agg(F.min("id").alias("id")).filter("id IS NOT NULL").withColumn("first", F.lit(True))
    known = flags.filter("id IS NOT NULL").join(firsts, ["k1", "k2", "id"], "left")
    known = known.withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(16)))
    known = known.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))  # so that no identifier is hot in the join
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(is_one("quality"), is_one("toxic"))
    known = known.join(marks, "id", "left").select("part", "mask", "n", *(F.when(F.col(c), F.col("n")).otherwise(0).alias(c) for c in ("quality", "toxic")))
    none = flags.filter("id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).withColumns({c: F.lit(0).cast("long") for c in ("quality", "toxic")})
    return known.unionByName(none).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Each order and step of the filters for each part of mask_counts(); bit i of a mask is the i-th letter."""
    steps = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            steps.append(f"struct('{''.join(order)}' AS filter_order, {step} AS step, {bit} AS bit, {before} AS before)")
            before |= bit
    orders = len(steps) // len(letters)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("groups"))  # 32 at most
    parts = parts.select("part", "groups", F.explode(F.expr(f"array({', '.join(steps)})")).alias("s")).select("part", "groups", "s.*")

    def total(value: str, *conditions: str) -> Column:
        return F.expr(f"aggregate(groups, 0L, (t, x) -> t + CASE WHEN {' AND '.join(conditions)} THEN {value} ELSE 0L END)")

    fails, went = "x.mask & bit <> 0", "x.mask & before"
    return parts.select(
        "part", "filter_order", "step", total("x.n", f"{went} = 0", "x.mask & bit = 0").alias("kept"), total("x.n", fails, f"{went} = 0").alias("removed"),
        total("x.n", fails, f"{went} <> 0").alias("redundant"), total("x.n", "x.mask = bit").alias("unique_fails"),
        total("x.good", fails, f"{went} = 0").alias("good_lost"), total("x.toxic", fails, f"{went} = 0").alias("toxic_lost"),
        total(f"x.n * {orders} div bit_count(x.mask)", fails).alias("shapley"),  # of the filters a document fails, each is the first in as many orders
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed
    FROM w LEFT JOIN q ON w.doc_id = q.doc_id),
u AS (SELECT part, good, toxic, failed, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT *, substr(filter_order, step, 1) AS x, contains(failed, substr(filter_order, step, 1)) AS fails, len([k for k in [1, 2, 3, 4] if k < step AND contains(failed, substr(filter_order, k, 1))]) > 0 AS early
    FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM u, o)),
m AS (SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (NOT early AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT early AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (early AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = x), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n * good) FILTER (NOT early AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n * toxic) FILTER (NOT early AND fails), 0) AS BIGINT) AS toxic_lost FROM s GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM m
"""
