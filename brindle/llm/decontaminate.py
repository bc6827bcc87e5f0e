"""Benchmark decontamination: passages within an edit budget of a test item, by pigeonhole pieces and Myers' distance.

Texts are compared in lower case, with every run of other characters than letters and digits as one space.  An item of m
characters has an error budget k = m * `rate`.  Split into k + 1 pieces, at least one piece of any passage within the
budget is unchanged, so exact hits of pieces (an Aho-Corasick automaton, one pass over each text) lose nothing.  Around the
hits, Myers' bit-parallel algorithm finds the smallest edit distance of the item to any passage.

Items are the stated query set: they go to the tasks in blocks of bounded size (`block_chars`), one pass over the documents
for each block.  Documents aren't shuffled.  All items pass through the driver, block by block, so this is for test sets, not
for a second corpus.

Items of fewer than `least_chars` characters are searched for with the same budget, int(m * rate), which may be 0, but their
passages begin and end with whole words.  Items of one or two words are searched for too, without edits; since such words occur in many
documents that have nothing to do with the test, what they match is marked (few_words) unless the document has no other words.  In
scripts written without spaces each character counts as a word.  clean_documents() keeps documents with marked matches only, unless
it is told not to.
Null or empty texts match nothing, null or empty items neither.  Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, identifier, slices, table

BREAK = re.compile(r"[\W_]+")
WORDS = re.compile(r"[^\W_]+")
#: Characters of scripts written without spaces: Thai, Lao, Burmese, Khmer, Japanese, Chinese.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Short items of so many words are searched for without edits, and what they match is marked.
FEW_WORDS = 2
MATCH = "id long, item_id long, distance int, start long, end long, few_words boolean"


def plain(text: str) -> str:
    return BREAK.sub(" ", text.lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 parts of about the same length, with their places."""
    edges = [round(len(item) * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:]) if b > a]


def myers(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of text that is closest to item, the first if several; None beyond budget."""
    m = len(item)
    equal: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        equal[c] |= 1 << i
    equal = dict(equal)
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = equal.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus = down | ~(h | up) & full
        minus = up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(v | plus) & full, plus & v
        if score <= budget and (best is None or score < best[0]):
            best = score, at + 1
    return best


def word_count(text: str) -> int:
    return len(UNSPACED.sub(" x ", text).split())


def borders(text: str, low: int, high: int) -> list[int]:
    """Places from low to high where a word begins or ends."""
    out = []
    for p in range(max(0, low), min(len(text), high) + 1):
        near = text[max(0, p - 1) : p + 1]
        if p in (0, len(text)) or " " in near or UNSPACED.search(near):
            out.append(p)
    return out


def whole_words(item: str, text: str, starts: Iterable[int], budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest passage that begins at one of the places and ends with a word; None beyond budget."""
    best = None
    for start in starts:
        if text[start : start + 1] in ("", " "):
            continue
        part = text[start : start + len(item) + budget]
        ends = {p - start for p in borders(text, start + len(item) - budget, start + len(part)) if p > start and text[p - 1] != " "}
        if not ends:
            continue
        row = list(range(len(item) + 1))
        for j, c in enumerate(part, 1):
            last, row[0] = row[0], j
            for i, d in enumerate(item, 1):
                last, row[i] = row[i], min(last + (c != d), row[i] + 1, row[i - 1] + 1)
            if j in ends and row[-1] <= budget and (best is None or (row[-1], start) < best[:2]):
                best = row[-1], start, start + j
    return best


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int):
        import ahocorasick

        self.automaton, self.items = ahocorasick.Automaton(), []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            short = len(text) < least_chars
            few = short and word_count(text) <= FEW_WORDS
            budget = 0 if few else int(len(text) * rate)
            for at, piece in pieces(text, budget):
                places[piece].append((len(self.items), at))
            self.items.append((item_id, text, budget, short, few))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.searchable = bool(places)
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int, bool]]:
        """(item_id, distance, start, end, few_words) in the plain text, the best passage of each item found."""
        out = []
        if not self.searchable:
            return out
        regions: dict[int, list[list[int]]] = {}
        starts: dict[int, set[int]] = {}  # of short items
        for end, (n, where) in self.automaton.iter(text):
            for k, at in where:
                _, item, budget, short, _ = self.items[k]
                from_ = end + 1 - n - at
                if short:
                    if places := borders(text, from_ - budget, from_ + budget):
                        starts.setdefault(k, set()).update(places)
                    continue
                lo, hi = max(0, from_ - budget), from_ + len(item) + budget
                own = regions.setdefault(k, [])
                if own and lo <= own[-1][1] and lo >= own[-1][0] - len(item):
                    own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]  # one scan for regions that overlap
                else:
                    own.append([lo, hi])
        for k, own in regions.items():
            item_id, item, budget, *_ = self.items[k]
            best = None
            for lo, hi in own:
                if (found := myers(item, text[lo:hi], budget)) and (best is None or found[0] < best[0]):
                    best = found[0], lo + found[1]
            if best:
                begin = max(0, best[1] - len(item) - budget)
                _, length = myers(item[::-1], text[begin : best[1]][::-1], best[0])
                out.append((item_id, best[0], best[1] - length, best[1], False))
        for k, places in starts.items():
            item_id, item, budget, _, few = self.items[k]
            if found := whole_words(item, text, sorted(places), budget):
                out.append((item_id, *found, few and found[1:] != (0, len(text))))
        return sorted(out, key=lambda x: (x[0] is not None, *(v or 0 for v in x)))


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original text for spans of its plain form, in whole words."""
    low = text.lower()
    if len(low) == len(text):
        origin = range(len(text))
    else:  # some characters have longer lower cases
        origin = [i for i, c in enumerate(text) for _ in c.lower()]
    starts, ends, own, at = [], [], [], 0  # of words, in the plain form
    for word in WORDS.finditer(low):
        starts.append(at)
        at += len(word[0])
        ends.append(at)
        own.append(word.span())
        at += 1
    out = []
    for start, end in spans:
        first, last = bisect_right(ends, start), bisect_left(starts, end) - 1
        out.append((origin[own[first][0]], origin[own[last][1] - 1] + 1) if first <= last else (0, 0))
    return out


def item_blocks(items: DataFrame, block_chars: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block, held = [], 0
    for row in items.select(identifier(items, id_col), text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        if text := plain(row[1]):
            if block and held + len(text) > block_chars:
                yield block
                block, held = [], 0
            block.append((row[0], text))
            held += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.08, least_chars: int = 40, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, distance, start, end, few_words): a row for each document and item that it holds within the budget."""

    def search(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Items(block, rate, least_chars)
            schema = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("few_words", pa.bool_())])
            for batch in slices(batches, 256):
                out = []
                for doc_id, text in zip(column(batch, "id").to_pylist(), column(batch, "text")):
                    text = text.as_py() or ""
                    if found := own.matches(plain(text)):
                        spans = original_spans(text, [x[2:4] for x in found])
                        out += [{"id": doc_id, "item_id": i, "distance": d, "start": a, "end": b, "few_words": few} for (i, d, _, _, few), (a, b) in zip(found, spans)]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

        return rows.mapInArrow(run, MATCH)

    rows = docs.select(identifier(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    found = [search(block) for block in item_blocks(items, block_chars, item_id_col, item_text_col)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], MATCH)


def clean_documents(docs: DataFrame, items: DataFrame, rate: float = 0.08, least_chars: int = 40, block_chars: int = 4_000_000, few_words: bool = False) -> DataFrame:
    """The rows of docs that hold no item; few_words: nor words of an item of one or two."""
    for block in item_blocks(items, block_chars, "item_id", "text"):

        def run(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = Items(block, rate, least_chars)
            for batch in slices(batches, 256):
                yield batch.filter(pa.array([all(m[4] and not few_words for m in own.matches(plain(x.as_py() or ""))) for x in column(batch, "text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents only."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")
