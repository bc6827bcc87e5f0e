"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level tokenizer of the tokenizers library, B a model of sentencepiece; both encode the text behind a space.  Each
lays its tokens over the same bytes, so where tokens of both end is a cut, and the tokens between two cuts are a group.

1.  Texts are encoded in parts, cut only where neither tokenizer's tokens can span; the ids of parts are kept in the worker.  With
    tokenizers that don't allow this, whole texts are encoded.
2.  The bytes of a whole batch lie one behind the other.  One count of the ends of A's and B's tokens by byte offset
    gives the cuts (both) and the links: between two neighbouring ends of either lies the overlap of exactly one token of A and
    one of B, which running sums of the ends number.  Sums up to the documents' ends give each document's share.
3.  A chunk of documents is a task's share of about CHUNK bytes of text.  It has a dictionary of its pairs of ids, with the number of its
    documents that hold each; a document keeps places in the dictionary and how often it holds them.  All is written to one table.
4.  Dictionaries add up to the counts of the corpus.  Each dictionary asks for its own pairs' counts, and the answers return
    to the chunk, so that what is shuffled is dictionaries and places, and not links.  Nothing is broadcast.

A document is a row; identifiers may be null or repeat.  A text that is null or empty, or whose tokens of A or B don't have the
bytes of the space and the text, has no tokens: zeros, and '' for the hash.  A long text is taken in segments
where it may be cut.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, slices, table, written
from .tokens import SAFE_CUT, Encoder

#: Bytes of text in a step of numpy, of a segment, and of a chunk.
STEP, SEGMENT, CHUNK = 2 << 20, 1 << 20, 32 << 20
#: Parts whose ids are kept by each encoder; all go when there are more.
KEPT = 200_000
SPACE = "▁"


def ids_type(n: int) -> str:
    return "H" if n <= 1 << 16 else "I"


class Vocabulary:
    """What a tokenizer's ids stand for: `length` in bytes, the bytes, and the ids as decimals."""

    def __init__(self, tokens: list[bytes], parts: dict[str, bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.flat, self.at = np.frombuffer(b"".join(tokens) or b"\0", np.uint8), np.concatenate([[0], np.cumsum(self.length)[:-1]])
        digits = [str(i).encode() for i in range(len(tokens))]
        if len(digits[-1]) > 7:
            raise ValueError("ids have more than seven digits")
        self.digits = np.array([len(d) + 1 for d in digits], np.int64)
        self.shown = lambda mark: np.frombuffer(b"".join((d + mark).ljust(8, b"\0") for d in digits), "<u8")
        self.type, self.parts = ids_type(len(tokens)), parts

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        begin = np.cumsum(length) - length
        return self.flat[np.repeat(self.at[ids] - begin, length) + np.arange(int(length.sum()))]


class ByteTokens(Vocabulary):
    """Tokenizer A."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, plain=True)
        of_char = {chr(b): b for b in range(256) if b not in self.encoder.visible} | {chr(c): b for b, c in self.encoder.visible.items()}
        names = self.encoder.tokenizer.get_vocab()
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = bytes(map(of_char.__getitem__, name)) if all(c in of_char for c in name) else name.encode()
        super().__init__(tokens, {})
        self.type = "H" if self.encoder.width == 2 else "I"
        self.in_parts = self.encoder.in_parts

    def whole(self, text: str) -> bytes:
        return self.encoder.ids(" " + text)

    def add(self, parts: list[str]) -> None:
        for p in parts:
            self.parts[p] = self.encoder.part(p)


class PieceTokens(Vocabulary):
    """Tokenizer B.  Texts may be cut before a space or a line end if the model changes no text, no piece goes on behind a space that
    follows something else, and none holds a line end."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        tokens = [bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(names)]
        super().__init__(tokens, {})
        self.begin = array(self.type, [self.model.piece_to_id(SPACE)]).tobytes()
        self.in_parts = self.unchanged() and not any(SPACE in t.lstrip(SPACE) or "\n" in t for t in names)

    def unchanged(self) -> bool:
        """Whether the model encodes texts as they are, behind a space."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False
        own = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        how = own.normalizer_spec
        return not how.precompiled_charsmap and how.add_dummy_prefix and not how.remove_extra_whitespaces and not own.trainer_spec.treat_whitespace_as_suffix

    def whole(self, text: str) -> bytes:
        return array(self.type, self.model.encode(text)).tobytes()

    def add(self, parts: list[str]) -> None:
        for p, ids in zip(parts, self.model.encode(parts, num_threads=1)):
            ids = array(self.type, ids).tobytes()
            # a part that begins with its line end has no space before it, but the model puts one there
            self.parts[p] = ids if p[:1] != "\n" else ids[len(self.begin) :] if ids.startswith(self.begin) else self.refuse(p)

    def refuse(self, part: str) -> bytes:
        raise ValueError(f"the model joins a line end to the space before it: {part[:20]!r}")


def segments(text: str, cut: bool) -> list[str]:
    """A text in segments, cut as parts are: each but the first is behind a space, or begins with its line end."""
    out, at = [], 0
    while cut and len(text) - at > 2 * SEGMENT and (m := SAFE_CUT.search(text, at + SEGMENT)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]] if out else [text]


def encoded(tokens: tuple[ByteTokens, PieceTokens], segs: list[str], firsts: list[bool], cut: bool) -> list[list[bytes]]:
    """The ids of each segment, for each tokenizer.  A segment that begins a text is behind a space whatever it begins with."""
    if not cut:
        return [[t.whole(s) for s in segs] for t in tokens]
    parts = [tokens[0].encoder.cut(s) for s in segs]
    heads = [p[0] if first and p[0][:1] == "\n" else None for p, first in zip(parts, firsts)]
    parts = [p if h is None else p[1:] for p, h in zip(parts, heads)]
    needed, out = set().union(*parts), []
    for t in tokens:
        if len(t.parts) > KEPT:
            t.parts.clear()
        t.add([p for p in needed if p not in t.parts])
        out.append([(b"" if h is None else t.whole(h)) + b"".join(map(t.parts.__getitem__, p)) for p, h in zip(parts, heads)])
    return out


def offsets(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


class Step:
    """Alignment of a batch of segments: the numbers of each, the text of its groups, and its links as pairs of ids."""

    def __init__(self, a: Vocabulary, b: Vocabulary, ids_a: list[bytes], ids_b: list[bytes], data: list[bytes]):
        self.vocabularies, size = (a, b), np.array([len(x) for x in data], np.int64)
        whole = np.frombuffer(b"".join(data), np.uint8)
        self.fine = np.ones(len(data), bool)
        ids = []
        for v, own in ((a, ids_a), (b, ids_b)):
            flat = np.frombuffer(b"".join(own), np.dtype(v.type).newbyteorder("<")).astype(np.int64)
            at = offsets(np.array([len(x) for x in own], np.int64) // np.dtype(v.type).itemsize)
            self.fine &= np.diff(offsets(v.length[flat])[at]) == size
            ids.append((flat, at))
        if not self.fine.all():
            ids = [self.kept(*x) for x in ids]
            whole = whole[np.repeat(self.fine, size)]
        size = np.where(self.fine, size, 0)
        ends = offsets(size)
        wrong = np.zeros(len(whole), bool)
        for v, (flat, _) in zip((a, b), ids):
            wrong |= v.bytes_of(flat) != whole
        if wrong.any():
            self.fine &= np.diff(offsets(wrong)[ends]) == 0
            ids = [self.kept(*x) for x in ids]
            size = np.where(self.fine, size, 0)
            ends = offsets(size)
        self.align(*ids[0], *ids[1], ends)

    def kept(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(at)
        return flat[np.repeat(self.fine, n)], offsets(np.where(self.fine, n, 0))

    def align(self, a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, ends: np.ndarray) -> None:
        va, vb = self.vocabularies
        marks = np.bincount(np.cumsum(va.length[a]), minlength=ends[-1] + 1) + 2 * np.bincount(np.cumsum(vb.length[b]), minlength=ends[-1] + 1)
        where = np.flatnonzero(marks)
        kind = marks[where]
        end_a, end_b, cut = kind & 1, kind >> 1, kind == 3
        self.links = np.searchsorted(where, ends, "right")  # links before each segment
        group = np.cumsum(cut) - cut
        self.n_a, self.n_b, self.n_links, self.n_groups = np.diff(at_a), np.diff(at_b), np.diff(self.links), np.diff(offsets(cut)[self.links])
        self.pairs = a[np.cumsum(end_a) - end_a] * len(vb.length) + b[np.cumsum(end_b) - end_b]
        group_a, group_b = group[end_a > 0], group[end_b > 0]
        groups = int(cut.sum())
        place_a = np.arange(len(a)) + offsets(np.bincount(group_b, minlength=groups))[group_a]
        place_b = np.arange(len(b)) + np.cumsum(np.bincount(group_a, minlength=groups))[group_b]
        shown = np.zeros(len(a) + len(b), "<u8")
        shown[place_a] = np.where(cut[end_a > 0], va.last[a], va.inner[a])
        shown[place_b] = np.where(cut[end_b > 0], vb.last[b], vb.inner[b])
        chars = shown.view(np.uint8)
        self.text = memoryview(chars[chars != 0])
        self.chars = offsets(va.digits[a])[at_a] + offsets(vb.digits[b])[at_b]

    def groups(self, i: int) -> memoryview:
        """The groups of segment i, each ended by a semicolon."""
        return self.text[self.chars[i] : self.chars[i + 1]]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import tokenizers  # lives as long as the worker, and so does what is kept here

        kept = tokenizers.__dict__.setdefault("_brindle_pairs", {})
        if (path_a, path_b) not in kept:
            a, b = ByteTokens(path_a), PieceTokens(path_b)
            (a.inner, a.last), (b.inner, b.last) = ((v.shown(b","), v.shown(mark)) for v, mark in ((a, b"|"), (b, b";")))
            kept[path_a, path_b] = a, b
        self.tokens = kept[path_a, path_b]
        self.cut = all(t.in_parts for t in self.tokens)

    def documents(self, texts: Iterable[tuple[int | None, str | None]]) -> Iterator[dict]:
        """Each document's numbers, hash, and distinct pairs with how often it has each, in order."""
        todo, held = [], 0
        now: dict = {}
        for doc_id, text in texts:
            parts = segments(text, self.cut) if text else [""]
            for k, part in enumerate(parts):
                todo.append((doc_id, part, k == 0, k == len(parts) - 1, bool(text)))
                held += len(part)
                if held >= STEP // 2 or len(todo) >= 4096:
                    yield from self.step(todo, now)
                    todo, held = [], 0
        yield from self.step(todo, now)

    def step(self, todo: list[tuple], now: dict) -> Iterator[dict]:
        segs, firsts = [x[1] for x in todo], [x[2] for x in todo]
        has = [x[4] for x in todo]
        real = [i for i, x in enumerate(has) if x]
        data = [(b"" if segs[i][:1] == "\n" and not firsts[i] else b" ") + segs[i].encode() for i in real]
        if not real and not todo:
            return
        ids = encoded(self.tokens, [segs[i] for i in real], [firsts[i] for i in real], self.cut) if real else [[], []]
        step = Step(*self.tokens, *ids, data)
        span, n = len(self.tokens[0].length) * len(self.tokens[1].length), len(real)
        key, often = np.unique(np.repeat(np.arange(n), step.n_links) * span + step.pairs, return_counts=True)
        at = np.searchsorted(key, np.arange(n + 1) * span)
        key %= span
        number = dict(zip(real, range(n)))
        for i, (doc_id, _, first, last, _) in enumerate(todo):
            if first:
                now.clear()
                now.update(doc_id=doc_id, n_a=0, n_b=0, n_groups=0, n_links=0, fine=has[i], hash=hashlib.sha256(), pairs=[])
            if has[i]:
                k = number[i]
                now["fine"] &= bool(step.fine[k])
                for c in ("n_a", "n_b", "n_groups", "n_links"):
                    now[c] += int(getattr(step, c)[k])
                text = step.groups(k)
                now["hash"].update(text[:-1] if last else text)
                now["pairs"].append((key[at[k] : at[k + 1]], often[at[k] : at[k + 1]]))
            if last:
                yield self.finished(now)

    @staticmethod
    def finished(now: dict) -> dict:
        none = np.zeros(0, np.int64)
        if not now["fine"]:
            return {"doc_id": now["doc_id"], "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": none, "often": none}
        pairs, often = (np.concatenate(x) for x in zip(*now["pairs"]))
        if len(now["pairs"]) > 1:
            pairs, of = np.unique(pairs, return_inverse=True)
            often = np.bincount(of, often, len(pairs)).astype(np.int64)
        return {c: now[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": now["hash"].hexdigest(), "pairs": pairs, "often": often}


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
NUMBERS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
CHUNKS = pa.schema([("chunk", pa.int64()), *((c, pa.int64()) for c in NUMBERS[:-1]), (NUMBERS[-1], pa.string()), ("places", pa.binary()), ("often", pa.binary()), ("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])


def chunk_rows(docs: list[dict], chunk: int, n_b: int) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk: its documents, then its dictionary."""
    pairs, place = np.unique(np.concatenate([d["pairs"] for d in docs]), return_inverse=True)
    at = offsets(np.array([len(d["pairs"]) for d in docs]))
    place = place.astype("<u4")
    columns = {"chunk": pa.array([chunk] * len(docs), pa.int64())}
    columns |= {c: pa.array([d[c] for d in docs], CHUNKS.field(c).type) for c in NUMBERS}
    columns |= {"places": pa.array([place[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()), "often": pa.array([d["often"].astype("<u4").tobytes() for d in docs], pa.binary())}
    yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(docs), f.type)) for f in CHUNKS], schema=CHUNKS)
    n = len(pairs)
    columns = {"chunk": pa.array(np.full(n, chunk)), "place": pa.array(np.arange(n, dtype=np.int32)), "a": pa.array((pairs // n_b).astype(np.int32)), "b": pa.array((pairs % n_b).astype(np.int32)), "docs": pa.array(np.bincount(place, minlength=n))}
    yield from pa.Table.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in CHUNKS], schema=CHUNKS).to_batches(1 << 16)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of chunks: rows with a null place are documents, the others entries of the chunk's dictionary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(path_a, path_b)
        n_b, chunk = len(aligner.tokens[1].length), TaskContext.get().partitionId() << 32
        held, own = 0, []

        def texts() -> Iterator[tuple[int | None, str | None]]:
            for batch in slices(batches, 256):
                yield from zip(column(batch, "id").to_pylist(), column(batch, "text").to_pylist())

        for d in aligner.documents(texts()):
            own.append(d)
            held += d["n_a"] * 4 + 64  # about the bytes of its text
            if held >= CHUNK:
                yield from chunk_rows(own, chunk, n_b)
                chunk, held, own = chunk + 1, 0, []
        if own:
            yield from chunk_rows(own, chunk, n_b)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, f"chunk long, {DOCUMENT}, places binary, often binary, place int, a int, b int, docs long"), "aligned")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, count, best): the documents that hold each pair of ids linked, and whether no other pair of this a is held by more."""
    counts = chunks.filter("place IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # the rows of an a are ids of b, no more than the vocabulary has
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    chunks = aligned(docs, path_a, path_b, id_col, text_col)
    entries = chunks.filter("place IS NOT NULL").select("chunk", "place", "a", "b")
    answers = entries.join(pair_counts(chunks).hint("merge"), ["a", "b"]).select(F.col("chunk").alias("of"), "place", "count", "best")

    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        place = answers["place"].to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = answers["count"].to_numpy(), answers["best"].to_numpy()
        at, often = (np.frombuffer(b"".join(documents[c].to_pylist()), "<u4").astype(np.int64) for c in ("places", "often"))
        ends = offsets(np.array([len(x.as_buffer()) // 4 for chunk in documents["places"].chunks for x in chunk], np.int64))
        total = lambda values: pa.array(np.diff(offsets(values)[ends]))
        columns = {c: documents[c] for c in NUMBERS}
        return pa.table(columns | {"n_best": total(often * best[at]), "count_sum": total(often * count[at])})

    documents = chunks.filter("place IS NULL").select("chunk", *NUMBERS, "places", "often")
    out = documents.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, f"{DOCUMENT}, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
