"""Token ids in sorted-string tables: documents keyed by identifier, in shards that a binary search reads.

A shard is one file:

    block*   entries in key order; a key is stored as the length it shares with the one before and the rest, then the
             length of the value and the value (token ids, little-endian, 2 bytes each if the vocabulary allows, else 4);
             a CRC-32 ends the block
    index    for each block its last key, offset and length (sparse: one entry for each block)
    filter   a Bloom filter of the keys
    footer   fixed size: offsets of index and filter, counts, width of an id, magic bytes

Keys are 9 bytes: 0 for a null identifier or 1, then the identifier, big-endian, shifted to be unsigned; so null comes
first and byte order is id order.  Documents with the same identifier lie next to each other, ordered by a hash of the text.

Spark range-partitions and sorts by identifier and hash, so that documents that share an identifier (or have none) may lie in
several shards, and each task streams one shard to the shared folder under a name of its own, renamed when complete: a
repeated or speculative task replaces a shard by the same bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, new_folder, slices, table

MAGIC = b"BRSST\x00\x00\x01"
FOOTER = "<QQQQQQI4x8s"  # index, filter and footer offsets, documents, tokens, filter's bits, width
ENTRY = "<HHQ"  # bytes shared, bytes of the rest of the key, bytes of the value
INDEX = "<QQH"  # offset, length, bytes of the last key
BLOCK = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7

#: Texts are cut only where no pretoken can span: before a space or line end between two other characters.
SAFE_CUT = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n\S))")
UNSAFE = re.compile(r"\s\s")
#: A part as most are: perhaps a line end, letters (in any version of Unicode), perhaps ASCII marks; each a pretoken.
USUAL = re.compile(r"(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)\Z")
INSIDE = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*[!-/:-@\[-`{-~]*\Z")
#: Kept parts in each worker; beyond that the long ones go, which seldom come again.  No more than twice as many are ever kept.
CACHE, SHORT = 600_000, 8


class Parts(dict):
    """Ids of parts, made when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(part)
        if len(self) < 2 * CACHE:
            self[part] = ids
        return ids


def may_be_cut(tokenizer) -> bool:
    """Whether a tokenizer is of the kind whose texts may be encoded in parts: byte-level BPE with the usual word pattern, nothing
    before it, and no added token that could lie across a cut or inside a usual part."""
    config = json.loads(tokenizer.to_str())
    before, model = config["pre_tokenizer"] or {}, config["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not config["normalizer"] and not config["truncation"]
    bpe = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = config["added_tokens"]
    return bool(plain and bpe and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) or INSIDE.match(x["content"]) for x in added))


class Encoder:
    """Encodes texts with a tokenizer of the tokenizers library.

    For byte-level BPE with the usual word pattern, a space between two visible characters always starts a
    pretoken, and a line end there is one, so a text's ids are those of its parts cut there.  A part stands for
    itself behind a space, or begins with its line end.  Parts repeat, so their ids are kept in the worker process,
    across tasks.  The library encodes each new part; letters are one pretoken and go straight to its BPE model.
    With a tokenizer of another kind (may_be_cut) the library encodes whole texts.
    plain: the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_brindle", {})  # this module lives as long as the worker
        if (path, plain) not in kept:
            tokenizer = tokenizers.Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = plain
            kept[path, plain] = tokenizer, Parts(None), may_be_cut(tokenizer)
        self.tokenizer, self.parts, self.in_parts = kept[path, plain]
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # byte-level vocabularies write the bytes that aren't visible in Latin-1 as the characters from U+0100 on
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.visible = {b: 256 + i for i, b in enumerate(hidden)}
        self.marks = Parts(self.ids)
        self.parts.encode = self.part

    def ids(self, text: str) -> bytes:
        return array("H" if self.width == 2 else "I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, letters: str, space: str) -> bytes:
        shown = space + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.visible))
        return array("H" if self.width == 2 else "I", [x.id for x in self.model.tokenize(shown)]).tobytes()

    def part(self, part: str) -> bytes:
        if not (usual := USUAL.match(part)):
            return self.ids(part if part[:1] == "\n" else " " + part)
        line, letters, marks = usual.groups()
        own = self.marks["\n"] + self.word(letters, "") if line else self.parts[letters] if marks else self.word(letters, "\u0120")
        return own + self.marks[marks] if marks else own

    def cut(self, text: str) -> list[str]:
        if UNSAFE.search(text) or text[:1].isspace() or text[-1:].isspace():
            return SAFE_CUT.split(text)
        return text.replace("\n", " \n").split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.in_parts:
            return [self.ids(text) for text in texts]
        parts = self.parts
        if len(parts) > CACHE:
            short = {k: v for k, v in parts.items() if len(k) <= SHORT}
            parts.clear()
            if len(short) < CACHE // 2:
                parts.update(short)
        out = []
        for text in texts:
            first, *rest = self.cut(text)
            out.append(self.ids(first) + b"".join(map(parts.__getitem__, rest)))
        return out


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; keys must come in order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.index, self.hashes = bytearray(), b"", [], []
        self.docs = self.tokens = 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        from xxhash import xxh64_intdigest

        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        self.block += struct.pack(ENTRY, shared, len(key) - shared, len(value)) + key[shared:] + value
        if not self.docs or key != self.last:
            self.hashes.append(xxh64_intdigest(key))
        self.last = key
        self.docs += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index.append(struct.pack(INDEX, self.at, len(self.block), len(self.last)) + self.last)
            self.put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        index = self.at
        self.put(b"".join(self.index))
        bloom = self.at
        bits = max(64, BLOOM_BITS * len(self.hashes) + 7 & ~7)
        h = np.array(self.hashes, np.uint64)
        flags = np.zeros(bits, np.uint8)
        for i in range(BLOOM_HASHES):
            flags[bloom_bit(h, i, bits)] = 1
        self.put(np.packbits(flags, bitorder="little").tobytes())
        self.put(struct.pack(FOOTER, index, bloom, self.at, self.docs, self.tokens, bits, self.width, MAGIC))


def bloom_bit(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h >> np.uint64(32)) + np.uint64(i) * (h & np.uint64(0xFFFFFFFF))) % np.uint64(bits)


class Shard:
    """Reads one shard: all entries in order, or those of one key."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - struct.calcsize(FOOTER))
        at, bloom, end, self.docs, self.tokens, self.bits, self.width, magic = struct.unpack(FOOTER, file.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("this isn't a shard of token ids, or it is cut short")
        self.bloom_at, self.bloom_bytes = bloom, end - bloom
        file.seek(at)
        data, i, self.index = file.read(bloom - at), 0, []
        while i < len(data):
            offset, length, n = struct.unpack_from(INDEX, data, i)
            i += struct.calcsize(INDEX) + n
            self.index.append((data[i - n : i], offset, length))

    def block(self, offset: int, length: int) -> Iterator[tuple[bytes, bytes]]:
        self.file.seek(offset)
        data = self.file.read(length + 4)
        if zlib.crc32(memoryview(data)[:length]) != int.from_bytes(data[length:], "little"):
            raise ValueError("a block of token ids is damaged")
        at, key = 0, b""
        while at < length:
            shared, rest, n = struct.unpack_from(ENTRY, data, at)
            at += struct.calcsize(ENTRY)
            key = key[:shared] + data[at : at + rest]
            at += rest + n
            yield key, data[at - n : at]

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, offset, length in self.index:
            yield from self.block(offset, length)

    def maybe(self, key: bytes) -> bool:
        """False if the filter rules the key out."""
        from xxhash import xxh64_intdigest

        h = np.array([xxh64_intdigest(key)], np.uint64)
        for i in range(BLOOM_HASHES):
            bit = int(bloom_bit(h, i, self.bits)[0])
            self.file.seek(self.bloom_at + bit // 8)
            if not self.file.read(1)[0] >> bit % 8 & 1:
                return False
        return True

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of each document with this identifier."""
        key = key_of(doc_id)
        found = []
        if self.index and self.maybe(key):
            for last, offset, length in self.index[bisect_left(self.index, key, key=lambda x: x[0]) :]:
                found += [np.frombuffer(v, f"<u{self.width}") for k, v in self.block(offset, length) if k == key]
                if last > key:
                    break
        return found


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards when its rows are asked for: (shard, path, docs, tokens, first key, last key), one for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, where = filesystem(folder)
        fs.create_dir(where, recursive=True)
        name = f"{where}/part-{context.partitionId():06d}.sst"
        part = f"{where}/_part-{context.partitionId():06d}-{context.taskAttemptId()}"
        encode = Encoder(tokenizer)
        tail = b"" if end_id is None else np.array([end_id], f"<u{encode.width}").tobytes()
        first = last = None
        with fs.open_output_stream(part) as out:
            to = ShardWriter(out, encode.width)
            for batch in slices(batches, 256):
                ids, values = column(batch, "id").to_pylist(), encode([x or "" for x in column(batch, "text").to_pylist()])
                for doc_id, value in zip(ids, values):
                    to.add(last := key_of(doc_id), value + tail)
                    first = first or last
            to.close()
        fs.move(part, name)
        yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "path": name, "docs": to.docs, "tokens": to.tokens, "first": first, "last": last}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")
    return rows.mapInArrow(run, "shard int, path string, docs long, tokens long, first binary, last binary")


def read_shards(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """A row (id, start, ids, width) for each document; start counts the ids of all documents before it."""
    manifest = sorted(manifest, key=lambda x: x["shard"])
    starts = accumulate((x["tokens"] for x in manifest), initial=0)
    rows = [(x["path"], s) for x, s in zip(manifest, starts) if x["docs"]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(column(batch, "path").to_pylist(), column(batch, "start").to_pylist()):
                with fs.open_input_file(path) as file:
                    shard, ids, begin, values, held = Shard(file), [], [], [], 0
                    for key, value in shard:
                        ids.append(id_of(key))
                        begin.append(start)
                        values.append(value)
                        start += len(value) // shard.width
                        held += len(value)
                        if held > 4 << 20:
                            yield batch_of(ids, begin, values, shard.width)
                            ids, begin, values, held = [], [], [], 0
                    if ids:
                        yield batch_of(ids, begin, values, shard.width)

    def batch_of(ids, begin, values, width):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begin, pa.int64()), pa.array(values, pa.binary()), pa.array([width] * len(ids), pa.int32())], ["id", "start", "ids", "width"])

    files = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(run, "id long, start long, ids binary, width int")


def digest(documents: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of what read_shards() gives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, ids = column(batch, "width").to_pylist(), column(batch, "ids")
            n = [len(x.as_buffer()) // w for x, w in zip(ids, widths)]
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4")) for x, w in zip(ids, widths)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def op4_token_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; null identifiers come first; repeated rows are separate documents."""
    import public_tokenizers

    folder = new_folder(spark, "token-shards")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2, shards).collect()  # a row for each shard
    return digest(read_shards(spark, folder, manifest)).withColumnRenamed("id", "doc_id")
