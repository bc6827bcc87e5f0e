"""Token-id shards against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm.common import new_folder
from brindle.llm.tokens import Encoder, Shard, digest, may_be_cut, op4_token_id_shards, read_shards, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id string, ids string, start long"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def write(spark, rows, shards=3):
    docs, folder = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], SCHEMA), new_folder(spark, "tokens")
    return folder, write_shards(docs, folder, PATH, 2, shards).collect()


def ids_of(row):
    return list(map(int, np.frombuffer(bytes(row["ids"]), f"<u{row['width']}")))


def test_encoder_agrees_with_the_library(tokenizer):
    rng = random.Random(3)
    parts = ["a", "b", "the", "The", " ", " ", "\n", ".", ",", "'s", "é", "ß", " ", "\t", "1", "23", "<|endoftext|>", "　", "😀", "中", "  ", "\n\n", "!", "'", "\x85", "\x1c", "ª", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    found = Encoder(PATH)(texts)
    assert [list(np.frombuffer(x, "<u2")) for x in found] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(spark, tokenizer):
    rows = [(i * 7 - 50, f"text number {i}, with\nlines  and  spaces" * (i % 5)) for i in range(200)] + [(None, "no number"), (3000, None), (3001, ""), (3002, "word " * 300_000), (-51, "b"), (-51, "a"), (2**63 - 1, "last"), (-(2**63), "first")]
    folder, manifest = write(spark, rows)
    found = sorted(read_shards(spark, folder, manifest).collect(), key=lambda x: x["start"])
    hashes = {x["text"]: x["h"] for x in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    assert [x["id"] for x in found] == [r[0] for r in expected]
    assert [ids_of(x) for x in found] == [tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in expected]
    starts = np.cumsum([0] + [len(ids_of(x)) for x in found])
    assert [x["start"] for x in found] == list(starts[:-1])


def test_tokenizers_of_other_kinds(tmp_path):
    """Whole texts where a cut isn't safe: another pattern, and an added token with a space or inside a word."""
    texts = ["Hello there\n the new\nworld, of  words 12 New York newyork", "", " a\tb c"]
    usual = Tokenizer.from_file(PATH)
    assert may_be_cut(usual)
    for k, token in enumerate(("New York", "world")):
        other = Tokenizer.from_file(PATH)
        other.add_tokens([token])
        other.save(f"{tmp_path}/{k}.json")
    for path in (f"{tmp_path}/0.json", f"{tmp_path}/1.json", public_tokenizers.path("word_bpe_49k.json")):
        library, encode = Tokenizer.from_file(str(path)), Encoder(str(path))
        assert not may_be_cut(library)
        assert [list(np.frombuffer(x, f"<u{encode.width}")) for x in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_hot_id_lies_in_many_shards(spark):
    rows = [(None, f"nameless {i} " * (i % 9)) for i in range(400)] + [(7, f"same {i}") for i in range(400)]
    folder, manifest = write(spark, rows, 8)
    assert sum(x["docs"] for x in manifest) == 800 and max(x["docs"] for x in manifest) < 300
    found = sorted(read_shards(spark, folder, manifest).collect(), key=lambda x: x["start"])
    assert [x["id"] for x in found] == [None] * 400 + [7] * 400


def test_lookup(spark, tokenizer):
    rows = [(i * 3, f"document {i} " * (i % 90)) for i in range(900)] + [(30, "twice")]
    _, manifest = write(spark, rows, 2)
    texts = dict(rows)
    fs, _ = FileSystem.from_uri(manifest[0]["path"])
    shards = [Shard(fs.open_input_file(x["path"])) for x in manifest]
    assert all(len(s.index) > 1 for s in shards)
    find = lambda i: [list(map(int, x)) for s in shards for x in s.get(i)]
    for i in (0, 3, 2697, 1500):
        assert find(i) == [tokenizer.encode(texts[i], add_special_tokens=False).ids + [2]]
    assert len(find(30)) == 2
    assert not any(find(i) for i in (1, -3, 2700, None))
    absent = sum(s.maybe(b"\1" + (i + (1 << 63)).to_bytes(8, "big")) for s in shards for i in range(1, 2700, 3))
    assert absent < 100  # the filter's false hits, of 1800


def test_damage_is_noticed(spark):
    _, manifest = write(spark, [(1, "some text")], 1)
    path = next(x["path"] for x in manifest if x["docs"])
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    fs, _ = FileSystem.from_uri(path)
    with pytest.raises(ValueError):
        list(Shard(fs.open_input_file(path)))


def test_empty_table(spark):
    folder, manifest = write(spark, [])
    assert digest(read_shards(spark, folder, manifest)).collect() == []


def test_query(spark, sf_dir, tokenizer):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, expected = 0, []
    for x in rows:
        ids = tokenizer.encode(x["text"], add_special_tokens=False).ids + [2]
        expected.append((x["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert sorted(map(tuple, op4_token_id_shards(spark, sf_dir).collect())) == expected
