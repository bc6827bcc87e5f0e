"""The alignment of two tokenizers against a plain one, token by token."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import align as module
from brindle.llm.align import Aligner, align, op13_align_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_of_char():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Plain:
    def __init__(self):
        self.a, self.b, self.chars = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of_char()
        self.a.encode_special_tokens = True

    def tokens(self, text):
        a = [(i, bytes(self.chars[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        return a, b

    def document(self, text):
        """The groups' text and all links."""
        if not text:
            return None
        spans = []
        for own in self.tokens(text):
            if b"".join(t for _, t in own) != (" " + text).encode():
                return None
            at, out = 0, []
            for i, t in own:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, lo, starts = [], 0, [0, 0]
        for cut in cuts:
            ids = []
            for side, own in enumerate(spans):
                k = starts[side]
                while k < len(own) and own[k][2] <= cut:
                    k += 1
                ids.append([str(i) for i, *_ in own[starts[side] : k]])
                starts[side] = k
            groups.append("|".join(map(",".join, ids)))
            lo = cut
        links, k = [], 0
        for i, x, y in spans[0]:
            while spans[1][k][2] <= x:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < y:
                links.append((i, spans[1][m][0]))
                m += 1
        assert lo == len((" " + text).encode())
        return len(spans[0]), len(spans[1]), groups, links


def plain(rows):
    own, p = {}, Plain()
    found = [(i, own.setdefault(t, p.document(t))) for i, t in rows]
    count = Counter(pair for _, d in found if d for pair in set(d[3]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for i, d in found:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = d[3]
            out.append((i, d[0], d[1], len(d[2]), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


ODD = [
    None, "", " ", "  ", "\n", "\n\n", "\nline", "a\n", "a ", " a", "a  b", "a \n b", "a\n\nb", "a\r\nb", "\ta\t", "<|endoftext|>", "x <|endoftext|> y <s> </s> <0x41>", "a▁b", "▁", "x ▁y", "日本語 テキスト", "naïve café",
    "ﬁ ① ²", "\0", "a\0b", "🙂🙂", "é́", " x y ", " x", "12345 678", "don't we'll", "x" * 500, "a" + " " * 40 + "b", "…!?", "﻿x", "ẞ", "a\x0bb\x0cc", "\x85", "tab\n\tindented\n    four", "�", "ab\n ", "\n \n",
]


def some_texts(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "quick", "brown", "fox's", "naïve", "日本語", "123", "1,234.5", "é", "##", "(ok)", "zzxqj", "Über", "🙂", " ", "▁", "\0", "http://a.b/c?d=e"]
    gaps = [" "] * 12 + ["\n", "\n\n", "  ", "\t", " \n", "\n ", ""]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found(op13_align_tokens(spark, sf_dir)) == plain([tuple(r) for r in docs])


@pytest.mark.parametrize("cut", [True, False])
def test_odd_texts(spark, monkeypatch, cut):
    rows = list(enumerate([*ODD, *some_texts(1), *ODD[5:9], *some_texts(1, 3)]))
    rows += [(None, "the quick fox"), (None, None), (3, "again"), (3, "again")]
    if not cut:
        monkeypatch.setattr(module.PieceTokens, "unchanged", lambda self: False)
    df = spark.createDataFrame([(i, t, "x", 1, b"y") for i, t in rows], "doc_id long, text string, chunk string, place int, a binary").repartition(3)
    aligner = Aligner(A, B)
    assert aligner.cut or not cut
    assert found(align(df, A, B)) == plain(rows)


def test_long_texts_in_segments_and_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(module, "SEGMENT", 50)
    monkeypatch.setattr(module, "STEP", 300)
    monkeypatch.setattr(module, "CHUNK", 500)
    monkeypatch.setattr(module, "KEPT", 20)
    texts = [*some_texts(2, 60), *ODD, "\n" + "word " * 300, "one\ntwo " * 200, "tail▁ " + "word " * 300, "nospace" * 100]
    assert max(len(module.segments(t or "", True)) for t in texts) > 5
    rows = list(enumerate(texts))
    assert found(align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B)) == plain(rows)


def test_empty_table(spark):
    assert found(align(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []


def test_counts_of_pairs_are_documents(spark):
    df = spark.createDataFrame([(i, "the fox the fox") for i in range(50)] + [(100, "the")], "doc_id long, text string").repartition(7)
    chunks = module.aligned(df, A, B)
    assert {r["count"] for r in module.pair_counts(chunks).collect()} == {50, 51}
    assert chunks.filter("place IS NOT NULL").groupBy("chunk").agg(F.sum("docs").alias("n")).count() > 1
