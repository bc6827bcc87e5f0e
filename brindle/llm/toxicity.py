"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Model.  A word's vector is the sum of hashed embeddings of the word and of its beginnings, so that unseen forms of a known stem
still tell.  A word of more than LONG bytes, as in scripts without spaces, is followed by its windows of WINDOW characters, as words
of their own.  Filters of several widths run over the word vectors of the whole text; the largest response of each
filter (max pooling) feeds a logistic output.  Texts are read in pieces that overlap by a filter's width, of which only the
largest responses are kept, so what a text needs beside itself is bounded and no window is lost.

Training.  On the driver, by stochastic gradient descent, on at most `sample` labelled rows of at most `longest` bytes whose
held-out remainder isn't 0, chosen by a hash of their identifiers.  Embeddings start from each bucket's log odds in the training
rows.  An identifier that several documents share stands for the smallest of their texts.

Calibration.  A fifth of the training rows is kept out of the fit.  For every language, guessed from a text's function
words, the threshold with the best F1 there is chosen (pulled to the common threshold where there are few rows).  The score is the
logistic of the distance to the threshold, so 0.5 is the threshold for every language.

A null text counts as empty and gets a score like any other; a null identifier's remainder is that of an empty string.
Identifiers may repeat.  Without labelled rows of both classes the score is 0 everywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, give_back, hashed_sample, slices, table, texts, words

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: Beginnings of a word, in bytes, that have embeddings of their own; beyond LONG bytes a word's windows of WINDOW characters follow it.
STARTS, LONG, WINDOW = range(4, 12), 24, 8
#: Words that are held at a time.
HELD = 200_000
SAMPLE, SEED = 6000, 5
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the and of to in is that it was for on are with as his they be at this have from or by".split(),
    "der die und das von zu den mit ist im für nicht auf ein eine dem auch sich als des".split(),
    "le les des et une du est dans que pour qui sur pas au par il elle avec ce ne".split(),
    "el los las y en un con por del se que no su para es al lo como más una".split(),
)
STRIP = b".,;:!?\"'()[]{}#*$%&|<>-"


def buckets_of(vocabulary: list[bytes]) -> np.ndarray:
    """Rows of bucket numbers, one row for each word: the word and its beginnings; 0 is none."""
    from xxhash import xxh64_intdigest

    stripped = [w.strip(STRIP) for w in vocabulary]
    raw = np.array(stripped, f"S{LONG}") if stripped else np.empty(0, f"S{LONG}")
    size = np.array([len(w) for w in stripped], np.int64)
    chars = raw.view(np.uint8).reshape(len(raw), LONG).astype(np.uint64)
    out = np.zeros((len(raw), 1 + len(STARTS)), np.int64)
    h = np.full(len(raw), 1469598103934665603, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(LONG):
            h = np.where(size > i, (h ^ chars[:, i]) * np.uint64(1099511628211), h)
            if i + 1 in STARTS:
                mixed = (h + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
                out[:, 1 + STARTS.index(i + 1)] = np.where(size > i + 1, mixed % np.uint64(BUCKETS - 1) + np.uint64(1), 0)
        for k in np.flatnonzero(size > LONG):
            h[k] = xxh64_intdigest(stripped[k])  # all of its bytes
        mixed = h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
    out[:, 0] = np.where(size > 0, mixed % np.uint64(BUCKETS - 1) + np.uint64(1), 0)
    return out


def tokens(data: bytes) -> Iterator[list[bytes]]:
    """Lists of the words of a text in lower case, and of the windows of long ones; no list is much longer than HELD."""
    for part in words(data):
        part = b" ".join(part).decode().lower().encode().split()
        if max(map(len, part), default=0) <= LONG:
            for at in range(0, len(part), HELD):
                yield part[at : at + HELD]
            continue
        out = []
        for w in part:
            out.append(w)
            if len(w) > LONG:
                chars = w.decode()
                for i in range(len(chars) - 1):
                    out.append(chars[i : i + WINDOW].encode())
                    if len(out) >= HELD:
                        yield out
                        out = []
        yield out


class Batch:
    """Words of some texts, each text with a margin of empty words around it."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {b"": 0}
        self.ids: list[int] = []
        self.starts: list[int] = []  # of pieces
        self.owner: list[int] = []  # a piece's text

    def add(self, owner: int, data: bytes) -> Iterator[int]:
        """Takes a text in, piece by piece, and says how many words are held after each; reset() may follow."""
        margin = max(WIDTHS) - 1
        tail = [b""] * margin
        for part in tokens(data):
            self.piece(owner, tail + part)
            tail = (tail + part)[-margin:]
            yield len(self.ids)
        self.piece(owner, tail + [b""] * margin)
        yield len(self.ids)

    def piece(self, owner: int, own: list[bytes]) -> None:
        self.starts.append(len(self.ids))
        self.owner.append(owner)
        self.ids += [self.index.setdefault(w, len(self.index)) for w in own]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        vocabulary = list(self.index)
        language = {w.encode(): k for k, own in enumerate(FUNCTION_WORDS) for w in own}
        said = np.array([language.get(w, 4) for w in vocabulary])
        return np.array(self.ids, np.int64), np.array(self.starts, np.int64), np.array(self.owner, np.int64), buckets_of(vocabulary), said


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)  # for each width: (width, DIM, FILTERS)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS))
    offset: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def pooled(self, ids, starts, buckets) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each piece, and the place of it."""
        vectors = self.embedding[buckets].sum(axis=1)
        ends = np.append(starts[1:], len(ids))
        best, place = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            response = (vectors @ f[0])[ids]
            for k in range(1, w):
                response[:-k] += (vectors @ f[k])[ids[k:]]
            at = np.stack([s + response[s : max(s + 1, e - w + 1)].argmax(axis=0) for s, e in zip(starts, ends)])
            best.append(np.take_along_axis(response, at, axis=0) + b)
            place.append(at)
        return np.hstack(best), np.hstack(place)

    def logits(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, with its language: 0 to 3, or 4 if no function word tells."""
        top, votes, batch = [], [], Batch()

        def note() -> None:
            ids, starts, owner, buckets, said = batch.arrays()
            best, _ = self.pooled(ids, starts, buckets)
            for piece, (k, end) in enumerate(zip(owner, np.append(starts[1:], len(ids)))):
                top[k] = np.maximum(top[k], best[piece])
                votes[k] += np.bincount(said[ids[starts[piece] : end]], minlength=5)

        for k, text in enumerate(texts):
            top.append(np.full(len(WIDTHS) * FILTERS, -np.inf))
            votes.append(np.zeros(5))
            for held in batch.add(k, text):
                if held > HELD:
                    note()
                    batch.reset()
        if batch.ids:
            note()
        votes = np.array(votes).reshape(-1, 5)
        language = np.where(votes[:, :4].sum(axis=1) > 0, votes[:, :4].argmax(axis=1), 4)
        return np.maximum(np.array(top).reshape(len(votes), -1), 0) @ self.out + self.offset, language

    def score(self, logits: np.ndarray, language: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[language], -30, 30)))


def train(rows: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1) -> Model:
    rng = np.random.default_rng(SEED)
    folds = np.array([zlib.crc32(t) % 5 for t in rows], int)
    own = np.flatnonzero(folds > 0) if len(set(labels[folds > 0])) == 2 else np.arange(len(rows))
    n = np.bincount(labels[own], minlength=2)
    model = Model(rng.normal(0, 0.02, (BUCKETS, DIM)))
    model.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS]
    model.bias = [np.zeros(FILTERS) for _ in WIDTHS]
    if not n.all():
        model.offset = -30.0
        return model
    # log odds of each bucket, by the texts that hold it
    held = np.zeros((2, BUCKETS))
    pieces = []
    for row in rows:
        one = Batch()
        for _ in one.add(0, row):
            pass
        ids, starts, _, buckets, _ = one.arrays()
        pieces.append((ids.astype(np.int32), starts, buckets.astype(np.int32)))
    for i in own:
        held[labels[i], np.unique(pieces[i][2])] += 1
    odds = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
    odds *= held.sum(axis=0) / (held.sum(axis=0) + 4)
    model.embedding[:, 0] += 0.3 * np.clip(odds, -1, 4)
    model.embedding[0] = 0
    for f in model.filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5 / len(f)
    model.out = np.full(len(WIDTHS) * FILTERS, 0.1) + rng.normal(0, 0.02, len(WIDTHS) * FILTERS)
    model.offset = float(np.log(n[1] / n[0]))
    weight = np.array([1.0, min(4.0, n[0] / n[1])])
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        order = rng.permutation(own)
        for at in range(0, len(order), batch):
            grads_out, grad_offset = np.zeros_like(model.out), 0.0
            grads = [np.zeros_like(f) for f in model.filters]
            grads_bias = [np.zeros_like(b) for b in model.bias]
            touched, values = [], []
            chosen = order[at : at + batch]
            for i in chosen:
                ids, starts, buckets = pieces[i]
                best, place = model.pooled(ids, starts, buckets)
                pick = best.argmax(axis=0)
                top, where = best[pick, np.arange(best.shape[1])], place[pick, np.arange(best.shape[1])]
                active = np.maximum(top, 0)
                logit = active @ model.out + model.offset
                error = (1 / (1 + np.exp(-logit)) - labels[i]) * weight[labels[i]] / len(chosen)
                grads_out += error * active
                grad_offset += error
                back = error * model.out * (top > 0)
                for k, w in enumerate(WIDTHS):
                    for j in range(FILTERS):
                        if g := back[k * FILTERS + j]:
                            grads_bias[k][j] += g
                            for d in range(w):
                                if (p := where[k * FILTERS + j] + d) < len(ids):
                                    b = buckets[ids[p]]
                                    grads[k][d, :, j] += g * model.embedding[b].sum(axis=0)
                                    touched.append(b)
                                    values.append(np.broadcast_to(g * model.filters[k][d, :, j], (len(b), DIM)))
            model.out -= step * (grads_out + 1e-3 * model.out)
            model.offset -= step * grad_offset
            for k in range(len(WIDTHS)):
                model.filters[k] -= step * (grads[k] + 1e-3 * model.filters[k])
                model.bias[k] -= step * grads_bias[k]
            if touched:
                np.subtract.at(model.embedding, np.concatenate(touched), step * np.concatenate(values))
                model.embedding[0] = 0
    # the embeddings travel as float32
    model.embedding = model.embedding.astype(np.float32)
    calibrate(model, [rows[i] for i in np.flatnonzero(folds == 0)], labels[folds == 0])
    return model


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> tuple[float, int]:
    """With the best F1, in the middle of the gap; and the number of toxic rows."""
    order = np.argsort(-logits)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, labels.sum()))
    k = int(f1.argmax())
    below = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + below) / 2), int(labels.sum())


def calibrate(model: Model, rows: list[bytes], labels: np.ndarray, least: int = 5) -> None:
    if not len(rows) or not labels.any() or labels.all():
        return
    logits, language = model.logits(rows)
    common, _ = best_threshold(logits, labels)
    model.thresholds[:] = common
    for k in range(5):
        own = language == k
        if own.any():
            t, n = best_threshold(logits[own], labels[own])
            model.thresholds[k] = (n * t + least * common) / (n + least) if n else common


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = 100_000) -> Model:
    """Trained on at most `sample` labelled rows of docs (id, text) of at most `longest` bytes."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out("id")).distinct()
    chosen = hashed_sample(usable, "id", sample)
    rows = docs.filter(F.octet_length("text") <= longest).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "toxic").agg(F.min("text").cast("binary").alias("text"))
    rows = sorted(((x["id"], bytes(x["text"]), x["toxic"]) for x in rows.toLocalIterator()))  # at most `sample`
    model = train([x[1] for x in rows], np.array([x[2] for x in rows], int))
    del rows
    give_back()  # the driver lives on for other stages
    return model


def scores_of(model: Model, column_: pa.Array) -> np.ndarray:
    return model.score(*model.logits(texts(column_)))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score, predicted) of docs (id, text)."""
    state = docs.sparkSession.sparkContext.broadcast(vars(model))  # arrays of fixed sizes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**state.value)
        for batch in slices(batches, 256):
            scores = scores_of(own, column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select("id", "text").mapInArrow(run, "id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text isn't toxic."""
    state = docs.sparkSession.sparkContext.broadcast(vars(model))  # arrays of fixed sizes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**state.value)
        for batch in slices(batches, 256):
            yield batch.filter(pa.array(scores_of(own, column(batch, "text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return classify(rows, fit(rows, labels, sample))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")
