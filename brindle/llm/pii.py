"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Base.  Four patterns (email, ip, card, phone) give leftmost spans that don't overlap within a kind.  Runs of characters
are taken whole, so every pattern takes linear time in any text.

Field.  Candidates are the tokens of a document that could be personal data: numbers of at least seven digits with their
separators, and words around an at sign.  Each is a node with a label (none or a kind).  Potentials:

* node: shape and context of the candidate (FEATURES);
* chain: candidates that stand next to each other;
* skip: candidates of the same document, however far apart, with the same digits or the same last digits, the same address or
  the same local part.  Each is linked to the last before it with that key, so links grow with the tokens, not with their pairs.

Base spans are observed labels.  Loopy belief propagation passes messages along all links until labels agree across the
document; a number that is no phone number by the patterns becomes one if it repeats one.

Training.  Weights start from a prior and are fitted by pseudo-likelihood, with the base spans as labels and features dropped
at random, on the candidates of at most `sample` documents, which are chosen by a hash of their identifiers.  Candidates
outside base spans that the prior takes for data, or that repeat a base span, count as unlabelled.

A document's field lies in one task, in memory that grows with its candidates; its labels don't depend on other documents.

Null and empty texts have no spans.  Identifiers may be null or repeat.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, hashed_sample, slices, table

KINDS = ("email", "ip", "card", "phone")
#: The patterns' parts; possessive, since what they give back could never match.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")
#: Candidates of the field.
NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++")
AT = re.compile(r"@|\x20?[\[(]at[\])]\x20?")
ADDRESS = re.compile(r"[^\s@<>()\[\],;:\"']+")  # either side of it
STOPS = re.compile(r"[\s@<>()\[\],;:\"']")
#: Words that announce a kind, in English, German, French and Spanish.
CUES = tuple(re.compile(x, re.I) for x in (r"mail|courriel|correo|contact|kontakt", r"\bip\b|host|server|serveur|servidor|login", r"card|visa|kredit|karte|carte|tarjeta|payment", r"tel|phone|call|fax|mobil|rufen|appel|llam"))

FEATURES = (
    "bias", "at sign", "dotted domain", "four numbers", "four bytes", "13 to 19 digits", "luhn", "9 to 15 digits", "7 or 8 digits",
    "plus", "parentheses", "separators", "glued to letters", "cue email", "cue ip", "cue card", "cue phone", "luhn fails", "over 19 digits",
)
#: Starting weights, a row for each feature: none, email, ip, card, phone.
PRIOR = np.array([
    [3.0, -1, -1, -1, -1], [0, 1.5, -3, -3, -3], [0, 3.5, 0, 0, 0], [0, 0, 1.5, -1, -1], [0, -3, 3.5, 0, 0], [0, -3, -3, 0.7, 0], [0, 0, 0, 4.5, 0], [0, -3, -1, 0, 0.7], [0, -3, -1, -1, 0.3],
    [0, 0, -1, -1, 1.5], [0, 0, -1, -1, 2.2], [0, 0, -1, 0.3, 0.5], [2.5, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1], [5, 0, -4, -4, -4], [6, -4, -4, -4, -4],
])
STEADY = [0, *range(len(FEATURES) - 2, len(FEATURES))]  # never dropped
_SAME = np.diag([0.3, 4.5, 4.5, 4.5, 4.5]) - np.where(np.eye(5), 0, 0.5)
LINKS = np.stack([np.diag([0.2, 0, 0, 0, 0]), _SAME])  # chain, skip


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS."""
    out = [list(emails(text)) if "@" in text else [], [], [], []]
    if DIGIT.search(text):
        out[1] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        out[2] = [m.span() for m in CARD.finditer(text) if 13 <= len(x := NO_DIGIT.sub("", m[0])) <= 19 and luhn(x)]
        if "+" in text:
            out[3] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    """kind:start:end by kind and start."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def numbers(own: str, at: int) -> Iterator[tuple[int, int]]:
    """The numbers of a run of digits and separators: long ones that only a space parts are two."""
    start, held, place, size = 0, 0, 0, lambda x: len(NO_DIGIT.sub("", x))
    for part in own.split(" "):
        n = size(part)
        if held >= 7 and n >= 7:
            yield at + start, at + place - 1
            start = place
        if n:
            held = n
        place += len(part) + 1
    if size(own[start:]) >= 7 or own[start:].count(".") == 3:
        yield at + start, at + len(own)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """What stands around each at sign, of any length; a character is looked at twice at most."""
    for hit in AT.finditer(text) if "@" in text or "at" in text else ():
        start, end = hit.span()
        while start and not STOPS.match(text[start - 1]):
            start -= 1
        if start < hit.start() and (m := ADDRESS.match(text, end)):
            yield start, m.end() - (m[0][-1] in ".!?")


def candidates(text: str) -> list[tuple[int, int]]:
    spans = list(addresses(text))
    if DIGIT.search(text):
        spans += [s for m in NUMBER.finditer(text) for s in numbers(m[0], m.start())]
    return sorted(set(spans))


def features(text: str, start: int, end: int) -> bytes:
    own = text[start:end]
    digits = NO_DIGIT.sub("", own)
    n, parts = len(digits), own.split(".")
    quad = len(parts) == 4 and all(x.isdigit() and x.isascii() and len(x) <= 3 for x in parts)
    at = AT.search(own)
    left = text[max(0, start - 24) : start]
    beside = text[start - 1 : start] + text[end : end + 1]
    number = not at
    return bytes((
        1, bool(at), bool(at and re.search(r"[A-Za-z0-9]\.[A-Za-z]", own[at.end() :])), number and quad, number and quad and all(int(x) <= 255 for x in parts),
        number and 13 <= n <= 19, number and 13 <= n <= 19 and luhn(digits), number and 9 <= n <= 15 and not quad, number and 7 <= n <= 8 and not quad,
        own[0] == "+", number and "(" in own, number and bool(re.search(r"[0-9][\x20-]|\)", own)), number and any(c.isalnum() or c in "_@" for c in beside),
        *(bool(c.search(left)) for c in CUES), number and 16 <= n <= 19 and not luhn(digits), number and n > 19,
    ))


def matrix(x: Iterable[bytes]) -> np.ndarray:
    """A row for each candidate's features."""
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, len(FEATURES))


def keys(own: str) -> list[str]:
    """Candidates with a key in common are linked."""
    if at := AT.search(own):
        return [f"a{own.lower()}", f"l{own[: at.start()].strip().lower()}"]
    digits = NO_DIGIT.sub("", own)
    return [f"d{digits}"] + [f"e{n}{digits[-n:]}" for n in (7, 10) if n <= len(digits) <= 15 and own.count(".") != 3]


def graph(text: str, base: list[list[tuple[int, int]]]) -> tuple[list[tuple[int, int]], list[bytes], list[int], list[tuple[int, int, int]]]:
    """Spans, features, observed labels (0 if none) and links (type, i, j) of a document's field."""
    observed = sorted((a, b, k + 1) for k, own in enumerate(base) for a, b in own)
    spans, labels = [], []
    ends, longest = [], 0
    for a, b, _ in observed:  # the largest end so far, for the search of overlaps
        longest = max(longest, b)
        ends.append(longest)
    starts = [x[0] for x in observed]
    free = []
    for a, b in candidates(text):
        i = bisect_right(starts, b - 1)
        if not i or ends[i - 1] <= a:
            free.append((a, b, 0))
    for a, b, k in sorted(observed + free):
        spans.append((a, b))
        labels.append(k)
    links, last = [], {}
    for i, (a, b) in enumerate(spans):
        if i and 0 <= a - spans[i - 1][1] <= 3:
            links.append((0, i - 1, i))
        linked = set()
        for key in keys(text[a:b]):
            if (j := last.get(key)) is not None and j not in linked:
                links.append((1, j, i))
                linked.add(j)
            last[key] = i
    return spans, [features(text, a, b) for a, b in spans], labels, links


def marginals(x: np.ndarray, observed: np.ndarray, links: np.ndarray, weights: np.ndarray, pairs: np.ndarray, document: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Label probabilities of every node, by loopy belief propagation with damping; links: rows (type, i, j).

    document: the number of each node's document; each stops on its own, so that none depends on what it is read with.
    """
    own = x @ weights
    seen = observed > 0
    own[seen] = -50
    own[seen, observed[seen]] = 50
    if not len(links):
        return np.exp(own - np.logaddexp.reduce(own, axis=1, keepdims=True))
    document = np.zeros(len(own), np.int64) if document is None else document
    kind = np.concatenate((links[:, 0], links[:, 0]))
    source, target = np.concatenate((links[:, 1], links[:, 2])), np.concatenate((links[:, 2], links[:, 1]))
    n = len(links)
    back = np.concatenate((np.arange(n, 2 * n), np.arange(n)))
    factor = np.exp(pairs)
    message = np.zeros((2 * n, own.shape[1]))
    live = np.arange(2 * n)
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, target, message)
        into = belief[source[live]] - message[back[live]]
        into = np.exp(into - into.max(axis=1, keepdims=True))
        new = np.empty_like(into)
        for t in range(len(factor)):
            new[kind[live] == t] = into[kind[live] == t] @ factor[t]
        new = np.log(new / new.sum(axis=1, keepdims=True))
        moved = np.zeros(int(document.max()) + 1)
        np.maximum.at(moved, document[source[live]], np.abs(new - message[live]).max(axis=1))
        message[live] = 0.5 * message[live] + 0.5 * new
        live = live[moved[document[source[live]]] >= 1e-4]
        if not len(live):
            break
    belief = own.copy()
    np.add.at(belief, target, message)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def fit(x: np.ndarray, labels: np.ndarray, links: np.ndarray, rounds: int = 200, drop: float = 0.3, pull: float = 0.02, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights by pseudo-likelihood: each node given its neighbours' labels; pulled to the prior, features dropped at random."""
    weights, pairs = PRIOR.copy(), LINKS.copy()
    if not len(x):
        return weights, pairs
    rng, k = np.random.default_rng(seed), weights.shape[1]
    near = np.zeros((len(x), 2, k))
    for kind in (0, 1):
        own = links[links[:, 0] == kind] if len(links) else np.empty((0, 3), int)
        np.add.at(near[:, kind], own[:, 1], np.eye(k)[labels[own[:, 2]]])
        np.add.at(near[:, kind], own[:, 2], np.eye(k)[labels[own[:, 1]]])
    truth = np.eye(k)[labels]
    # not in a base span: no data, unless the prior or an equal token says otherwise; those teach nothing
    score = x @ PRIOR
    doubtful = (labels == 0) & ((score.argmax(axis=1) > 0) | (near[:, 1, 1:].sum(axis=1) > 0))
    for _ in range(rounds):
        kept = x * (rng.random(x.shape) > drop)
        kept[:, STEADY] = x[:, STEADY]
        score = kept @ weights + np.einsum("ntl,tlk->nk", near, pairs)
        p = np.exp(score - np.logaddexp.reduce(score, axis=1, keepdims=True))
        error = (truth - p) / len(x)
        error[doubtful] = 0
        weights += error.T.dot(kept).T - pull * (weights - PRIOR)
        pairs += np.einsum("ntl,nk->tlk", near, error) - pull * (pairs - LINKS)
        pairs = (pairs + pairs.transpose(0, 2, 1)) / 2
    return weights, pairs


def train(docs: DataFrame, sample: int = 4000, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the candidates of at most `sample` documents (id, text).  The fit is bounded: documents with more than a tenth of
    `most` candidates aren't used, and the others, in the order of id and text, until there are `most` candidates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, text_hash in zip(column(batch, "text"), column(batch, "text_hash").to_pylist()):
                text = text.as_py() or ""
                _, x, labels, links = graph(text, base_spans(text))
                if 0 < len(x) <= most // 10:
                    out.append({"text_hash": text_hash, "x": b"".join(x), "labels": labels, "links": [v for row in links for v in row]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("text_hash", pa.int64()), ("x", pa.binary()), ("labels", pa.list_(pa.int32())), ("links", pa.list_(pa.int32()))]))

    chosen = hashed_sample(docs.select("id"), "id", sample).distinct()
    found = docs.withColumn("text_hash", F.xxhash64("id", "text")).join(F.broadcast(chosen), "id", "left_semi").mapInArrow(run, "text_hash long, x binary, labels array<int>, links array<int>")
    x, labels, links, at = [], [], [], 0
    for row in found.orderBy("text_hash").limit(sample).toLocalIterator():  # a few numbers for each candidate
        if at + len(row["labels"]) > most:
            break
        x.append(bytes(row["x"]))
        labels += row["labels"]
        links += [v if i % 3 == 0 else v + at for i, v in enumerate(row["links"])]
        at += len(row["labels"])
    return fit(matrix(x).astype(float), np.array(labels, int), np.array(links, int).reshape(-1, 3))


#: Candidates of whole documents that are labelled at a time, at least.
NODES = 50_000
SPANS = "id long, n_email long, n_ip long, n_card long, n_phone long, base string, n_added long, spans string"


def find(docs: DataFrame, sample: int = 4000, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base counts by kind, base, n_added, spans); base and spans are joined as kind:start:end, in code points."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    weights, pairs = train(rows, sample)

    def rows_of(ids: list[int | None], base: list, nodes: list, x: list[bytes], observed: list[int], links: list) -> pa.RecordBatch:
        all_spans = [[(k, a, b) for k, own in enumerate(found) for a, b in own] for found in base]
        added = [0] * len(base)
        if nodes:
            document = np.array([i for i, _, _ in nodes])
            p = marginals(matrix(x).astype(float), np.array(observed), np.array(links, int).reshape(-1, 3), weights, pairs, document)
            for n in np.flatnonzero((np.array(observed) == 0) & (p[:, 0] < 1 - least)):
                i, a, b = nodes[n]
                all_spans[i].append((int(p[n, 1:].argmax()), a, b))
                added[i] += 1
        counts = [pa.array([len(found[k]) for found in base], pa.int64()) for k in range(4)]
        text_of = [joined((k, a, b) for k, own in enumerate(found) for a, b in own) for found in base]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, pa.array(text_of, pa.string()), pa.array(added, pa.int64()), pa.array([joined(s) for s in all_spans], pa.string())], ["id", "n_email", "n_ip", "n_card", "n_phone", "base", "n_added", "spans"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [], [], [], [], [], []
            for doc_id, text in zip(column(batch, "id").to_pylist(), column(batch, "text")):
                ids, base, nodes, x, observed, links = held
                text = text.as_py() or ""
                found = base_spans(text)
                spans, own, labels, between = graph(text, found)
                links += [(t, a + len(nodes), b + len(nodes)) for t, a, b in between]
                nodes += [(len(base), a, b) for a, b in spans]
                x += own
                observed += labels
                ids.append(doc_id)
                base.append(found)
                if len(nodes) > NODES:
                    yield rows_of(*held)
                    held = [], [], [], [], [], []
            if held[0]:
                yield rows_of(*held)

    return rows.mapInArrow(run, SPANS)


def op1_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
