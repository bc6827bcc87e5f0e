"""SimHash near-duplicates: 64-bit fingerprints over word shingles, linked within a Hamming radius, without loss.

1.  Fingerprints.  Each task hashes the shingles of its texts (XXH64) and takes the majority of each bit.
2.  Candidates.  The 64 bits fall into radius + 2 segments.  Two fingerprints that differ in at most `radius` bits
    agree on at least two segments, so every link shows in one of the buckets that share two segments' bits (10
    buckets of about 26 bits for radius 3; keys are hashes of them, so a bucket may hold strangers, but loses none).  Only distinct fingerprints take part: copies are merged before, by a
    partial aggregation.
3.  Bit-sliced comparison.  A bucket's fingerprints become bit planes, one lane for each fingerprint.  Shifted by s
    lanes and XORed with themselves, the planes give the differing bits of every pair s apart, 64 pairs to a machine
    word.  Carry-save adders take three words of one weight to one of that and one of twice the weight, so eight planes
    go into the vertical counters of all lanes with few operations.  Words of lanes that have all gone beyond
    the radius are abandoned after every eight planes.
4.  Buckets with more than `cell` members are dealt into parts; every pair of parts is a cell of its own, so no task
    holds a bucket, whatever its size, and no pair is lost.
5.  Cells return a star of links for each group they find, not its pairs; components join them.

The pipeline's stage (one_of_each) links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.  Its
buckets are BANDS bands of ROWS smallest hashes of the sets each, in which a pair at 0.8 meets but for one in 14,000.  In a
bucket, the bit-sliced comparison of fingerprints of the sets, within a wide radius, leaves few of the strangers (sets of at most
SMALL shingles, whose fingerprints tell less, are all compared), and parities of the sets rule out most of those.  What goes into buckets is
a few hundred bytes a text, whatever its length.  The rest is found in rounds: each text asks, in each of its buckets, for its first
candidates of other components (with smaller numbers, `most` of them, four times as many in each round).  The sets of what is asked
for are made from the texts again and compared exactly, so that no pair below 0.8 is linked; links join components, refusals are
remembered, and the rounds end when nobody has a candidate.  So no bucket writes down its pairs, and sets travel only for comparisons.

Null texts count as empty; texts without words have fingerprint 0 and are linked like any other.  Null doc_ids keep
their rows; they never become a component_id unless the component has no other.  Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, components, cut, discard, slices, table, texts, trimmed, words, written

SEED = 42
#: Parts of a component, when its rows are joined with what holds for all of it.
SALTS = 16
#: Fingerprints of sets with a similarity of 0.8 differ in some 10 bits, with a standard deviation of about 3.
WIDE = 20
#: 1 - (1 - 0.8 ** ROWS) ** BANDS is 0.99993.
BANDS, ROWS = 24, 5
#: Sets of at most so many shingles are compared whatever their fingerprints.
SMALL = 20
#: Parities of a shingle set; two sets differ in as many shingles at least as in parities.
BITS = 1024
#: Rows of keys that are broadcast at most (24 bytes each); more are joined by merge.
FEW = 4_000_000


def votes_of(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        own = np.ascontiguousarray(hashes[at : at + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(own, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return votes


def majority(votes: np.ndarray, count: int) -> int:
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


def shingle_hashes(data: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, repeats included, in parts; of one with fewer words all of them are one shingle."""
    from xxhash import xxh64_intdigest

    tail, count = [], 0
    for part in words(data.lower()):  # bytes.lower() changes A-Z only
        part = tail + part
        tail = part[max(0, len(part) - shingle + 1) :] if shingle > 1 else []
        for at in range(0, len(part) - shingle + 1, 1 << 15):
            own = part[at : at + (1 << 15) + shingle - 1]
            h = np.array([xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(own[i:] for i in range(shingle)))], np.uint64)
            count += len(h)
            yield h
    if tail and not count:
        yield np.array([xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """Of one text, as an unsigned number."""
    votes, count = np.zeros(64, np.int64), 0
    for h in shingle_hashes(data, shingle):
        votes += votes_of(h)
        count += len(h)
    return majority(votes, count)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, text_hash, fp long) for each document; fp holds the 64 bits as a signed number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(x, shingle) for x in texts(column(batch, "text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "text_hash"), pa.array(fp.view(np.int64))], ["id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of the radius + 2 segments."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def bucket_keys(fp: Column, radius: int) -> Column:
    """An array of keys, one for each pair of segments: a hash of the pair and its bits."""
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for a, n in segments(radius)]
    return F.array(*(F.xxhash64(F.lit(k), part[i], part[j]) for k, (i, j) in enumerate(combinations(range(radius + 2), 2))))


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three words of one weight as one of twice the weight and one of the same."""
    u = a ^ b
    return a & b | u & c, u ^ c


def close_lanes(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i for which fingerprints i and i + shift differ in at most radius bits.

    planes: a row of 64-bit words for each bit of the fingerprints, lane i in bit i % 64 of word i // 64.
    valid: words of the lanes that count.
    """
    word, bit = divmod(shift, 64)
    at = np.flatnonzero(valid)
    live = valid[at]
    counter = [np.zeros(len(at), np.uint64) for _ in range(7)]  # of 1, 2, 4 up to 64 differing bits
    padded = planes.shape[1] - word - 2  # last word whose two shifted sources exist
    assert not len(at) or at[-1] <= padded

    def differing(k: int) -> np.ndarray:
        other = planes[k][at + word] >> np.uint64(bit)
        if bit:
            other = other | planes[k][at + word + 1] << np.uint64(64 - bit)
        return planes[k][at] ^ other

    for k in range(0, 64, 8):
        ones, twos, fours = counter[:3]
        fours_of = []
        for i in (k, k + 4):
            twos_a, ones = carry_save(ones, differing(i), differing(i + 1))
            twos_b, ones = carry_save(ones, differing(i + 2), differing(i + 3))
            four, twos = carry_save(twos, twos_a, twos_b)
            fours_of.append(four)
        carry, fours = carry_save(fours, *fours_of)
        counter[:3] = ones, twos, fours
        for i in range(3, 7):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        live = live & ~greater(counter, radius)
        keep = live != 0
        if not keep.all():
            at, live, counter = at[keep], live[keep], [c[keep] for c in counter]
        if not len(at):
            return at
    bits = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return at[row] * 64 + lane


def greater(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose bit-sliced counter is above limit."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for i in range(len(counter) - 1, -1, -1):
        if limit >> i & 1:
            equal = equal & counter[i]
        else:
            above = above | equal & counter[i]
            equal = equal & ~counter[i]
    return above


def bit_planes(fp: np.ndarray, spare: int) -> np.ndarray:
    """64 rows of words with a lane for each fingerprint, and spare words behind them."""
    n = -(-len(fp) // 64)
    padded = np.zeros(n * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((64, n + spare), np.uint64)
    out[:, :n] = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    return out


def near_lanes(group: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places (i, j) of fingerprints of one group within the radius; rows lie group by group."""
    longest = int(np.bincount(np.unique(group, return_inverse=True)[1]).max(initial=0))
    planes = bit_planes(fp, longest // 64 + 2)
    for shift in range(1, longest):
        same = group[:-shift] == group[shift:]
        if not same.any():
            break
        lanes = np.zeros(planes.shape[1] * 64, np.uint8)
        lanes[: len(same)] = same
        i = close_lanes(planes, shift, np.packbits(lanes, bitorder="little").view(np.uint64), radius)
        yield i, i + shift


def stars(group: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member's node, root's node) of the components inside each group; rows lie group by group."""
    label = np.arange(len(fp))
    for i, j in near_lanes(group, fp, radius):
        while len(i):  # unite: hook roots to the smaller, then flatten
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(flat := label[label], label):
                label = flat
    member = np.flatnonzero(label != np.arange(len(label)))
    return node[member], node[label[member]]


def runs(sizes: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lists of like sizes, taken together: of each run, the numbers of the lists and the places of their members."""
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end, total = at + 1, sizes[order[at]]
        while end < len(order) and sizes[order[end]] <= 2 * sizes[order[at]] and total + sizes[order[end]] <= most:
            total += sizes[order[end]]
            end += 1
        pick = order[at:end]
        own = sizes[pick]
        yield np.repeat(np.arange(len(pick)), own), np.repeat(start[pick] - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(total)
        at = end


def links(nodes: DataFrame, radius: int, cell: int) -> DataFrame:
    """Links (a, b) between nodes, rows (node, fp), that span all groups within the radius."""
    keyed = nodes.select("node", "fp", F.explode(bucket_keys(F.col("fp"), radius)).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > cell)
    hot = hot.select("key", F.ceil(F.col("n") / F.lit(cell)).cast("int").alias("parts"))
    cells = (
        keyed.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list(F.struct("node", "fp")).alias("members"))
        .filter(F.size("members") > 1)
        .select("members")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            lists = column(batch, "members")
            flat = lists.flatten()
            fp, node = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("fp", "node"))
            for group, rows in runs(np.diff(lists.offsets.to_numpy())):
                a, b = stars(group, fp[rows].view(np.uint64), node[rows], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def by_component(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component, component_id) of nodes (node, first) by links (node, root); component_id is the smallest `first`.

    Only components of several nodes are joined, their members spread over salts; the rest stand for themselves.
    """
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select("node", "first"), "node")
    members = cut(members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))))
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = members.join(smallest.hint("merge"), ["root", "salt"]).select("node", F.col("root").alias("component"), "component_id")
    alone = F.col("component").isNull()
    return nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.when(alone, F.col("first")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, cell: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, text_hash, fp, component, component_id) for each document; component tells components without any
    identifier apart."""
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    # a node is a hash of its fingerprint: of one number a bijection, and well spread
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("first")).select("fp", "first", F.xxhash64("fp").alias("node")))
    found = cut(components(links(nodes.select("node", "fp"), radius, cell)))
    by_fp = nodes.select("node", "fp").join(by_component(found, nodes), "node")
    return fps.join(by_fp, "fp").select("id", "text_hash", "fp", "component", "component_id")


def shingle_set(data: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; none for one without words."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(data, shingle)]))


def bands_of(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key for each band of a set of hashes: of its ROWS smallest members under as many orders.  first: odd multipliers, one for
    each order.  An empty set has the keys of no other."""
    from xxhash import xxh64_intdigest

    least = np.full(len(first), np.iinfo(np.uint32).max, np.uint32)
    high = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1 << 11):
        least = np.minimum(least, np.multiply.outer(first, high[at : at + (1 << 11)]).min(axis=1))
    return np.array([xxh64_intdigest(least[k : k + ROWS].tobytes(), k) for k in range(0, len(least), ROWS)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """A row (id, text_hash, node, n, fp, par, bands) for each document: node is a hash of its shingle set, n the set's size, fp its
    fingerprint, par its parities, bands its keys."""
    first = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches):
            nodes, sizes, fps, keys, pars = [], [], [], [], []
            for x in texts(column(batch, "text")):
                own = shingle_set(x, shingle)
                nodes.append(xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps.append(majority(votes_of(own), len(own)))
                keys.append(bands_of(own, first))
                pars.append(parities(own).tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "text_hash"), node, pa.array(np.array(sizes, np.int64)), fp, pa.array(pars, pa.binary()), lists], ["id", "text_hash", "node", "n", "fp", "par", "bands"])

    return docs.mapInArrow(trimmed(run), "id long, text_hash long, node long, n long, fp long, par binary, bands array<long>")


def parities(own: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1 == 1)


def first_asked(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a, b), the `most` smallest b of each a."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[new], b[new]
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
    return a[place < most], b[place < most]


def cell_asks(cell: dict[str, np.ndarray], refused: list[list[int]], across: bool, similarity: float, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a cell's nodes, which lie in their order: a asks for b, the smaller one."""
    node, n, fp, par, component, own = (cell[c] for c in ("node", "n", "fp", "par", "component", "own"))
    size, small = len(node), np.flatnonzero(n <= SMALL)
    no = [(k, x) for k, own_no in enumerate(refused) for x in own_no]
    if no:
        a, b = np.array(no, np.int64).T
        at = np.minimum(np.searchsorted(node, b), size - 1)
        no = np.sort((a * size + at)[node[at] == b])
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = near_lanes(np.zeros(size, np.int64), fp.view(np.uint64), radius)
    few = ((small[i], small[j]) for i, j in near_lanes(np.zeros(len(small), np.int64), fp[small].view(np.uint64), 64))
    todo, waiting = [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        return first_asked(*(np.concatenate(x) for x in zip(held, *todo)), most)

    for i, j in chain(near, few):
        may = component[i] != component[j]
        if across:
            may &= own[i] != own[j]
        i, j = i[may], j[may]
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        may = low >= similarity * high - 1e-9
        i, j, both = i[may], j[may], (low + high)[may]
        # sets differ in as many members at least as in parities
        may = np.bitwise_count(par[i] ^ par[j]).sum(axis=1, dtype=np.int64) * (1 + similarity) <= (1 - similarity) * both + 1e-6
        a, b = np.maximum(i, j)[may], np.minimum(i, j)[may]
        if len(no) and len(a):
            key = a * size + b
            new = no[np.minimum(np.searchsorted(no, key), len(no) - 1)] != key
            a, b = a[new], b[new]
        if len(a):
            todo.append((a, b))
            waiting += len(a)
            if waiting > 1 << 20:
                held, todo, waiting = reduced(), [], 0
    return reduced()


def buckets(members: DataFrame, cell: int) -> DataFrame:
    """(key, parts) of buckets with the rows (key, node); of buckets with the same nodes, which near copies have in many bands, one
    is enough.  What tells them apart are two hashes of 64 bits, which partial aggregations combine.  Buckets of more than `cell`
    nodes have several parts.
    """
    same = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"same{k}") for k in (0, 1)]
    each = members.groupBy("key").agg(F.count("*").alias("size"), *same)
    one = each.groupBy("size", "same0", "same1").agg(F.min("key").alias("key"))
    return one.select("key", F.ceil(F.col("size") / F.lit(cell)).cast("int").alias("parts"))


def cells_of(members: DataFrame, cell: int) -> DataFrame:
    """(key, i, j, own, node): buckets are dealt into their parts, and every pair of parts is a cell of its own."""
    dealt = members.join(buckets(members, cell).hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")


def asks(cells: DataFrame, state: DataFrame, similarity: float, radius: int, most: int) -> DataFrame:
    """(key, i, j, a, b): in which cell node a asks for node b.  state: (node, n, fp, par, component, refused)."""
    place, numbers = ["key", "i", "j"], ["own", "node", "n", "fp", "component"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the cell that isn't complete

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            cell = {c: rows[c].to_numpy().astype(np.int64) for c in numbers}
            cell["par"] = np.frombuffer(b"".join(rows["par"].to_pylist()), np.uint8).reshape(len(rows), -1)
            where = [rows[c][0].as_py() for c in place]
            a, b = cell_asks(cell, [x or [] for x in rows["refused"].to_pylist()], where[1] != where[2], similarity, radius, most) if len(rows) > 1 else (np.zeros(0, np.int64),) * 2
            same = [pa.array([x] * len(a), kind) for x, kind in zip(where, (pa.int64(), pa.int32(), pa.int32()))]
            return pa.RecordBatch.from_arrays([*same, pa.array(cell["node"][a]), pa.array(cell["node"][b])], [*place, "a", "b"])

        for batch in slices(batches, 4096):
            at = np.stack([column(batch, c).to_numpy().astype(np.int64) for c in place])
            edges = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            for x, y in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(x, y - x)
                if held and any(column(held[0], c)[0].as_py() != column(part, c)[0].as_py() for c in place):
                    yield done()
                held.append(part)
        if held:
            yield done()

    rows = cells.join(state.hint("merge"), "node").select(*place, *numbers, "par", "refused")
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *place).sortWithinPartitions(*place, "node").mapInArrow(trimmed(run), "key long, i int, j int, a long, b long")


def small(df: DataFrame, n: int) -> DataFrame:
    """df, to be broadcast if it has few rows, and else joined by merge."""
    return F.broadcast(df) if n <= FEW else df.hint("merge")


def sets_of(wanted: DataFrame, n: int, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, own) with the set of each of the n nodes that are wanted, made from its text again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x, shingle).view(np.int64) for x in texts(column(batch, "text"))]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], ["node", "own"])

    one = nodes.select("node", "text_hash", "some").join(small(wanted, n), "node")
    found = docs.select(F.coalesce("id", F.lit(0).cast("long")).alias("some"), "text_hash", "text").join(small(one, n), ["some", "text_hash"])
    return found.dropDuplicates(["some", "text_hash"]).select("node", "text").mapInArrow(trimmed(run), "node long, own array<long>")


def compared(pairs: DataFrame, n: int, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The n pairs (a, b) with whether their sets have the similarity (same), written.  An often asked b is a hot key of the second
    join, which adaptive execution splits."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(sets_of(wanted, 2 * n, docs, nodes, shingle), "sets")
    first = small(pairs, n).join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

    shared = F.size(F.array_intersect("x", "y"))
    same = shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9
    out = written(both.select("a", "b", same.alias("same")), "compared")
    discard(sets)
    return out


def set_links(cells: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """(node, root): components of the nodes of the cells whose sets have the similarity.  The cells are discarded."""
    spark, sketch = cells.sparkSession, nodes.select("node", "n", "fp", "par")
    found, results, most = spark.createDataFrame([], "node long, root long"), None, 1
    while True:
        refused = results.filter("NOT same").groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("refused")) if results is not None else None
        state = sketch.join(found.withColumnRenamed("root", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        state = state.join(refused, "node", "left") if refused is not None else state.withColumn("refused", F.lit(None).cast("array<long>"))
        asked = written(asks(cells, state, similarity, radius, most), "asks")
        pairs = written(asked.select("a", "b").distinct(), "pairs")
        n = pairs.count()
        if not n:
            discard(cells, asked, pairs)
            return found
        now = compared(pairs, n, docs, nodes, shingle, similarity)
        results = now if results is None else results.unionByName(now)
        if not now.filter("same").isEmpty():
            both = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(now.filter("same").select("a", "b"))  # what is found stands for earlier links
            found = written(components(both), "roots")
        # a cell in which nobody asked has no candidates, and will have none
        active = asked.select("key", "i", "j").distinct()
        fewer = written(cells.join(active.hint("merge"), ["key", "i", "j"], "left_semi"), "cells")
        discard(cells, asked, pairs)
        cells, most = fewer, 4 * most


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = WIDE, cell: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, text_hash, component, component_id) for each document, written; components are joined by pairs of texts whose sets
    of shingles have a Jaccard similarity of at least `similarity`, and by no others.

    Bands and the fingerprints' radius are wide enough that a pair is unlikely to be missed (BANDS, WIDE).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = written(sketches(docs, shingle), "sketches")
    some = F.min(F.struct("text_hash", F.coalesce("id", F.lit(0).cast("long")).alias("some"))).alias("_text")
    nodes = rows.groupBy("node").agg(F.min("id").alias("first"), some, *(F.first(x).alias(x) for x in ("n", "fp", "par", "bands")))
    nodes = written(nodes.select("node", "first", "_text.*", "n", "fp", "par", "bands"), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    members = written(keyed.join(shared.hint("merge"), "key", "left_semi"), "members")
    cells = written(cells_of(members, cell), "cells")
    discard(members)
    found = set_links(cells, nodes.drop("bands"), docs, shingle, similarity, radius)
    out = written(rows.select("id", "text_hash", "node").join(by_component(found, nodes), "node").select("id", "text_hash", "component", "component_id"), "similar")
    discard(rows, nodes)
    return out


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: of each component of similar_documents() the one with the smallest doc_id; of
    several with that, by hashes of the text and of the row.

    Only the keys of documents that go, or of which one of several rows stays, are joined with the documents.
    """
    key = ["id", "nameless", "text_hash"]
    ident = [F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.isnull("id").alias("nameless"), F.col("text_hash")]
    found = similar_documents(docs, shingle, similarity)
    chosen = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("of")).select("of.*").select(*ident, F.lit(True).alias("stays"))
    odd = found.select(*ident).groupBy(*key).agg(F.count("*").alias("n")).join(chosen.hint("merge"), key, "left").filter("stays IS NULL OR n > 1")
    odd = written(odd.select(*key, F.coalesce("stays", F.lit(False)).alias("stays")), "verdicts")
    discard(found)
    n, several = odd.agg(F.count("*"), F.coalesce(F.max("stays"), F.lit(False))).first()
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash")).select("doc", *ident)
    kept = whole.join(small(odd.select(*key), n), key, "left_anti").select("doc.*")
    if several:  # one row of each key, without a task that has all of them
        rows = whole.join(small(odd.filter("stays").select(*key), n), key).groupBy(*key).agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
        kept = kept.unionAll(rows.select("doc.*"))
    return kept


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
