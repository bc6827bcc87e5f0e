"""Near-duplicate vectors by a pigeonhole join of subspaces.

Unit vectors of d components with a cosine of at least c have a squared distance of at most s = 2 - 2 c.  A rotation, which keeps
distances, spreads every vector over all its components; these are split into blocks of about `width`.  Were the squared distance
in each block of k components above its share s k / d, the sum would be above s: so a linked pair is within the share in one
block at least, and the pairs within the share in some block are all the candidates there can be.

1.  Equal vectors of a label become one node with a number of copies: copies link, and are never compared.
2.  Each node is rotated and rounded to whole numbers (14 bits behind the point), once, in a written table.  The shares allow for the
    rounding, and sums of whole numbers come out the same in any order, so that all tasks agree on who is within a share.
3.  The range join of a block: its first components form a grid of cells twice as wide as the share's radius.  A node is at home in
    one cell and a guest in those neighbours, with a smaller cell number, that its radius reaches; so a pair meets in one cell.
4.  A cell beyond TILE nodes is dealt into tiles, and each pair of tiles is a group of its own.  A group counts the links of its
    nodes, verified by the cosine of the original components in double precision, and keeps a forest of them.  A pair counts
    in the first block that has it within the share, so counts add up without lists of pairs.

Nothing is approximate.  Labels and lengths must be equal for two vectors to link.  A null label or vector, a vector that is
empty or zero, or one with a null or non-finite component links with nothing and is a component of its own.  Repeated
rows are separate vectors.  Null identifiers link like others; a component's identifier is the smallest that isn't null.  An
empty table gives no rows.  Other columns of the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, components, cut, table, text_key, written

COSINE, WIDTH = 0.98, 16
#: Nodes of a tile, rows of a step within it, and bits behind the point of rotated components.
TILE, STEP, BITS = 4096, 512, 14
#: Cosines so near the limit are computed again, by exact sums.
NEAR = 1e-9
#: At most so many components of a block form its grid.
MOST_DIMS = 8


def rotation(d: int) -> np.ndarray:
    """The orthogonal matrix for vectors of d components; the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def blocks_of(d: int, width: int) -> list[slice]:
    """The components of each block, in about equal parts."""
    edges = np.linspace(0, d, max(1, round(d / width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def radius(cosine: float, d: int, k: int) -> int:
    """The share's radius for k of d components, in rounded units; each component's difference may be off by one."""
    return math.ceil(math.sqrt((2 - 2 * cosine) * k / d) * (1 << BITS) + math.sqrt(k)) + 1


def single(vectors: DataFrame, vector_col: str) -> bool:
    """Whether components are floats, which are then sent as such; all else is sent as doubles."""
    return vectors.schema[vector_col].dataType.simpleString() == "array<float>"


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, k1, k2), with null keys for those that link with nothing; nodes (node, first, k1, k2, label, copies, vector, turned),
    numbered in the order of their smallest identifiers."""
    vector = F.col(vector_col)
    fine = F.col(label_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), (vector if single(vectors, vector_col) else vector.cast("array<double>")).alias("vector"), F.coalesce(fine, F.lit(False)).alias("fine"))
    key = [F.when(F.col("fine"), k).alias(f"k{i}") for i, k in enumerate(text_key(F.struct("label", "vector")), 1)]
    kept = kept.select("id", *key, "label", "vector", "fine")
    groups = kept.filter("fine").groupBy("k1", "k2", "label", "vector").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    order = [F.col("first").asc_nulls_last(), F.col("k1"), F.col("k2")]
    groups = groups.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())

    def turn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = column(batch, "vector")
            sizes, at = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(float)
            turned = np.empty(len(sizes), object)
            for d in np.unique(sizes):
                if d not in known:
                    known[d] = rotation(d)
                rows = np.flatnonzero(sizes == d)
                for part in np.array_split(rows, len(rows) * int(d) // (1 << 20) + 1):
                    y = np.rint(unit(values[at[part][:, None] + np.arange(d)]) @ known[d] * (1 << BITS)).astype("<i2")
                    for i, x in zip(part, y):
                        turned[i] = x.tobytes()
            names = ["node", "first", "k1", "k2", "label", "copies", "vector"]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(turned, pa.binary())], [*names, "turned"])

    names = ["node", "first", "k1", "k2", "label", "copies", "vector"]
    groups = groups.select(*names)
    return kept.select("id", "k1", "k2"), written(groups.mapInArrow(turn, f"node long, first long, k1 long, k2 long, label {dict(groups.dtypes)['label']}, copies long, vector {dict(groups.dtypes)['vector']}, turned binary"), "vector-nodes")


def neighbours(q: np.ndarray, wide: int, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for rows q of whole numbers: each row's own cell, and the smaller-numbered ones within r of it."""
    m = q.shape[1]
    bits = 63 // m
    of = (q + (1 << BITS)) // wide + 1  # from 1, so that a neighbour's number isn't negative
    row, key, left = np.arange(len(q)), np.zeros(len(q), np.int64), np.full(len(q), r * r, np.int64)
    own = key.copy()
    for i in range(m):
        c = of[:, i]
        below = q[:, i] + (1 << BITS) - (c - 1) * wide  # how far above the cell's lower edge
        own = own << bits | c
        parts = []
        for by, gap in ((0, np.zeros(len(q), np.int64)), (-1, below + 1), (1, wide - below)):
            left_now = left - gap[row] ** 2
            on = left_now >= 0
            parts.append((row[on], key[on] << bits | (c[row[on]] + by), left_now[on]))
        row, key, left = (np.concatenate(x) for x in zip(*parts))
    on = key <= own[row]
    return row[on], key[on], (key == own[row])[on]


def placed(nodes: DataFrame, cosine: float, width: int, dims: int) -> DataFrame:
    """(label, d, block, cell, home, node, copies, vector, turned): each node in its cells of each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            sizes = np.array([len(x) // 2 for x in column(batch, "turned").to_pylist()])
            for d in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == d)))
                q = np.frombuffer(b"".join(column(own, "turned").to_pylist()), "<i2").reshape(-1, d).astype(np.int64)
                for block, at in enumerate(blocks_of(int(d), width)):
                    k = at.stop - at.start
                    r, m = radius(cosine, int(d), k), min(dims, k)
                    wide = max(2 * r, -(-(2 << BITS) // ((1 << 63 // m) - 3)))
                    row, cell, home = neighbours(q[:, at][:, :m], wide, r)
                    out = own.take(pa.array(row))
                    vector = pa.array([x.tobytes() for x in column(own, "vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)], pa.binary()).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([column(out, "label"), pa.array(np.full(len(row), d, np.int32)), pa.array(np.full(len(row), block, np.int32)), pa.array(cell), pa.array(home), column(out, "node"), column(out, "copies"), vector, column(out, "turned")], ["label", "d", "block", "cell", "home", "node", "copies", "vector", "turned"])

    label = dict(nodes.dtypes)["label"]
    return nodes.select("label", "node", "copies", "vector", "turned").mapInArrow(run, f"label {label}, d int, block int, cell long, home boolean, node long, copies long, vector binary, turned binary")


def tiled(cells: DataFrame) -> DataFrame:
    """Adds tile and other: cells beyond TILE nodes are dealt, and a node goes to each pair of tiles that has its own.

    The sizes of the cells beyond TILE are few (one for TILE rows at most); they are broadcast only if they are below a million.
    """
    key = ["label", "d", "block", "cell"]
    large = cut(cells.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select(*key, F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    large = F.broadcast(large) if large.count() < 1_000_000 else large.hint("merge")
    cells = cells.join(large, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    cells = cells.withColumn("with", other)
    return cells.withColumn("tile", F.least("own", "with")).withColumn("other", F.greatest("own", "with")).drop("tiles", "with")


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y)))


class Forest:
    """Which nodes hang together, and the links that show it."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def add(self, i: int, js: np.ndarray) -> None:
        labels, first = np.unique(self.label[js], return_index=True)
        new = labels != self.label[i]
        if new.any():
            self.links += [(i, int(j)) for j in js[first[new]]]
            self.label[np.isin(self.label, labels)] = self.label[i]


def compare(group: dict[str, np.ndarray], d: int, block: int, across: bool, cosine: float, width: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The links of each node of a group, copies counted, and a forest of them."""
    x = unit(group["vector"].astype(float))
    q, home, own, copies = group["turned"].astype(float), group["home"], group["own"], group["copies"]
    parts = blocks_of(d, width)[: block + 1]
    rows = np.flatnonzero(home)
    found, forest = np.zeros(len(x), np.int64), Forest(len(x))
    lengths = [np.einsum("ij,ij->i", q[:, p], q[:, p]) for p in parts]
    limits = [radius(cosine, d, p.stop - p.start) ** 2 for p in parts]
    for step in range(0, len(rows), STEP):
        a = rows[step : step + STEP]

        def within(k: int, a=a) -> np.ndarray:
            return lengths[k][a][:, None] + lengths[k][None] - 2 * (q[a][:, parts[k]] @ q[:, parts[k]].T) <= limits[k]

        on = within(block)
        on &= (~home[None]) | (a[:, None] < np.arange(len(x))[None])  # a pair at home once; guests don't meet
        if across:
            on &= own[a][:, None] != own[None]
        if not on.any():
            continue
        some = np.flatnonzero(on.any(axis=0))
        on, dots = on[:, some], x[a] @ x[some].T
        linked = on & (dots >= cosine)
        for i, j in np.argwhere(on & (np.abs(dots - cosine) <= NEAR)):
            linked[i, j] = exact_cosine(group["vector"][a[i]].astype(float), group["vector"][some[j]].astype(float)) >= cosine
        for k in range(block):
            if not linked.any():
                break
            linked &= ~within(k)[:, some]
        found[a] += linked @ copies[some]
        found[some] += copies[a] @ linked
        for i in np.flatnonzero(linked.any(axis=1)):
            forest.add(int(a[i]), some[linked[i]])
    return found, forest.links


def links_of(cells: DataFrame, cosine: float, width: int, real: str) -> DataFrame:
    """(a, b, n): with a null b the links that a group found for node a; else a link of its forest."""

    def run(rows: pa.Table) -> pa.Table:
        d, block, across = rows["d"][0].as_py(), rows["block"][0].as_py(), rows["tile"][0].as_py() != rows["other"][0].as_py()
        joined = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind).reshape(-1, d)
        group = {"vector": joined("vector", real), "turned": joined("turned", "<i2")} | {c: rows[c].to_numpy() for c in ("home", "own", "copies", "node")}
        found, links = compare(group, d, block, across, cosine, width)
        some, node = np.flatnonzero(found), group["node"]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({
            "a": pa.array(np.concatenate([node[some], node[a]])),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[b])]),
            "n": pa.array(np.concatenate([found[some], np.zeros(len(a), np.int64)])),
        })

    return cells.groupBy("label", "d", "block", "cell", "tile", "other").applyInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", width: int = WIDTH) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors; links are pairs of equal labels with a cosine of at least `cosine`."""
    rows, nodes = nodes_of(vectors, id_col, vector_col, label_col)
    n = nodes.count()
    dims = min(MOST_DIMS, max(1, round(math.log(max(1, n / TILE), 2.2))))  # as many as bring a label with all nodes down to a tile a cell
    real = "<f4" if single(vectors, vector_col) else "<f8"
    links = written(links_of(tiled(placed(nodes, cosine, width, dims)), cosine, width, real), "vector-links")
    counts = links.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(links.filter("b IS NOT NULL").select("a", "b"))
    names = nodes.select("node", "first", "k1", "k2", "copies")
    # a root is the smallest node of its component, and nodes are in the order of their identifiers
    firsts = names.select(F.col("node").alias("root"), F.col("first").alias("component_id"))
    named = roots.join(firsts, "root").select("node", "component_id", F.lit(True).alias("member"))
    nodes_out = names.join(counts.withColumnRenamed("a", "node"), "node", "left").join(named, "node", "left").select(
        "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("member"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")
    )
    alone = rows.filter("k1 IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = rows.filter("k1 IS NOT NULL").join(nodes_out.hint("merge"), ["k1", "k2"]).select("id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: All pairs of a label, and the smallest row reachable; for tables of some thousand vectors.
OP12_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.a = l.a),
c AS (SELECT a, min(root) AS root FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.root AS component_id, v.vec_id = c.root AS kept FROM v JOIN c ON v.vec_id = c.a
"""
