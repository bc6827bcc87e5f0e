"""Products of query vectors with all vectors, by tiles of both."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, StructField, StructType

from brindle.operators.joins import MOST_PARTS
from brindle.operators.salts import salted

#: Vectors on a side of a tile.
SIDE = 1000


def whole_vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places and values of the vectors that aren't null and hold no null."""
    own = column.combine_chunks()
    lengths = np.array(pc.list_value_length(own).fill_null(-1))
    broken = pc.list_parent_indices(own).filter(pc.list_flatten(own).is_null()).to_numpy(zero_copy_only=False)
    lengths[np.unique(broken)] = -1
    found = {}
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        found[int(n)] = at, pc.list_flatten(own.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
    return found


def products(a: np.ndarray, b: np.ndarray, stripe: int = 64) -> np.ndarray:
    """Inner products of the rows of both, each summed in the order of its components."""
    out, right = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    for at in range(0, len(a), stripe):
        own = out[at : at + stripe]
        part = np.empty_like(own)
        for x, y in zip(a[at : at + stripe].T, right):
            np.multiply(x[:, None], y, out=part)
            own += part
    return out


def norms(a: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for x in a.T:
        total += x * x
    return np.sqrt(total)


def rounded(x: np.ndarray, no: np.ndarray, digits: int) -> pa.Array:
    """x as decimals of 9 digits, `digits` of them behind the point; null for `no`, and where a plain rounding may be wrong: near the
    middle of two decimals, and beyond the 9 digits."""
    with np.errstate(all="ignore"):
        scaled = x * 10.0**digits + 0.5
        below = np.floor(scaled)
        plain = ~no & (np.abs(scaled) < 9e8) & (np.abs(scaled - np.rint(scaled)) > 1e-6)
    units = np.where(plain, below, 0).astype(np.int64)
    valid = pa.py_buffer(np.packbits(plain, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.decimal128(9, digits), len(x), [valid, pa.py_buffer(np.stack([units, units >> 63], axis=1).tobytes())])


def query_products(queries: DataFrame, rows: DataFrame, side: int = SIDE, digits: int = 4) -> DataFrame:
    """Each of the queries (a number, its vector) with each of the rows (a number, its vector): both numbers, the inner product `dot` and
    the `cosine`.  These are null if a vector is null, holds a null, or has another length; the cosine also if a vector is zero.
    Their decimals with `digits` digits are dot_rounded and cosine_rounded, null too where the rounding needs care: Spark's takes
    some microseconds a value, and is for those only.

    Both sides are cut into strips of about `side` vectors, and a task multiplies two strips at a time, so that it holds
    side * side pairs at most; there are as many partitions as tiles.
    """
    high, wide = max(1, -(-queries.count() // side)), max(1, -(-rows.count() // side))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    (query_id, query), (row_id, row) = queries.columns, rows.columns
    parts = min(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), high * wide), MOST_PARTS)
    left = salted(queries.toDF("id", "vector"), high, "high").withColumn("wide", every(wide)).repartition(parts, "high", "wide")
    right = salted(rows.toDF("id", "vector"), wide, "wide").withColumn("high", every(high)).repartition(parts, "high", "wide")

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        n, m = a.num_rows, b.num_rows
        dot, cosine = np.zeros((n, m)), np.zeros((n, m))
        no_dot, no_cosine = np.ones((n, m), bool), np.ones((n, m), bool)
        others = whole_vectors(b.column("vector")) if n else {}
        for length, (at, own) in whole_vectors(a.column("vector")).items() if m else ():
            if length in others:
                place, theirs = np.ix_(at, others[length][0]), others[length][1]
                with np.errstate(all="ignore"):
                    found, size = products(own, theirs), np.outer(norms(own), norms(theirs))
                    dot[place], no_dot[place] = found, False
                    cosine[place], no_cosine[place] = found / size, size == 0
        columns = [a.column("id").take(pa.array(np.repeat(np.arange(n), m))), b.column("id").take(pa.array(np.tile(np.arange(m), n)))]
        flat = [(x.ravel(), no.ravel()) for x, no in ((dot, no_dot), (cosine, no_cosine))]
        columns += [pa.array(x, mask=no) for x, no in flat] + [rounded(x, no, digits) for x, no in flat]
        return pa.Table.from_arrays(columns, names)

    kinds = {"dot": DoubleType(), "cosine": DoubleType(), "dot_rounded": DecimalType(9, digits), "cosine_rounded": DecimalType(9, digits)}
    names = [query_id, row_id, *kinds]
    schema = StructType([queries.schema[query_id], rows.schema[row_id], *(StructField(c, kind) for c, kind in kinds.items())])
    return left.groupBy("high", "wide").cogroup(right.groupBy("high", "wide")).applyInArrow(tile, schema)
