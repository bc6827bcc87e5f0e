"""Window operators: top k of a group, sessions, frames that Spark's grammar lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.scan import HOT, running
from brindle.scratch import free_prefix


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits each group before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def qualify(df: DataFrame, value: Column, condition: str, name: str = "_q") -> DataFrame:
    """Rows for which a condition on a window value holds: QUALIFY."""
    return df.withColumn(name, value).filter(condition)


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, rows: int = HOT) -> DataFrame:
    """A row for each session: keys, its first and last time, its rows; a gap of at least `gap` starts a new one.  Rows without
    a time are a session of their own key, before the others.

    Sessions are numbered by running aggregates, so that a key with more than `rows` rows isn't one task.
    """
    p = free_prefix(df)
    earlier, number = f"{p}earlier", f"{p}number"
    own = running(df.select(*keys, time), keys, [time], {earlier: ("max", F.col(time))}, inclusive=False, rows=rows)
    new = F.coalesce(F.col(time) - F.col(earlier) >= F.expr(f"interval {gap}"), F.col(time).isNotNull())
    numbered = running(own, keys, [time, earlier], {number: ("sum", new.cast("int"))}, rows=rows)
    return numbered.groupBy(*keys, number).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n")).drop(number)


def over_groups(df: DataFrame, keys: list[str], order: str, value: Column, before: int, after: int, name: str) -> DataFrame:
    """An aggregate over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: peers are numbered, then a range frame is used."""
    peers = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    return peers.withColumn(name, value.over(Window.partitionBy(*keys).orderBy("_peer").rangeBetween(-before, after))).drop("_peer")


def sum_excluding_current(df: DataFrame, keys: list[str], order: list[str], value: str, before: int, after: int, name: str) -> DataFrame:
    """A sum over ROWS BETWEEN before PRECEDING AND after FOLLOWING EXCLUDE CURRENT ROW; null where no other row has a value."""
    frame = Window.partitionBy(*keys).orderBy(*order)
    sides = [F.sum(value).over(frame.rowsBetween(-before, -1)), F.sum(value).over(frame.rowsBetween(1, after))]
    total = F.when(sides[0].isNull(), sides[1]).otherwise(sides[0] + F.coalesce(sides[1], F.lit(0)))
    return df.withColumn(name, total)


#: How the two parts of a frame become one aggregate; either may be null.
TOGETHER = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)), "max": (F.max, lambda a, b: F.greatest(a, b)),
}
EXCLUDE = ("no others", "current row", "group", "ties")


def excluding(df: DataFrame, keys: list[str], order: list[str], kind: str, value: Column, before: int, after: int, exclude: str, name: str, frame: str = "rows") -> DataFrame:
    """An aggregate (sum, count, min, max) over ROWS or GROUPS BETWEEN before PRECEDING AND after FOLLOWING, with the EXCLUDE clause
    that Spark's grammar lacks: "current row", "group" (the row and its peers), "ties" (its peers only) or "no others".

    None of it needs an inverse, so min and max are possible.  The frame is split around what is left out.  In a frame of groups,
    peers are what lies at distance 0 of the numbered groups.  In a frame of rows, they are those of the at most before + after
    neighbours that have the same number; the neighbours come in two bounded frames.  Of rows that are equal in `order`,
    which is in whose frame isn't determined, as in any window of rows.
    """
    if exclude not in EXCLUDE or frame not in ("rows", "groups") or kind not in TOGETHER:
        raise ValueError(f"{kind} over {frame} excluding {exclude} isn't known")
    p = free_prefix(df)
    peer, x = f"{p}peer", f"{p}value"
    f, both = TOGETHER[kind]
    out = df.withColumn(x, value).withColumn(peer, F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))
    own = Window.partitionBy(*keys).orderBy(peer, *order)
    one = f(x).over(own.rowsBetween(0, 0))
    if frame == "groups":
        near = Window.partitionBy(*keys).orderBy(peer)
        whole, sides = f(x).over(near.rangeBetween(-before, after)), [f(x).over(near.rangeBetween(-before, -1)), f(x).over(near.rangeBetween(1, after))]
        ties = Window.partitionBy(*keys, peer).orderBy(*order)
        peers = [f(x).over(ties.rowsBetween(Window.unboundedPreceding, -1)), f(x).over(ties.rowsBetween(1, Window.unboundedFollowing))]
        others = both(*sides)
        result = {"no others": whole, "current row": both(both(others, peers[0]), peers[1]), "group": others, "ties": both(others, one)}[exclude]
    else:
        sides = [f(x).over(own.rowsBetween(-before, -1)) if before else F.lit(None), f(x).over(own.rowsBetween(1, after)) if after else F.lit(None)]

        def others(lo: int, hi: int) -> Column:
            """Of the rows of a frame, those that aren't peers; a list of lo to hi neighbours, aggregated in place."""
            if lo > hi:
                return F.lit(None)
            near = F.filter(F.collect_list(F.struct(peer, x)).over(own.rowsBetween(lo, hi)), lambda r: (r[peer] != F.col(peer)) & r[x].isNotNull())
            kept = F.transform(near, lambda r: r[x])
            zero = F.lit(0).cast(out.schema[x].dataType)
            total = {"sum": lambda: F.when(F.size(kept) > 0, F.aggregate(kept, zero, lambda a, b: (a + b).cast(out.schema[x].dataType))), "count": lambda: F.size(kept).cast("long"), "min": lambda: F.array_min(kept), "max": lambda: F.array_max(kept)}
            return total[kind]()

        split = both(others(-before, -1), others(1, after)) if exclude in ("group", "ties") else both(*sides)
        result = {"no others": both(split, one), "current row": split, "group": split, "ties": both(split, one)}[exclude]
    return out.withColumn(name, result).drop(peer, x)
