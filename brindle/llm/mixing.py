"""Mixing sources to target weights, with DataFrame operations only.

1.  Packing.  The words of a source's documents, one document behind the other, are cut into blocks of `block` words; a
    source's last block may be shorter.  Documents lie in the order of a hash, so that running sums need no task with
    a whole source.
2.  Targets.  Sources share the budget by weight; none gets more than `most` times its size, and what it leaves goes to
    the others by weight.  In the order of (cap / weight) the sources at their cap come first, so one running sum
    gives the final level.
3.  Drawing.  A source has as many slots as blocks are needed for its target, the last one perhaps for a part of its block.
    Each output shard has SHARD_SLOTS slots (the last one what is left) and draws how many of them go to each source: a
    multinomial draw, conditioned on what every source has left, so that targets are met and not only expected.  All these draws
    together are one order of all slots by a hash, cut into runs of SHARD_SLOTS.  The counts then say which slots a shard has:
    the first shard has a source's first ones, and so on.
4.  Mapping.  Slot number n of a source with b blocks takes block permutation(n mod b), so blocks are repeated only when all
    have been taken.  The permutation is a keyed bijection of 0 to b - 1 (swap-or-not rounds), and needs no sorting.
5.  Slots and blocks are joined by the block's index, and each document counts the words that its blocks' slots take.

All draws are MD5 hashes of a seed, a source and an index: the same table gives the same mix.  A null text has no words, a
null source is a source of its own, the last; sources without words have target 0.  Repeated rows are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, chunks_for, cut, identifier, ranks, table

BLOCK, MOST, WEIGHTS, SEED = 128, 3, (1, 2, 3), "mix"
SHARD_SLOTS, ROUNDS = 1 << 13, 16
#: Numbers that a row of `numbered` stands for, and about how many a task makes.
STEP, TASK_NUMBERS = 1 << 13, 1 << 14
#: Bits of the hashes: 15 hexadecimal digits.
HASH_BITS = 60


def drawn(*what: Column | str) -> Column:
    """A number of HASH_BITS bits; nulls count as the word none."""
    parts = [F.lit(SEED), *(F.coalesce(F.col(x).cast("string") if isinstance(x, str) else x.cast("string"), F.lit("none")) for x in what)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def in_order(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums of the rows before each, over all rows in an order that is total; no task has them all."""
    near = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_all", F.lit(0)))
    for name, weight in sums.items():
        near = ranks(near, ["_all"], "_part", order, name, weight)
    return near.drop("_part", "_all")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source_key, source, source_size, target) of rows (source_key, source, source_size), one for each source."""
    by_name = F.col("source").asc_nulls_last()
    out = in_order(sizes, [by_name], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    out = out.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("limit", F.col("cap") / F.col("weight"))
    out = cut(in_order(out, [F.col("limit").asc(), by_name], {"caps": F.col("cap"), "weights": F.col("weight")}))
    words, weight = out.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(words) - F.col("caps")) / (F.lit(weight) - F.col("weights"))
    final = out.filter(level * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("limit", level.alias("level")))).first()[0]
    return out.select("source_key", "source", "source_size", F.least("cap", F.col("weight") * F.lit(final["level"] if final else 0.0)).alias("target"))


def numbered(counts: DataFrame, count: str, name: str, total: int, *keys: str) -> DataFrame:
    """A row for each number from 0 to count - 1, made in two steps so that no task makes all of a large count.

    total: the sum of all counts.  The few rows before the second step look small enough for one task, which is why the
    number of tasks comes from what they become.
    """
    steps = counts.filter(F.col(count) > 0).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {STEP}"))))
    most = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = steps.repartition(max(1, min(most, -(-total // TASK_NUMBERS))), *keys, "_step")
    end = F.least(F.col(count), (F.col("_step") + 1) * STEP) - 1
    return steps.withColumn(name, F.explode(F.sequence(F.col("_step") * STEP, end))).drop("_step")


def permuted(index: Column, keys: Column) -> Column:
    """A bijection of 0 to blocks - 1: in each round a number and its mirror image about a key change places, or don't, by a
    bit that both share.  A round undoes itself, so the keys in reverse order give the inverse."""

    def swap(x: Column, key: Column) -> Column:
        other = F.pmod(key["k"] - x, F.col("blocks"))
        bit = F.md5(F.concat_ws(":", F.lit(SEED), F.lit("bit"), F.col("source_key"), key["i"].cast("string"), F.greatest(x, other).cast("string"))) < "8"
        return F.when(bit, other).otherwise(x)

    return F.aggregate(keys, index.cast("long"), swap)


def plan_slots(sources: DataFrame, block: int) -> DataFrame:
    """Adds what the slots of each source (source_key, source_size, target) are: blocks, slots, keys of the permutation, and
    last_words, the words that the last slot takes."""
    out = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long")).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.pmod(drawn(F.lit("key"), "source_key", F.lit(i)), F.greatest("blocks", F.lit(1))).alias("k")) for i in range(ROUNDS)))
    out = out.withColumn("keys", keys).withColumn("passes", F.expr("CASE WHEN source_size > 0 THEN goal div source_size ELSE 0 END"))
    # slots of the last pass: how many depends on whether the short block is among them
    out = out.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size")).withColumn("lacks", F.col("blocks") * block - F.col("source_size"))
    out = out.withColumn("short_at", F.when(F.col("blocks") > 0, permuted(F.col("blocks") - 1, F.reverse("keys"))).otherwise(0))
    out = out.withColumn("more", F.expr(f"(rest + {block} - 1) div {block}"))
    out = out.withColumn("more", F.when(F.col("short_at") < F.col("more"), F.expr(f"(rest + lacks + {block} - 1) div {block}")).otherwise(F.col("more")))
    before = (F.col("more") - 1) * block - F.when(F.col("short_at") < F.col("more") - 1, F.col("lacks")).otherwise(0)
    out = out.withColumn("last_words", F.when(F.col("rest") > 0, F.col("rest") - before).otherwise(block))
    return out.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("more")).drop("goal", "passes", "rest", "lacks", "short_at", "more")


def pack(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Documents (id, source_key, size, text_hash, start), and sources with their targets, blocks and slots."""
    source = F.col(source_col).cast("string")
    text_hash = drawn(F.lit("text"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(
        identifier(docs, id_col).alias("id"), source.alias("source"), source_key(source).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), text_hash.alias("text_hash"),
    ).withColumn("order", drawn(F.lit("order"), "id", "text_hash"))
    rows = cut(rows)
    sizes = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = cut(plan_slots(targets(sizes), block))
    bits = chunks_for(rows.count()).bit_length() - 1
    placed = rows.drop("source").withColumn("chunk", F.shiftright("order", HASH_BITS - bits))  # the order, whatever the bits
    placed = ranks(placed, ["source_key"], "chunk", [F.col("order"), F.col("id"), F.col("text_hash")], "start", F.col("size"))
    return cut(placed.drop("chunk", "order")), sources


def source_key(source: Column) -> Column:
    """Tells sources apart, and is never null."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def shard_counts(sources: DataFrame, total: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(source_key, shard, n, first): how many of a shard's slots each source draws, and the first of its slots there."""
    hashed = numbered(sources.select("source_key", "slots"), "slots", "slot", total, "source_key").select("source_key", "slot", drawn(F.lit("shard"), "source_key", "slot").alias("hash"))
    bits = chunks_for(total).bit_length() - 1
    ordered = hashed.withColumn("chunk", F.shiftright("hash", HASH_BITS - bits)).withColumn("_all", F.lit(0))
    ordered = ranks(ordered, ["_all"], "chunk", [F.col("hash"), F.col("source_key"), F.col("slot")], "place")
    counts = ordered.groupBy("source_key", F.expr(f"place div {shard_slots}").alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself: (shard, source_key, slot, block, words) with the block that each slot of each output shard takes, and how
    many of its words from the first on (null: all)."""
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    counts = shard_counts(sources, total, shard_slots).join(sources.select("source_key", "blocks", "slots", "last_words", "keys"), "source_key")
    out = numbered(counts, "n", "k", total, "source_key", "shard").withColumn("slot", F.col("first") + F.col("k"))
    words = F.when(F.col("slot") == F.col("slots") - 1, F.col("last_words"))
    return out.select("shard", "source_key", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("keys")).alias("block"), words.alias("words"))


def mix(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(id, source_key, text_hash, size, source_size, target, taken, first_shard) of each document; taken counts its words in the
    mix, first_shard is the first output shard with one (null: none)."""
    rows, sources = pack(docs, block, id_col, text_col, source_col)
    takes = slots(sources, shard_slots).groupBy("source_key", "block").agg(F.count("*").alias("n"), F.min("words").alias("words"), F.min("shard").alias("shard"), F.min(F.when(F.col("words").isNull(), F.col("shard"))).alias("whole_shard"))
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    pieces = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    # of a block that the last slot takes in part, that slot's words stand for themselves
    part = F.when(F.col("words").isNotNull(), F.greatest(F.lit(0), F.least(end, F.col("block") * block + F.col("words")) - low))
    taken = F.coalesce((end - low) * (F.col("n") - F.when(F.col("words").isNotNull(), 1).otherwise(0)) + F.coalesce(part, F.lit(0)), F.lit(0))
    shard = F.when((part > 0) | F.col("words").isNull(), F.col("shard")).otherwise(F.col("whole_shard"))
    counted = (
        pieces.join(takes.hint("merge"), ["source_key", "block"], "left").select("source_key", "start", "id", "text_hash", "size", taken.alias("taken"), shard.alias("shard"))
        .groupBy("source_key", "start").agg(F.first("id").alias("id"), F.first("text_hash").alias("text_hash"), F.first("size").alias("size"), F.sum("taken").alias("taken"), F.min("shard").alias("first_shard"))
    )
    columns = ["id", "source_key", "text_hash", "size", "taken", "first_shard"]
    none = rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_shard", F.lit(None).cast("long"))
    return counted.select(*columns).unionByName(none.select(*columns)).join(sources.select("source_key", "source_size", "target"), "source_key")


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs, each repeated as the mix takes it: taken / size times, the rest of that by a draw."""
    key = F.struct(identifier(docs, "doc_id").alias("id"), source_key(F.col("source").cast("string")).alias("source_key"), drawn(F.lit("text"), F.md5(F.coalesce("text", F.lit("")))).alias("text_hash"))
    times = mix(docs, block).filter("taken > 0").groupBy("id", "source_key", "text_hash").agg((F.sum("taken") / F.sum("size")).alias("share"))  # rows that are the same have the same share
    part = F.pmod(drawn(F.lit("rest"), "id", "text_hash"), F.lit(1 << 20)) / F.lit(1 << 20)
    times = times.select(F.struct("id", "source_key", "text_hash").alias("of"), F.floor(F.col("share") + part).cast("int").alias("times")).filter("times > 0")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key"))  # names of docs' own can't clash
    chosen = whole.join(times, F.col("key").eqNullSafe(F.col("of")))
    return chosen.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_shard")


def hash_sql(*what: str) -> str:
    parts = " || ':' || ".join([f"'{SEED}'", *what])
    return f"CAST('0x' || substr(md5({parts}), 1, 15) AS BIGINT)"


OP9_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id AS id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    {hash_sql("'text'", "md5(coalesce(text, ''))")} AS text_hash FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hash, id NULLS FIRST, text_hash) AS place,
    CAST(coalesce(sum(size) OVER (PARTITION BY k ORDER BY hash, id NULLS FIRST, text_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM (SELECT *, {hash_sql("'order'", "coalesce(CAST(id AS VARCHAR), 'none')", "CAST(text_hash AS VARCHAR)")} AS hash FROM docs)),
sized AS (SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY k),
weighed AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, source_size * {float(MOST)}::DOUBLE AS cap FROM sized),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (SELECT k, source_size, least(cap, weight * coalesce((SELECT min({{'limit': cap / weight, 'level': level}}).level FROM levels WHERE level * weight <= cap), 0)) AS target FROM levels),
sources AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM goals),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes, blocks * {BLOCK} - source_size AS lacks FROM sources),
walk AS (SELECT k, i, i AS x, blocks, 0 AS round FROM (SELECT k, blocks, unnest(range(blocks)) AS i FROM sources WHERE blocks > 0)
    UNION ALL SELECT k, i, CASE WHEN md5('{SEED}:bit:' || k || ':' || round || ':' || greatest(x, other)) < '8' THEN other ELSE x END, blocks, round + 1
    FROM (SELECT *, ({hash_sql("'key'", "k", "CAST(round AS VARCHAR)")} % blocks - x + blocks) % blocks AS other FROM walk WHERE round < {ROUNDS})),
mapped AS (SELECT k, i, x AS block FROM walk WHERE round = {ROUNDS}),
taking AS (SELECT m.k, m.i, m.block, p.blocks, p.passes, p.goal - p.passes * p.source_size - coalesce(sum(CASE WHEN m.block = p.blocks - 1 THEN {BLOCK} - p.lacks ELSE {BLOCK} END)
    OVER (PARTITION BY m.k ORDER BY m.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, CASE WHEN m.block = p.blocks - 1 THEN {BLOCK} - p.lacks ELSE {BLOCK} END AS words FROM mapped m JOIN passes p ON m.k = p.k),
uses AS (SELECT k, block, i + pass * blocks AS slot, CASE WHEN pass < passes THEN words ELSE least(words, rest) END AS words
    FROM (SELECT *, unnest(range(passes + 1)) AS pass FROM taking) WHERE pass < passes OR rest > 0),
drawn AS (SELECT k, (row_number() OVER (ORDER BY hash, k, slot) - 1) // {SHARD_SLOTS} AS shard FROM (SELECT k, slot, {hash_sql("'shard'", "k", "CAST(slot AS VARCHAR)")} AS hash FROM uses)),
shares AS (SELECT *, lead(first, 1, 9223372036854775807) OVER (PARTITION BY k ORDER BY shard) AS next FROM (SELECT k, shard, coalesce(sum(count(*)) OVER (PARTITION BY k ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM drawn GROUP BY k, shard)),
dealt AS (SELECT u.*, s.shard FROM uses u JOIN shares s ON u.k = s.k AND u.slot >= s.first AND u.slot < s.next),
met AS (SELECT k, place, shard, least(start + size, block * {BLOCK} + words) - greatest(start, block * {BLOCK}) AS n
    FROM (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0) JOIN dealt USING (k, block)),
found AS (SELECT k, place, CAST(sum(n) AS BIGINT) AS taken, min(shard) AS first_shard FROM met WHERE n > 0 GROUP BY k, place)
SELECT p.id AS doc_id, p.size, s.source_size, s.target, coalesce(f.taken, 0) AS taken, f.first_shard
FROM placed p JOIN sources s ON p.k = s.k LEFT JOIN found f ON p.k = f.k AND p.place = f.place
"""
