"""Shards of near-equal bytes by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Key ranges: one for so many rows, within bounds. A range is overfull from TWICE its share of the bytes on, a key that alone fills a share is hot.
ROWS_A_RANGE, LEAST_RANGES, MOST_RANGES, TWICE = 1 << 18, 1024, 1 << 12, 2
#: Keys sampled for each range, at the input's mean weight.
SAMPLED = 16
#: Equal texts of up to this part of a shard's bytes stay together.
TOGETHER = 0.02


def splitters(keys: DataFrame, total: int, n: int) -> list[int]:
    """At most n - 1 boundaries between n ranges of about equal bytes: quantiles of a size-weighted sample.

    A row is drawn if the hash of its key and id falls under its size's share of the sample, so that a task that runs
    again draws the same rows. The sample holds about SAMPLED * n keys, at most SAMPLED * MOST_RANGES.
    """
    lot = F.pmod(F.xxhash64("key", "doc_id", F.lit(71)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keys.where(lot < F.col("size") * (SAMPLED * n / total))
    cuts = drawn.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    return sorted(set(cuts or []))


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{x}L" if x > -(1 << 63) else "-9223372036854775807L" for x in values) + ")" if values else "cast(array() as array<bigint>)")


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many splitters are not above the key: looked up among every w-th, then among the w after that."""
    w = max(1, int(len(cuts) ** 0.5))
    rows = F.array(*[_longs(cuts[i : i + w]) for i in range(0, len(cuts) + 1, w)])
    coarse = F.size(F.filter(_longs(cuts[w - 1 :: w]), lambda s: s <= key))
    return coarse * w + F.size(F.filter(F.element_at(rows, coarse + 1), lambda s: s <= key))


def piece_of(key: Column, at: Column, cuts: list[int], pieces: Column) -> Column:
    """Which of so many parts of equal width of its range a key lies in; equal keys never part."""
    edges = _longs([-(1 << 63) + 1, *cuts, (1 << 63) - 1])
    low, high = F.element_at(edges, at + 1).cast("double"), F.element_at(edges, at + 2).cast("double")
    part = F.floor((key.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * pieces)
    return F.greatest(F.least(part, pieces - 1), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shard and slot of every document under the law `bytes`.

    The key of a record is a hash of its text, so equal texts are neighbours. A key that alone fills a range is hot: it
    is a range of its own, cut by a hash of its records' places. Splitters at the quantiles of a size-weighted sample
    deal the records of other keys into ranges; an overfull range is subdivided by the width of its keys, so that no
    key is cut. A record's place is the bytes of all ranges before its own plus the running sum inside it; its shard is
    the fortieth of all bytes that its middle lies in. Copies of a text with up to TOGETHER of a shard's bytes go by the
    middle of their group, so that they stay together, whatever stands beside them; larger groups are cut where the law
    asks for it. Any two shards differ by little over the largest record or such a group.

    Size: UTF-8 bytes plus 16, and 16 for a null or empty text, whose crc32 is 0. A null doc_id is a record like any
    other, and repeated rows are records of their own. No rows give no rows. grown_shard is null. Other columns of
    `docs` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    keys = staged(bare.withColumn("place", F.monotonically_increasing_id()), "shard-keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = min(MOST_RANGES, max(-(-rows // ROWS_A_RANGE), min(LEAST_RANGES, -(-rows // 16)), 1))
    share = max(1, total // n)
    pieces = lambda b, c: F.greatest(F.ceil(b / share), F.ceil(c / ROWS_A_RANGE)).cast("int")

    # At most one for each share of the bytes and each ROWS_A_RANGE rows.
    sums = keys.groupBy("key").agg(F.sum("size").alias("b"), F.count("*").alias("c")).where((F.col("b") > share) | (F.col("c") > ROWS_A_RANGE))
    hot = staged(sums.select("key", "b", (F.row_number().over(Window.orderBy("key")) + (1 << 20)).alias("hot"), pieces(F.col("b"), F.col("c")).alias("cuts")), "shard-hot")
    marked = keys.join(F.broadcast(hot), "key", "left")
    light = marked.where("hot is null")
    cuts = splitters(light, max(total, 1), n)
    ranged = marked.withColumn("range", F.coalesce("hot", range_of(F.col("key"), cuts)))
    full = ranged.where("hot is null").groupBy("range").agg(F.sum("size").alias("fb"), F.count("*").alias("fc")).where((F.col("fb") > TWICE * share) | (F.col("fc") > TWICE * ROWS_A_RANGE)).select("range", pieces(F.col("fb"), F.col("fc")).alias("pieces"))
    own = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("place", F.lit(5)), F.col("cuts"))).when(F.col("pieces").isNotNull(), piece_of(F.col("key"), F.col("range"), cuts, F.col("pieces"))).otherwise(0)
    cut = ranged.join(F.broadcast(full), "range", "left").withColumn("part", own.cast("int")).select("doc_id", "size", "text_crc32", "key", "place", "range", "part", F.col("b").alias("hot_size"))

    # One row for each part: about twice MOST_RANGES, and one more for each ROWS_A_RANGE rows.
    order = Window.orderBy("range", "part")
    before = cut.groupBy("range", "part").agg(F.sum("size").alias("b")).select("range", "part", (F.sum("b").over(order) - F.col("b")).alias("before"))
    before = before.withColumn("hot_start", F.min("before").over(Window.partitionBy("range")))
    here = Window.partitionBy("range", "part")
    inside = here.orderBy("key", "doc_id", "place").rowsBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("range", "part", "key")
    placed = (
        cut.join(F.broadcast(before), ["range", "part"])
        .withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("group_start", F.when(F.col("hot_size").isNotNull(), F.col("hot_start")).otherwise(F.min("start").over(alike)))
        .withColumn("group_size", F.coalesce("hot_size", F.sum("size").over(alike)))
        .withColumn("middle", F.when(F.col("group_size") <= TOGETHER * total / shards, F.col("group_start") * 2 + F.col("group_size")).otherwise(F.col("start") * 2 + F.col("size")))
        .withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.lit(2 * max(total, 1))), F.lit(shards - 1)).cast("int"))
        .withColumn("n", F.row_number().over(Window.partitionBy("range", "part", "shard").orderBy("key", "doc_id", "place")))
        .select("doc_id", "size", "text_crc32", "range", "part", "shard", "n")
    )
    placed = staged(placed, "shard-places")
    counts = placed.groupBy("shard", "range", "part").agg(F.count("*").alias("c"))
    first = counts.select("shard", "range", "part", (F.sum("c").over(Window.partitionBy("shard").orderBy("range", "part")) - F.col("c")).alias("first"))
    return placed.join(F.broadcast(first), ["shard", "range", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
