"""Postings clustered by term, in blocks with bounds: a query reads the blocks of its own terms, and of these the ones that can matter.

A block holds postings of one term whose parts of a score are near each other, the largest tf and the least length among
them. No row of it has a larger part than these two would give, whatever the mean length is by then. So blocks whose
bound, with the best that the query's other terms can add, stays under the k-th score are left unread.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import sent, staged
from .retrieve import K1, SLACK, B, local_top, top

#: Postings of a block; postings of a query's terms that are summed without bounds, as they are few; candidates that are looked up by their keys.
BLOCK, DIRECT, LOOKED_UP = 128, 200_000, 5_000
#: Parquet's row groups and pages: small, as a reader wants some terms alone.
SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size": 64 << 10}
SCHEMA = "term string, n int, high_tf double, low_length double, keys array<long>, tfs array<double>, lengths array<double>"


def part(tf: Column, length: Column, mean: float) -> Column:
    """What a term adds to a score, but for its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to `most` rows that are sorted by term and part."""
    rest: pa.Table | None = None

    def blocks(t: pa.Table, all_: bool) -> tuple[pa.RecordBatch, pa.Table]:
        term = t.column("term").combine_chunks().dictionary_encode()
        code = term.indices.to_numpy()
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        size = np.diff(np.append(new, len(code)))
        place = np.arange(len(code)) - np.repeat(new, size)
        start = np.flatnonzero(place % most == 0)
        # The last block may go on in the next batch.
        keep = len(start) if all_ else len(start) - 1
        end = np.append(start[1:], len(code))[:keep]
        start = start[:keep]
        used = int(end[-1]) if keep else 0
        tf, length = t.column("tf").to_numpy()[:used], t.column("length").to_numpy()[:used]
        edge = pa.array(np.append(start, used).astype(np.int32))
        one = lambda c: pa.ListArray.from_arrays(edge, t.column(c).combine_chunks().slice(0, used))
        columns = [
            term.dictionary.take(term.indices.take(pa.array(start))), pa.array((end - start).astype(np.int32)),
            pa.array(np.maximum.reduceat(tf, start) if keep else tf), pa.array(np.minimum.reduceat(length, start) if keep else length), one("key"), one("tf"), one("length"),
        ]
        return pa.RecordBatch.from_arrays(columns, ["term", "n", "high_tf", "low_length", "keys", "tfs", "lengths"]), t.slice(used)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None and rest.num_rows else t
        out, rest = blocks(t, False)
        if out.num_rows:
            yield out
    if rest is not None and rest.num_rows:
        yield blocks(rest, True)[0]


def blocked(counts: DataFrame, key: str, mean: float) -> DataFrame:
    """term, n, high_tf, low_length, keys, tfs and lengths of blocks of `term_counts`, sorted by term and, at this mean
    length, by falling part; ranges are drawn over both, so a term of many rows lies in several tasks."""
    rows = counts.select(F.col(key).alias("key"), "length", F.inline(F.arrays_zip("terms", "tfs"))).select("key", F.col("length").cast("double").alias("length"), F.col("terms").alias("term"), F.col("tfs").cast("double").alias("tf"))
    rows = rows.withColumn("_part", -part(F.col("tf"), F.col("length"), mean))
    most = BLOCK
    return rows.repartitionByRange("term", "_part").sortWithinPartitions("term", "_part", "key").select("term", "key", "tf", "length").mapInArrow(lambda b: _cut(b, most), SCHEMA)


def _each(blocks: DataFrame, idf: dict[str, float], mean: float) -> DataFrame:
    """term, key and part of every posting of the blocks."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in idf.items() for x in kv]), F.col("term"))
    more = [c for c in blocks.columns if c.startswith("_")]
    rows = blocks.select("term", *more, F.inline(F.arrays_zip("keys", "tfs", "lengths")))
    return rows.select("term", *more, F.col("keys").alias("key"), (weight * part(F.col("tfs"), F.col("lengths"), mean)).alias("part"))


def block_top(blocks: DataFrame, counts: DataFrame, key: str, terms: list[str], df: dict[str, int], stats: tuple[int, float], k: int, alive: Callable[[DataFrame], DataFrame] = lambda f: f, direct: int | None = None) -> DataFrame:
    """key and score (9 digits) of the k best rows for one query's distinct terms, in the order that `bm25_top` ranks them in.

    df: in how many rows each term is; stats: number and mean length of rows. alive: leaves the rows of a frame with the
    column `key` that are to be found. A query whose terms have up to `direct` postings, DIRECT if it is not given, sums them all. Beyond, the terms'
    best blocks give a score that k rows reach, for which blocks and then rows that cannot reach it are left out; what
    remains is scored by its row of counts. Up to LOOKED_UP such rows are asked for by key, more by a join."""
    n, mean = stats
    idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms if df.get(t, 0) > 0}
    none = counts.sparkSession.createDataFrame([], "key long, score double")
    if not idf or not mean:
        return none
    own = blocks.where(F.col("term").isin(*idf))
    # k rows of a task, and then k of these: no window over all.
    best = lambda rows: rows.groupBy("key").agg(F.round(F.sum("part"), 9).alias("score")).orderBy(F.desc("score"), "key").limit(k)
    if sum(df[t] for t in idf) <= (DIRECT if direct is None else direct):
        return best(alive(_each(own, idf, mean)))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in idf.items() for x in kv]), F.col("term"))
    bound = weight * part(F.col("high_tf"), F.col("low_length"), mean)
    # Heads alone: the arrays are not read.
    most = {r["term"]: r["m"] for r in own.groupBy("term").agg(F.max(bound).alias("m")).collect()}
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("term"))
    first = best(alive(_each(own.where(bound >= limit), idf, mean))).collect()
    least = min((r["score"] for r in first), default=0.0) if len(first) == k else 0.0
    least -= SLACK
    # Terms that cannot bring a row to that score together are not looked for; of the others, blocks that may.
    total, left = 0.0, dict(sorted(most.items(), key=lambda x: (x[1], x[0])))
    small = set()
    for t, m in left.items():
        if total + m >= least:
            break
        total += m
        small.add(t)
    large = [t for t in most if t not in small]
    every = sum(most.values())
    kept = own.where(F.col("term").isin(*large) & (bound - limit + F.lit(every) >= F.lit(least)))
    some = alive(_each(kept, idf, mean)).groupBy("key").agg(F.sum("part").alias("found"), F.sum(limit).alias("of"))
    some = some.where(F.col("found") + F.lit(every) - F.col("of") >= F.lit(least)).select("key")
    drawn = [r["key"] for r in some.limit(LOOKED_UP + 1).collect()]
    held = counts.withColumnRenamed(key, "key") if key != "key" else counts
    rows = held.where(F.col("key").isin(drawn)) if len(drawn) <= LOOKED_UP else held.join(some, "key", "left_semi")
    scored = rows.select("key", "length", F.inline(F.arrays_zip("terms", "tfs"))).where(F.col("terms").isin(*idf))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in idf.items() for x in kv]), F.col("terms"))
    return best(scored.select("key", (weight * part(F.col("tfs"), F.col("length"), mean)).alias("part")))


def block_tops(blocks: DataFrame, counts: DataFrame, key: str, queries: DataFrame, query_key: str, df: DataFrame, stats: tuple[int, float], k: int) -> DataFrame:
    """query_key, key, score (9 digits) and rank of the k best rows of every query, as `block_top` finds them for one beyond
    `direct`: for all queries at once, so that the number of Spark's jobs does not grow with theirs.

    queries: query_key (a number) and term, each term once a query; df: term and df, of the queries' terms at least."""
    n, mean = stats
    mean = mean or 1.0
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = staged(queries.select(F.col(query_key).cast("long").alias("q"), "term").join(df, "term").select("q", "term", idf.alias("idf")), "block-queries")
    held_rows = weighed.count()
    few = lambda rows: sent(rows, held_rows, 64)
    # Heads alone: the arrays are not read.
    bound = part(F.col("high_tf"), F.col("low_length"), mean)
    heads = blocks.select("term", bound.alias("bound")).join(few(weighed.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.max("bound").alias("high"))
    asked = staged(weighed.join(heads, "term").select("q", "term", "idf", "high", (F.col("idf") * F.col("high")).alias("most")), "block-heads")

    def parts(kept: DataFrame, *more: str) -> DataFrame:
        """q, key and part of every posting of blocks that are joined with queries."""
        rows = kept.select("q", "idf", *more, F.inline(F.arrays_zip("keys", "tfs", "lengths")))
        return rows.select("q", *more, F.col("keys").alias("key"), (F.col("idf") * part(F.col("tfs"), F.col("lengths"), mean)).alias("part"))

    own = blocks.withColumn("bound", bound)
    first = parts(own.join(few(asked), "term").where("bound >= high")).groupBy("q", "key").agg(F.round(F.sum("part"), 9).alias("score"))
    first = top(first, "q", "key", k)
    least = first.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(0.0)).alias("least")).select("q", (F.col("least") - SLACK).alias("least"))
    # Terms that cannot bring a row to that score together are not looked for; of the others, blocks that may.
    of_q = Window.partitionBy("q")
    told = asked.join(least, "q").withColumn("every", F.sum("most").over(of_q)).withColumn("up_to", F.sum("most").over(of_q.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)))
    large = staged(told.where("up_to >= least").select("q", "term", "idf", "most", "every", "least"), "block-terms")
    kept = own.join(few(large), "term").where(F.col("idf") * F.col("bound") - F.col("most") + F.col("every") >= F.col("least"))
    some = parts(kept, "most", "every", "least").groupBy("q", "key").agg(F.sum("part").alias("found"), F.sum("most").alias("of"), F.first("every").alias("every"), F.first("least").alias("least"))
    keys = staged(some.where("found + every - of >= least").select(F.col("key").alias(key)).distinct(), "block-candidates")
    # A row that is left for any query is scored for all where its counts are: no posting of it is shuffled.
    rows = counts.join(sent(keys, keys.count()), key, "left_semi")
    return local_top(rows, key, weighed.select(F.col("q").alias(query_key), "term", F.col("idf").alias("weight")), query_key, k, mean)
