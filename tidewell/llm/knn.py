"""Exact top-k search by inner product: a Voronoi join.

Each vector gets one more component, so that all have one length; then the order by inner product is the order by
distance. Queries and data are grouped by the nearest pivot. Summaries of the groups bound how far the k-th neighbour
of any query of a group can be; only data that can lie as near are sent to that group, in blocks, and solved there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: One pivot for so many queries, at most MOST_PIVOTS; queries and data in a block of local work, and queries whose scores are held at once.
QUERIES_A_PIVOT, MOST_PIVOTS, QUERY_BLOCK, DATA_BLOCK, LEAST_BLOCK, HELD_QUERIES = 512, 256, 4096, 8192, 512, 512
#: The group of vectors whose products may be beyond 53 bits: they are near no pivot, and are computed with whole numbers of any size.
WIDE = -1
ROW = "vec_id long, vector binary, norm double, size int, wide boolean"
FOUND = "query_id long, vec_id long, score long, beyond int, digits binary"


def quantised(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """floor(scale * x) of the components as 64-bit integers, or written out where products need more than 53 bits; vectors without an id, or with a missing or non-finite component, go."""
    for batch in batches:
        rows = []
        for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
            if i is None or not x.is_valid or x.values.null_count:
                continue
            v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
            if not np.isfinite(v).all():
                continue
            with np.errstate(over="ignore"):
                n = np.floor(scale * v)
                wide = bool(np.abs(n).max(initial=0) ** 2 * len(n) >= 2**52)
            if wide:
                whole = [int(q) if math.isfinite(q) else math.floor(Fraction(scale) * Fraction(p)) for p, q in zip(v.tolist(), n.tolist(), strict=True)]
                rows.append((i, ",".join(map(str, whole)).encode(), 0.0, len(n), True))
            else:
                rows.append((i, n.astype("<i8").tobytes(), float(n @ n), len(n), False))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.binary(), pa.float64(), pa.int32(), pa.bool_()), strict=True)], ["vec_id", "vector", "norm", "size", "wide"])


def matrix(column, width: int) -> np.ndarray:
    """Rows of integers as float64, shorter ones with zeros at the end."""
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        v = np.frombuffer(x.as_py(), "<i8")
        out[i, : len(v)] = v
    return out


def whole(vector: bytes, wide: bool) -> list[int]:
    return [int(x) for x in vector.split(b",")] if wide else np.frombuffer(vector, "<i8").tolist()


def assigned(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, width: int, top: float) -> Iterator[pa.RecordBatch]:
    """Nearest pivot and its distance, of each vector as data and as a query; WIDE for wide vectors."""
    squares = (pivots * pivots).sum(1)
    for batch in batches:
        wide, norm = batch.column("wide").to_numpy(zero_copy_only=False), batch.column("norm").to_numpy()
        x = np.zeros((len(wide), width))
        own = np.flatnonzero(~wide)
        x[own] = matrix(batch.column("vector").take(pa.array(own)), width)
        rest = np.sqrt(np.maximum(top - norm, 0))
        columns = [batch.column("vec_id"), batch.column("vector"), batch.column("wide")]
        for last, square in ((rest, 0 * norm + top), (0 * rest, norm)):
            near, far = np.full(len(wide), WIDE), np.zeros(len(wide))
            if len(own) and len(pivots):
                product = x @ pivots[:, :-1].T + np.outer(last, pivots[:, -1])
                d = np.sqrt(np.maximum(squares - 2 * product + square[:, None], 0))
                near[own], far[own] = d.argmin(1)[own], d.min(1)[own]
            columns += [pa.array(near, pa.int32()), pa.array(far, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "wide", "cell", "far", "q_cell", "q_far"])


def told(query: list, vec: list, score: list, beyond: list, digits: list) -> pa.Table:
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64()), "beyond": pa.array(beyond, pa.int32()), "digits": pa.array(digits, pa.binary())})


def long_score(score: int) -> tuple[int, int, bytes | None]:
    """(score as 64 bits hold it, beyond, digits): by beyond, score and digits, whole numbers of any size are in order."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 0, None
    size = (abs(score).bit_length() + 7) // 8
    digits = abs(score).to_bytes(size, "big")
    return (((1 << 63) - 1, size, digits) if score > 0 else (-(1 << 63), -size, bytes(255 - b for b in digits)))


def solved_wide(queries: pa.Table, data: pa.Table, k: int) -> pa.Table:
    """As `solved`, with whole numbers of any size."""
    own = [(i, whole(v, w)) for i, v, w in zip(*(data.column(c).to_pylist() for c in ("data_id", "data", "data_wide")), strict=True)]
    out = []
    for q, v, w in zip(*(queries.column(c).to_pylist() for c in ("vec_id", "vector", "wide")), strict=True):
        asked = whole(v, w)
        best = sorted((-sum(a * b for a, b in zip(asked, x)), i) for i, x in own if i != q)[:k]  # noqa: B905
        out += [(q, i, *long_score(-s)) for s, i in best]
    return told(*(map(list, zip(*out, strict=True)) if out else [[]] * 5))


def solved(queries: pa.Table, data: pa.Table, k: int, width: int) -> pa.Table:
    """The k best of a block of data for each query of a block, ties to the smaller id; never a row with the query's id."""
    data = data.combine_chunks().sort_by("data_id")
    wide = [t.column(c).to_numpy().astype(bool) if t.num_rows else np.zeros(0, bool) for t, c in ((queries, "wide"), (data, "data_wide"))]
    parts = []
    if wide[0].any() or wide[1].any():
        plain = data.filter(pa.array(~wide[1]))
        parts = [solved_wide(queries.filter(pa.array(wide[0])), data, k), solved_wide(queries.filter(pa.array(~wide[0])), data.filter(pa.array(wide[1])), k)]
        queries, data = queries.filter(pa.array(~wide[0])), plain
    ids = data.column("data_id").to_numpy()
    n = len(ids)
    if n and queries.num_rows:
        x = matrix(data.column("data").combine_chunks(), width)
        keep = min(k, n)
        for at in range(0, queries.num_rows, HELD_QUERIES):
            some = queries.slice(at, HELD_QUERIES)
            q = some.column("vec_id").to_numpy()
            score = matrix(some.column("vector").combine_chunks(), width) @ x.T
            own = q[:, None] == ids
            if np.abs(score).max() * n < 2**51:  # with the place among the ids, no two are equal
                best = np.argpartition(np.where(own, -(2.0**52), score * n + (n - 1 - np.arange(n))), n - keep, axis=1)[:, n - keep :]
            else:
                best = np.argsort(np.where(own, np.inf, -score), axis=1, kind="stable")[:, :keep]
            rows, cols = np.repeat(np.arange(len(q)), keep), best.ravel()
            other = ~own[rows, cols]
            rows, cols = rows[other], cols[other]
            parts.append(told(q[rows], ids[cols], score[rows, cols].astype(np.int64), np.zeros(len(rows), np.int32), [None] * len(rows)))
    return pa.concat_tables(parts) if parts else told([], [], [], [], [])


def summaries(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of the rows of a task, the k + 1 ids of each group nearest to its pivot."""
    best: dict[int, dict[int, float]] = {}
    for batch in batches:
        cell, ids, far = (batch.column(c).to_numpy() for c in ("cell", "vec_id", "far"))
        for c in np.unique(cell).tolist():
            held = best.setdefault(c, {})
            own = np.flatnonzero(cell == c)
            # Among the nearest rows, repeated ids count once.
            for i in own[np.argsort(far[own], kind="stable")].tolist():
                if len(held) > k and far[i] >= max(held.values()):
                    break
                held[int(ids[i])] = min(float(far[i]), held.get(int(ids[i]), math.inf))
                if len(held) > k + 1:
                    held.pop(max(held, key=held.__getitem__))
    rows = [(c, i, d) for c, held in best.items() for i, d in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.int64(), pa.float64()), strict=True)], ["cell", "vec_id", "far"])


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the largest integer inner product, for every query.

    vectors: vec_id and embedding; is_query: a column of vec_id. Vectors without an id, null ones and those with a null
    or non-finite component take no part. Rows that share a vec_id are rows of their own as data, never for each other;
    as queries they share one list of k. Shorter vectors are read as if zeros followed. Products are exact: those that
    may need more than 53 bits are computed with whole numbers of any size, and a score beyond 64 bits is ranked as it
    is and told as the nearest 64-bit number. Ties go to the smaller vec_id; a query with fewer other rows has fewer
    ranks. No rows give no rows. Other columns are not read.

    What reaches the driver: the pivots and, for each, k + 1 distances and a few sums, MOST_PIVOTS at most.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").mapInArrow(lambda b: quantised(b, scale), ROW)
    rows = staged(rows.withColumn("asks", is_query), "knn-vectors")
    n, asks, top, width = rows.agg(F.count("*"), F.sum(F.col("asks").cast("int")), F.max("norm"), F.max("size")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n or not asks:
        return spark.createDataFrame([], out)

    drawn = rows.where("not wide").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(min(MOST_PIVOTS, -(-asks // QUERIES_A_PIVOT))).select("vector", "norm").collect()
    pivots = np.zeros((len(drawn), width + 1))
    for i, r in enumerate(drawn):
        v = np.frombuffer(r["vector"], "<i8")
        pivots[i, : len(v)], pivots[i, -1] = v, np.sqrt(max(top - r["norm"], 0))
    cells = staged(rows.select("vec_id", "vector", "norm", "wide").mapInArrow(lambda b: assigned(b, pivots, width, top), "vec_id long, vector binary, wide boolean, cell int, far double, q_cell int, q_far double").withColumn("place", F.monotonically_increasing_id()), "knn-cells")
    queries = cells.where(is_query)

    # Summaries, and from them the distances of data to their pivot that a group of queries needs.
    # Rounding of squares moves a distance by no more than this.
    slack = 8 * math.sqrt(2.0**-52 * (width + 8) * max(top, 1.0))
    between = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(2), 0))
    nearest: dict[int, list[tuple[float, int]]] = {}
    for r in cells.where(F.col("cell") != WIDE).select("cell", "vec_id", "far").mapInArrow(lambda b: summaries(b, k), "cell int, vec_id long, far double").groupBy("cell", "vec_id").agg(F.min("far").alias("far")).withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far", "vec_id"))).where(F.col("r") <= k + 1).collect():
        nearest.setdefault(r["cell"], []).append((r["far"], r["vec_id"]))
    count = {r["cell"]: (r["count"], r["far"]) for r in cells.groupBy("cell").agg(F.count("*").alias("count"), F.max("far").alias("far")).collect()}
    asking = {r["q_cell"]: (r["c"], r["m"]) for r in queries.groupBy("q_cell").agg(F.count("*").alias("c"), F.max("q_far").alias("m")).collect()}
    span = max(LEAST_BLOCK, min(DATA_BLOCK, n // 16))
    needs, blocks = [], []
    for i, (c, reach) in asking.items():
        theta = math.inf
        if i != WIDE:
            # The k + 1 different ids that are surely nearest to any query of the group hold k others than its own.
            seen: dict[int, float] = {}
            for d, v in sorted((between[i, j] + reach + d, v) for j, near in nearest.items() for d, v in near):
                seen.setdefault(v, d)
                if len(seen) > k:
                    theta = d
                    break
        q_blocks, d_blocks = -(-c // QUERY_BLOCK), 0
        for j, (held, furthest) in count.items():
            low, high = (-math.inf, math.inf) if WIDE in (i, j) else (between[i, j] - reach - theta - slack, between[i, j] + reach + theta + slack)
            if furthest >= low:
                d_blocks += held
                needs.append((i, j, float(low), float(high), q_blocks))
        blocks.append((i, q_blocks, max(1, -(-d_blocks // span))))
    # At most MOST_PIVOTS squared and MOST_PIVOTS rows.
    needs = spark.createDataFrame(needs, "i int, cell int, low double, high double, q_blocks int").join(spark.createDataFrame([(i, d) for i, _, d in blocks], "i int, d_blocks int"), "i")
    shape = spark.createDataFrame(blocks, "q_cell int, q_blocks int, d_blocks int")

    lot = lambda seed, n: F.pmod(F.xxhash64("place", F.lit(seed)), n).cast("int")
    sent = (
        cells.select("place", "vec_id", "vector", "wide", "cell", "far")
        .join(F.broadcast(needs), "cell")
        .where(F.col("far").between(F.col("low"), F.col("high")))
        .select("i", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"), lot(1, F.col("d_blocks")).alias("d"), F.col("vec_id").alias("data_id"), F.col("vector").alias("data"), F.col("wide").alias("data_wide"))
    )
    asked = queries.join(F.broadcast(shape), "q_cell").select(F.col("q_cell").alias("i"), lot(2, F.col("q_blocks")).alias("q"), F.explode(F.sequence(F.lit(0), F.col("d_blocks") - 1)).alias("d"), "vec_id", "vector", "wide")
    local = asked.groupBy("i", "q", "d").cogroup(sent.groupBy("i", "q", "d")).applyInArrow(lambda a, b: solved(a, b, k, width), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), F.desc("digits"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
