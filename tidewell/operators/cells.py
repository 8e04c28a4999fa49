"""Cosine by trained cells: a query reads the codes of the cells that can matter, and the vectors of few rows.

A unit vector is its cell's centre and a residual. The residual is kept as signed bytes times a scale, beside the length of
what the bytes leave out; a query has length 1, so no score is further from the coded one than that. No row of a cell is
nearer to a query than the centre's angle less the cell's. Both bounds hold for every row, so a search without a number of
probes is exact; with one, it misses only what lies in cells that it does not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import released, sent, staged
from .retrieve import QUERY_BLOCK, ROW_SLICE, SLACK, top

#: Cells at most, and bytes of their centres; rows a cell is learned from, bytes of all these, and rounds of learning.
MOST_CELLS, CENTRE_BYTES, LEARNED, SAMPLE_BYTES, ROUNDS = 4096, 32 << 20, 64, 64 << 20, 12
#: Cells that give an exact search its first scores; candidates that a task holds before it looks through them again; vectors that are asked for by key.
FIRST, HELD, LOOKED_UP = 4, 1 << 20, 5_000
CODES = "cell int, key long, scale double, error double, angle double, same long, code binary"


def _units(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the lists of this size that have a length, and which lists they are."""
    at = np.flatnonzero(pc.list_value_length(lists).fill_null(-1).to_numpy() == width)
    x = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    length = np.sqrt((x * x).sum(1))
    real = np.isfinite(length) & (length > 0)  # a null became no number
    return x[real] / length[real, None], at[real]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    parts = [np.argmax(x[s : s + ROW_SLICE] @ centres.T, axis=1) for s in range(0, len(x), ROW_SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _bounds(q: np.ndarray, matrix: np.ndarray, angles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What no row of a cell exceeds."""
    gap = np.arccos(np.clip(q @ matrix.T, -1, 1)) - angles
    return np.where(n > 0, np.cos(np.maximum(gap, 0.0)), -np.inf) + SLACK


def _ranked(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """query_id, cell and place, from 1, of each cell in the order of a query's bounds."""
    matrix, angles, n = held.value
    for batch in batches:
        q, at = _units(batch.column(1), matrix.shape[1])
        order = np.argsort(-_bounds(q, matrix, angles, n), axis=1, kind="stable")
        place = np.tile(np.arange(1, len(matrix) + 1, dtype=np.int32), len(q))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy()[at], len(matrix))), pa.array(order.ravel().astype(np.int32)), pa.array(place)], ["query_id", "cell", "place"])


def _learned(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n unit centres: means of the sample's nearest rows, time and again. The first are distinct rows in the sample's order."""
    first = np.sort(np.unique(sample, axis=0, return_index=True)[1])[:n]
    centres = sample[first]
    for _ in range(ROUNDS):
        sums = np.zeros_like(centres)
        np.add.at(sums, _nearest(sample, centres), sample)
        length = np.sqrt((sums * sums).sum(1))
        # A centre without rows, or whose rows cancel each other, stays.
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres


def _coded(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """CODES of key, same and embedding."""
    centres = held.value
    for batch in batches:
        for s in range(0, batch.num_rows, ROW_SLICE):
            part = batch.slice(s, ROW_SLICE)
            x, at = _units(part.column(2), centres.shape[1])
            cell = _nearest(x, centres)
            rest = x - centres[cell]
            scale = np.abs(rest).max(axis=1, initial=0.0) / 127
            code = np.rint(rest / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
            left = rest - scale[:, None] * code
            angle = np.arccos(np.clip((x * centres[cell]).sum(1), -1, 1))
            keys = part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))
            edges = pa.array(np.arange(len(code) + 1, dtype=np.int32) * code.shape[1])
            bytes_ = pa.Array.from_buffers(pa.binary(), len(code), [None, edges.buffers()[1], pa.py_buffer(np.ascontiguousarray(code))])
            columns = [pa.array(cell.astype(np.int32)), keys[0], pa.array(scale), pa.array(np.sqrt((left * left).sum(1))), pa.array(angle), keys[1], bytes_]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "key", "scale", "error", "angle", "same", "code"])


@dataclass(frozen=True)
class Cells:
    """centres: cell, centre, angle (of the farthest row) and n (rows), some thousands at most. codes: CODES, sorted by cell."""

    centres: DataFrame
    codes: DataFrame

    @classmethod
    def made(cls, vectors: DataFrame, key: str, embedding: str, cells: int | None = None) -> Cells:
        """Cells of all rows whose vectors have the commonest size (the larger of equals), a length, and no nulls; others are
        in no cell, as a search would not find them.

        There are as many cells as the root of the rows, MOST_CELLS and CENTRE_BYTES at most. They are learned from LEARNED rows
        each, SAMPLE_BYTES together, drawn by hashes of keys. Every row is then coded, whatever was drawn."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(key).cast("long").alias("key"), F.xxhash64(embedding).alias("same"), F.col(embedding).cast("array<double>").alias("embedding"))
        common = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        if common is None:
            empty = spark.createDataFrame([], "cell int, centre array<double>, angle double, n long")
            return cls(empty, spark.createDataFrame([], CODES))
        width, count = common
        most = max(1, min(MOST_CELLS, CENTRE_BYTES // (8 * width)))
        n = min(cells or math.isqrt(count - 1) + 1, most)
        wanted = max(1, min(LEARNED * n, SAMPLE_BYTES // (8 * width)))
        some = rows.where(F.size("embedding") == width)
        drawn = F.pmod(F.xxhash64("key", F.lit("cells")), F.lit(max(1, count // wanted))) == 0
        sample = some.where(drawn).select(F.xxhash64("key", F.lit("order")).alias("at"), "embedding").orderBy("at").limit(wanted).toArrow()
        x, _ = _units(sample.column("embedding").combine_chunks(), width)
        if not len(x):
            # What was drawn cannot be scored: any row that can will do.
            real = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
            x, _ = _units(some.where(real).select("embedding").limit(n).toArrow().column("embedding").combine_chunks(), width)
        if not len(x):
            x = np.eye(1, width)
        return cls._of(spark, _learned(x, n), rows)

    @classmethod
    def _of(cls, spark: SparkSession, centres: np.ndarray, rows: DataFrame) -> Cells:
        held = spark.sparkContext.broadcast(centres)
        codes = rows.select("key", "same", "embedding").mapInArrow(lambda b: _coded(b, held), CODES)
        # A cell of many rows goes to several tasks.
        codes = staged(codes.hint("rebalance", "cell").sortWithinPartitions("cell", "key"), "codes")
        return cls(cls._told(spark, centres, codes), codes)

    @staticmethod
    def _told(spark: SparkSession, centres: np.ndarray, codes: DataFrame) -> DataFrame:
        found = {r["cell"]: (r["angle"], r["n"]) for r in codes.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()}
        told = [found.get(i, (0.0, 0)) for i in range(len(centres))]
        table = pa.table({"cell": pa.array(np.arange(len(centres), dtype=np.int32)), "centre": pa.array(centres.tolist(), pa.list_(pa.float64())), "angle": pa.array([a for a, _ in told], pa.float64()), "n": pa.array([n for _, n in told], pa.int64())})
        return spark.createDataFrame(table)

    def added(self, vectors: DataFrame, key: str, embedding: str) -> Cells:
        """With further rows, in the cells that were learned before: bounds stay right, however far the new rows are."""
        matrix = self._matrix()[0]
        if not len(matrix):
            return Cells.made(vectors, key, embedding)
        spark = vectors.sparkSession
        rows = vectors.select(F.col(key).cast("long").alias("key"), F.xxhash64(embedding).alias("same"), F.col(embedding).cast("array<double>").alias("embedding"))
        new = Cells._of(spark, matrix, rows)
        codes = self.codes.unionByName(new.codes)
        both = self.centres.unionByName(new.centres).groupBy("cell").agg(F.first("centre").alias("centre"), F.max("angle").alias("angle"), F.sum("n").alias("n"))
        return Cells(both, codes)

    def write(self, folder: str) -> Cells:
        """The tables in a new folder."""
        self.codes.hint("rebalance", "cell").sortWithinPartitions("cell", "key").write.parquet(f"{folder}/codes")
        self.centres.coalesce(1).write.parquet(f"{folder}/centres")
        return Cells.open(self.codes.sparkSession, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Cells:
        return cls(spark.read.parquet(f"{folder}/centres"), spark.read.schema(CODES).parquet(f"{folder}/codes"))

    def _matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, angles and numbers of rows: CENTRE_BYTES at most."""
        rows = sorted(self.centres.collect(), key=lambda r: r["cell"])
        return np.array([r["centre"] for r in rows], np.float64), np.array([r["angle"] for r in rows]), np.array([r["n"] for r in rows], np.int64)

    def candidates(self, queries: DataFrame, key: str, embedding: str, k: int, probes: int | None = None) -> DataFrame:
        """query_id, key, upper, lower (bounds of the score) and read (rows whose codes were looked at for the query) of all
        rows that may be among the k nearest to a query, in the `probes` cells whose bounds are best, or in all that can matter.

        Of rows with one vector the k smallest keys are told. The table is staged; whoever has done with it releases it."""
        matrix, angles, n = self._matrix()
        spark = self.codes.sparkSession
        names = "query_id long, key long, upper double, lower double, read long"
        asked = queries.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("embedding")).where(F.size("embedding") == (matrix.shape[1] if len(matrix) else -1))
        passes = max(1, -(-asked.count() // QUERY_BLOCK)) if len(matrix) else 0
        tables = []
        for block in range(passes):
            drawn = asked.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == block).toArrow()
            q, at = _units(drawn.column("embedding").combine_chunks(), matrix.shape[1])
            if not len(q):
                continue
            ids = drawn.column("key").to_numpy()[at]
            bound = _bounds(q, matrix, angles, n)
            size = min(probes or FIRST, len(matrix))
            mask = np.zeros(bound.shape, bool)
            np.put_along_axis(mask, np.argsort(-bound, axis=1, kind="stable")[:, :size], True, axis=1)
            mask &= n > 0
            found = self._pass(ids, q, matrix, mask, k, np.full(len(q), -np.inf))
            parts = [found]
            if probes is None:
                least = np.full(len(q), -np.inf)
                place = {int(i): p for p, i in enumerate(ids)}
                for r in _least(found, k).collect():
                    least[place[r["query_id"]]] = r["least"]
                more = ~mask & (n > 0) & (bound >= least[:, None] - SLACK)
                if more.any():
                    parts.append(self._pass(ids, q, matrix, more, k, least))
                mask |= more
            every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            # No more rows than queries of a pass.
            read = spark.createDataFrame(pa.table({"query_id": ids, "read": (mask * n).sum(1)}))
            kept = every.join(F.broadcast(_least(every, k)), "query_id", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least") - SLACK))
            tables.append(staged(kept.join(F.broadcast(read), "query_id").select("query_id", "key", "upper", "lower", "read"), "candidates"))
            for p in parts:
                released(p)
        if not tables:
            return staged(spark.createDataFrame([], names), "candidates")
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def _pass(self, ids: np.ndarray, q: np.ndarray, matrix: np.ndarray, mask: np.ndarray, k: int, least: np.ndarray) -> DataFrame:
        """query_id, key, upper and lower of what may be among the k nearest of the marked cells' rows, and reaches `least`."""
        cells = np.flatnonzero(mask.any(axis=0))
        probed = {int(c): np.flatnonzero(mask[:, c]) for c in cells}
        held = self.codes.sparkSession.sparkContext.broadcast((ids, q, matrix, probed, least))
        # A condition on few cells reaches the scan; of many, most would pass.
        codes = self.codes.where(F.col("cell").isin([int(c) for c in cells])) if len(cells) < mask.shape[1] else self.codes
        return staged(codes.select("cell", "key", "scale", "error", "same", "code").mapInArrow(lambda b: _near(b, held, k), "query_id long, key long, upper double, lower double"), "coded")

    def top(self, vectors: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, probes: int | None = None) -> DataFrame:
        """query_id, key, score and rank of the k rows nearest to each query, never itself, as `cosine_top` tells them:
        exactly without `probes`, else of the cells that are read. vectors: what was coded, with key and embedding.

        Scores come from the vectors, so they are exact in both cases. Queries of another size than the cells find nothing."""
        return self.exact(self.candidates(queries, key, embedding, k, probes), vectors, queries, key, embedding, k)

    def probes(self, vectors: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, recall: float = 0.95) -> int:
        """The least number of probes with which `top` finds that share of what it finds without a number, over all rows of
        these queries: how far down a query's cells its nearest rows lie is looked up in the codes. Ask with a few hundred."""
        matrix, angles, n = self._matrix()
        found = self.top(vectors, queries, key, embedding, k).select("query_id", F.col(key).alias("key"))
        if not len(matrix):
            return 1
        # A query's cells by falling bound, as `candidates` takes them.
        ranks = queries.select(F.col(key).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("embedding")).where(F.size("embedding") == matrix.shape[1])
        held = self.codes.sparkSession.sparkContext.broadcast((matrix, angles, n))
        ranks = ranks.mapInArrow(lambda b: _ranked(b, held), "query_id long, cell int, place int")
        need = found.join(self.codes.select("key", "cell"), "key").join(ranks, ["query_id", "cell"]).groupBy("place").agg(F.count("*").alias("c")).orderBy("place").collect()
        every, sum_ = sum(r["c"] for r in need), 0
        for r in need:
            sum_ += r["c"]
            if sum_ >= recall * every:
                return r["place"]
        return 1

    def exact(self, found: DataFrame, vectors: DataFrame, queries: DataFrame, key: str, embedding: str, k: int) -> DataFrame:
        """Candidates by their vectors' cosine."""
        pairs = found.select("query_id", "key")
        count = pairs.count()
        unit = lambda c: F.transform(c, lambda x: F.try_divide(x, F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y))))
        own = queries.select(F.col(key).cast("long").alias("query_id"), unit(F.col(embedding).cast("array<double>")).alias("_q"))
        rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("_x"))
        if count <= LOOKED_UP:
            rows = rows.where(F.col("key").isin(sorted({r["key"] for r in pairs.collect()})))
        joined = rows.join(sent(pairs, count), "key").join(own, "query_id")
        score = F.aggregate(F.zip_with("_q", unit(F.col("_x")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return top(joined.select("query_id", F.col("key").alias(key), F.round(score, 9).alias("score")), "query_id", key, k)


def _least(found: DataFrame, k: int) -> DataFrame:
    """query_id and least: what the k-th of its candidates reaches surely; queries with fewer candidates are left out."""
    order = Window.partitionBy("query_id").orderBy(F.desc("lower"), "key")
    first = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return first.groupBy("query_id").agg(F.min("lower").alias("least"), F.count("*").alias("c")).where(F.col("c") == k).select("query_id", "least")


def _near(batches: Iterator[pa.RecordBatch], held: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """Bounds of the rows that may be among a task's k nearest to a query."""
    ids, matrix, centres, probed, least = held.value
    least, best = least.copy(), np.full((len(ids), k), -np.inf)
    kept: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def through() -> list[tuple[np.ndarray, ...]]:
        """Those that still reach the k-th; of one vector, the k smallest keys."""
        q, key, upper, lower, same = (np.concatenate(c) for c in zip(*kept, strict=True))
        good = upper >= least[q] - SLACK
        q, key, upper, lower, same = q[good], key[good], upper[good], lower[good], same[good]
        order = np.lexsort((key, lower, upper, same, q))
        q, key, upper, lower, same = q[order], key[order], upper[order], lower[order], same[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (same[1:] != same[:-1]) | (upper[1:] != upper[:-1]) | (lower[1:] != lower[:-1])
        start = np.flatnonzero(new)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        return [tuple(c[place < k] for c in (q, key, upper, lower, same))]

    for batch in batches:
        cell, key, scale, error, same = (batch.column(i).to_numpy() for i in range(5))
        code = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.int8).reshape(-1, centres.shape[1])
        for c in np.unique(cell):
            q = probed.get(int(c))
            if q is None:
                continue
            own = np.flatnonzero(cell == c)
            middle = matrix[q] @ centres[c]
            for s in range(0, len(own), ROW_SLICE):
                at = own[s : s + ROW_SLICE]
                score = middle[:, None] + (matrix[q] @ code[at].T.astype(np.float64)) * scale[at]
                score[ids[q][:, None] == key[at][None]] = -np.inf
                lower = score - error[at]
                best[q] = np.partition(np.concatenate([best[q], lower], axis=1), -k, axis=1)[:, -k:]
                least[q] = np.maximum(least[q], best[q].min(axis=1))
                a, b = np.nonzero((score + error[at] >= least[q][:, None] - SLACK) & np.isfinite(score))
                kept.append((q[a], key[at][b], (score + error[at])[a, b], lower[a, b], same[at][b]))
                rows += len(a)
                if rows > HELD:
                    kept = through()
                    rows = len(kept[0][0])
    if kept:
        q, key, upper, lower, _ = through()[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(key), pa.array(upper), pa.array(lower)], ["query_id", "key", "upper", "lower"])
