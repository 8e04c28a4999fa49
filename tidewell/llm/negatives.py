"""Hard negatives by threshold joins with an inverted index, after L2AP.

An anchor asks for the best rows in a window of scores, above a threshold. In each block of rows an index lists the
components by groups of dimensions, the widest first; of a row, those groups are left out whose remaining norm cannot
reach the least threshold by itself. Scores are accumulated group by group, and rows and anchors go whose sum and
remaining norms cannot reach the threshold; left-out groups are added for what remains. Thresholds begin high; windows
that are not full ask again with lower ones, down to the window's own floor, so every result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Dimensions of a group of the index; rows and anchors of a task at least and at most; rows and anchors whose scores are held at once.
GROUP, LEAST_ROWS, MOST_ROWS, MOST_ASKS, HELD_ROWS, HELD_ASKS = 16, 512, 65_536, 16_384, 8_192, 512
#: Thresholds of positives as shares of the largest product of norms, and of negatives as shares of the window from its top; last comes the floor.
POSITIVE_STEPS, NEGATIVE_STEPS = (0.6, 0.3), (0.1, 0.4)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
ROW = "vec_id long, label long, vector binary, size int, norm double"
FOUND = "ask long, place_of long, win int, place long, vec_id long, score long"


def quantised(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """floor(scale * x), as 16-bit integers where a row's fit, else 64-bit; rows that take no part go."""
    for batch in batches:
        rows = []
        for i, label, x in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
            if i is None or label is None or not x.is_valid or x.values.null_count:
                continue
            v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                n = np.floor(scale * v)
                square = float(n @ n)
            if not np.isfinite(v).all() or not square < 2.0**62:
                continue
            rows.append((i, label, n.astype("<i2" if np.abs(n).max(initial=0) < 2**15 else "<i8").tobytes(), len(n), np.sqrt(square)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.float64()), strict=True)], ["vec_id", "label", "vector", "size", "norm"])


def matrix(table: pa.Table, width: int, whole: bool) -> np.ndarray:
    """Rows of integers, shorter ones with zeros at the end; as float64 where all products are exact in 53 bits, else int64."""
    out = np.zeros((table.num_rows, width), np.int64 if whole else np.float64)
    for i, (x, n) in enumerate(zip(table.column("vector").to_pylist(), table.column("size").to_pylist(), strict=True)):
        out[i, :n] = np.frombuffer(x, "<i2" if len(x) == 2 * n else "<i8")
    return out


def remaining(x: np.ndarray, cuts: list[slice]) -> np.ndarray:
    """groups by rows: the norm of what comes after each group, rounded up."""
    squares = np.stack([(x[:, c].astype(np.float64) ** 2).sum(1) for c in cuts])
    after = np.concatenate((np.cumsum(squares[::-1], 0)[::-1][1:], np.zeros((1, len(x)))))
    return np.sqrt(after) * (1 + 1e-9)


class Index:
    """Groups of dimensions of a block of rows, and for each row how many of them are listed."""

    def __init__(self, rows: np.ndarray, order: np.ndarray):
        self.x = rows[:, order]
        self.cuts = [slice(i, min(i + GROUP, len(order))) for i in range(0, len(order), GROUP)]
        self.rest = remaining(self.x, self.cuts)

    def reached(self, asks: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of asks by rows, and which of them reach the asks' thresholds; the others' scores are not complete."""
        least = exact.astype(np.float64)
        # Bounds are floating numbers; below 2**62 they are apart from whole ones by less.
        spare = 1 if self.x.dtype == np.float64 else 4096
        score = np.zeros((len(asks), len(self.x)), self.x.dtype)
        reach = np.zeros(score.shape, bool)
        if not score.size:
            return score, reach
        ask_rest = remaining(asks, self.cuts)
        bottom = float(least.min())
        # Of a row, groups are listed until what comes after cannot reach any threshold alone.
        listed = 1 + (self.rest * ask_rest.max(1)[:, None] >= bottom).sum(0) if bottom > 0 else np.full(len(self.x), len(self.cuts))
        rows, some = np.arange(len(self.x)), np.arange(len(asks))
        for g, cut in enumerate(self.cuts):
            on = rows[listed[rows] > g]
            if len(on) and len(some):
                score[np.ix_(some, on)] += asks[some][:, cut] @ self.x[on][:, cut].T
                alive = score[np.ix_(some, on)] + np.outer(ask_rest[g][some], self.rest[g][on]) * (1 + 1e-9) + spare >= least[some][:, None]
                # Rows go without any ask left, and asks without any row, where all rows are listed so far.
                every = len(on) == len(rows)
                rows = np.concatenate((on[alive.any(0)], rows[listed[rows] <= g]))
                if every:
                    some = some[alive.any(1)]
        # What was left out is added where the sum and the remaining norms may still reach.
        for n in np.unique(listed[rows]).tolist():
            on = rows[listed[rows] == n]
            part = score[np.ix_(some, on)]
            if n < len(self.cuts):
                may = part + np.outer(ask_rest[n - 1][some], self.rest[n - 1][on]) * (1 + 1e-9) + spare >= least[some][:, None]
                on, part = on[may.any(0)], part[:, may.any(0)]
                after = slice(self.cuts[n].start, self.x.shape[1])
                part = part + asks[some][:, after] @ self.x[on][:, after].T
            score[np.ix_(some, on)] = part
            reach[np.ix_(some, on)] = part >= exact[some][:, None]
        return score, reach


def best(asks: pa.Table, rows: pa.Table, same: bool, k: int, width: int, whole: bool) -> pa.Table:
    """The k best rows of a block for each window of its asks, ties to the smaller vec_id and then place."""
    out: list[tuple[np.ndarray, ...]] = []
    if asks.num_rows and rows.num_rows:
        rows = rows.combine_chunks().sort_by([("vec_id", "ascending"), ("place", "ascending")])
        asks = asks.combine_chunks()
        q, x = matrix(asks, width, whole), matrix(rows, width, whole)
        order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
        q = q[:, order]
        ids, labels, places = (rows.column(c).to_numpy() for c in ("vec_id", "label", "place"))
        own, mine, own_place, least = (asks.column(c).to_numpy() for c in ("ask", "ask_label", "place_of", "least"))
        windows = asks.column("windows").to_pylist()
        for s in range(0, len(ids), HELD_ROWS):
            e = min(s + HELD_ROWS, len(ids))
            index = Index(x[s:e], order)
            for a in range(0, len(own), HELD_ASKS):
                score, reach = index.reached(q[a : a + HELD_ASKS], least[a : a + HELD_ASKS])
                for i in range(len(score)):
                    j = a + i
                    at = np.flatnonzero(reach[i])
                    at = at[((labels[s + at] == mine[j]) == same) & (ids[s + at] != own[j])]
                    if not len(at):
                        continue
                    value = score[i, at].astype(np.int64)
                    by = np.argsort(-value, kind="stable")
                    at, value = at[by], value[by]
                    for w in windows[j]:
                        low = max(w["low"], w["least"])
                        first = np.searchsorted(-value, -w["high"], "left")
                        last = np.searchsorted(-value, -low, "right")
                        pick = slice(first, min(last, first + k))
                        n = max(0, pick.stop - pick.start)
                        if n:
                            out.append((np.full(n, own[j]), np.full(n, own_place[j]), np.full(n, w["win"]), places[s + at[pick]], ids[s + at[pick]], value[pick]))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
    # Of all slices, the k best.
    by = np.lexsort((columns[3], columns[4], -columns[5], columns[2], columns[1]))
    columns = [c[by] for c in columns]
    if len(by):
        new = np.append(True, (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1]))
        begin = np.flatnonzero(new)
        keep = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by)))) < k
        columns = [c[keep] for c in columns]
    return pa.table([pa.array(c, pa.int32() if n == 2 else pa.int64()) for n, c in enumerate(columns)], names=["ask", "place_of", "win", "place", "vec_id", "score"])


def filled(asks: DataFrame, rows: DataFrame, n: int, steps: list[Callable[[Column, Column, Column], Column]], same: bool, k: int, width: int, whole: bool) -> DataFrame:
    """place_of, win, rank, place, vec_id, score: the k best rows of each window.

    asks: ask, place_of, ask_label, vector, size, norm, win, low, high. steps: thresholds of a window from its norm, low
    and high; windows with k rows over one are done, the others go on to the next, and the last is the floor.
    """
    spans = max(1, -(-n // max(LEAST_ROWS, min(MOST_ROWS, n // 16))))
    lot = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    results = None
    order = Window.partitionBy("place_of", "win").orderBy(F.desc("score"), "vec_id", "place")
    for turn, step in enumerate(steps):
        last = turn == len(steps) - 1
        windows = asks.withColumn("least", F.greatest(F.col("low"), step(F.col("norm"), F.col("low"), F.col("high"))))
        # An anchor has some windows alone; they travel together.
        each = windows.groupBy("place_of").agg(*(F.first(c).alias(c) for c in ("ask", "ask_label", "vector", "size")), F.min("least").alias("least"), F.collect_list(F.struct("win", "low", "high", "least")).alias("windows"))
        asking = asks.select("place_of").distinct().count()
        if not asking:
            break
        lots = -(-asking // MOST_ASKS)
        asked = each.withColumn("q", lot("place_of", lots)).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
        held = rows.select("place", "vec_id", "label", "vector", "size").withColumn("d", lot("place", spans)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        found = asked.groupBy("q", "d").cogroup(held.groupBy("q", "d")).applyInArrow(lambda a, b: best(a, b, same, k, width, whole), FOUND)
        found = staged(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("place_of", "win", "rank", "place", "vec_id", "score"), "negatives-found")
        if not last:
            full = found.where(F.col("rank") == k).select("place_of", "win")
            found, asks = found.join(full, ["place_of", "win"], "left_semi"), staged(asks.join(full, ["place_of", "win"], "left_anti"), "negatives-asks")
        results = found if results is None else results.unionByName(found)
    return results


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label and embedding; is_anchor: a column of vec_id. Components become floor(scale * x). An anchor's
    positives are its best rows of the same label, and for each of them the best rows of other labels are told whose
    score is at most the positive's and at least four fifths of it; so a positive under zero has none. Ties go to the
    smaller vec_id. Rows without id, label or vector, or with a null or non-finite component, take no part, nor do those
    whose squared length needs more than 62 bits, as their scores may be no 64-bit numbers. Shorter vectors are read as
    if zeros followed. Rows that share a vec_id are rows of their own in every role, but never for each other. No rows, or
    no anchors, give no rows. Other columns are not read.

    The driver gets counts alone. Blocks of rows and of anchors meet in a grid: each task holds one of each.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(lambda b: quantised(b, scale), ROW)
    rows = staged(rows.withColumn("place", F.monotonically_increasing_id()), "negatives-rows")
    n, width, longest = rows.agg(F.count("*"), F.max("size"), F.max("norm")).first()
    if not n or not width:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = bool(longest**2 >= 2.0**52)
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("ask"), F.col("place").alias("place_of"), F.col("label").alias("ask_label"), "vector", "size", "norm")
    asks = anchors.withColumns({"win": F.lit(0), "low": F.lit(LOWEST), "high": F.lit(HIGHEST)})
    to_long = lambda c: F.floor(c).cast("long")
    floor = lambda norm, low, high: low
    found = filled(asks, rows, n, [*(lambda norm, low, high, f=f: to_long(norm * F.lit(f * longest)) for f in POSITIVE_STEPS), floor], True, positives, width, whole)
    # 80 p <= 100 s says s >= p - p div 5.
    near = found.where("score >= 0").select("place_of", F.col("rank").alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("high"), F.expr("score - score div 5").alias("low")) if found is not None else None
    if near is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    near = staged(near.join(anchors, "place_of"), "negatives-windows")
    found = filled(near.drop("positive_id"), rows, n, [*(lambda norm, low, high, f=f: high - to_long((high - low) * F.lit(f)) for f in NEGATIVE_STEPS), floor], False, negatives, width, whole)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    told = near.select("place_of", "win", F.col("ask").alias("anchor_id"), "positive_id", F.col("high").alias("positive_score"))
    return found.join(told, ["place_of", "win"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
