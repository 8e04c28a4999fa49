"""Benchmark decontamination by a random-walk embedding, bit sampling and exact edit distance.

Texts are words. An item may differ from a passage by EDITS of its words. Cut into one segment more than it may have
edits, at least one segment of it stands unchanged in the passage, so windows are tried only where a segment stands.
Each item-sized window there is embedded by CGK walks, which map edit distance to Hamming distance; windows that
agree with the item in a sample of places, in any of several repeats, are checked by exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, LOWER, MASK, bounded, mixed, passes, staged, words

#: Edits for each word of an item, rounded down.
EDITS = 0.2
#: Walks, samples of each, and places in a sample. With half of all places apart, a pair is missed by all with a chance of 0.75 ** 64, 1 in 100 million.
WALKS, SAMPLES, PLACES = 8, 8, 2
#: Words of items that a task works with at once; more items take more passes over the texts.
ITEM_WORDS = 2_000_000
#: Places whose windows are embedded at once; words of windows, and pairs of a place and an item's segment, that are held at once.
BLOCK, CELLS, HITS = 2_000, 1 << 20, 1 << 18
#: Words from which an item's exact distance costs less than the walks of all its windows: its candidates go there at once.
LONG = 512
SCHEMA = "doc_id long, item_ids array<long>, n_items long"


def gram(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(h) < n:
        return h[:0]
    return mixed(sum((h[i : len(h) - n + 1 + i] * np.uint64(pow(BASE, 3 * i + 1, 1 << 64)) for i in range(n)), np.uint64(0)))


def walk(sequences: np.ndarray, seed: int, steps: int | None = None) -> np.ndarray:
    """CGK embeddings of rows of words: three letters for each word; the walk steps on by a bit of the word and the step. Past the end stand zeros."""
    rows, n = sequences.shape
    padded = np.concatenate((sequences, np.zeros((rows, 1), np.uint64)), 1)
    at, line = np.zeros(rows, np.int64), np.arange(rows)
    out = np.empty((rows, steps or 3 * n), np.uint64)
    for j in range(out.shape[1]):
        out[:, j] = letter = padded[line, at]
        turn = mixed(letter ^ np.uint64((seed * 1_000_003 + j) * BASE & MASK)) >> np.uint64(63)
        at = np.minimum(at + turn.astype(np.int64), n)
    return out


def half(n: int) -> int:
    return max(1, 3 * n // 2)


def sampled_places(n: int, seed: int) -> np.ndarray:
    """SAMPLES by PLACES places of an embedding of n words; only the first half of the walk, which stays inside the words."""
    return np.random.default_rng((seed, n)).integers(0, half(n), (SAMPLES, PLACES))


def edit_distance(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Least edits that make a run of words of each row from a; rows are regions that the run may lie in."""
    width = rows.shape[1]
    step = np.arange(width + 1)
    d = np.zeros((len(rows), width + 1), np.int64)
    for i, word in enumerate(a):
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, 1:] + 1, d[:, :-1] + (rows != word))
        d = np.minimum.accumulate(new - step, axis=1) + step
    return d.min(1)


class Items:
    """Items by their number of words: words, ids, embeddings; and their segments by length."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        found: dict[int, list[tuple[int | None, np.ndarray]]] = {}
        for i, text in rows:
            h = words([(text or "").encode("utf-8").translate(LOWER)])[0]
            if len(h):
                found.setdefault(len(h), []).append((i, h))
        self.sizes = sorted(found)
        self.ids = {n: [i for i, _ in x] for n, x in found.items()}
        self.words = {n: np.stack([h for _, h in x]) for n, x in found.items()}
        self.samples = {n: [walk(w, s, half(n))[:, sampled_places(n, s)] for s in range(WALKS)] for n, w in self.words.items() if n <= LONG}
        segments: dict[int, list[tuple[int, int, int, int]]] = {}
        for n, w in self.words.items():
            length = n // (int(EDITS * n) + 1)
            for offset in range(0, length * (int(EDITS * n) + 1), length):
                for row, h in enumerate(gram(w[:, offset : offset + length].ravel(), length)[::length].tolist()):
                    segments.setdefault(length, []).append((h, n, row, offset))
        self.segments = {}
        for length, x in segments.items():
            x.sort()
            table = np.zeros(1 << 20, bool)
            key = np.array([s[0] for s in x], np.uint64)
            table[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.segments[length] = (key, np.array([s[1:] for s in x]), table)


def matches(texts: list[bytes], items: Items) -> list[tuple[int, int, int]]:
    """(number of the text, words, row) of the items that the texts hold."""
    h, _, _, count = words(texts)
    out: set[tuple[int, int, int]] = set()
    for length, (key, what, table) in items.segments.items():
        g = gram(h, length)
        at = np.flatnonzero(table[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low, high = np.searchsorted(key, g[at], "left"), np.searchsorted(key, g[at], "right")
        doc = np.searchsorted(count, at, "right") - 1
        own = (high > low) & (at + length <= count[doc + 1])
        at, low, high, doc = at[own], low[own], high[own], doc[own]
        # A segment may stand in many items: so many pairs at a time.
        total = np.cumsum(high - low)
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HITS, "right")))
            n = (high - low)[begin:end]
            first = np.repeat(low[begin:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out |= found(h, g, length, count, np.column_stack((what[first, 0], what[first, 1], np.repeat(doc[begin:end], n), np.repeat(at[begin:end], n) - what[first, 2])), items, out)
            begin = end
    return sorted(out)


def found(h: np.ndarray, g: np.ndarray, length: int, count: np.ndarray, hits: np.ndarray, items: Items, known: set) -> set[tuple[int, int, int]]:
    """Items of hits (size, row, text, start) with a segment of `length` words, block by block; pairs that are known are not tried again."""
    out: set[tuple[int, int, int]] = set()
    hits = np.unique(hits, axis=0)
    for size in np.unique(hits[:, 0]).tolist():
        some = hits[hits[:, 0] == size]
        block = max(1, min(BLOCK, CELLS // (size + 4 * int(EDITS * size))))
        for s in range(0, len(some), block):
            part = some[s : s + block]
            new = np.array([(d, size, r) not in out and (d, size, r) not in known for _, r, d, _ in part.tolist()], bool)
            part = part[new]
            part = part[shared(g, length, count, part, size, items)] if len(part) else part
            if len(part):
                out |= confirmed(h, count, part, size, items)
    return out


def shared(g: np.ndarray, length: int, count: np.ndarray, hits: np.ndarray, size: int, items: Items) -> np.ndarray:
    """Hits around whose start so many runs of `length` words are the item's as no passage within its edits can lack: an edit takes away `length` of an item's runs at most."""
    edits = int(EDITS * size)
    need = size - length + 1 - length * edits
    keep = np.ones(len(hits), bool)
    if need <= 1:
        return keep
    _, row, doc, start = hits.T
    at = start[:, None] + np.arange(-2 * edits, size + 2 * edits - length + 1)
    inside = (at >= count[doc][:, None]) & (at + length <= count[doc + 1][:, None])
    runs = g[np.clip(at, 0, len(g) - 1)]
    for r in np.unique(row).tolist():
        own = np.flatnonzero(row == r)
        mine = np.unique(gram(items.words[size][r], length))
        place = np.minimum(np.searchsorted(mine, runs[own]), len(mine) - 1)
        keep[own] = ((mine[place] == runs[own]) & inside[own]).sum(1) >= need
    return keep


def confirmed(h: np.ndarray, count: np.ndarray, hits: np.ndarray, size: int, items: Items) -> set[tuple[int, int, int]]:
    """Items at hits (size, row, text, start) that a window near the start agrees with, by samples and then by distance."""
    _, row, doc, start = hits.T
    edits = int(EDITS * size)
    low, high = count[doc], count[doc + 1]
    # Words around the start, zeros beyond the text.
    at = start[:, None] + np.arange(-2 * edits, size + 2 * edits)
    region = np.where((at >= low[:, None]) & (at < high[:, None]), h[np.clip(at, 0, len(h) - 1)], np.uint64(0))
    agreed = np.full(len(hits), size > LONG)
    shifts = 2 * edits + 1
    for s in range(WALKS):
        rest = np.flatnonzero(~agreed)
        if not len(rest):
            break
        step = max(1, CELLS // (shifts * size))
        for i in range(0, len(rest), step):
            # The windows at all shifts of some hits, one after another.
            part = rest[i : i + step]
            window = np.lib.stride_tricks.sliding_window_view(region[part, edits : size + 3 * edits], size, axis=1).reshape(-1, size)
            sample = walk(window, s, half(size))[:, sampled_places(size, s)]
            same = (sample == np.repeat(items.samples[size][s][row[part]], shifts, axis=0)).all(2).any(1)
            agreed[part[same.reshape(-1, shifts).any(1)]] = True
    out = set()
    for r in np.unique(row[agreed]).tolist():
        own = np.flatnonzero(agreed & (row == r))
        near = edit_distance(items.words[size][r], region[own]) <= edits
        out |= {(d, size, r) for d in doc[own[near]].tolist()}
    return out


def held_items(batch: pa.RecordBatch, items: Items) -> list[set[tuple[int, int]]]:
    """(words, row) of the items that each text holds."""
    texts = [t.translate(LOWER) for t in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
    held: list[set] = [set() for _ in texts]
    for part in passes([len(t) for t in texts]):
        for d, n, row in matches(texts[part], items):
            held[d + part.start].add((n, row))
    return held


def marked(batches: Iterator[pa.RecordBatch], items: Items, key: str = "doc_id", bare: bool = True) -> Iterator[pa.RecordBatch]:
    """The key, item_ids and n_items of each row; of those alone that hold an item, if not `bare`."""
    for batch in batches:
        held = held_items(batch, items)
        ids = [sorted({i for n, r in x if (i := items.ids[n][r]) is not None}) for x in held]
        out = pa.RecordBatch.from_arrays([batch.column(key), pa.array(ids, pa.list_(pa.int64())), pa.array(map(len, held), pa.int64())], [key, "item_ids", "n_items"])
        yield out if bare else out.filter(pa.array([bool(x) for x in held], pa.bool_()))


def parts(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark in parts of up to about ITEM_WORDS words, one at least, each sent to all executors."""
    rows = benchmark.select("item_id", "text").where("length(text) > 0")
    size = rows.agg(F.coalesce(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    n = max(1, -(-size // ITEM_WORDS))
    for part in range(n):
        yield benchmark.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part).collect()]))


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_ids, n_items and contaminated for every document.

    A document holds an item if some run of its words is at most EDITS of the item's words away from it in edit
    distance; words are what stands between white space, A to Z lower-cased. item_ids are sorted and without repeats;
    an item without id counts in n_items alone. Items without words are held by none; null and empty texts hold none.
    A null doc_id is a document like any other, and repeated rows are told each. No rows give no rows. Other columns
    are not read.

    The benchmark goes to all executors in parts of up to ITEM_WORDS words; documents are not shuffled. With several
    parts, each row gets a place in a table first, and only finds are told by place and summed.
    """
    docs = bounded(docs).select("doc_id", "text")
    every = parts(benchmark)
    first, second = next(every), next(every, None)
    if second is None:
        out = docs.mapInArrow(lambda b: marked(b, first.value), SCHEMA)
    else:
        placed = staged(docs.withColumn("place", F.monotonically_increasing_id()), "items-places")
        finds = None
        for items in chain((first, second), every):
            one = staged(placed.select("place", "text").mapInArrow(lambda b, items=items: marked(b, items.value, "place", False), "place long, item_ids array<long>, n_items long"), "items-found")
            finds = one if finds is None else finds.unionByName(one)
            items.unpersist()
        found = finds.groupBy("place").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.sum("n_items").alias("n_items"))
        none = F.array().cast("array<long>")
        out = placed.select("place", "doc_id").join(found, "place", "left").select("doc_id", F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))
    return out.withColumn("contaminated", F.col("n_items") > 0)


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item; as in find_items, null and empty texts hold none."""
    docs, schema = bounded(docs), docs.schema
    after = False
    for items in parts(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in held_items(batch, items.value)], pa.bool_()))

        # A table between two parts, so that a worker holds one.
        docs = (staged(docs, "items-clean") if after else docs).mapInArrow(run, schema)
        after = True
    return docs
