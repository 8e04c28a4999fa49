"""Near-duplicate documents by MinHash bands, odd sketches and exact Jaccard on word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, mixed, passes, shingles, staged
from .near import band_keys, classes, min_hashes, odd_sketch, sent

#: Bands and rows: a pair at the threshold shares no band with a chance under 1 in a million (0.85: 25 of 5, 0.8: 28 of 4).
BANDS = {85: (25, 5), 80: (28, 4)}
SIGNED = "doc_id long, hash long, check long, n_shingles long, bands array<long>, sketch array<long>"


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two numbers, 128 bits together, for a set of hashes, by its members alone."""
    x = mixed(s)
    sums = np.array([x.sum(dtype=np.uint64) + np.uint64(len(s)), (x * (x >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64)])
    return tuple(mixed(sums).view(np.int64).tolist())


def signed(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The set of every text by its two hashes, with its size, bands and sketch; none of these for a text without words."""
    for batch in batches:
        texts = [None if x is None else x.encode("utf-8") for x in batch.column("text").to_pylist()]
        for part in passes([len(t or b"") for t in texts]):
            sets = list(shingles(texts[part], width))
            full = [i for i, s in enumerate(sets) if len(s)]
            name, check, keys, sketch = ([None] * len(sets) for _ in range(4))
            if full:
                own = [sets[i] for i in full]
                samples = min_hashes(np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1], bands * rows)
                for i, s, k, x in zip(full, own, band_keys(samples, bands, rows), odd_sketch(samples), strict=True):
                    (name[i], check[i]), keys[i], sketch[i] = set_hash(s), k, x
            ids = batch.column("doc_id").slice(part.start, len(sets))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(name, pa.int64()), pa.array(check, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(keys, longs), pa.array(sketch, longs)], ["doc_id", "hash", "check", "n_shingles", "bands", "sketch"])


def items(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """node and its sorted shingles, where the text's set is the node's."""
    for batch in batches:
        texts = [None if x is None else x.encode("utf-8") for x in batch.column("text").to_pylist()]
        want = zip(*(batch.column(c).to_pylist() for c in ("node", "hash", "check")), strict=True)
        rows = [(n, s.tobytes()) for (n, *own), s in zip(want, shingles(texts, width), strict=True) if len(s) and set_hash(s) == tuple(own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "items"])


def near_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    A document's set holds its distinct shingles of `width` words, lower-cased A to Z; the whole sequence if it has
    fewer words. Documents with 100 * intersection >= percent * union are linked; component_id is the smallest doc_id
    that links lead to, and kept marks that document. Documents with equal sets, by 128 bits, are one node, so copies
    are never paired. A pair is missed only if no band finds it (under 1 in a million at the threshold, less above).

    A null or empty text, and one without words, has no shingles and no links: it is its own component. A null doc_id
    has no links, a null component and stays. Rows that share a doc_id are told apart by their sets; equal rows are
    treated alike. No rows give no rows. Other columns of `docs` are not read.
    """
    bands, rows = BANDS[percent]
    table = bounded(docs).select("doc_id", "text")
    marks = staged(table.mapInArrow(lambda b: signed(b, width, bands, rows), SIGNED), "document-marks")
    known = marks.where("hash is not null and doc_id is not null").groupBy("hash", "check")
    found = known.agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = staged(found.withColumn("node", F.monotonically_increasing_id()), "document-nodes")

    def full_sets(members: DataFrame, n: int) -> DataFrame:
        first = nodes.select("node", "hash", "check", F.col("first").alias("doc_id")).join(sent(members, n), "node")
        return table.join(sent(first, n, 32), "doc_id").select("node", "hash", "check", "text").mapInArrow(lambda b: items(b, width), "node long, items binary").dropDuplicates(["node"])

    linked = staged(classes(nodes.select("node", "size", "bands", "sketch"), percent, bands * rows, full_sets), "document-classes")
    n = linked.count()
    placed = staged(nodes.select("node", "hash", "check", "first", "n").join(sent(linked, n), "node", "left").where("root is not null or n > 1"), "document-placed")
    least = staged(placed.where("root is not null").groupBy("root").agg(F.min("first").alias("least")), "document-least")
    whole = staged(placed.join(sent(least, n), "root", "left").select("hash", "check", F.coalesce("least", "first").alias("to")), "document-components")
    out = marks.select("doc_id", "n_shingles", "hash", "check").join(sent(whole, whole.count(), 24), ["hash", "check"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("to", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
