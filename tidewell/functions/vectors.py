"""Column functions on vectors, and the default embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The size of the default embedding, and the token of a text without any.
DIMENSIONS, EMPTY = 384, "__empty__"
#: Rows whose vectors are held at once.
SLICE = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def embedded_tokens(text: Column) -> Column:
    """The tokens that the default embedding hashes: those of a text without any are EMPTY alone."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-zA-Z0-9_]+\b"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(EMPTY)))


def token_vectors(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """rows by DIMENSIONS: unit vectors of lists of tokens, and which entries any token met.

    Each token adds 1 at the place that the first 8 bytes of its SHA-256 give, and half at the place of the next 8, with
    the sign of the 17th byte's parity. Equal tokens of a batch are hashed once."""
    n = len(lists)
    tokens = lists.flatten().dictionary_encode()
    digests = [hashlib.sha256(t.encode()).digest() for t in tokens.dictionary.to_pylist()]
    whole = np.array([int.from_bytes(d[:8], "big") % DIMENSIONS for d in digests], np.int64)
    half = np.array([int.from_bytes(d[8:16], "big") % DIMENSIONS for d in digests], np.int64)
    sign = np.array([0.5 if d[16] % 2 == 0 else -0.5 for d in digests])
    code = tokens.indices.to_numpy()
    row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy()) * DIMENSIONS
    at, other = row + whole[code], row + half[code]
    out = np.bincount(at, minlength=n * DIMENSIONS) + np.bincount(other, sign[code], minlength=n * DIMENSIONS)
    met = np.zeros(n * DIMENSIONS, bool)
    met[at] = met[other] = True
    out = out.reshape(n, DIMENSIONS)
    length = np.sqrt((out * out).sum(1))
    return np.where(length[:, None] > 0, out / np.where(length > 0, length, 1)[:, None], 0.0), met.reshape(n, DIMENSIONS)


def _tokens(batches: Iterator[pa.RecordBatch], key: str, all_: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, SLICE):
            some = batch.slice(s, SLICE)
            value, met = token_vectors(some.column("tokens"))
            met = np.ones_like(met) if all_ else met
            edge = pa.array(np.append(0, np.cumsum(met.sum(1))).astype(np.int32))
            values = pa.ListArray.from_arrays(edge, pa.array(value[met]))
            if all_:
                yield pa.RecordBatch.from_arrays([some.column(key), values], [key, "embedding"])
            else:
                yield pa.RecordBatch.from_arrays([some.column(key), pa.ListArray.from_arrays(edge, pa.array(np.nonzero(met)[1].astype(np.int32))), values], [key, "places", "values"])


def hash_embedding(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, place and value of the entries of every row's embedding that a token met, a unit vector of hashed tokens. An
    entry whose parts cancel is 0 and told. A function of the row alone: nothing is shuffled."""
    wide = rows.select(key, embedded_tokens(F.col(text)).alias("tokens"))
    out = wide.mapInArrow(lambda b: _tokens(b, key, False), f"{key} {dict(rows.dtypes)[key]}, places array<int>, values array<double>")
    return out.select(key, F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("values").alias("value"))))


def hashed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and embedding, the whole vectors of `hash_embedding`."""
    wide = rows.select(key, embedded_tokens(F.col(text)).alias("tokens"))
    return wide.mapInArrow(lambda b: _tokens(b, key, True), f"{key} {dict(rows.dtypes)[key]}, embedding array<double>")


def _filled(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("entries")
        entry = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
        out = np.zeros(batch.num_rows * DIMENSIONS)
        out[row * DIMENSIONS + entry.field("place").to_numpy()] = entry.field("value").to_numpy()
        edge = pa.array(np.arange(0, len(out) + 1, DIMENSIONS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(edge, pa.array(out))], [key, "embedding"])


def dense(entries: DataFrame, key: str) -> DataFrame:
    """key and embedding array of DIMENSIONS numbers, from rows of key, place and value, each place once."""
    at = entries.groupBy(key).agg(F.collect_list(F.struct("place", "value")).alias("entries"))
    return at.mapInArrow(lambda b: _filled(b, key), f"{key} {dict(entries.dtypes)[key]}, embedding array<double>")
