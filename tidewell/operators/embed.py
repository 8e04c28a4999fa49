"""Embeddings by a provider, with a cache by content, so that a text is encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import DIMENSIONS, embedded_tokens, hashed, token_vectors
from ..scratch import staged


class Provider(Protocol):
    """What makes vectors of texts: `name` and `dimension` tell its vectors from others'."""

    name: str
    dimension: int

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """key and embedding of every row."""


class Hashed:
    """The default: hashed tokens, row by row."""

    name, dimension = "hashed", DIMENSIONS

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        return hashed(rows, key, text)


def vectors_of(provider: Provider, queries: DataFrame, key: str, text: str) -> dict[int, list[float]]:
    """The vectors of a few queries that the driver holds; the default embedding makes them there."""
    if isinstance(provider, Hashed):
        rows = queries.select(key, embedded_tokens(F.col(text)).alias("tokens")).toArrow()
        made = token_vectors(rows.column("tokens").combine_chunks())[0] if rows.num_rows else []
        return dict(zip(rows.column(key).to_pylist(), (v.tolist() for v in made), strict=True))
    return {r[key]: r["embedding"] for r in provider.embed(queries, key, text).collect()}


class Encoder:
    """A model in tasks: load() makes, once a task, a function from texts to vectors; texts go to it BATCH at a time."""

    BATCH = 64

    def __init__(self, name: str, dimension: int, load: Callable[[], Callable[[list[str]], list[list[float]]]]):
        self.name, self.dimension, self.load = name, dimension, load

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        load, size = self.load, self.BATCH

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None
            for batch in batches:
                model = model or load()
                for s in range(0, batch.num_rows, size):
                    some = batch.slice(s, size)
                    vectors = model([t or "" for t in some.column(text).to_pylist()])
                    yield pa.RecordBatch.from_arrays([some.column(key), pa.array(vectors, pa.list_(pa.float64()))], [key, "embedding"])

        return rows.select(key, text).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>")


def content_hash(text) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def cached(rows: DataFrame, key: str, text: str, provider: Provider, cache: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key and embedding of every row, what the cache lacked, counts). A cache has content_hash, model and embedding; only
    texts whose hash it lacks for this provider are encoded, each once. Counts: rows, hits and misses (texts)."""
    hashed = rows.select(key, F.col(text).alias("_text"), content_hash(text).alias("content_hash"))
    each = hashed.groupBy("content_hash").agg(F.first("_text").alias("_text"), F.count("*").alias("n"))
    known = None if cache is None else cache.where(F.col("model") == provider.name).select("content_hash", "embedding")
    lacking = each if known is None else each.join(known.select("content_hash"), "content_hash", "left_anti")
    fresh = staged(provider.embed(lacking, "content_hash", "_text"), "embeddings")
    every = fresh.select("content_hash", "embedding") if known is None else known.unionByName(fresh.select("content_hash", "embedding"))
    out = hashed.select(key, "content_hash").join(every, "content_hash", "left").select(key, "embedding")
    missed = each.join(fresh.select("content_hash", F.lit(1).alias("m")), "content_hash", "left")
    counts = missed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.when(F.col("m").isNull(), 1)).alias("hits"), F.count("m").alias("misses"))
    return out, fresh.withColumn("model", F.lit(provider.name)), counts
