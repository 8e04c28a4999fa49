"""Compression of candidate lists, in one pass."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewell.operators import rank as R

ROWS = [
    # query, key, score, text, document, embedding
    (1, 1, 9.0, "the tide comes in at noon", "a", [1.0, 0.0]),
    (1, 2, 8.0, "the tide comes in at noon", "b", [1.0, 0.0]),  # the same text
    (1, 3, 7.0, "the tide comes in at noon!", "c", [0.0, 1.0]),  # nearly the same
    (1, 4, 6.0, "quays and moorings", "d", [1.0, 0.01]),  # a near vector
    (1, 5, 5.0, "a lighthouse keeper's log", "a", [0.0, -1.0]),  # document a again
    (1, 6, 5.0, "ropes, knots and splices", "e", None),
    (1, 7, 0.5, "far under the floor", "f", [0.5, 0.5]),
    (1, 8, None, "no score", "g", [0.5, 0.5]),
    (2, 1, 3.0, None, None, None),
    (2, 2, 3.0, None, None, None),  # the same null text
    (2, 3, 2.0, "", None, None),  # no document either: another of the same
    (3, 1, 0.1, "alone and low", "a", [1.0, 1.0]),
]


def hits(spark, rows=ROWS):
    return spark.createDataFrame(rows, "q long, k long, score double, text string, doc string, e array<double>")


def test_steps_and_totals(spark):
    totals = Observation()
    out, counts = R.compressed(hits(spark), "q", "k", "text", "doc", 1.0, embedding="e", totals=totals)
    assert sorted((r["q"], r["k"]) for r in out.collect()) == [(1, 1), (1, 6), (2, 1)]
    assert out.columns == ["q", "k", "score", "text", "doc", "e"]
    told = {r["q"]: [r[s] for s in R.STEPS] + [r["clusters_merged"]] for r in counts.collect()}
    assert told == {1: [8, 6, 5, 4, 3, 2, 3], 2: [3, 3, 2, 2, 2, 1, 1], 3: [1, 0, 0, 0, 0, 0, 0]}
    assert [totals.get[s] for s in R.STEPS] == [12, 9, 7, 6, 5, 3]


def test_without_vectors_and_limits(spark):
    out, counts = R.compressed(hits(spark).where("q = 1"), "q", "k", "text", "doc", 1.0, per_document=0)
    assert [r["k"] for r in out.orderBy("k").collect()] == [1, 4, 5, 6]
    assert counts.first()["clusters_merged"] == 2
    out, counts = R.compressed(hits(spark, []), "q", "k", "text", "doc", 1.0)
    assert out.count() == counts.count() == 0


def test_the_source_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    source = hits(spark).mapInArrow(seen, hits(spark).schema)
    out, counts = R.compressed(source, "q", "k", "text", "doc", 1.0, embedding="e")
    assert out.count() and counts.agg(F.sum("original")).first()[0] == len(ROWS) == read.value
