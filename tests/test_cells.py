"""Trained cells against exact cosine."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import cells as K
from tidewell.operators import retrieve as S
from tidewell.operators.cells import Cells
from tidewell.scratch import scratch

SCHEMA = "key long, embedding array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA)


def clustered(n: int, width: int, groups: int, seed: int = 5):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, width))
    return [(i, middle[i % groups] + 0.2 * r.normal(size=width)) for i in range(n)]


def listed(rows):
    return {(r["query_id"], r["rank"]): (r["key"], r["score"]) for r in rows.collect()}


def test_exact_as_brute_force(spark):
    """Half of all rows are copies of one vector, some are scaled, some cannot be scored; ties go to the smaller key."""
    rows = clustered(400, 16, 7)
    rows += [(1000 + i, rows[3][1]) for i in range(400)] + [(2000 + i, 3 * np.asarray(rows[i][1])) for i in range(20)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] + [1.0] * 15), (3004, [float("nan")] * 16), (3005, [1.0, 2.0]), (3006, [float("inf")] + [0.0] * 15)]
    vectors = frame(spark, rows)
    asked = vectors.where("key % 7 = 3 or key >= 2990")
    made = Cells.made(vectors, "key", "embedding")
    assert made.codes.count() == 820
    assert listed(made.top(vectors, asked, "key", "embedding", 5)) == {k: v for k, v in listed(S.cosine_top(vectors.where(F.size("embedding") == 16), asked.where(F.size("embedding") == 16), "key", "embedding", 5)).items()}


def test_bounds_hold(spark):
    vectors = frame(spark, clustered(300, 12, 9))
    made = Cells.made(vectors, "key", "embedding")
    found = made.candidates(vectors.where("key < 40"), "key", "embedding", 3)
    unit = {r["key"]: np.asarray(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in vectors.collect()}
    for r in found.collect():
        assert r["lower"] - 1e-12 <= unit[r["query_id"]] @ unit[r["key"]] <= r["upper"] + 1e-12


def test_cells_that_cannot_matter_are_not_read(spark):
    """In clusters that lie apart an exact search reads the codes of few of them, and vectors of few rows."""
    vectors = frame(spark, clustered(1200, 24, 30))
    made = Cells.made(vectors, "key", "embedding", 30)
    asked = vectors.where("key < 20")
    found = made.candidates(asked, "key", "embedding", 5)
    assert found.agg(F.max("read")).first()[0] < 600
    assert found.count() < 20 * 15
    assert listed(made.exact(found, vectors, asked, "key", "embedding", 5)) == listed(S.cosine_top(vectors, asked, "key", "embedding", 5))


def test_probes_reach_the_recall(spark):
    r = np.random.default_rng(2)
    vectors = frame(spark, [(i, v) for i, v in enumerate(r.normal(size=(1500, 32)))])
    made = Cells.made(vectors, "key", "embedding")
    probes = made.probes(vectors, vectors.where("key % 10 = 1"), "key", "embedding", 10, 0.95)
    asked = vectors.where("key % 10 = 2")
    want = {(q, k) for (q, _), (k, _) in listed(S.cosine_top(vectors, asked, "key", "embedding", 10)).items()}
    got = {(q, k) for (q, _), (k, _) in listed(made.top(vectors, asked, "key", "embedding", 10, probes)).items()}
    assert 1 < probes < 39 and len(want & got) >= 0.93 * len(want)


def test_added_and_opened(spark):
    """Rows that come later go to the cells that were learned; what is written is read as it was."""
    rows = clustered(500, 8, 5)
    old, new = frame(spark, rows[:300]), frame(spark, [(i, -np.asarray(v)) for i, v in rows[300:]])
    every = old.unionByName(new)
    made = Cells.made(old, "key", "embedding").added(new, "key", "embedding").write(f"{scratch(spark)}/cells-{uuid.uuid4().hex}")
    asked = every.where("key % 20 = 0")
    assert listed(made.top(every, asked, "key", "embedding", 4)) == listed(S.cosine_top(every, asked, "key", "embedding", 4))


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [0.0, 0.0])], [(1, [1.0, 0.0])]])
def test_few_rows(spark, rows):
    vectors = frame(spark, rows)
    made = Cells.made(vectors, "key", "embedding")
    assert made.top(vectors, vectors, "key", "embedding", 3).count() == 0
    assert made.top(vectors, frame(spark, [(9, [1.0, 1.0])]), "key", "embedding", 3, 2).count() == len(rows) * (len(rows) == 1)


def test_many_queries_in_passes(spark, monkeypatch):
    vectors = frame(spark, clustered(200, 8, 4))
    want = listed(S.cosine_top(vectors, vectors, "key", "embedding", 3))
    monkeypatch.setattr(K, "QUERY_BLOCK", 64)
    monkeypatch.setattr(K, "LOOKED_UP", 10)
    assert listed(Cells.made(vectors, "key", "embedding").top(vectors, vectors, "key", "embedding", 3)) == want
