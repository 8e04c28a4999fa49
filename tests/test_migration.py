"""A change of the model of a written index."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators.embed import Encoder
from tidewell.plans import migration as M
from tidewell.plans.search import Index

from .test_store import ASKED, RECORD, answers, rows


def lengths(texts):
    return [[float(len(t) + 1), float(t.count("o")), 1.0] for t in texts]


NEW = Encoder("counts", 3, lambda: lengths)


def made(spark, at, n=18):
    rng = random.Random(4)
    index = Index.create(spark, at)
    held = []
    for start in range(0, n, 6):
        some = rows(rng, range(start, start + 6))
        held += some
        index = index.change(spark.createDataFrame(some, RECORD))
    return index, held


def test_change_of_model_and_back(spark, tmp_path):
    at = str(tmp_path / "index")
    index, held = made(spark, at)
    index = index.change(removed=spark.createDataFrame([("d0",)], "doc_id string"))
    kept = [r for r in held if r[1] != "d0"]
    old = answers(index, ASKED)
    # Beside the old ones, nothing changes; a second run makes nothing again.
    beside = M.backfilled(index, NEW)
    assert answers(beside, ASKED) == old and M.lacking(beside, NEW).isEmpty()
    assert M.backfilled(beside, NEW).manifest.number == beside.manifest.number
    new = M.flipped(beside, NEW)
    assert answers(new, ASKED) == answers(Index(spark.createDataFrame(kept, RECORD), provider=NEW), ASKED)
    # A reader of before goes on, a new one needs the right provider, and so does a writer.
    assert answers(beside, ASKED) == old
    with pytest.raises(ValueError, match="counts"):
        Index.open(spark, at)
    with pytest.raises(ValueError, match="counts"):
        beside.change(spark.createDataFrame([(90, "d90", "T", "late", "f", "", "p", "note")], RECORD))
    # What comes after is of the new model; the way back makes only that.
    late = (91, "d91", "T91", "rope and anchor", "f91.md", "", "p0", "note")
    new = new.change(spark.createDataFrame([late], RECORD))
    with pytest.raises(M.Unready):
        M.flipped(new, index.provider)
    back = M.migrated(new, index.provider)
    assert answers(back, ASKED) == answers(Index(spark.createDataFrame([*kept, late], RECORD)), ASKED)
    done = M.contracted(back)
    assert not any(p.others for p in done.manifest.segments) and answers(done, ASKED) == answers(back, ASKED)


def test_killed_and_late_segments(spark, tmp_path):
    """A run that dies after a segment goes on, and a segment that comes before the change is made up for."""
    at = str(tmp_path / "index")
    index, held = made(spark, at)
    calls = []

    class Dying(Encoder):
        def embed(self, rows, key, text):
            calls.append(1)
            if len(calls) == 2:
                raise RuntimeError("killed")
            return super().embed(rows, key, text)

    dying = Dying("counts", 3, lambda: lengths)
    with pytest.raises(RuntimeError):
        M.migrated(index, dying)
    late = (91, "d91", "T91", "rope and anchor", "f91.md", "", "p0", "note")
    index.refreshed().change(spark.createDataFrame([late], RECORD))
    new = M.migrated(index, dying)
    assert len(calls) == 1 + 1 + 3
    assert answers(new, ASKED) == answers(Index(spark.createDataFrame([*held, late], RECORD), provider=NEW), ASKED)


def test_vectors_of_a_wrong_size(spark, tmp_path):
    index, _ = made(spark, str(tmp_path / "index"), 6)
    wrong = Encoder("counts", 4, lambda: lengths)
    with pytest.raises(M.Unready):
        M.migrated(index, wrong)
    assert answers(index.refreshed(), ASKED) == answers(index, ASKED)


def test_segments_without_a_name(spark, tmp_path):
    """Vectors of segments that do not tell their model are those of the provider that opens them."""
    index, held = made(spark, str(tmp_path / "index"), 6)
    from dataclasses import replace

    m = index.store.commit(lambda m: M._with(m, tuple(replace(p, model="") for p in m.segments)))
    new = M.migrated(M._at(index, m, index.provider), NEW)
    assert {p.model for p in new.manifest.segments} == {"counts"} and set(new.manifest.segments[0].others) == {"hashed"}
    assert new.embeddings.agg(F.max(F.size("embedding"))).first()[0] == 3
    assert M.migrated(new, index.provider).embeddings.count() == len(held)
