"""A change of the model that a written index's vectors come from, beside its searches and writers.

Vectors of another model are made segment by segment, each by a commit, so that a run that was killed goes on. When every
record has one, one commit sets all segments to them, and those of before stay until they are given up. Searches have
whole vectors of one model at any time, and a segment that another writer adds in between is made up for before the change.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.embed import Provider
from ..sources.store import Manifest, Part
from .search import Index, embedded, sorted_by_key


class Unready(ValueError):
    """Vectors of the wanted model are not whole, so that searches stay with the model that they have."""


def _has(part: Part, model: str) -> bool:
    return part.model == model and "embeddings" in part.tables or model in part.others


def _with(m: Manifest, segments: tuple[Part, ...]) -> Manifest:
    return Manifest(m.number, segments, m.deletions, m.streams)


def _vectors(index: Index, part: Part, model: str) -> DataFrame | None:
    """A segment's vectors of a model."""
    return index.store.read(_set(part, model) if model in part.others else part, "embeddings") if _has(part, model) else None


def _set(part: Part, model: str) -> Part:
    """The segment with its vectors of a model to be searched; those that were searched stay beside them."""
    schema, place = part.others[model]
    others = {k: v for k, v in part.others.items() if k != model}
    if part.model and "embeddings" in part.tables:
        others[part.model] = [part.tables["embeddings"], part.places.get("embeddings", part.path)]
    return replace(part, tables=part.tables | {"embeddings": schema}, places=part.places | {"embeddings": place}, model=model, others=others)


def _named(index: Index) -> Index:
    """The index with the name of its provider at segments of before, which do not tell whose their vectors are."""
    if all(p.model or "embeddings" not in p.tables for p in index.manifest.segments):
        return index
    name = index.provider.name

    def next_(m: Manifest) -> Manifest | None:
        new = tuple(replace(p, model=name) if "embeddings" in p.tables and not p.model else p for p in m.segments)
        return _with(m, new) if new != m.segments else None

    return _at(index, index.store.commit(next_), index.provider)


def _at(index: Index, m: Manifest, provider: Provider) -> Index:
    return Index.open(index.store.spark, index.store.folder, provider=provider, number=m.number, probed=False)


def backfilled(index: Index, provider: Provider) -> Index:
    """The index with vectors of another model beside its own, of all rows that its segments hold. What is there is not made again."""
    index = _named(index)
    store, m = index.store, index.manifest
    for part in m.segments:
        if _has(part, provider.name):
            continue
        # Rows that are gone by now need none.
        rows = store.live(m, [(part, store.read(part, "records"))])
        at = f"{part.path}/vectors-{uuid.uuid4().hex}"
        made = [store.write(sorted_by_key(embedded(rows, provider)), at, "embeddings", ("_kind", "_project")), at]

        def next_(now: Manifest, part=part, made=made) -> Manifest | None:
            segments = tuple(replace(p, others=p.others | {provider.name: made}) if p.path == part.path and not _has(p, provider.name) else p for p in now.segments)
            return _with(now, segments) if segments != now.segments else None

        store.commit(next_)
    return index.refreshed()


def lacking(index: Index, provider: Provider) -> DataFrame:
    """key of the records that have no vector of a model's size from it."""
    m = index.manifest
    found = [v.where(F.size("embedding") == provider.dimension).select("key") for p in m.segments if (v := _vectors(index, p, provider.name)) is not None]
    keys = index.records.select("key")
    return keys.join(functools.reduce(DataFrame.unionByName, found), "key", "left_anti") if found else keys


def flipped(index: Index, provider: Provider) -> Index:
    """The index whose searches use a model's vectors, by one commit. Refused if a record has none, and if a segment without them
    was committed meanwhile: nothing is changed then."""
    index = _named(index.refreshed())
    if n := lacking(index, provider).limit(1).count():
        raise Unready(f"records without vectors of {provider.name}, or with some of another size: {n} or more")
    late: list[str] = []

    def next_(m: Manifest) -> Manifest | None:
        late[:] = [p.path for p in m.segments if not _has(p, provider.name)]
        if late or all(p.model == provider.name for p in m.segments):
            return None
        return _with(m, tuple(p if p.model == provider.name else _set(p, provider.name) for p in m.segments))

    done = index.store.commit(next_)
    if late:
        raise Unready(f"segments without vectors of {provider.name}: {', '.join(late)}")
    return _at(index, done, provider)


def migrated(index: Index, provider: Provider, tries: int = 5) -> Index:
    """Vectors made and searches set to them; again for segments that came meanwhile. With the model of before, which is still
    beside, the way back: only what was added since is made."""
    for _ in range(tries):
        index = backfilled(index.refreshed(), provider)
        # A model's vectors that are not whole are not made whole by trying.
        if not lacking(index, provider).isEmpty():
            break
        try:
            return flipped(index, provider)
        except Unready:
            continue
    raise Unready(f"vectors of {provider.name} are not whole")


def contracted(index: Index) -> Index:
    """The index with the vectors that it searches alone: those of other models go with their segments."""

    def next_(m: Manifest) -> Manifest | None:
        return _with(m, tuple(replace(p, others={}) for p in m.segments)) if any(p.others for p in m.segments) else None

    return _at(index, index.store.commit(next_), index.provider)
