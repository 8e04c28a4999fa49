"""Communities that are stable."""

from __future__ import annotations

import random
from collections import Counter

from tidewell.operators import state as U


def unsettled(pairs, label):
    """Nodes around which another label is more frequent than their own."""
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert set(near) == set(label)
    votes = {n: Counter(label[x] for x in around) for n, around in near.items()}
    return [n for n, v in votes.items() if max(v.values()) > v[label[n]]]


def found(spark, pairs):
    return {r["node"]: r["community"] for r in U.settled_communities(spark.createDataFrame(pairs, "src long, dst long")).collect()}


def test_cliques(spark):
    """Two cliques with a bridge are two communities, whatever repeated edges, loops and nulls there are."""
    pairs = [(a, b) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)]
    pairs += [(5, 10), (0, 1), (1, 0), (3, 3), (99, 99), (None, 2), (2, None)]
    label = found(spark, pairs)
    assert not unsettled(pairs, label)
    assert len({label[n] for n in range(6)}) == len({label[n] for n in range(10, 16)}) == 1 and label[0] != label[10]


def test_what_swings_settles(spark):
    """On a graph of two sides all nodes at once would swap labels for ever; a hub and random edges settle too."""
    rng = random.Random(3)
    pairs = [(a, 100 + b) for a in range(4) for b in range(4)] + [(1000, 2000 + i) for i in range(60)] + [(rng.randrange(5000, 5080), rng.randrange(5000, 5080)) for _ in range(160)]
    label = found(spark, pairs)
    assert not unsettled(pairs, label)
    assert len({label[n] for n in label if 1000 <= n < 5000}) == 1


def test_no_edges(spark):
    assert found(spark, []) == found(spark, [(1, 1)]) == {}


def test_many_neighbours_take_few_rounds(spark, monkeypatch):
    """Where nearly all nodes of one side are neighbours of all of the other, or all of all, a round is not one move."""
    rng = random.Random(5)
    pairs = [(a, 1000 + b) for a in range(30) for b in range(120) if rng.random() < 0.7] + [(5000 + a, 5000 + b) for a in range(40) for b in range(a)]
    tables = []
    monkeypatch.setattr(U, "staged", lambda f, label, real=U.staged: (tables.append(label), real(f, label))[1])
    label = found(spark, pairs)
    assert not unsettled(pairs, label)
    assert len({label[n] for n in label if n < 5000}) == len({label[n] for n in label if n >= 5000}) == 1
    assert tables.count("wants") <= 15
