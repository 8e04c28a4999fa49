"""Operators on small tables against plain versions: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import string
import struct
import time
import zlib
from fractions import Fraction
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bpe, decon, documents, extract, knn, lines, near, passages, quality, secrets, shard
from tidewell.llm.queries import tokenizer

SYLLABLES = "an be der ei en er es fi ga he in ka lo mi no or pa que ra st ti un vo wa ün éz ção".split()


def sentence(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [sentence(rng, rng.choice([3, 20, 60, 150])) for _ in range(40)]
    base = [re.sub(r"((?:\S+ ){12})", r"\1\n", t) for t in base]
    rows = list(enumerate(base))
    shared = sentence(rng, 30)
    for i in range(40, 60):
        words = base[i % 7].split(" ")
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(i, f"{sentence(rng, 10)}\n{shared} {sentence(rng, 5)}") for i in range(60, 66)]
    rows += [(i, base[2]) for i in range(66, 72)]
    rows += [(72, None), (73, ""), (74, " \n\t "), (75, "a"), (76, "One two"), (77, "one two"), (None, base[3]), (None, None), (78, base[5]), (78, base[5]), (79, "same id " * 12), (79, "other text " * 12)]
    rows += [(80, sentence(rng, 30000)), (81, "x" * 50000), (82, "ab" * 3000), (83, "=" * 700), (84, "\n".join(["line of text that comes again"] * 30)), (85, "Zu und ﻿ tabs\x1cnot\x85blank 漢字 😀 ΑΣ Σ İ")]
    return rows


CLASH = ("ids", "node", "version", "row", "key", "bucket", "removed", "score", "label", "n", "range", "hash", "spans", "size")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in CLASH:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.withColumn("n_chars", F.length("text").cast("long")).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, extra string")


def union(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return [find(i) for i in range(n)]


# 1


def test_bpe(docs, rows, none, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    want = collections.Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    got = bpe.encode_documents(docs, tokenizer(), keep_ids=True)
    assert collections.Counter(tuple(r)[:4] for r in got.collect()) == want
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(got.where("doc_id = 76"), tokenizer()).collect()}
    assert back == {76: "one</w> two</w>"}
    assert bpe.encode_documents(none, tokenizer()).count() == 0
    assert [r["text"] for r in bpe.decode_documents(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), tokenizer()).collect()] == ["", ""]


def test_bpe_words():
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(tokenizer()), bpe.vocabulary(Path(tokenizer()).read_bytes())
    rng = random.Random(1)
    pools = ["abc'sStTdDrRlLmM '  ", "\x00\x1c\x1f\x0b\x85\xa0 　﻿ ab", "ΣσςİıßẞǅÀÉ́̀a", "½²Ⅷ①٣3९a ", "<|endoftext|><|startoftext|>ab<|", "漢字한글𝒳😀a", "=-#!$%"]
    for _ in range(800):
        pool = "".join(rng.sample(pools, 2))
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert list(memoryview(v.encode(text)).cast("I")) == t.encode(text, add_special_tokens=False).ids, repr(text)
    for word in ("a" * 97, "ab" * 400, "unbelievable" * 30):
        assert v._heaped([*v.byte.__class__(v.byte[b] for b in word.encode()[:-1]), v.last[ord(word[-1])]]) == v._scanned([*(v.byte[b] for b in word.encode()[:-1]), v.last[ord(word[-1])]])


def test_memory_of_words(monkeypatch):
    """What a worker remembers is bounded, and forgetting changes nothing."""
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    v, whole = (bpe.Vocabulary(Path(tokenizer()).read_bytes()) for _ in "ab")
    rng = random.Random(6)
    for _ in range(300):
        text = " ".join(f"w{rng.randrange(1000)}-{rng.choice('abc')}.x" for _ in range(20))
        ids = v.encode(text)
        assert len(v.known) <= 50
        whole.known.clear()
        assert ids == whole.encode(text)


# 2


def test_quality(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_edges(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(none, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_attention_by_hand():
    """Scores against a plain loop over passages, gradients against finite differences."""
    rng = np.random.default_rng(3)
    x, start, y = rng.normal(size=(23, 9)), np.array([0, 1, 6, 7, 15]), np.array([1.0, 0, 1, 0, 1])
    weight = rng.random(5)
    m = quality.Model(x)
    m.p = {k: v + rng.normal(0, 0.3, v.shape) for k, v in m.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def score(p, passages):
        codes = [np.tanh(((v - m.mean) * m.scale) @ p["A"] + p["a"]) for v in passages]
        gate = np.array([np.exp((np.tanh(c @ p["V"]) * sigmoid(c @ p["U"])) @ p["w"]) for c in codes])
        return sigmoid(sum(g / gate.sum() * c for g, c in zip(gate, codes, strict=True)) @ p["k"] + p["d"][0])

    def loss(p):
        s = [score(p, part) for part in np.split(x, start[1:])]
        return -sum(w * (t * np.log(v) + (1 - t) * np.log(1 - v)) for w, t, v in zip(weight, y, s, strict=True))

    f = m.forward(x, start)
    assert np.allclose(f["score"], [score(m.p, part) for part in np.split(x, start[1:])])
    for k, g in m.gradients(f, start, y, weight).items():
        at = np.ndindex(m.p[k].shape)
        for i in list(at)[:: max(1, m.p[k].size // 25)]:
            up, down = ({n: v.copy() for n, v in m.p.items()} for _ in "ud")
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[i]) < 1e-6, k


def test_passages_have_words():
    """Hashed words tell two texts of alike shapes apart, and every word counts in one passage."""
    x, first = quality.encoded([b"alpha gamma " * 40, b"betas delta " * 40, b"", b"one"])
    assert first.tolist() == [0, 2, 4, 5, 6] and x.shape[1] == quality.WIDTH
    words, other = x[:, -quality.HASHED :], x[:, : -quality.HASHED]
    assert np.allclose(other[0], other[2]) and not np.allclose(words[0], words[2]) and not x[4].any() and np.abs(words[5]).sum() == 1


# 3


def test_shards(docs, rows, none, spark):
    got = shard.shard_documents(docs, 7).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((-1 if i is None else i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in x) - total / 7) <= 2 * most for x in by.values())
    assert shard.shard_documents(none).count() == 0
    hot = spark.createDataFrame([(i, "hot text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 6000)], "doc_id long, text string")
    sizes = [r["b"] for r in shard.shard_documents(hot).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 200
    few = {r["shard"] for r in shard.shard_documents(hot.withColumn("text", F.when(F.col("doc_id") % 500 == 0, "few").otherwise(F.col("text")))).where(F.col("text_crc32") == zlib.crc32(b"few")).collect()}
    assert len(few) == 1


def test_shards_beside_a_hot_text(spark):
    """A text of very many copies, equal rows among them, is cut; pairs and small groups beside it are not."""
    rows = [(i if i % 2 else 7, "hot text that comes very often") for i in range(3000)] + [(10_000 + i, f"pair {i // 2} of two") for i in range(3000)] + [(20_000 + i, f"group {i // 4}") for i in range(500)]
    got = shard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    shards, sizes = collections.defaultdict(set), collections.Counter()
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert len(shards.pop(zlib.crc32(b"hot text that comes very often"))) > 10
    assert all(len(x) == 1 for x in shards.values()) and len(shards) == 1625
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 400


def test_pieces(spark, monkeypatch):
    """Overfull ranges are subdivided by width: the law holds, and groups stay whole."""
    monkeypatch.setattr(shard, "SAMPLED", 1)
    monkeypatch.setattr(shard, "LEAST_RANGES", 6)
    monkeypatch.setattr(shard, "ROWS_A_RANGE", 60)
    monkeypatch.setattr(shard, "MOST_RANGES", 6)
    rows = [(i, f"text {i // 3}") for i in range(4000)]
    got = shard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values()) and len(by) == 8
    sizes = [sum(r["size"] for r in x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 200
    assert len({(r["text_crc32"], r["shard"]) for r in got}) == len({r["text_crc32"] for r in got})


# 4


def brute_top_k(rows, k=20):
    """By plain whole numbers, over rows of (vec_id, embedding) that take part."""
    ok = [(i, [math.floor(Fraction(64) * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    out = []
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        asked = [v for i, v in ok if i == q]
        best = sorted((-sum(a * b for a, b in zip(x, v)), d) for x in asked for d, v in ok if d != q)[:k]  # noqa: B905
        out += [(q, r + 1, d, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, d) in enumerate(best)]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (20, rows[20][1]), (20, rows[33][1]), (77, rows[20][1]), (77, rows[20][1]), (404, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    want = brute_top_k(rows)
    for limit in (512, 3):
        knn.QUERIES_A_PIVOT = limit
        got = knn.top_k(frame, F.col("vec_id") % 20 == 0)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    knn.QUERIES_A_PIVOT = 512
    assert knn.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.top_k(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 2048)]


def test_top_k_wide(spark):
    """Large components: no error, exact order, also beyond 64 bits."""
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 0, 0, 3, 9, 30, 300, 308]) for _ in range(3)]) for i in range(60)]
    rows += [(60, [1e9, 0.0, 0.0]), (61, [1.0, 1.0, 1.0]), (62, [1e30, -1e30, 0.0]), (80, [1.7e308, 1.7e308, -1.7e308]), (80, [1e30])]
    for some in (rows, rows[-5:-2], [r for r in rows if max(map(abs, r[1])) > 1e9]):
        got = knn.top_k(spark.createDataFrame(some, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
        assert sorted(map(tuple, got.collect())) == sorted(brute_top_k(some))


def test_top_k_sql(spark):
    """The registered SQL tells the same rows where ids come again."""
    import duckdb

    from tidewell.llm.queries import SQL

    rng = random.Random(2)
    rows = [(i % 45, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(4)]) for i in range(90)]
    embeddings = pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))})
    c = duckdb.connect()
    c.register("embeddings", embeddings)
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(SQL["op4_knn"]).fetchall())


# 5


def word_sets(texts, n):
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        yield {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def links(sets, percent):
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            yield i, j


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_documents(docs, rows, none, width, percent):
    known = [(i, t) for i, t in rows if i is not None]
    sets = list(word_sets([t for _, t in known], width))
    root = union(len(known), links(sets, percent))
    least = {}
    for (i, _), r in zip(known, root, strict=True):
        least[r] = min(i, least.get(r, i))
    want = [(i, len(s), least[r], i == least[r]) for (i, _), s, r in zip(known, sets, root, strict=True)]
    want += [(None, len(s), None, True) for s in word_sets([t for i, t in rows if i is None], width)]
    got = documents.near_documents(docs, width, percent)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert documents.near_documents(none).count() == 0


def test_large_families(spark, monkeypatch):
    """Blocks of a few members: links across blocks, and between what no leader is near, are found."""
    rng = random.Random(2)
    base = sentence(rng, 200).split(" ")
    rows = []
    for i in range(120):
        words = list(base)
        if i % 40 == 39:
            base = words
        for _ in range(rng.randint(0, 13)):
            words[rng.randrange(200)] = f"w{rng.random()}"
        rows.append((i, " ".join(words)))
    for name, value in (("FAMILY_BLOCK", 7), ("GROUP_BLOCK", 5), ("GROUP_MOST", 20), ("GROUP_BLOCKS", 3)):
        monkeypatch.setattr(near, name, value)
    got = {r["doc_id"]: r["component_id"] for r in documents.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert [got[i] for i in range(120)] == union(120, links(list(word_sets([t for _, t in rows], 3)), 85))


def test_chain(spark, monkeypatch):
    """Each text is near the next two alone, so that one leader links few of them."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 160])) for i in range(90)]
    rng.shuffle(rows)
    monkeypatch.setattr(near, "GROUP_BLOCK", 6)
    got = {r["doc_id"]: r["component_id"] for r in documents.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    want = union(90, links(list(word_sets([t for _, t in sorted(rows)], 3)), 85))
    assert [got[i] for i in range(90)] == want and len(set(want)) < 5


def test_blocks_meet(spark):
    """Every pair of a group with one of the rest meets in a block, and rows grow with both, not with the square of a group."""
    rows = spark.createDataFrame([(0, i, i < 40) for i in range(1000)], "key long, node long, rest boolean")
    got = near.blocked(rows, F.lit(10), F.lit(1)).collect()
    assert len(got) == 1000 + 40 * 10
    sides = collections.defaultdict(lambda: (set(), set()))
    for r in got:
        sides[r["i"], r["j"]][r["side"] - 1].add(r["node"])
    met = {(a, b) for one, two in sides.values() for a in one for b in two}
    assert met == {(a, b) for a in range(1000) for b in range(40)}


def test_among():
    rng = np.random.default_rng(9)
    for n, m, top in ((1, 5, 4), (1000, 5000, 3000), (20000, 50000, 1 << 63)):
        some = rng.integers(0, top, n, dtype=np.uint64)
        items = np.concatenate((rng.choice(some, m), rng.integers(0, top, m, dtype=np.uint64), some << np.uint64(40)))
        assert (near.among(items, some) == np.isin(items, some)).all()


def test_star_links():
    """Links of leaders, all blocks at once, are those of the pairs one by one."""
    rng = random.Random(17)
    sets, rows = {}, []
    for family in range(30):
        base = [rng.randrange(1 << 63) for _ in range(rng.randint(1, 40))]
        for i in range(rng.randint(1, 9)):
            own = sorted({x if rng.random() < 0.9 else rng.randrange(1 << 63) for x in base})
            sets[len(rows)] = set(own)
            rows.append((family, 0, 0, 2 if i else 1, len(rows), np.array(own, np.uint64).tobytes()))
    table = pa.table(dict(zip(("family", "i", "j", "side", "node", "items"), zip(*rows, strict=True), strict=True)))
    got = {(a, b) for out in near.star_links(iter(table.to_batches(max_chunksize=7)), 80, near.hashes) for a, b in zip(out.column("src").to_pylist(), out.column("dst").to_pylist(), strict=True)}
    lead = {f: n for f, _, _, side, n, _ in rows if side == 1}
    assert got == {(lead[f], n) for f, _, _, side, n, _ in rows if side == 2 and 100 * len(sets[n] & sets[lead[f]]) >= 80 * len(sets[n] | sets[lead[f]])} and got


def test_hot_family(spark, monkeypatch):
    """A family's rows grow with its members: all but the leader are compared with it alone."""
    seen = []
    monkeypatch.setattr(near.Search, "compared", lambda self, rows, *by, real=near.Search.compared: (seen.append(rows.count()), real(self, rows, *by))[1])
    monkeypatch.setattr(near, "GROUP_BLOCK", 50)
    monkeypatch.setattr(near, "LED_BLOCK", 50)
    rng = random.Random(31)
    base = [f"w{i}" for i in range(300)]
    for n in (200, 800):
        rows = []
        for i in range(n):
            w = list(base)
            w[rng.randrange(300)] = f"x{i}"
            rows.append((i, " ".join(w)))
        seen.clear()
        got = documents.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
        assert {r["component_id"] for r in got.collect()} == {0}
        assert sum(seen) < 8 * n


def test_components(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (50, 30), (300, 290), (64, 63)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n != 64 else [(i, i + 1) for i in range(63)]
        got = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
        root = union(n, pairs)
        assert got == {i: root[i] for i in {x for a, b in pairs if a != b for x in (a, b)}}


def test_key_counts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    keys = [[rng.choice([-5, 7, 1 << 62, rng.randrange(-(1 << 63), 1 << 63)]) for _ in range(4)] for _ in range(300)]
    monkeypatch.setattr(near, "HELD_KEYS", 100)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 40], pa.list_(pa.int64()))], ["bands"]) for i in range(0, 300, 40)]
    packed = pa.Table.from_batches(list(near.counted(iter(batches), 8))).sort_by("bucket").combine_chunks().to_batches(max_chunksize=5)
    got = {k: n for b in near.summed(iter(packed)) for k, n in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True)}
    assert got == {k: n for k, n in collections.Counter(x for row in keys for x in row).items() if n > 1}


def test_sketches():
    rng = np.random.default_rng(4)
    for s in (0.85, 0.5):
        common = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
        n = int(2000 * (1 - s) / (2 * s))
        a, b = (np.concatenate((common, rng.integers(0, 1 << 63, n, dtype=np.uint64))) for _ in "ab")
        x = near.min_hashes(np.concatenate((a, b)), np.array([0, len(a)]), 125)
        sketch = near.odd_sketch(x)
        apart = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
        assert (apart <= near.most_bits(0.85, 125)) == (s == 0.85)


# 6


def brute_passages(rows, length=50):
    first = {}
    known = sorted(((i, (t or "").encode()) for i, t in rows if i is not None), key=lambda r: r[0])
    for i, t in known:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    out = []
    for i, t in [(i, (t or "").encode()) for i, t in rows]:
        gone = np.zeros(len(t) + 1, bool)
        if i is not None:
            for p in range(len(t) - length + 1):
                if first[t[p : p + length]] < i:
                    gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_passages(docs, rows, none, monkeypatch):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(brute_passages(rows), key=key)
    got = passages.remove_repeats(docs).drop("kept")
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert passages.remove_repeats(none).count() == 0
    for name, value in (("PIECE", 3000), ("RANGE_BYTES", 20_000), ("HELD", 500), ("MANY", 2), ("MOST_SPLITTERS", 5), ("RANGES_A_TASK", 1)):
        monkeypatch.setattr(passages, name, value)
    assert sorted(map(tuple, passages.remove_repeats(docs).drop("kept").collect()), key=key) == want


def test_passages_of_one_id(spark):
    """Many texts of one id, and equal rows: each loses what smaller ids have, and nothing to its own id."""
    rng = random.Random(14)
    shared = sentence(rng, 40)
    rows = [(1, f"{sentence(rng, 9)} {shared}")] + [(2, f"{sentence(rng, rng.randint(5, 60))} {shared if i % 3 else ''} {sentence(rng, 20)}") for i in range(60)]
    rows += [rows[5]] * 7 + [(3, rows[4][1]), (None, rows[4][1])]
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_passages(rows), key=key)


def test_buckets():
    """Equal tokens are in one bucket, buckets keep the order of tokens, and hold about equally many."""
    rng = np.random.default_rng(5)
    token = np.sort(rng.integers(0, 1 << 64, 20000, dtype=np.uint64))
    cuts = token[2000::2000]
    at = passages.bucket_of(token, cuts, 4)
    assert (np.diff(at) >= 0).all() and at.min() == 0 and at.max() == 39 and np.bincount(at).max() < 700


def test_common_passage(spark, monkeypatch):
    """A short passage of all documents, whose stretches hold other bytes at their edges, gathers in no range and no group."""
    rng = random.Random(4)
    other = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    shared = "This footer stands in each and every document of the table, always."
    texts = {i: f"{other(120)}{shared}{other(120)}" for i in range(600)}
    batch = pa.RecordBatch.from_pydict({"doc_id": list(texts), "version": pa.array([0] * len(texts), pa.int64()), "text": list(texts.values())})
    tokens = np.concatenate([t for t, *_ in passages.chosen(passages.utf8(batch))])
    drawn = np.concatenate([b.column("token").to_numpy() for b in passages.sampled(iter([batch]))]).view(np.uint64)
    counted = collections.Counter((tokens & ~np.uint64(0xFFFF)).tolist())
    common = np.array([t for t, n in counted.items() if n > 300], np.uint64)
    assert len(common) and all(((drawn & ~np.uint64(0xFFFF)) == t).sum() > 30 for t in common)
    rest = np.sort(tokens[~np.isin(tokens & ~np.uint64(0xFFFF), common)])
    cuts = rest[np.arange(1, 8) * len(rest) // 8] & ~np.uint64(0xFFFF)
    most = max(len(x) // 33 for b in passages.dealt(iter([batch]), cuts, common) for x in b.column("packed").to_pylist())
    assert most < 1.5 * len(tokens) / 8

    for name, value in (("RANGE_BYTES", 20_000), ("MANY", 100), ("OFTEN", 20)):
        monkeypatch.setattr(passages, name, value)
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in passages.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[0] == texts[0] and all(shared not in got[i] and 230 <= len(got[i]) <= 240 for i in range(1, 600))
    places = [np.array([int(t)], np.uint64).view(np.int64)[0].tobytes() + np.int32(130).tobytes() + bytes([9]) for t in common[:1]]
    held = pa.RecordBatch.from_pydict({"doc_id": [1], "version": pa.array([0], pa.int64()), "text": [texts[1]], "places": places})
    hot = common.view(np.int64)
    assert [b.num_rows for b in passages.stretches(iter([held]), hot, False)] == [0] and [b.num_rows for b in passages.stretches(iter([held]), hot, True)] == [9]


# 7


def test_lines(docs, rows, none):
    blank = " \t\n\v\f\r"
    order = sorted((i, j, s) for i, t in rows if i is not None for j, line in enumerate((t or "").split("\n")) if (s := line.strip(blank)))
    texts = sorted({s for _, _, s in order})
    sets = [{s[i : i + lines.WIDTH] for i in range(max(1, len(s) - lines.WIDTH + 1))} for s in texts]
    root = dict(zip(texts, union(len(texts), links(sets, lines.PERCENT)), strict=True))
    keeper = {}
    for i, j, s in order:
        keeper.setdefault(root[s], (i, j))
    want = collections.Counter()
    for i, t in rows:
        every = [] if t is None else t.split("\n")
        full = [bool(x.strip(blank)) for x in every]
        gone = [f and i is not None and keeper[root[x.strip(blank)]] != (i, j) for j, (x, f) in enumerate(zip(every, full, strict=True))]
        want[i, None if t is None else "\n".join(x for x, g in zip(every, gone, strict=True) if not g), sum(full), sum(gone)] += 1
    # rows that share an id and a line number are compared apart
    plain = lambda c: {k: n for k, n in c.items() if k[0] != 79}
    assert plain(collections.Counter(tuple(r) for r in lines.dedup_lines(docs).collect())) == plain(want)
    assert lines.dedup_lines(none).count() == 0
    out = lines.rewritten(docs)
    assert out.columns == docs.columns and out.where("n_chars <> length(text)").count() == 0
    assert out.where("doc_id = 66").count() == 0 and out.where("doc_id = 73").count() == 1


# 8


def words_apart(item, text):
    """Least word edits between the item and a run of the text."""
    d = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(d[j + 1] + 1, d[j] + (w != x), new[j] + 1))
        d = new
    return min(d)


def test_decontamination(spark, docs, none):
    rng = random.Random(9)
    items = [(i, sentence(rng, n)) for i, n in enumerate((15, 22, 40, 59, 8, 3, 1))] + [(7, None), (8, ""), (None, sentence(rng, 20))]
    rows = [(0, None), (1, ""), (None, items[0][1])]
    for k, (_, text) in enumerate(items[:5] + items[9:]):
        w = text.split(" ")
        for e in range(0, len(w) // 3):
            x = list(w)
            for _ in range(e):
                op, at = rng.randrange(3), rng.randrange(len(x))
                x[at : at + (op > 0)] = [] if op == 1 else [f"new{rng.random()}"]
            rows.append((100 * (k + 1) + e, f"{sentence(rng, 40)} {' '.join(x).upper() if e % 2 else ' '.join(x)}\n{sentence(rng, 30)}"))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_ids", F.lit("clash"))
    low = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    want = {}
    for i, t in rows:
        held = [k for k, x in items if low(x) and words_apart(low(x), low(t)) <= int(decon.EDITS * len(low(x)))]
        want[i] = (sorted(k for k in held if k is not None), len(held))
    got = {r["doc_id"]: (r["item_ids"], r["n_items"]) for r in decon.find_items(frame, benchmark).collect()}
    assert got == want
    assert decon.find_items(frame, benchmark.limit(0)).where("contaminated").count() == 0
    assert decon.find_items(none, benchmark).count() == 0
    assert sorted(r["doc_id"] for r in decon.without_items(frame.where("doc_id is not null"), benchmark).collect()) == sorted(i for i, (_, n) in want.items() if i is not None and not n)


def test_decontamination_parts(spark, docs, none, monkeypatch):
    """A benchmark of several parts: every row is told, those that share an id or have none too."""
    rng = random.Random(19)
    items = [(i, sentence(rng, 12)) for i in range(9)] + [(3, sentence(rng, 14)), (None, sentence(rng, 13)), (None, None)]
    text = [f"{sentence(rng, 20)} {items[i][1]} {sentence(rng, 20)}" for i in (0, 4, 9, 10)]
    rows = [(1, text[0]), (1, text[0]), (1, text[1]), (2, sentence(rng, 30)), (None, text[2]), (None, text[3]), (None, None), (3, f"{text[0]} {text[1]} {text[2]}")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("clash"))
    order = lambda f: sorted((repr(r["doc_id"]), r["item_ids"], r["n_items"], r["contaminated"]) for r in f.collect())
    whole, kept = order(decon.find_items(frame, benchmark)), sorted(map(repr, decon.without_items(frame, benchmark).collect()))
    assert whole == sorted([("1", [0], 1, True)] * 2 + [("1", [4], 1, True), ("2", [], 0, False), ("None", [3], 1, True), ("None", [], 1, True), ("None", [], 0, False), ("3", [0, 3, 4], 3, True)])
    monkeypatch.setattr(decon, "ITEM_WORDS", 40)
    assert order(decon.find_items(frame, benchmark)) == whole
    assert sorted(map(repr, decon.without_items(frame, benchmark).collect())) == kept and len(kept) == 2
    assert decon.find_items(none, benchmark).count() == 0


def test_recall_at_the_limit():
    """Passages with as many edits as an item may have: thousands, all found."""
    rng = random.Random(23)
    pool = [f"w{i}" for i in range(3000)]
    source = [rng.choices(pool, k=rng.randint(10, 80)) for _ in range(200)]
    items = decon.Items([(i, " ".join(w)) for i, w in enumerate(source)])
    texts = []
    for w in source:
        for _ in range(15):
            x = list(w)
            edits = int(decon.EDITS * len(w))
            for at in sorted(rng.sample(range(len(w)), edits), reverse=True):
                op = rng.randrange(3)
                x[at : at + (op > 0)] = [] if op == 1 else [f"new{rng.random()}"]
            texts.append((w, " ".join([*rng.choices(pool, k=20), *x, *rng.choices(pool, k=20)])))
    missed = 0
    for s in range(0, len(texts), 300):
        some = texts[s : s + 300]
        found = collections.defaultdict(set)
        for d, size, row in decon.matches([t.encode() for _, t in some], items):
            found[d].add(items.ids[size][row])
        missed += sum(source.index(w) not in found[d] for d, (w, _) in enumerate(some))
    assert missed == 0


def test_walks_keep_edits_near():
    """Embeddings of near sequences differ less than those of others."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    b = np.delete(a, 20)[None]
    b = np.concatenate((b, [[np.uint64(1)]]), 1)
    c = rng.integers(0, 1 << 63, (1, 40), dtype=np.uint64)
    apart = lambda x: np.mean([(decon.walk(a[None], s) != decon.walk(x, s)).mean() for s in range(20)])
    assert apart(b) < 0.5 < apart(c)


# 9


def test_extract(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=x>Menu item</a></nav><!-- ad <p>no</p> --><div class="ad">Buy, now!</div><div id="cookie-notice">We use cookies.</div><article><h1>The  title</h1><p>One &amp; two,<b> three</b>.<br>Four\n five.<p>Six.<ul><li>a<li>b</ul><form><input><button>Send</button></form><aside>Aside, text.</aside></article><div class="comments"><p>I say, no. Really, no.</p></div><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (1, "u", page), (4, "u", "<p>only & text"), (5, "u", page[: page.index("Six.") + 3]), (6, "u", "<div>" * 20000 + "deep, text." + "</div>" * 20000), (7, "u", "<script>x"), (8, "u", "<p title=\"a>b\">c</p>"), (9, "u", "x" * 100000), (10, "u", "&am")]
    got = extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    want = "The title\nOne & two, three. Four five.\nSix.\na\nb"
    text = collections.defaultdict(list)
    for r in got:
        text[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert text[1] == [want, want] and text[None] == [want] and text[2] == text[3] == text[7] == [""]
    assert text[4] == ["only & text"] and text[5] == ["The title\nOne & two, three. Four five.\nSix"] and text[6] == ["deep, text."] and text[8] == ["c"] and text[10] == ["&am"] and len(text[9][0]) == 100000


PROSE = "Prose that goes on, and on, with words; and more. " * 6
LINKS = "<ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(15)) + "</ul>"
#: Pages of several layouts, and their article's blocks.
LABELLED = [
    (f"<body><div>{LINKS}</div><div><div><h2>Head</h2><p>{PROSE}<p>{PROSE}</div></div><div><a>x</a></div></body>", ["Head", PROSE, PROSE]),
    ('<body><div class="page with-sidebar"><article><p>Kept, here.</p></article></div></body>', ["Kept, here."]),
    (f"<article><h1>T</h1><p>{PROSE}</p>{LINKS}<p>{PROSE}</p></article>", ["T", PROSE, PROSE]),
    (f"<article><p>{PROSE}</p><section class='related-work'><h2 id='search-trees'>Search</h2><p>{PROSE}</p></section></article>", [PROSE, "Search", PROSE]),
    (f"<article><p>{PROSE}</p><div class='notice'><p>{PROSE}</p></div><p class=notice>Short.</p></article><div class=notice>{PROSE}</div>", [PROSE, PROSE, "Short."]),
    (f"<article><p>{PROSE}</p><div class='share-buttons'>Share this</div><div id=comments><p>{PROSE}</p></div><div class='ad'>{PROSE}</div></article>", [PROSE]),
    (f"<article><h3 id='social-impact'>Impact</h3><p>{PROSE}</p><table><tr><td>1<td>2</table><ul><li>one<li>two</ul></article>", ["Impact", PROSE, "1", "2", "one", "two"]),
    (f"<main><article><p>{PROSE}</article><article><p>{PROSE} End.</article></main>", [PROSE, PROSE + "End."]),
    (f"<article><p>{PROSE}</article><article><p>{PROSE} End.</article><article class=comment><p>{PROSE}</article>", [PROSE, PROSE + "End."]),
    (f"<main><div>{LINKS}</div><article><p>{PROSE}</article></main>", [PROSE]),
    (f"<body><h1>Title</h1><div><p>{PROSE}</div><div>more</div></body>", ["Title", PROSE]),
    (f"<body><div><p>{PROSE}</div><div><p>{PROSE}</div></body>", [PROSE, PROSE]),
    (f"<body class=sidebar><div class='menu'><p>{PROSE}</p></div></body>", [PROSE]),
    ("<div>" * 600 + f"<script>var x='leak';</script><nav>menu</nav><p>{PROSE}</p>" + "</div>" * 600, [PROSE]),
    (f"<div><a title='x>y' href=\"z\" \">Link</a> and <b>text,</b> here.</div><p>{PROSE}", ["Link and text, here.", PROSE]),
]


@pytest.mark.parametrize("at", range(len(LABELLED)))
def test_extract_labelled(at):
    page, want = LABELLED[at]
    assert extract.main_text(page) == "\n".join(x.strip() for x in want)


def test_ratios():
    """Against paths that are written out."""
    rng = random.Random(8)
    for _ in range(40):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "<b>", "</b>", "<ul><li>", "</ul>", "<a href=x>", "</a>", "Some text, and more. ", "word "]) for _ in range(60))
        _, nodes = extract.parsed(page)
        if not nodes:
            continue

        def path(e):
            return (path(e.parent) if e.parent else ()) + (e.tag,)

        mean = lambda f, e: np.mean([f(s) for o, _, s in nodes if path(o) == path(e)])  # noqa: E731, B023
        signs = lambda s: sum(c in ".,;:!?" for c in s)
        smooth, plain = extract.ratios(nodes)
        assert np.allclose(plain, [mean(len, e) * (1 + mean(signs, e)) for e, _, _ in nodes])
        weight = lambda x, i: sum(math.exp(-((i - j) ** 2) / 2) * x[j] for j in range(len(x)) if abs(i - j) < 3) / sum(math.exp(-((i - j) ** 2) / 2) for j in range(len(x)) if abs(i - j) < 3)
        length, sign = [mean(len, e) for e, _, _ in nodes], [mean(signs, e) for e, _, _ in nodes]
        assert np.allclose(smooth, [weight(length, i) * (1 + weight(sign, i)) for i in range(len(nodes))])


def test_deep_pages():
    began = time.time()
    assert len(extract.main_text("<div>x, y." * 20000)) == 119999
    assert extract.main_text("<li><b>" * 20000 + "deep, text.") == "deep, text."
    assert extract.main_text("<p></section></b>" * 20000 + "<a \"" * 2000 + ">x, y.") == "x, y."
    assert time.time() - began < 20


def test_extract_pages_table(spark, folder):
    """The given pages hold one article each; all of it, and nothing else, is told."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract.extract_pages(pages).collect():
        inside = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1]
        words = lambda x: re.sub(r"\s+", "", unescape(re.sub(r"<[^>]*>", "", x)))
        assert words(r["text"]) == words(inside)
    assert extract.extract_pages(pages.limit(0)).count() == 0


# 10


def brute_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, none):
    rng = random.Random(7)
    b64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    hexa = "".join(rng.choices("0123456789abcdef", k=32))
    texts = [
        None, "", f"see {b64} there", f"x {hexa} y", "api_key: 'abc123def' Password=\"short\" passwd=longer.value", "toKEN = aaaaaaaa token:bbbbbbb secret=token=abcdef", "AKIA" + "B" * 16 + " AKIAB AKIAAKIA" + "C" * 10,
        "ſecret=abcdefgh toKen=abcdefgh", "é😀 password: hunter22 end", "a" * 30000, "thiscouldbeaverylongwordwithoutanyspaces " * 5, "deadbeef" * 3 + "g" + "0" * 24, "https://example.org/some/long/path/to/page-2024.html", "password=" + "x" * 20000,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[4]), (4, texts[4])]
    got = secrets.scan_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("clash")))
    found = {r["doc_id"]: [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["spans"]] for r in got.collect()}
    for i, t in rows:
        assert [s for s in found[i] if s[1] < 3] == brute_secrets(t or "")
    assert [s for s in found[2] if s[1] == 3] == [(4, 3, 44)]
    assert all(s[1] < 3 for i in (9, 10, 12) for s in found[i])
    d = {r["doc_id"]: r for r in secrets.digests(got).collect()}
    assert (d[4]["n_assign"], d[3]["n_hex"], d[6]["n_access"], d[0]["n_assign"]) == (2, 1, 1, 0)
    assert d[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and d[3]["spans"] == "hex:2:34"
    assert secrets.digests(secrets.scan_documents(none)).count() == 0
    assert secrets.redact("a secret b", [(2, 8)]) == "a [secret] b"


def test_battery():
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    kept = sum(min(secrets.battery("".join(rng.choices(letters, k=64)))) >= secrets.RULED_OUT for _ in range(300))
    assert kept >= 290
    assert min(secrets.battery("0123456789" * 5)) < secrets.RULED_OUT and min(secrets.battery("a1" * 30)) < secrets.RULED_OUT
    assert secrets.discoveries([(0, 60, 5), (0, 20, 1)], 100) == {0: 60}


def plain_chance(run):
    """log10 of the one chance of a run, from the three tests by plain loops; None if no alphabet has all letters, 0 if a test rules it out."""
    letters = run.rstrip("=")
    fits = [a for _, a in secrets.ALPHABETS if set(letters) <= set(a)]
    if not fits:
        return None
    order, n = fits[0], len(letters)
    k, x = len(order), [order.index(c) for c in letters]
    expected = n / k
    chi = sum((x.count(i) - expected) ** 2 / expected for i in range(k))
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    above = [i >= k / 2 for i in x]
    a, b = above.count(True), above.count(False)
    if not a or not b:
        return 0.0
    expected = 1 + 2 * a * b / n
    spread = math.sqrt((expected - 1) * (expected - 2) / (n - 1)) or math.sqrt(1e-9)
    turns = len(list(itertools.groupby(above)))
    mean = sum(x) / n
    serial = sum((x[i] - mean) * (x[i + 1] - mean) for i in range(n - 1)) / sum((i - mean) ** 2 for i in x)
    chances = [math.erfc(z / math.sqrt(2)) / 2, math.erfc(max(0.0, abs(turns - expected) - 0.5) / spread / math.sqrt(2)), math.erfc(abs(serial + 1 / n) * math.sqrt(n) / math.sqrt(2))]
    if min(chances) < secrets.RULED_OUT:
        return 0.0
    odds = secrets.ordinary(letters) + n * math.log10(min(len(a) for a in fits)) + math.log10(len(secrets.ALPHABETS))
    return odds - math.log10(min(1, 3 * min(chances)))


def plain_random(texts):
    """Spans of kind random in each text: every run tested, then Benjamini and Hochberg's rule by its definition, a class of lengths at a time."""
    letters = set(string.ascii_letters + string.digits + "+/_-")
    tested = []
    for t, text in enumerate(texts):
        at, base = 0, brute_secrets(text)
        while at < len(text):
            end = at
            while end < len(text) and text[end] in letters:
                end += 1
            if end - at >= 20:
                end += len(re.match("={0,2}", text[end:])[0])
                if not any(s < end and at < e for s, _, e in base) and (p := plain_chance(text[at:end])) is not None:
                    tested.append((sum(end - at >= c for c in (32, 64, 128)), -max(0, min(400, int(-10 * p))) / 10, t, at, end))
            at = max(end, at + 1)
    found = [[] for _ in texts]
    for length in range(4):
        own = sorted(x for x in tested if x[0] == length)
        passed = [i for i, x in enumerate(own, 1) if 10 ** x[1] <= secrets.RATE * sum(y[1] <= x[1] for y in own) / len(own)]
        for _, _, t, s, e in own[: max(passed, default=0)]:
            found[t].append((s, e))
    return [sorted(f) for f in found]


def test_random_spans(spark, folder):
    """Spans of kind random on the given documents and on planted runs, against the plain version."""
    rng = random.Random(13)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    for _ in range(300):
        alphabet = rng.choice([a for _, a in secrets.ALPHABETS] + [string.ascii_lowercase[:5], "ab", "xyz-_0"])
        run = "".join(rng.choices(alphabet, k=rng.choice([15, 20, 24, 31, 32, 40, 64, 100, 128, 200]))) + "=" * rng.randrange(4)
        texts.append(f"see {run} and {'/'.join(rng.choices(['path', 'to', 'some', 'file', 'Name42'], k=8))} there")
    got = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random") for r in secrets.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = plain_random(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(map(len, want)) > 100


def test_random_alphabets(spark):
    """Random runs of every alphabet are found, and long ordinary runs, which count as tested, are not."""
    rng = random.Random(3)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    alphabets = [lower.upper() + "234567", digits + lower, digits + "ABCDEF", lower, lower.upper(), digits + lower.upper(), lower + lower.upper()]
    planted = [(n, "".join(rng.choices(x, k=n))) for x in alphabets for n in (20, 32, 64, 150) for _ in range(20)]
    plain = ["gesellschaftsentwicklungen", "AbstractSingletonProxyFactoryBean", "images/2023/11/foo/bar/index", "550e8400-e29b-41d4-a716-446655440000", "THIS_IS_A_CONSTANT_NAME", "20240110123045678901", "gh" * 40]
    rows = [(i, f"see {x} there") for i, (_, x) in enumerate(planted)] + [(1000 + i, f"see {x} there") for i, x in enumerate(plain * 10)]
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(found[i] for i in found if i >= 1000)
    for n, least in ((20, 0.9), (32, 0.97), (64, 0.97), (150, 0.97)):
        got = [found[i] == [("random", 4, 4 + n)] for i, (k, _) in enumerate(planted) if k == n]
        assert sum(got) >= least * len(got), n
    decimal = "".join(rng.choices(digits, k=300))
    assert secrets.depth(decimal) > 100 and secrets.depth(decimal[:20]) < 30
