"""Segments, manifests, deletions, merging; and postings in blocks."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import blocks as K
from tidewell.operators import retrieve as S
from tidewell.plans.search import Index, Request
from tidewell.sources import store as store_module
from tidewell.sources.store import Manifest, Part, Store

RECORD = "key long, doc_id string, title string, body string, file_path string, header_path string, project string, source_kind string"
WORDS = "moon tide harbour boat compost worm leaf soil water rope anchor mast seed root bed fish net wave wind rain".split()


def rows(rng, keys, doc=None):
    return [(k, doc or f"d{k // 2}", f"T{k}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 14))), f"f{k // 2}.md", "", f"p{k % 3}", "note") for k in keys]


def answers(index, texts, **k):
    queries = index.records.sparkSession.createDataFrame(list(enumerate(texts)), "qid long, query string")
    got = index.search(queries, Request(top_n=10, max_chunks_per_doc=0, **k))
    return sorted((r["qid"], r["rank"], r["key"], round(r["score"], 9)) for r in got.select("qid", "rank", "key", "score").collect())


def frequencies(index):
    frame = index.frequencies if index.frequencies is not None else S.frequencies(index.counts)
    return {r["term"]: r["df"] for r in frame.collect()}


ASKED = ["moon tide", "compost worm soil", "rope", "nothing known"]


def same(index, spark, held, search=True):
    """As an index that is built anew over the rows that hold; what it finds too, if asked for."""
    fresh = Index(spark.createDataFrame(list(held.values()), RECORD)) if held else None
    if fresh is None:
        assert index.records.count() == 0 and answers(index, ASKED) == []
        return
    assert sorted(r["key"] for r in index.records.select("key").collect()) == sorted(held)
    assert frequencies(index) == frequencies(fresh)
    n, mean = fresh.stats
    assert index.stats[0] == n and index.stats[1] == pytest.approx(mean, abs=1e-12)
    if search:
        assert answers(index, ASKED) == answers(fresh, ASKED)


def test_changes(spark, tmp_path, monkeypatch):
    """After each commit, a search is as over an index built anew; readers keep what they opened."""
    monkeypatch.setattr(store_module, "MERGED", 3)
    monkeypatch.setattr(store_module, "GROWTH", 64)
    rng = random.Random(11)
    at = str(tmp_path / "index")
    index = Index.create(spark, at)
    held: dict[int, tuple] = {}
    same(index, spark, held)

    def put(new, removed=()):
        nonlocal index
        gone = {r[1] for r in new} | set(removed)
        for k in [k for k, r in held.items() if r[1] in gone]:
            del held[k]
        held.update({r[0]: r for r in new})
        index = index.change(spark.createDataFrame(new, RECORD) if new else None, spark.createDataFrame([(d,) for d in removed], "doc_id string") if removed else None)

    put(rows(rng, range(12)))
    same(index, spark, held, False)
    before, told = index, answers(index, ASKED)
    put(rows(rng, [2, 3, 100], "d1") + rows(rng, [200, 201], "d100"))
    same(index, spark, held)
    assert not before.fresh() and index.fresh() and answers(before, ASKED) == told and answers(before.refreshed(), ASKED) == answers(index, ASKED)
    put([], ["d0", "d100", "unknown"])
    same(index, spark, held, False)
    put(rows(rng, [0, 1]))
    put(rows(rng, [300]), ["d5"])
    same(index, spark, held)
    many = len(index.manifest.segments)
    index = index.merged()
    assert len(index.manifest.segments) < many
    same(index, spark, held)
    put([], sorted({r[1] for r in held.values()})[:2])
    index = index.merged()
    same(index, spark, held)
    assert answers(before, ASKED) == told
    gone = index.store.clean(keep=1)
    assert gone and index.store.numbers() == [index.manifest.number]
    same(Index.open(spark, at), spark, held, False)
    put([], sorted({r[1] for r in held.values()}))
    same(index, spark, {})


def test_two_writers(spark, tmp_path):
    """A manual change between two batches of a stream undoes neither, and is undone by neither; a batch counts once."""
    at = str(tmp_path / "index")
    rng = random.Random(2)
    one = Index.create(spark, at)
    two = Index.open(spark, at)
    frame = lambda key, doc, body: spark.createDataFrame([(key, doc, "t", body, "f", "", "p", "note")], RECORD)
    one.change(frame(1, "a", "old words"), stream=("s", 0))
    # Opened before that; its commit looks again.
    two.change(frame(2, "a", "manual words"))
    now = one.change(frame(3, "a", "stream words"), stream=("s", 1))
    assert [r["body"] for r in now.records.collect()] == ["stream words"]
    again = two.change(frame(4, "a", "twice"), stream=("s", 1))
    assert [r["body"] for r in again.records.collect()] == ["stream words"] and again.manifest.number == now.manifest.number
    assert frequencies(again) == {"stream": 1, "words": 1}
    later = two.change(spark.createDataFrame(rows(rng, [8, 9]), RECORD))
    assert {r["key"] for r in later.records.collect()} == {3, 8, 9}


def test_commit_order(spark, tmp_path, monkeypatch):
    """A number that is taken is never taken again; the writer that loses commits after the other."""
    store = Store(spark, str(tmp_path / "s"))
    assert store.manifest() is None and store.commit(lambda m: None) == Manifest()
    seen = []

    def change(m):
        seen.append(m.number)
        if len(seen) == 1:
            Store(spark, str(tmp_path / "s")).commit(lambda n: Manifest(0, (*n.segments, Part("segments/other", n.number + 1))))
        return Manifest(0, (*m.segments, Part("segments/own", m.number + 1)))

    done = store.commit(change)
    assert seen == [0, 1] and done.number == 2 and [p.path for p in done.segments] == ["segments/other", "segments/own"]
    assert store.numbers() == [1, 2] and store.manifest(1).number == 1
    monkeypatch.setattr(store, "_put", lambda m: False)
    with pytest.raises(RuntimeError):
        store.commit(lambda m: m)


def test_write_over_itself(spark, tmp_path):
    """What is opened from a folder may be written to it; readers of the old generation go on."""
    at = str(tmp_path / "index")
    rng = random.Random(6)
    first = Index(spark.createDataFrame(rows(rng, range(6)), RECORD), spark.createDataFrame([(0, 2), (2, 4)], "src long, dst long")).write(at)
    told = answers(first, ASKED)
    again = Index.open(spark, at).write(at)
    assert answers(again, ASKED) == told == answers(first, ASKED) and len(again.manifest.segments) == 1
    less = Index(first.records.where("key < 3")).write(at)
    assert less.records.count() == 3 and answers(first, ASKED) == told


def test_edges_of_changes(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "i"))
    rng = random.Random(1)
    pairs = lambda x: spark.createDataFrame(x, "src long, dst long")
    index = index.change(spark.createDataFrame(rows(rng, [0, 2, 4]), RECORD), edges=pairs([(0, 2), (2, 4), (4, 0)]))
    index = index.change(spark.createDataFrame(rows(rng, [2]), RECORD), edges=pairs([(2, 0)]))
    told = lambda: sorted((r["src"], r["dst"]) for r in index.edges.collect())
    assert told() == [(0, 2), (2, 0), (4, 0)]
    index = index.change(removed=spark.createDataFrame([("d0",)], "doc_id string"))
    assert told() == []


def test_together(spark, tmp_path):
    """Two indexes, a written one that was changed and one that was not written, as one over all their records."""
    rng = random.Random(12)
    a, b = rows(rng, range(8)), rows(rng, range(4, 12))
    one = Index(spark.createDataFrame(a, RECORD), spark.createDataFrame([(0, 2)], "src long, dst long")).write(str(tmp_path / "a"))
    one = one.change(removed=spark.createDataFrame([("d1",)], "doc_id string"))
    two = Index(spark.createDataFrame(b, RECORD))
    both = Index.together({"a": one, "b": two})
    named = lambda name, held: [(k + (0 if name == "a" else 1000), f"{name}:{d}", *rest) for k, d, *rest in held]
    whole = Index(spark.createDataFrame(named("a", [r for r in a if r[1] != "d1"]) + named("b", b), RECORD), spark.createDataFrame([(0, 2)], "src long, dst long"))

    def told(index, **k):
        queries = spark.createDataFrame(list(enumerate(ASKED)), "qid long, query string")
        found = index.search(queries, Request(top_n=100, top_k=100, max_chunks_per_doc=0, **k)).join(index.records.select("key", F.col("body").alias("b")), "key")
        return sorted((r["qid"], r["doc_id"], r["b"], round(r["score"], 4)) for r in found.collect())

    # Equal scores may lie in another order, as keys are others: lists are long enough for all.
    assert [x[:3] for x in told(both)] == [x[:3] for x in told(whole)] and both.stats[0] == whole.stats[0]
    assert {x[:2] for x in told(both, projects=("p1",))} == {x[:2] for x in told(whole, projects=("p1",))}
    assert frequencies(both) == frequencies(whole) and {r["index"] for r in both.records.collect()} == {"a", "b"}
    other = Index(spark.createDataFrame(b, RECORD))
    other.provider = type("P", (), {"name": "other", "dimension": 3})()
    with pytest.raises(ValueError):
        Index.together({"a": one, "o": other})


def test_vectors_after_words(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "i"))
    frame = spark.createDataFrame(rows(random.Random(3), range(8)), RECORD)
    index = index.change(frame, vectors=False)
    assert index.embeddings.count() == 0 and [r["key"] for r in index.query_documents("moon").collect()]
    done = index.embed_missing()
    assert answers(done, ASKED) == answers(Index(frame), ASKED) and done.embed_missing().manifest.number == done.manifest.number


def test_folders(spark, tmp_path):
    """Conditions on kind and project are partition filters on all three tables, and change no answer."""
    records = spark.createDataFrame([(k, f"d{k}", "t", f"moon {k % 7}", "f", "", p, kind) for k, (p, kind) in enumerate((p, kind) for p in ("", None, "2024", "a/b", "sea") for kind in ("note", "git_commit", None) for _ in range(4))], RECORD)
    index = Index(records).write(str(tmp_path / "i"))
    assert {(r["project"], r["source_kind"]) for r in index.records.collect()} == {(r["project"], r["source_kind"]) for r in records.collect()}
    request = Request(top_n=20, projects=("2024", "sea"), source_kinds=("note",), max_chunks_per_doc=0)
    queries = spark.createDataFrame([(0, "moon 3")], "qid long, query string")
    plain = Index(records).search(queries, request)
    assert sorted(r["key"] for r in index.search(queries, request).collect()) == sorted(r["key"] for r in plain.collect())
    for frame in (index.records, index.counts, index.embeddings):
        plan = index._folders(frame, request)._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters") :].split("]")[0]
        assert "_kind" in filters and "_project" in filters


# Blocks


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    names = [f"w{i}" for i in range(60)]
    data = [(k, " ".join(rng.choices(names, [1 / (i + 1) for i in range(60)], k=rng.randrange(1, 60)))) for k in range(900)]
    return S.term_counts(spark.createDataFrame(data, "key long, body string"), "key", {"content": "body"}).persist()


def test_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 4)
    blocks = K.blocked(corpus, "key", 20.0).persist()
    held = {(r["term"], k): (t, n) for r in blocks.collect() for k, t, n in zip(r["keys"], r["tfs"], r["lengths"], strict=True)}
    assert held == {(t, r["key"]): (f, r["length"]) for r in corpus.collect() for t, f in zip(r["terms"], r["tfs"], strict=True)}
    for r in blocks.collect():
        assert r["n"] == len(r["keys"]) <= 4 and r["high_tf"] == max(r["tfs"]) and r["low_length"] == min(r["lengths"])
    n, mean = corpus.agg(F.count("*"), F.avg("length")).first()
    df = {r["term"]: r["df"] for r in S.frequencies(corpus).collect()}
    for direct in (1 << 30, 0):
        monkeypatch.setattr(K, "DIRECT", direct)
        for looked in (5000, 3):
            monkeypatch.setattr(K, "LOOKED_UP", looked)
            for terms in (["w0", "w40"], ["w1", "w2", "w3"], ["w55"], ["w59", "w0", "w1", "none"], ["none"]):
                queries = spark.createDataFrame([(1, t) for t in terms], "qid long, term string")
                want = [(r["key"], r["score"], r["rank"]) for r in S.bm25_top(corpus, "key", queries, "qid", 7).orderBy("rank").collect()]
                got = [(r["key"], r["score"], i) for i, r in enumerate(K.block_top(blocks, corpus, "key", terms, df, (n, mean), 7).collect(), 1)]
                assert [g[::2] for g in got] == [w[::2] for w in want] and all(math.isclose(g[1], w[1], abs_tol=2e-9) for g, w in zip(got, want, strict=True))
        # Rows that are gone, another mean length.
        alive = lambda f: f.where("key % 2 = 0")
        got = {r["key"] for r in K.block_top(blocks, corpus.where("key % 2 = 0"), "key", ["w0", "w30"], df, (n, 5.0), 7, alive).collect()}
        ranked = S.local_top(corpus.where("key % 2 = 0"), "key", spark.createDataFrame([(1, t, math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for t in ("w0", "w30")], "qid long, term string, weight double"), "qid", 7, 5.0)
        assert got == {r["key"] for r in ranked.collect()}


def test_blocks_of_many_queries_at_once(spark, corpus, monkeypatch):
    """The lists of single queries, with as many jobs for many queries as for few."""
    monkeypatch.setattr(K, "BLOCK", 4)
    blocks = K.blocked(corpus, "key", 20.0).persist()
    stats = corpus.agg(F.count("*"), F.avg("length")).first()
    rng = random.Random(2)
    asked = {i: rng.sample([f"w{j}" for j in range(60)], rng.randrange(1, 6)) for i in range(12)} | {90: ["none"], 91: ["w59", "none"]}
    tables = []
    monkeypatch.setattr(K, "staged", lambda f, label, real=K.staged: (tables.append(label), real(f, label))[1])
    for some in (list(asked)[:1], list(asked)):
        tables.clear()
        queries = spark.createDataFrame([(i, t) for i in some for t in asked[i]], "qid long, term string")
        got = {(r["qid"], r["rank"]): (r["key"], r["score"]) for r in K.block_tops(blocks, corpus, "key", queries, "qid", S.frequencies(corpus), stats, 7).collect()}
        want = {(r["qid"], r["rank"]): (r["key"], r["score"]) for r in S.bm25_top(corpus, "key", queries, "qid", 7).collect()}
        assert {p: x[0] for p, x in got.items()} == {p: x[0] for p, x in want.items()} and all(math.isclose(got[p][1], want[p][1], abs_tol=2e-9) for p in want)
        assert len(tables) == 4


def test_blocks_are_read_by_term(spark, corpus, tmp_path):
    """What a query reads of written blocks does not grow with the terms that it does not have."""
    from tidewell.sources.store import Store

    store = Store(spark, str(tmp_path / "s"))
    more = spark.range(60000).select((F.col("id") + 1000).alias("key"), F.lit(3.0).alias("length"), F.array(F.concat(F.lit("x"), F.col("id").cast("string")), F.concat(F.lit("y"), F.col("id").cast("string"))).alias("terms"), F.array(F.lit(1.0), F.lit(1.0)).alias("tfs"))
    read = []
    for name, counts in (("small", corpus), ("large", corpus.unionByName(more))):
        store.write(K.blocked(counts, "key", 20.0), name, "postings", **{"parquet.block.size": 1 << 14, "parquet.page.size": 1 << 12})
        frame = spark.read.parquet(f"{tmp_path}/s/{name}/postings").where(F.col("term").isin("w3", "w5")).select("keys")
        frame.collect()
        plan, scanned = frame._jdf.queryExecution().executedPlan(), 0
        stack = [plan]
        while stack:
            p = stack.pop()
            if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                p = p.executedPlan()
            if "FileSourceScan" in p.getClass().getSimpleName():
                scanned = p.metrics().apply("numOutputRows").value()
            stack += [p.children().apply(i) for i in range(p.children().size())]
        read.append(scanned)
    assert read[1] < 20 * read[0] + 2000 and spark.read.parquet(f"{tmp_path}/s/large/postings").count() > 100000
