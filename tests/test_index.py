"""The index as tables, requests, answers, providers and the newer operators against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import chunk as C
from tidewell.operators import embed as E
from tidewell.operators import projects as P
from tidewell.operators import rank as R
from tidewell.operators import records as N
from tidewell.operators import retrieve as S
from tidewell.operators import state as U
from tidewell.plans.search import Index, Request
from tidewell.scratch import scratch

SCHEMA = "key long, doc_id string, title string, body string, file_path string, header_path string, project string, source_kind string, category string, author string, modified_at long, tags array<string>"
NOTES = [
    (0, "gardening", "Garden beds", "Raised beds keep roots warm. Compost feeds the soil.", "home/gardening.md", "Garden beds", "home", "note", "how", "ann", 10, ["garden"]),
    (1, "compost", "Compost", "Compost needs air, water and brown leaves.", "home/compost.md", "Compost", "home", "note", "how", "bob", 20, ["garden", "soil"]),
    (2, "tides", "Tides", "The moon pulls the sea; spring tides follow the full moon.", "sea/tides.md", "Tides", "sea", "note", "why", "ann", 30, ["sea"]),
    (3, "harbour", "Harbour", "Boats wait in the harbour for high water.", "sea/harbour.md", "Harbour", "sea", "note", "how", "bob", 40, ["sea"]),
    (4, "worms", "Worms", "They turn waste over.", "home/worms.md", "Worms", "home", "note", "why", "cy", 50, ["soil"]),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(NOTES, SCHEMA)


@pytest.fixture(scope="module")
def index(spark, records, tmp_path_factory):
    return Index(records, spark.createDataFrame([(1, 0), (3, 2)], "src long, dst long")).write(str(tmp_path_factory.mktemp("index")))


def keys(rows):
    return [r["key"] for r in rows.collect()]


def test_written_index(spark, index, records, tmp_path):
    at = str(tmp_path / "index")
    again = index.write(at)
    assert keys(again.query_documents("compost leaves")) == keys(index.query_documents("compost leaves"))
    (tmp_path / "index" / "counts").rename(tmp_path / "index" / "lost")
    for part in (tmp_path / "index" / "embeddings").glob("*.parquet"):
        part.write_bytes(b"no parquet")
    healed = Index.open(spark, at)
    assert keys(healed.query_documents("full moon"))[0] == 2
    with pytest.raises(FileNotFoundError):
        Index.open(spark, str(tmp_path / "none"))
    assert keys(Index.open(spark, str(tmp_path / "none"), records).query_documents("full moon"))[0] == 2


def test_filters(index):
    of = lambda **k: set(keys(index.query_documents("compost water moon", Request(top_n=5, **k))))
    assert of(categories=("why",)) <= {2, 4} and of(authors=("ann",)) <= {0, 2} and of(modified_after=20) <= {2, 3, 4}
    assert 4 in of(expand_tags=True)


def test_typos(index):
    rows = index.query_documents("harbuor copmost boots", Request(correct=True)).collect()
    assert rows
    assert 3 in keys(index.query_documents("harbou", Request(correct=True)))
    assert all("keyword" not in r["strategies"] for r in index.query_documents("harbou").collect())


def test_answers(index):
    got = index.answer({"query": " compost leaves ", "top_n": 2})
    assert got["status"] == "ok" and not got["degraded"] and got["results"][0]["chunk_id"] == 1 and len(got["results"]) == 2
    for bad in ({"query": " "}, {"query": 3}, {"query": "a", "top_n": "5"}, {"query": "a", "odd": 1}, {"query": "a", "min_score": True}, {"query": "a", "scope_mode": "explicit_projects"}, {"query": "a", "scope_projects": ["x"]}, {"query": "a", "preferred_project": "x"}, {"query": "a", "uniqueness_mode": "no"}):
        assert index.answer(bad)["error"] == "validation_error", bad
    assert {r["project_id"] for r in index.answer({"query": "water", "scope_mode": "explicit_projects", "scope_projects": ["sea"]})["results"]} == {"sea"}
    with pytest.raises(PermissionError):
        Request().authorised(["other"], None)
    assert Request().authorised(["search:read"], ["sea"]).projects == ("sea",)
    with pytest.raises(PermissionError):
        Request(projects=("home",)).authorised(["search:read"], ["sea"])


def test_degraded(spark, records):
    class Broken:
        name, dimension = "broken", 2

        def embed(self, rows, key, text):
            if key == "qid":
                raise RuntimeError("model is away")
            return rows.select(key, F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))

    got = Index(records, provider=Broken()).answer({"query": "compost leaves"})
    assert got["degraded"] and got["failures"] == ["vector: model is away"] and got["results"][0]["chunk_id"] == 1


def test_rerank(index):
    by_length = lambda: lambda _, texts: [-len(t) for t in texts]
    with pytest.raises(ValueError):
        Request(reranker=by_length)
    first = keys(index.query_documents("compost water leaves", Request(reranker=by_length, rerank_budget=2)))
    plain = keys(index.query_documents("compost water leaves"))
    best = sorted(plain[:2], key=lambda k: len(NOTES[k][3]))
    assert [k for k in first if k in plain[:2]] == best


def test_provider_and_cache(spark, records):
    seen = []

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    provider = E.Encoder("lengths", 2, load)
    rows = records.select("key", "body").unionByName(spark.createDataFrame([(9, NOTES[0][3]), (10, None)], "key long, body string"))
    out, fresh, counts = E.cached(rows, "key", "body", provider, None)
    assert counts.first().asDict() == {"rows": 7, "hits": 0, "misses": 6} and {r["key"]: r["embedding"][0] for r in out.collect()}[9] == len(NOTES[0][3])
    _, again, counts = E.cached(rows, "key", "body", provider, fresh)
    assert counts.first().asDict() == {"rows": 7, "hits": 6, "misses": 0} and again.count() == 0
    assert E.cached(rows, "key", "body", E.Encoder("other", 2, load), fresh)[2].first()["misses"] == 6 and not seen


def brute_bm25(texts, queries, k):
    words = {i: re.findall(r"\w+", t.lower()) for i, t in texts}
    words = {i: w for i, w in words.items() if w}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, terms in queries:
        scores = []
        for i, ws in words.items():
            tf = Counter(ws)
            s = sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in terms if tf[t])
            if s:
                scores.append((-round(s, 9), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def test_local_scores(spark, monkeypatch):
    """Scores in slices of rows and queries, in several passes, equal to a plain loop and to the join."""
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 25)))) for i in range(300)] + [(300, ""), (301, "...")]
    queries = [(q, rng.sample(pool + ["none"], rng.randint(1, 8))) for q in range(40)]
    for name, value in (("QUERY_BLOCK", 16), ("QUERY_SLICE", 5), ("ROW_SLICE", 64)):
        monkeypatch.setattr(S, name, value)
    rows = spark.createDataFrame(texts, "key long, body string")
    asked = spark.createDataFrame([(q, t) for q, ts in queries for t in ts], "qid long, term string")
    want = brute_bm25(texts, queries, 7)
    got = S.bm25_top(S.term_counts(rows, "key", {"content": "body"}), "key", asked, "qid", 7)
    assert sorted(map(tuple, got.select("qid", "key", "score", "rank").collect())) == sorted(want)
    joined = S.top(S.bm25(S.postings(rows, "key", "body"), "key", asked, "qid").withColumn("score", F.round("score", 9)), "qid", "key", 7)
    assert sorted(map(tuple, joined.select("qid", "key", "score", "rank").collect())) == sorted(want)
    monkeypatch.setattr(S, "FEW", 30)
    got = S.bm25_top(S.term_counts(rows, "key", {"content": "body"}), "key", asked, "qid", 7)
    assert sorted(map(tuple, got.select("qid", "key", "score", "rank").collect())) == sorted(want)
    assert S.bm25_top(S.term_counts(rows.limit(0), "key", {"content": "body"}), "key", asked, "qid", 7).count() == 0
    assert S.bm25_top(S.term_counts(rows, "key", {"content": "body"}), "key", asked.limit(0), "qid", 7).count() == 0


def test_cosine(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=5).tolist()) for i in range(200)] + [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [0.0] * 5), (203, [1.0, 2.0]), (204, [3.0, 1.0])]
    for name, value in (("QUERY_BLOCK", 7), ("ROW_SLICE", 32)):
        monkeypatch.setattr(S, name, value)
    frame = spark.createDataFrame(vectors, "key long, embedding array<double>")
    got = S.cosine_top(frame, frame.where("key % 10 = 3 or key >= 200"), "key", "embedding", 4)
    real = {i: np.array(v) for i, v in vectors if v is not None and None not in v and any(v)}
    want = []
    for q in real:
        if q % 10 == 3 or q >= 200:
            near = sorted((-round(float(real[q] @ real[i] / np.linalg.norm(real[q]) / np.linalg.norm(real[i])), 9), i) for i in real if i != q and len(real[i]) == len(real[q]))
            want += [(q, i, -s) for s, i in near[:4]]
    assert sorted((r["query_id"], r["key"], round(r["score"], 8)) for r in got.collect()) == sorted((q, i, round(s, 8)) for q, i, s in want)


def test_long_lists(spark):
    """No result is lost beyond the hundredth."""
    rows = spark.createDataFrame([(0, i, float(-i), [float(i // 2), 1.0], f"text number {i // 2} of many") for i in range(260)], "q long, k long, score double, x array<double>, t string")
    assert R.mmr(rows, "q", "k", "x", 200).count() == 200
    spread = rows.withColumn("x", F.expr("transform(sequence(0, 129), j -> if(j = k div 2, 1.0D, 0.0D))"))
    assert R.semantic_dedup(spread, "q", "k", "x").count() == 130
    assert R.ngram_dedup(rows, "q", "k", "t", 0.999).count() == 130


def test_corrections(spark):
    vocabulary = [("harbour", 5), ("harbor", 9), ("water", 3), ("later", 3), ("tide", 1)]
    typed = ["harbur", "wate", "xater", "tide", "tdie", "zzzz", "waters"]

    def apart(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(d[j + 1] + 1, new[j] + 1, d[j] + (x != y)))
            d = new
        return d[-1]

    known = dict(vocabulary)
    want = {t: min((w for w in known if apart(t, w) <= 1), key=lambda w: (-known[w], w)) for t in typed if t not in known and any(apart(t, w) <= 1 for w in known)}
    got = S.corrected(spark.createDataFrame([(t,) for t in typed], "term string"), spark.createDataFrame(vocabulary, "term string, count long"))
    assert {r["term"]: r["correction"] for r in got.collect()} == want


def test_registration(spark):
    roots = spark.createDataFrame([("notes", "/home/a/notes"), ("x", "/srv/x/y")], "project string, root string")
    places = ["/home/a/notes", "/home/a/notes/deep", "/srv/x", "/", "/new/notes", "/new/x", "/other/x"]
    got = {r["place"]: (r["reason"], r["project"]) for r in P.registration(spark.createDataFrame([(p,) for p in places], "place string"), roots, ["/"]).collect()}
    assert got["/home/a/notes"] == ("already_registered", "notes") and got["/home/a/notes/deep"] == ("inside_registered_project", "notes")
    assert got["/srv/x"] == ("contains_registered_project", None) and got["/"] == ("unsafe_root", None)
    assert got["/new/notes"] == ("registered", "notes-2") and {got["/new/x"][1], got["/other/x"][1]} == {"x-2", "x-3"}


def test_records(spark):
    d = spark.createDataFrame([("a", "a.md", "p", None, {"x": "doc", "y": "1"}, ["b"], [])], "doc_id string, file_path string, project string, modified_time timestamp, metadata map<string,string>, links array<string>, tags array<string>")
    c = spark.createDataFrame([("a", "a_0", 0, "one", "", {"x": "chunk"}), ("a", "a_1", 1, "two", "H > I", None)], "doc_id string, chunk_id string, chunk_index int, content string, header_path string, metadata map<string,string>")
    rows = {r["source_id"]: r for r in N.note_records(c, d).collect()}
    assert rows["a_0"]["metadata"]["x"] == "chunk" and rows["a_1"]["metadata"]["x"] == "doc" and rows["a_0"]["title"] == "a" and rows["a_1"]["title"] == "H > I"
    assert rows["a_1"]["storage_key"] == "p|note|a_1" and rows["a_0"]["metadata"]["links"] == '["b"]'


def test_availability_and_flip(spark):
    f = lambda *xs: spark.createDataFrame([(x,) for x in xs], "path string")
    state = lambda *a: U.availability(*a).first()
    assert tuple(state(f("a", "b"), f("a"), f())) == ("available", "available", "backfilling")
    assert tuple(state(f("a"), f(), f())) == ("unavailable", "unavailable", "unavailable") and state(f("a"), f("a"), f("a", "z"))["semantic"] == "complete"
    pointer = spark.createDataFrame([("old", None)], "model string, previous string")
    vectors = spark.createDataFrame([("old", 1, [1.0]), ("old", 2, [1.0]), ("new", 1, [1.0, 2.0])], "model string, key long, embedding array<double>")
    assert tuple(U.flipped(pointer, vectors, "new").first()) == ("old", None, False)
    whole = vectors.unionByName(spark.createDataFrame([("new", 2, [1.0, 2.0])], vectors.schema))
    assert tuple(U.flipped(pointer, whole, "new").first()) == ("new", "old", True)
    assert tuple(U.flipped(pointer, whole, "missing").first()) == ("old", None, False)


def test_chunks(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("ab .\n", k=n))) for i, n in enumerate((0, 1, 9, 10, 11, 25, 40, 100))]
    frame = spark.createDataFrame(texts, "k long, t string")
    got = {r["k"]: r["w"] for r in frame.select("k", C.windows(F.col("t"), 10, 3).alias("w")).collect()}
    for i, t in texts:
        want = []
        at = 0
        while t:
            want.append(t[at : at + 10])
            if at + 10 >= len(t):
                break
            at += 7
        assert got[i] == want
    one = spark.createDataFrame([("One two. Three! Four? Five",)], "t string").select(C.sentences(F.col("t"), 16).alias("s")).first()["s"]
    assert one == ["One two. Three!", "Four? Five"]
    lines = spark.createDataFrame([("a\r\nb\rc d\x0ce",)], "t string").select(C.line_chunks(F.col("t"), 2, 0).alias("s")).first()["s"]
    assert "\n".join(lines).split("\n") == list("abcde")


def test_scratch_needs_a_shared_folder():
    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch(Session())
    assert T.path_glob("*.md")


def test_settings(tmp_path):
    from tidewell import config

    assert config.nearest(tmp_path, tmp_path) is None and config.load(None).search.weights["graph"] == 1.0
    (tmp_path / ".tidewell").mkdir()
    (tmp_path / ".tidewell" / "config.toml").write_text('[indexing]\ninclude = ["**/*.md"]\nold = 1\n[search]\nkeyword_weight = 2.0\n[[projects]]\nname = "a"\npath = "/a"\n')
    (tmp_path / "x" / "y").mkdir(parents=True)
    found = config.load(config.nearest(tmp_path / "x" / "y", tmp_path / "none"))
    assert found.indexing.include == ("**/*.md",) and found.search.weights["keyword"] == 2.0 and found.projects[0].path == "/a"
    for bad in ({"rerank_budget": 3}, {"reranker_model": "m"}, {"abstention_threshold": 2.0}, {"project_uplift_multiplier": 0.0}):
        with pytest.raises(ValueError):
            config.Search(**bad)
    with pytest.raises(ValueError):
        config.Config(projects=(config.Project("a", "/x"), config.Project("a", "/y")))


def test_parents(spark):
    rng = random.Random(4)
    rows = [(d, i, "x" * rng.choice([10, 700, 1600, 2900]), rng.choice(["A > B", "A > C", "A"])) for d in range(5) for i in range(12)]
    frame = spark.createDataFrame(rows, "d long, i long, t string, header_path string")
    got = {(r["d"], r["i"]): r["parent_chunk_id"] for r in C.parents(frame, "d", "i", "t").collect()}
    for d in range(5):
        number, size = 0, 0
        for _, i, t, _ in [r for r in rows if r[0] == d]:
            if size and (size >= C.PARENT_LEAST or size + len(t) > C.PARENT_MOST):
                number, size = number + 1, 0
            size += len(t)
            assert got[d, i] == f"{d}_parent_{number}"
    paths = spark.createDataFrame([(["A > B > C", "A > B", "A > B > D"],), (["A", "B"],), (["A > B"],), (["A > Bx", "A > B"],)], "p array<string>")
    assert [r[0] for r in paths.select(C.shared_path(F.col("p"))).collect()] == ["A > B", "", "A > B", "A"]


def test_strategies(spark):
    frame = spark.createDataFrame([(1, "# H\nOne. Two.\n\nThree.")], "k long, t string")
    for strategy in ("none", "header_based", "paragraph", "sentence", "sliding_window"):
        rows = C.chunked(frame, "k", "t", strategy).collect()
        assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and rows
    assert C.chunked(frame, "k", "t", "none").first()["content"] == "# H\nOne. Two.\n\nThree."
    with pytest.raises(ValueError):
        C.chunked(frame, "k", "t", "other")
