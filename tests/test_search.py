from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions.text import metadata_rank
from tidewell.operators import rank as R
from tidewell.operators import retrieve as S
from tidewell.operators import state as U
from tidewell.plans.search import Index, Request
from tidewell.queries import QUERIES

NOTES = [
    (0, "gardening", "Garden beds", "Raised beds keep roots warm. Compost feeds the soil.", "home/gardening.md", "Garden beds", "home", "note"),
    (1, "compost", "Compost", "Compost needs air, water and brown leaves.", "home/compost.md", "Compost", "home", "note"),
    (2, "tides", "Tides", "The moon pulls the sea; spring tides follow the full moon.", "sea/tides.md", "Tides", "sea", "note"),
    (3, "harbour", "Harbour", "Boats wait in the harbour for high water.", "sea/harbour.md", "Harbour", "sea", "note"),
    (4, "harbour", "Harbour > Fees", "Fees are due before high water.", "sea/harbour.md", "Harbour > Fees", "sea", "note"),
]


@pytest.fixture(scope="module")
def index(spark):
    records = spark.createDataFrame(NOTES, "key long, doc_id string, title string, body string, file_path string, header_path string, project string, source_kind string")
    edges = spark.createDataFrame([(1, 0), (3, 2)], "src long, dst long")
    return Index(records, edges)


def found(index, query, **k):
    return [r["key"] for r in index.query_documents(query, Request(**k)).collect()]


def test_search(index):
    assert found(index, "compost leaves")[0] == 1
    assert found(index, "full moon")[0] == 2
    # linked from the first hit, without a word of the query
    assert 0 in found(index, "brown leaves air")
    assert found(index, "compost", projects=("sea",)) == [] or 1 not in found(index, "compost", projects=("sea",))
    assert 1 not in found(index, "compost leaves", excluded_files=("compost",))
    assert len({r["doc_id"] for r in index.query_documents("high water").collect()}) == len(found(index, "high water"))
    assert {3, 4} <= set(found(index, "high water", max_chunks_per_doc=0))
    assert found(index, "anything.with: (odd) *signs*", min_score=1.0) == []


def test_hypothesis(index):
    rows = index.search_with_hypothesis("compost needs brown leaves").collect()
    assert rows[0]["key"] == 1 and all(r["strategies"] == ["vector"] for r in rows)


def test_requests():
    for bad in ({"top_n": 0}, {"top_n": True}, {"min_score": 2.0}, {"similarity_threshold": 0.2}, {"max_chunks_per_doc": -1}):
        with pytest.raises(ValueError):
            Request(**bad)


def test_git_history(spark):
    rows = [(i, f"git:{i // 2}", "fix", f"fix the {w} parser", None, None, "p", "git_commit", f"git:{i // 2}", s, 100 * i, [f"src/x/{w}.py"]) for i, (w, s) in enumerate((("url", "summary"), ("url", "diff"), ("date", "summary"), ("date", "body")))]
    records = spark.createDataFrame(rows, "key long, doc_id string, title string, body string, file_path string, header_path string, project string, source_kind string, commit_id string, section string, committed_at long, files_changed array<string>")
    index = Index(records)
    got = index.search_git_history("url parser").collect()
    assert got[0]["commit_id"] == "git:0" and got[0]["matched_chunk_count"] == 2 and sorted(got[0]["matched_sections"]) == ["diff", "summary"]
    assert [r["commit_id"] for r in index.search_git_history("parser", files_glob="src/**/date.py").collect()] == ["git:1"]
    assert [r["commit_id"] for r in index.search_git_history("parser", after=150).collect()] == ["git:1"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "q int, k string, rank int")
    judged = spark.createDataFrame([(0, "b"), (0, "c"), (1, "z")], "q int, k string")
    got = {r["q"]: r for r in R.ranking_metrics(ranked, judged, "q", "k").collect()}
    assert (got[0]["reciprocal_rank"], got[0]["recall_at_1"], got[0]["recall_at_3"]) == (0.5, 0.0, 1.0)
    assert round(got[0]["ndcg_at_3"], 3) == 0.693 and got[1]["reciprocal_rank"] == 0.0


def test_metadata_rank(spark):
    row = spark.createDataFrame([("Install guide", "Setup > Linux", "docs/a.md")], "t string, h string, f string")
    rank = lambda q: row.select(metadata_rank(F.lit(q), F.col("t"), F.col("h"), F.col("f"))).first()[0]
    assert [rank(q) for q in ("install", "linux guide", "nothing", " ")] == [2, 1, 0, 0]


def test_limits():
    assert S.candidate_limit(5) == 20 and S.candidate_limit(5, projects=True) == 50 and S.candidate_limit(5, per_document=3) == 30
    assert U.fetch_limit(5, True) == 50 and U.fetch_limit(20, True) == 100


def test_deltas(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "x")], "d int, h string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z"), (3, "y")], "d int, h string")
    got = {r["d"]: r["action"] for r in U.deltas(old, new, "d", "h").collect()}
    assert got == {1: "delta", 2: "delete", 3: "reindex"}
    moved = U.moves(spark.createDataFrame([("o", c) for c in "abcde"], "d string, h string"), spark.createDataFrame([("n", c) for c in "abcdf"] + [("m", c) for c in "abcde"], "d string, h string"), "d", "h").collect()
    assert [(r["old"], r["new"], r["similarity"]) for r in moved] == [("o", "m", 1.0)]


def brute_moves(docs):
    """Every pair of an even and an odd document, over all chunks."""
    out = []
    for o, a in docs.items():
        near = [(-len(a & b) / len(a | b), n) for n, b in docs.items() if n % 2 and len(a & b) / len(a | b) >= U.MOVED] if o % 2 == 0 else []
        out += [(o, n, round(-s, 6)) for s, n in [min(near)]] if near else []
    return sorted(out)


def test_moves_whole(spark):
    """Frequent chunks count, and so do documents with equal chunks."""
    rng = random.Random(2)
    base = [{f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 14))} for _ in range(25)]
    docs = {}
    for i in range(300):
        own = set(rng.choice(base))
        for _ in range(rng.randrange(3)):
            own ^= {f"w{rng.randrange(30)}" if rng.random() < 0.8 else f"rare{i}"}
        docs[i] = own or {"w0"}
    rows = spark.createDataFrame([(i, c) for i, own in docs.items() for c in own], "d long, h string")
    got = U.moves(rows.where("d % 2 = 0"), rows.where("d % 2 = 1"), "d", "h").collect()
    want = brute_moves(docs)
    assert sorted(map(tuple, got)) == want and {s for _, _, s in want} > {0.8, 1.0}


def test_move_detection_whole(spark, tmp_path):
    """Lines in over 20 texts, one rare line in common, and a text under ids of both sides."""
    common = [f"line {k}" for k in range(10)]
    texts = {i: common[:4] + [f"own {i}"] + common[5:] for i in range(40)}  # 9 of 11 lines in common
    texts |= {41: ["rare", "a"], 42: ["rare", "b"], 51: ["same"], 52: ["same"], 54: ["same"]}
    spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["move_detection_whole"](spark, str(tmp_path)).collect()
    want = brute_moves({i: set(x) for i, x in texts.items()})
    assert sorted(map(tuple, got)) == want and len(want) == 22
