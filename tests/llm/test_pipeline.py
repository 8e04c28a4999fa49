"""The pipeline's stages on a small corpus, each against a plain version of it."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tidewell.llm.queries import QUERIES, SQL, tokenizer

from .test_operators import corpus, links, union, word_sets


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Input and output of each stage."""
    at, frame, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(at / name)
        stage(spark, frame, folder).write.parquet(path)
        out.append((frame, spark.read.parquet(path)))
        frame = out[-1][1]
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality(spark, folder, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[0][1].collect()}
    judged = [(i in kept) == bool(q) for i, q in labels.items() if i in {r["doc_id"] for r in stages[0][0].collect()}]
    assert sum(judged) >= 0.95 * len(judged)


def test_lines(stages):
    before, after = ([(r["doc_id"], r["text"]) for r in f.collect()] for f in stages[1])
    every = [s for _, t in after for line in t.split("\n") if (s := line.strip())]
    assert len(every) == len(set(every))
    texts = dict(before)
    assert all(set(t.split("\n")) <= set(texts[i].split("\n")) for i, t in after)
    # What is gone with a whole document is held by another, or is near a line that is.
    assert {i for i, _ in after} < {i for i, _ in before}


def test_near(stages):
    before, after = (sorted((r["doc_id"], r["text"]) for r in f.collect()) for f in stages[2])
    sets = list(word_sets([t for _, t in before], 5))
    root = union(len(before), links(sets, 80))
    assert after == [r for k, r in enumerate(before) if root[k] == k]


def test_clean(spark, folder, stages):
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: r["text"] for r in f.collect()} for f in stages[3])
    assert not [i for i, t in after.items() for x in items if x in t]
    assert set(after) <= set(before)


def test_encoded(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    texts = {r["doc_id"]: r["text"] for r in stages[4][0].collect()}
    for r in stages[4][1].collect():
        assert r["ids"] == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder)
    assert sorted(r["ids_sha256"] for r in got.collect()) == sorted(r["ids_sha256"] for r in stages[4][1].collect())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, empty and very long texts, ties, repeated rows and further columns with clashing names."""
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en" if i else None, None if i and i % 4 == 0 else "s", len(t or ""), "a", i, None) for i, t in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, version long, items array<int>")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, corpus()[1][1]), (2, None), (None, corpus()[7][1]), (3, " ")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_odd_rows(spark, odd):
    """Each stage on the same odd rows, and on none of them."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    every = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), odd).count() == 0, name
        after = stage(spark, docs, odd)
        rows = after.collect()
        if name == "bpe":
            assert len(rows) == docs.count()
            continue
        assert after.schema == docs.schema, name
        if name != "line_dedup":
            assert {(r["doc_id"], r["text"]) for r in rows} <= every
        if name != "quality":
            # Nothing is near, held by or repeated in what has no words.
            assert {(r["doc_id"], r["text"]) for r in rows} >= {(72, None), (73, ""), (74, " \n\t "), (None, None)}, name
        if name == "near_dedup":
            assert sum(r["doc_id"] == 78 for r in rows) in (0, 2) and not [r for r in rows if r["doc_id"] in range(66, 72)]
        if name == "decontamination":
            gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in rows}
            assert {1, 7} <= gone
    assert corpus_pipeline.run(spark, odd).where("n_tokens is null").count() == 0


def test_registered():
    assert [k.split("_")[0] for k in QUERIES] == ["pipeline", *(f"op{n}" for n in range(1, 11))] and set(SQL) <= set(QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None


def test_knn_sql(spark, folder):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES["op4_knn"](spark, folder).select("query_id", "rank", "vec_id", "score").collect())) == sorted(c.sql(SQL["op4_knn"]).fetchall())
