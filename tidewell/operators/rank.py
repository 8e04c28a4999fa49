"""Fusion, scores, filters, de-duplication and limits of search results, in batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import file_name, query_type, trigrams, without_suffix
from ..functions.vectors import cosine
from ..scratch import staged

#: RRF's constant, calibration's slope and middle, uplifts and floors.
RRF_K, SLOPE, MIDDLE, UPLIFT, COMMUNITY, FLOOR = 60, 150.0, 0.035, 1.2, 1.1, 0.01
#: Variance under which a strategy's weight shrinks, and the least share that it keeps.
VARIANCE, LEAST_SHARE = 0.1, 0.25
#: How much more a list counts for a type of query.
TYPE_WEIGHTS = {"factual": ("keyword", 1.5), "navigational": ("graph", 1.5), "exploratory": ("vector", 1.3)}


def ranked(hits: DataFrame, query_key: str, key: str) -> DataFrame:
    """1-based rank in each strategy's list of a query; ties go to the smaller key."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(query_key, "strategy").orderBy(F.desc("score"), key)))


def rrf(hits: DataFrame, query_key: str, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """query_key, key, score, strategies and strategy_scores: the sum of weight / (RRF_K + rank).

    hits: query_key, key, strategy, rank and score, and weight if it differs by query."""
    weight = F.lit(1.0)
    if weights:
        weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for w in weights.items() for x in w]), F.col("strategy")), F.lit(1.0))
    elif "weight" in hits.columns:
        weight = F.col("weight")
    each = F.array_sort(F.collect_list(F.struct("strategy", F.col("score").alias("s"))))
    fused = hits.groupBy(query_key, key).agg(F.sum(weight / (RRF_K + F.col("rank"))).alias("score"), each.alias("e"))
    return fused.select(query_key, key, "score", F.transform("e", lambda x: x["strategy"]).alias("strategies"), F.map_from_entries("e").alias("strategy_scores"))


def type_weights(hits: DataFrame, queries: DataFrame, query_key: str, query: str) -> DataFrame:
    """hits with a weight: the list that suits a query's type counts more."""
    kind = query_type(F.col(query))
    weight = F.lit(1.0)
    for name, (strategy, factor) in TYPE_WEIGHTS.items():
        weight = F.when((F.col("_kind") == name) & (F.col("strategy") == strategy), factor).otherwise(weight)
    return hits.join(queries.select(query_key, kind.alias("_kind")), query_key).withColumn("weight", weight).drop("_kind")


def variance_weights(hits: DataFrame, query_key: str) -> DataFrame:
    """query_key, strategy and weight: a strategy whose scores hardly differ counts less; weights keep their sum."""
    v = hits.groupBy(query_key, "strategy").agg(F.var_pop("score").alias("v"))
    raw = v.withColumn("raw", F.when(F.col("v") < VARIANCE, F.greatest(F.lit(LEAST_SHARE), F.col("v") / VARIANCE)).otherwise(F.lit(1.0)))
    w = Window.partitionBy(query_key)
    return raw.select(query_key, "strategy", (F.col("raw") * F.count("*").over(w) / F.sum("raw").over(w)).alias("weight"))


def min_max(score: Column, by: list[str]) -> Column:
    """0 to 1 over the rows of `by`; 1 if all are equal."""
    w = Window.partitionBy(*by)
    span = F.max(score).over(w) - F.min(score).over(w)
    return F.when(span == 0, F.lit(1.0)).otherwise((score - F.min(score).over(w)) / span)


def comb_sum(hits: DataFrame, query_key: str, key: str) -> DataFrame:
    scaled = hits.withColumn("scaled", min_max(F.col("score"), [query_key, "strategy"]))
    return scaled.groupBy(query_key, key).agg((F.sum("scaled") + F.sum(F.lit(1.0) / (RRF_K + F.col("rank")))).alias("score"))


def recency(when: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, when)
    return F.when(days <= 7, 1.2).when(days <= 30, 1.1).otherwise(1.0)


def calibrated(score: Column) -> Column:
    return 1 / (1 + F.exp(-SLOPE * (score - MIDDLE)))


def uplift(score: Column, project: Column, active: Column, factor: float = UPLIFT) -> Column:
    return F.when(project == active, score * factor).otherwise(score)


def file_excluded(path: Column, root: Column, excluded: Column) -> Column:
    """Whether any name of a file is in the array: path, name, stem, path relative to the root, each with and without suffix."""
    inside = F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)
    name = file_name(path)
    names = F.array(path, name, without_suffix(name), without_suffix(path), inside, without_suffix(inside))
    return F.coalesce(F.arrays_overlap(names, excluded), F.lit(False))


def first_of(rows: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group; 0 keeps all."""
    if n == 0:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def greedy(hits: DataFrame, query_key: str, key: str, item: str, close) -> DataFrame:
    """Rows in score order, less those that are close to a row that stays: all rows of a query, which are a list of
    candidates and so bounded by its length. close(a, b): a condition on two rows' items."""
    rows = hits.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col(key).alias("k"), F.col(item).alias("x")))).alias("rows"))
    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda held, r: F.when(F.exists(held, lambda h: close(h["x"], r["x"])), held).otherwise(F.concat(held, F.array(r))))
    return rows.select(query_key, F.posexplode(kept).alias("at", "r")).select(query_key, F.col("r.k").alias(key), (-F.col("r.o")).alias("score"), (F.col("at") + 1).alias("rank"))


def ngram_dedup(hits: DataFrame, query_key: str, key: str, text: str, threshold: float = 0.7) -> DataFrame:
    """Jaccard similarity of hashed character trigrams; texts without any are close to none."""
    grams = hits.withColumn("_grams", F.transform(trigrams(F.col(text)), lambda g: F.xxhash64(g)))
    # intersection / union >= t, with the intersection taken once
    close = lambda a, b: (F.size(F.array_intersect(a, b)) * (1 + threshold) >= threshold * (F.size(a) + F.size(b))) & (F.size(a) + F.size(b) > 0)
    return greedy(grams, query_key, key, "_grams", close)


def semantic_dedup(hits: DataFrame, query_key: str, key: str, embedding: str, threshold: float = 0.85) -> DataFrame:
    """A row without embedding stays."""
    return greedy(hits, query_key, key, embedding, lambda a, b: F.coalesce(cosine(a, b) >= threshold, F.lit(False)))


def mmr(hits: DataFrame, query_key: str, key: str, embedding: str, n: int, trade: float = 0.7) -> DataFrame:
    """n rows of each query, one after another: the most of trade * score - (1 - trade) * nearness to rows chosen before.

    All rows of a query, which are a list of candidates, are weighed in one group; keys are numbers. Values are compared at 12 digits, ties by key.
    """
    import numpy as np
    import pandas as pd

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, ignore_index=True)
        x = np.stack([np.asarray(v, np.float64) for v in rows[embedding]])
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        near, left, out = np.zeros(len(rows)), np.ones(len(rows), bool), []
        for i in range(min(n, len(rows))):
            value = np.where(left, np.round(trade * rows["score"].to_numpy() - (1 - trade) * near, 12), -np.inf)
            best = int(value.argmax())
            out.append((rows[query_key].iloc[0], rows[key].iloc[best], float(value[best]), i + 1))
            left[best] = False
            near = np.maximum(near if i else -2.0, x @ x[best])
        return pd.DataFrame(out, columns=[query_key, key, "value", "rank"])

    return hits.select(query_key, key, "score", embedding).groupBy(query_key).applyInPandas(choose, f"{query_key} long, {key} long, value double, rank long")


def reranked(rows: DataFrame, query_key: str, key: str, query: str, text: str, load: Callable[[], Callable[[list[str], list[str]], list[float]]], budget: int) -> DataFrame:
    """rows with rank and rerank_score: the first `budget` of each query in the order of a scorer of (queries, texts), the
    others after them as they were. load() makes the scorer, once a task. rows: query_key, key, score, query and text."""
    order = [F.desc("score"), key]
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(query_key).orderBy(*order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or load()
            scores = scorer(batch.column(query).to_pylist(), batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(query_key), batch.column(key), pa.array(map(float, scores), pa.float64())], [query_key, key, "rerank_score"])

    few = placed.where(F.col("_place") <= budget).select(F.col(query_key).cast("long"), F.col(key).cast("long"), query, text)
    scored = few.mapInArrow(run, f"{query_key} long, {key} long, rerank_score double")
    out = placed.join(scored, [query_key, key], "left")
    last = Window.partitionBy(query_key).orderBy(F.desc_nulls_last("rerank_score"), "_place")
    return out.withColumn("rank", F.row_number().over(last)).drop("_place")


def commit_results(hits: DataFrame, query_key: str) -> DataFrame:
    """One row for each query and commit: the best-scored hit, its sections in the order of hits, and their number.

    hits: query_key, commit_id, chunk_id, section, score and position."""
    best = F.max_by(F.struct("chunk_id", "section"), F.struct("score", (-F.col("position")).alias("p")))
    sections = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "section"))), lambda x: x["section"]))
    grouped = hits.groupBy(query_key, "commit_id").agg(best.alias("best"), F.max("score").alias("score"), sections.alias("matched_sections"), F.count("*").alias("matched_chunk_count"))
    return grouped.select(query_key, "commit_id", "best.chunk_id", "score", F.array_compact("matched_sections").alias("matched_sections"), "matched_chunk_count")


def strategy_counts(results: DataFrame, query_key: str) -> DataFrame:
    """How many results of each query each strategy found, under the names that reports use."""
    name = F.when(F.col("s") == "vector", "semantic").when(F.col("s") == "expansion", "tag_expansion").otherwise(F.col("s"))
    names = ["semantic", "keyword", "graph", "code", "tag_expansion"]
    return results.select(query_key, F.explode("strategies").alias("s")).select(query_key, name.alias("s")).groupBy(query_key).pivot("s", names).count().na.fill(0)


def ranking_metrics(ranked_rows: DataFrame, judged: DataFrame, query_key: str, key: str) -> DataFrame:
    """Reciprocal rank, recall at 1, 3 and 5 and NDCG at 3 and 5 of every judged query.

    ranked_rows: query_key, key, rank; judged: query_key and key of relevant rows."""
    relevant = judged.select(query_key, key).distinct()
    total = relevant.groupBy(query_key).agg(F.count("*").alias("n"))
    found = ranked_rows.select(query_key, key, "rank").join(relevant, [query_key, key]).groupBy(query_key)
    gain = lambda k: F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    got = found.agg(F.min("rank").alias("first"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in (1, 3, 5)], *[gain(k).alias(f"g{k}") for k in (3, 5)])
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(got, query_key, "left").select(
        query_key,
        zero(1 / F.col("first")).alias("reciprocal_rank"),
        *[zero(F.col(f"h{k}") / F.col("n")).alias(f"recall_at_{k}") for k in (1, 3, 5)],
        *[zero(F.col(f"g{k}") / ideal(k)).alias(f"ndcg_at_{k}") for k in (3, 5)],
    )


#: The counts that compression of a list of candidates tells, in the order of its steps.
STEPS = ("original", "after_threshold", "after_content_dedup", "after_ngram_dedup", "after_dedup", "after_doc_limit")


def compressed(hits: DataFrame, query_key: str, key: str, text: str, document: str, floor: float, ngram: float = 0.7, embedding: str | None = None, semantic: float = 0.85, per_document: int = 1, totals: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, counts by query): floor, exact copies, n-gram copies, near vectors (if there is a column of them), limit by document, each with what it left.

    A query's candidates, a list of bounded length, are one row, and each step leaves a part of the list: all steps are one pass
    with one shuffle. Hits and lists are staged, so neither frame makes the hits again. totals: an observation that gets
    each step's count over all queries from that same pass. A hit with a null score is under the floor."""
    hits = staged(hits, "hits")
    # Whole texts stay where they are.
    row = F.struct(
        (-F.col("score")).alias("o"), F.col(key).alias("k"), F.md5(text).alias("copy"), F.transform(trigrams(F.col(text)), lambda g: F.xxhash64(g)).alias("grams"),
        (F.col(embedding) if embedding else F.lit(None).cast("array<double>")).alias("near"), F.col(document).alias("of"),
    )
    rows = hits.groupBy(query_key).agg(F.array_sort(F.collect_list(row), _by_score).alias("original"))

    def less(held: Column, close: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(held, F.slice(held, 1, 0), lambda kept, r: F.when(F.exists(kept, lambda h: close(h, r)), kept).otherwise(F.concat(kept, F.array(r))))

    def limited(held: Column) -> Column:
        room = lambda kept, r: F.size(F.filter(kept, lambda h: h["of"].eqNullSafe(r["of"]))) < per_document
        return F.aggregate(held, F.slice(held, 1, 0), lambda kept, r: F.when(room(kept, r), F.concat(kept, F.array(r))).otherwise(kept)) if per_document else held

    alike = lambda a, b: (F.size(F.array_intersect(a["grams"], b["grams"])) * (1 + ngram) >= ngram * (F.size(a["grams"]) + F.size(b["grams"]))) & (F.size(a["grams"]) + F.size(b["grams"]) > 0)
    steps = [
        lambda held: F.filter(held, lambda r: F.coalesce(-r["o"] >= floor, F.lit(False))),
        lambda held: less(held, lambda a, b: a["copy"].eqNullSafe(b["copy"])),
        lambda held: less(held, lambda a, b: F.coalesce(alike(a, b), F.lit(False))),
        lambda held: less(held, lambda a, b: F.coalesce(cosine(a["near"], b["near"]) >= semantic, F.lit(False))) if embedding else held,
        limited,
    ]
    for before, name, step in zip(STEPS[:-1], STEPS[1:], steps, strict=True):
        rows = rows.withColumn(name, step(F.col(before)))
    rows = rows.select(query_key, *[F.size(s).cast("long").alias(s) for s in STEPS], F.transform(STEPS[-1], lambda r: r["k"]).alias("_kept"))
    if totals is not None:
        rows = rows.observe(totals, *[F.sum(s).alias(s) for s in STEPS])
    rows = staged(rows, "compressed")
    kept = rows.select(query_key, F.explode("_kept").alias(key))
    return hits.join(kept, [query_key, key], "left_semi"), rows.drop("_kept").withColumn("clusters_merged", F.col("after_threshold") - F.col("after_dedup"))


def _by_score(a: Column, b: Column) -> Column:
    """The better first, then the smaller key; a hit without a score last."""
    less = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return F.coalesce(F.when(a["o"].isNull() & b["o"].isNotNull(), 1).when(a["o"].isNotNull() & b["o"].isNull(), -1), less(a["o"], b["o"]), less(a["k"], b["k"]), F.lit(0))
