"""Times headline queries: BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

import tempfile

from pyspark.sql import functions as F

from tidewell.queries import QUERIES
from tidewell.queries.index import document_index
from tidewell.session import session, table

HEADLINE = [
    "index_search", "hybrid_search", "bm25_topk", "bm25f_fields", "cosine_topk_batch", "rrf_fuse", "graph_neighbors_2hop", "tag_expansion", "vocabulary_topn", "hash_embedding_entries",
    "paragraph_chunks", "line_pack_chunks", "commit_chunks", "content_hash_dedup", "semantic_dedup", "mmr", "per_document_limit", "commit_aggregate", "upsert_latest", "delta_by_hash", "debounce_latest", "community_labels", "ranking_metrics", "wikilinks", "header_chunks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    # One query at a time on a written index: the median of ten, and the writing.
    began = time.time()
    index = document_index(spark, folder).write(tempfile.mkdtemp(prefix="spark-"))
    times["index_write"] = round(time.time() - began, 3)
    each = []
    for row in table(spark, folder, "benchmark").select(F.left("text", F.lit(200)).alias("text")).limit(11).collect():
        began = time.time()
        index.query_documents(row["text"]).collect()
        each.append(time.time() - began)
    times["query_documents_one"] = round(sorted(each[1:])[5], 3)
    print(json.dumps({"metric": "seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
