"""Upkeep of a written index, and postings in blocks, on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import retrieve as S
from ..operators.blocks import block_tops, blocked
from ..plans.search import Index
from ..scratch import scratch, sent, staged
from ..session import table
from .registry import query
from .search import KEYWORD, POSTINGS, item_terms, scores_sql

#: Rows of each list.
LISTED = 10


def document_records(docs):
    """A record a document."""
    number = F.col("doc_id").cast("string")
    return docs.select(F.col("doc_id").alias("key"), number.alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("body"), F.concat("source", F.lit("/"), number).alias("file_path"), F.lit("").alias("header_path"), F.col("source").alias("project"), F.lit("note").alias("source_kind"))


LEFT = POSTINGS.replace("from documents", "from documents where doc_id % 11 <> 0")


@query(f"with {scores_sql(LEFT)}, {KEYWORD} select item_id, doc_id, round(score, 6) as score, rank from k where rank <= {LISTED}")
def segmented_bm25(spark, folder):
    """All documents in three commits, of which the later ones replace and remove what the earlier ones put, and a merge:
    the lists are those of an index that is built anew over the documents that hold."""
    docs = table(spark, folder, "documents")
    index = Index.create(spark, f"{scratch(spark)}/index-{uuid.uuid4().hex}")
    old = docs.where("doc_id % 3 <> 0").withColumn("text", F.concat_ws(" ", F.lit("stale words of before"), "text"))
    index = index.change(document_records(old), vectors=False)
    index = index.change(document_records(docs.where("doc_id % 3 <> 1")), vectors=False)
    index = index.change(document_records(docs.where("doc_id % 3 = 1")), docs.where("doc_id % 11 = 0").select(F.col("doc_id").cast("string").alias("doc_id")), vectors=False)
    gone = docs.where("doc_id % 11 = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    index = index.change(removed=gone).merged()
    found = S.bm25_top(index.counts, "key", item_terms(spark, folder), "item_id", LISTED, index.frequencies, index.stats)
    return found.select("item_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"with {scores_sql()}, {KEYWORD} select item_id, doc_id, round(score, 6) as score, rank from k where rank <= {LISTED}")
def bm25_blocks(spark, folder):
    """Each benchmark text by the blocks of its terms, with bounds from the first posting on."""
    counts = staged(S.term_counts(table(spark, folder, "documents"), "doc_id", {"content": "text"}), "postings")
    n, mean = counts.agg(F.count("*"), F.avg("length")).first()
    blocks = staged(blocked(counts, "doc_id", mean), "blocks")
    terms = staged(item_terms(spark, folder), "terms")
    asked = terms.select("term").distinct()
    df = S.frequencies(counts).join(sent(asked, asked.count(), 32), "term", "left_semi")
    found = block_tops(blocks, counts, "doc_id", terms, "item_id", df, (n, mean), LISTED)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")
