"""Corpus pipeline: quality, line de-duplication, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of `docs`, whatever further ones there are and however they
are named. No stage fails on an empty table, which stays empty, or on nulls in any column; repeated rows are rows of
their own and share their fate, unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, decon, documents, lines, quality
from tidewell.llm.common import staged
from tidewell.llm.near import sent
from tidewell.llm.queries import tokenizer

#: No SQL: a trained model, hashed bands and a tokenizer are beyond it.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: a score of 0.3 and more stays, ties included.

    A null text is judged as an empty one. Rows without doc_id are judged like others. Without labels all rows stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents go that had lines and lose all of them.

    Of linked lines the first by doc_id, place and text's hash stays. A null text stays null, an empty one empty. A row
    without doc_id stays whole and takes no line from others. Rows that share a doc_id are told apart by their texts;
    equal rows lose the same lines."""
    return lines.rewritten(docs)


def keep_one_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id: five-word shingles, similarity 0.8.

    Null texts and texts without words are near nothing and stay, as do rows without doc_id. Rows that share a doc_id
    stay if one of them is kept."""
    marks = documents.near_documents(docs, width=5, percent=80)
    gone = staged(marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"), "near-gone")
    return docs.join(sent(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; an item without id counts, one without words does not."""
    return decon.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, counts and digests of every row. A null text has no tokens."""
    return bpe.encode_documents(docs, tokenizer(), keep_ids=True)


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_dedup", keep_one_near), ("decontamination", keep_clean), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, with a table in the shared folder between each two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
