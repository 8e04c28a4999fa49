"""From folders to a searchable index: what changed is read, parsed, cut, and committed, some files at a time.

What the index knows of its files is written with their records, in the same commit. So a run that is killed at any
point goes on where the last commit ended: the next look finds what is left, and nothing is counted twice or lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import edge_type
from ..operators.chunk import chunked, header_sections, merged_sections
from ..operators.embed import Provider
from ..operators.records import note_records
from ..operators.state import file_changes, tried_paths
from ..scratch import staged
from ..sources import files
from .search import Index

#: Files of a commit.
FILES = 2_000
FILE = "path string, file_path string, modified_time timestamp, size long"


def looked(spark: SparkSession, roots: dict[str, str], **globs) -> DataFrame:
    """doc_id, project, path, file_path, modified_time and size of the files under the roots that a parser reads; roots: folders by project.

    A document's id is its project and its path in it, so equal names in two projects, and suffixes, are told apart."""
    name = F.lit(None).cast("string")
    for project, root in roots.items():
        name = F.when(F.col("root") == root.rstrip("/"), F.lit(project)).otherwise(name)
    found = files.discover(spark, list(roots.values()), **globs).where(files.parser_of(F.col("path")).isNotNull())
    return found.select(name.alias("project"), "path", "file_path", "modified_time", "size").withColumn("doc_id", F.concat_ws("/", "project", "file_path"))


def documents(spark: SparkSession, paths: list[str], roots: dict[str, str], **globs) -> DataFrame:
    """Parsed documents of these files alone: nothing else is read."""
    name = F.lit(None).cast("string")
    for project, root in roots.items():
        name = F.when(F.col("root") == root.rstrip("/"), F.lit(project)).otherwise(name)
    found = files.with_roots(spark.read.format("binaryFile").load(paths), list(roots.values()))
    return files.parse(found).withColumn("project", name).withColumn("doc_id", F.concat_ws("/", "project", "file_path"))


def chunks(docs: DataFrame, strategy: str) -> DataFrame:
    """Chunks of documents as note_records wants them."""
    if strategy == "header_based":
        found = merged_sections(header_sections(docs, "doc_id", "content"), "doc_id").select("doc_id", "chunk_index", "chunk_id", "content", "header_path")
    else:
        found = chunked(docs, "doc_id", "content", strategy).withColumn("header_path", F.lit(""))
    return found.where("content <> ''").withColumn("metadata", F.create_map().cast("map<string,string>"))


def records(docs: DataFrame, strategy: str) -> DataFrame:
    """Records of an index: the key is a 64-bit hash of the storage key."""
    rows = note_records(chunks(docs, strategy), docs)
    field = lambda name: F.try_element_at("metadata", F.lit(name)).alias(name)
    return rows.select(
        F.xxhash64("storage_key").alias("key"), "doc_id", "title", "body", "file_path", "header_path", "project", "source_kind", field("category"), field("author"),
        F.col("modified_time").cast("long").alias("modified_at"), "tags", "storage_key", "uri", "metadata",
    )


def links(docs: DataFrame) -> DataFrame:
    """doc_id, target, priority, target_doc and edge_type of the links of documents; the type is told by the heading that a
    wiki link stands under."""
    headed = files.links_with_context(docs, "doc_id", "content").groupBy("doc_id", "target").agg(F.first("header").alias("header"))
    each = docs.select("doc_id", "project", "file_path", F.explode(F.array_distinct("links")).alias("target")).join(headed, ["doc_id", "target"], "left")
    kind = F.when(F.col("header").isNull(), F.lit("links_to")).otherwise(edge_type(F.col("header")))
    return each.select("doc_id", "target", F.posexplode(tried_paths(F.col("file_path"), F.col("target"))).alias("priority", "_path"), "project", kind.alias("edge_type")).select("doc_id", "target", "priority", F.concat_ws("/", "project", "_path").alias("target_doc"), "edge_type")


def ingest(spark: SparkSession, roots: dict[str, str], folder: str, strategy: str = "header_based", most: int = FILES, vectors: bool = True, provider: Provider | None = None, between: Callable[[Index, int], None] | None = None, **globs) -> Index:
    """The index in a folder, after a look at the files under the roots: new and changed ones are in, those that are gone
    are out. Each commit has up to `most` files and their records, links and marks. `between` is told after each, with
    what is left. Without `vectors` all is found by words first, and vectors are made when the last words are in."""
    index = Index.create(spark, folder, provider)
    found = staged(looked(spark, roots, **globs), "looked-files")
    before = index.files.select("path", "file_path", "modified_time", "size") if index.files is not None else spark.createDataFrame([], FILE)
    changed = staged(file_changes(before, found), "changed-files")
    number = changed.groupBy("action").count()
    count = {r["action"]: r["count"] for r in number.collect()}
    names = found.select("path", "doc_id", "project")
    if index.files is not None:
        names = names.unionByName(index.files.select("path", "doc_id", "project").join(names.select("path"), "path", "left_anti"))
    placed = changed.join(names, "path")
    todo = sum(count.values())
    lots = max(1, -(-todo // most))
    lot = F.pmod(F.xxhash64("path"), F.lit(lots))
    for i in range(lots if todo else 0):
        # At most some more than `most` paths, as they are dealt by a hash.
        some = placed.where(lot == i).select("path", "doc_id", "project", "file_path", "modified_time", "size", "action").collect()
        if not some:
            continue
        put = [r["path"] for r in some if r["action"] == "index"]
        gone = [(r["doc_id"],) for r in some if r["action"] == "remove"]
        marks = spark.createDataFrame([(r["doc_id"], r["project"], r["path"], r["file_path"], r["modified_time"], r["size"]) for r in some if r["action"] == "index"], f"doc_id string, project string, {FILE}") if put else None
        removed = spark.createDataFrame(gone, "doc_id string") if gone else None
        docs = staged(documents(spark, put, roots), "parsed-files") if put else None
        index = index.change(records(docs, strategy) if put else None, removed, files=marks, links=links(docs) if put else None, vectors=vectors)
        todo -= len(some)
        if between is not None:
            between(index, todo)
    return index.embed_missing()


def follow(spark: SparkSession, roots: dict[str, str], folder: str, checkpoint: str, every: str = "1 minute", merged: bool = True, **options) -> StreamingQuery:
    """Looks at the files at every tick, and merges small segments after it. A tick that fails is looked at again."""

    def tick(_: DataFrame, number: int) -> None:
        index = ingest(spark, roots, folder, **options)
        if merged:
            index.merged()

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
