"""Records of an index from chunks of documents and commits: their fields, edges, counts and attribution."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds of records.
NOTE, COMMIT = "note", "git_commit"
#: What a commit without a title is called.
UNTITLED = "(no commit message)"


def _known(*pairs: tuple[str, Column]) -> Column:
    """A map of texts without the entries that are null."""
    return F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def storage_key(workspace: Column, kind: Column, source: Column) -> Column:
    return F.concat_ws("|", F.coalesce(workspace, F.lit("")), kind, source)


def note_records(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """A record of each chunk, with its document's metadata, its ids and its own metadata, which wins.

    chunks: doc_id, chunk_id, chunk_index, content, header_path and metadata (a map of texts); documents: doc_id,
    file_path, project, modified_time, metadata, links and tags. The title is the header path, or else the document."""
    d = documents.select("doc_id", "file_path", "project", "modified_time", F.col("metadata").alias("_document"), "links", "tags")
    rows = chunks.join(d, "doc_id")
    empty = F.create_map().cast("map<string,string>")
    ids = _known(("chunk_id", F.col("chunk_id")), ("doc_id", F.col("doc_id")), ("chunk_index", F.col("chunk_index")), ("file_path", F.col("file_path")), ("project_id", F.col("project")))
    lists = _known(("links", F.to_json("links")), ("tags", F.to_json("tags")))
    merged = merged_maps(F.coalesce("_document", empty), ids, lists, F.coalesce("metadata", empty))
    return rows.select(
        storage_key(F.col("project"), F.lit(NOTE), F.col("chunk_id")).alias("storage_key"), F.lit(NOTE).alias("source_kind"), F.col("chunk_id").alias("source_id"), "doc_id",
        F.coalesce(F.nullif(F.col("header_path"), F.lit("")), F.col("doc_id").cast("string")).alias("title"), F.col("content").alias("body"), F.col("content").alias("indexed_text"), "header_path", "file_path", "project",
        F.concat(F.lit("file://"), "file_path").alias("uri"), "modified_time", merged.alias("metadata"), "links", "tags",
    )


def merged_maps(*maps: Column) -> Column:
    """One map; of a key the value of the last map that has it."""

    def after(first: Column, second: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)

    return functools.reduce(after, maps)


def commit_records(chunks: DataFrame, commits: DataFrame, project: str | None = None) -> DataFrame:
    """A record of each chunk of a commit. chunks: hash, section, section_index, text, estimated_tokens; commits: hash,
    timestamp (seconds), title, author, committer, files_changed. Commits without a hash have none."""
    count = F.count("*").over(Window.partitionBy("hash"))
    rows = chunks.where("hash <> ''").withColumn("chunk_count", count).join(commits.select("hash", "timestamp", F.col("title").alias("_title"), "author", "committer", "files_changed"), "hash")
    commit = F.concat(F.lit("git:"), F.col("hash").cast("string"))
    title = F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.lit(UNTITLED))
    source = F.concat_ws(":", commit, F.col("section"), F.col("section_index").cast("string"))
    workspace = F.lit(project).cast("string")
    metadata = _known(
        ("author", F.col("author")), ("committer", F.col("committer")), ("timestamp", F.col("timestamp")), ("files_changed", F.to_json("files_changed")), ("title", title), ("doc_id", commit), ("commit_id", commit), ("project_id", workspace),
        ("chunk_section", F.col("section")), ("chunk_index", F.col("section_index")), ("chunk_count", F.col("chunk_count")), ("estimated_tokens", F.col("estimated_tokens")),
    )
    return rows.select(
        storage_key(workspace, F.lit(COMMIT), source).alias("storage_key"), F.lit(COMMIT).alias("source_kind"), source.alias("source_id"), commit.alias("doc_id"), commit.alias("commit_id"), title.alias("title"), F.col("text").alias("body"),
        workspace.alias("project"), "section", "section_index", "chunk_count", "author", "committer", "files_changed", F.col("timestamp").alias("committed_at"), metadata.alias("metadata"),
    )


def weighted_text(header_path: Column, content: Column) -> Column:
    """What is embedded of a chunk: its headings count with its text."""
    return F.concat_ws("\n\n", F.nullif(header_path, F.lit("")), content)


def edges(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """src and dst: every record of a linking document to every record of the one it links to.

    resolved: source and target documents, project (the linking document's); records: storage_key, doc_id, project. Only
    records of the linking document's own project link."""
    links = resolved.select("source", "target", "project").distinct()
    a = records.select(F.col("storage_key").alias("src"), F.col("doc_id").alias("source"), "project")
    b = records.select(F.col("storage_key").alias("dst"), F.col("doc_id").alias("target"))
    same = links["project"].eqNullSafe(a["project"])
    return links.join(a, (links["source"] == a["source"]) & same).select("src", links["target"]).join(b, "target").select("src", "dst", F.lit("links_to").alias("edge_type"))


def implicit_edges(documents: DataFrame, path: str, tags: str) -> DataFrame:
    """doc_id, group and kind: documents of one folder, and of one tag, are near each other through that group; pairs of a
    large group are never written out, but a node for the group stands between."""
    folder = documents.select("doc_id", F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("group"), F.lit("folder").alias("kind"))
    tagged = documents.select("doc_id", F.explode(F.array_distinct(tags)).alias("group"), F.lit("tag").alias("kind"))
    return folder.where("`group` <> ''").unionByName(tagged)


def counts(records: DataFrame) -> DataFrame:
    """source_kind and n: records of each kind, and for commits the commits themselves."""
    commit = F.substring_index("source_id", ":", 2)
    return records.groupBy("source_kind").agg(F.when(F.col("source_kind") == COMMIT, F.count_distinct(commit)).otherwise(F.count("*")).alias("n"))


def descriptions(records: DataFrame) -> DataFrame:
    """doc_id, file_path and source_kind of its first record, and chunk_count, of every document."""
    first = F.min_by(F.struct("file_path", "source_kind"), F.col("storage_key"))
    return records.groupBy("doc_id").agg(first.alias("f"), F.count("*").alias("chunk_count")).select("doc_id", "f.file_path", "f.source_kind", "chunk_count")


def root_of(path: Column, roots: list[str]) -> Column:
    """The place in the list, from 0, of the first root that holds the path; null if none does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(roots))):
        bare = roots[i].rstrip("/")
        out = F.when((path == bare) | F.startswith(path, F.lit(bare + "/")), F.lit(i)).otherwise(out)
    return out


def root_stats(found: DataFrame, indexed: DataFrame, roots: list[str]) -> DataFrame:
    """root, discovered, documents, chunks and remaining of each root, of what no root holds, and of all together.

    found: path; indexed: file_path and chunk_count (of `descriptions`). The first root that holds a file has it."""
    names = F.array(*map(F.lit, roots))
    name = lambda path: F.coalesce(F.get(names, root_of(F.col(path), roots)), F.lit("(none)"))
    a = found.groupBy(name("path").alias("root")).agg(F.count("*").alias("discovered"))
    b = indexed.groupBy(name("file_path").alias("root")).agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))
    total = a.join(b, "root", "full").na.fill(0).rollup("root").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("discovered", "documents", "chunks")])
    return total.select(F.coalesce("root", F.lit("(all)")).alias("root"), "discovered", "documents", "chunks", F.greatest(F.col("discovered") - F.col("documents"), F.lit(0)).alias("remaining"))


def reattributed(records: DataFrame, commits: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(records of these commits that belong to another project, put right; the storage keys that are stale then).

    commits: hash. records: storage_key, source_kind, source_id, project and metadata."""
    own = commits.select(F.concat(F.lit("git:"), F.col("hash").cast("string")).alias("_commit")).distinct()
    wrong = records.where((F.col("source_kind") == COMMIT) & (~F.col("project").eqNullSafe(F.lit(project)) | ~F.coalesce(F.try_element_at("metadata", F.lit("project_id")), F.lit("")).eqNullSafe(F.lit(project))))
    wrong = wrong.withColumn("_commit", F.substring_index("source_id", ":", 2)).join(own, "_commit", "left_semi").drop("_commit").withColumn("_old", F.col("storage_key"))
    right = wrong.withColumn("project", F.lit(project)).withColumn("metadata", merged_maps(F.col("metadata"), F.create_map(F.lit("project_id"), F.lit(project)))).withColumn("storage_key", storage_key(F.lit(project), F.col("source_kind"), F.col("source_id")))
    return right.drop("_old"), right.where("_old <> storage_key").select(F.col("_old").alias("storage_key"))
