"""Hybrid search: a batch of queries through keyword, vector, graph and tag lists, fusion, filters and limits."""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import glob_pattern, lexical_match, metadata_rank, query_type, words
from ..operators import rank as R
from ..operators import retrieve as S
from ..operators.blocks import SMALL_GROUPS, block_top, blocked
from ..operators.embed import Hashed, Provider, vectors_of
from ..operators.projects import allowed_projects
from ..scratch import staged
from ..sources.store import MANIFESTS, Manifest, Part, Store

#: Characters of a snippet and of a factual answer; fields of metadata that answers show; the scope that a caller needs.
SNIPPET, FACTUAL = 4000, 200
SAFE = ("chunk_id", "doc_id", "file_path", "header_path", "project_id")
SCOPE = "search:read"
#: Fields that a call may have, and how many times more candidates a search of commits asks for, with conditions and without.
FIELDS = "query top_n min_score similarity_threshold excluded_files uniqueness_mode scope_mode scope_projects preferred_project".split()
WIDER, WIDE = 10, 4


@dataclass(frozen=True)
class Request:
    """What a search asks for; checked when it is made."""

    top_n: int = 5
    top_k: int = 0
    projects: tuple[str, ...] = ()
    project_context: str | None = None
    source_kinds: tuple[str, ...] = ()
    excluded_files: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    modified_after: int | None = None
    min_score: float | None = None
    similarity_threshold: float | None = None
    max_chunks_per_doc: int = 1
    semantic_only: bool = False
    calibrate: bool = False
    uplift: bool = False
    adaptive: bool = False
    expand_tags: bool = False
    correct: bool = False
    reranker: Callable | None = None
    rerank_budget: int | None = None
    weights: dict[str, float] = field(default_factory=lambda: {"vector": 1.0, "keyword": 1.0, "graph": 1.0, "expansion": 1.0})

    def __post_init__(self):
        if isinstance(self.top_n, bool) or not isinstance(self.top_n, int) or not 1 <= self.top_n <= 100:
            raise ValueError("top_n must be an integer from 1 to 100")
        for name, low in (("min_score", 0), ("similarity_threshold", 0.5)):
            value = getattr(self, name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, int | float) or not low <= value <= 1):
                raise ValueError(f"{name} must be a number from {low} to 1")
        if self.max_chunks_per_doc < 0:
            raise ValueError("max_chunks_per_doc must be 0 or more")
        if (self.reranker is None) != (self.rerank_budget is None):
            raise ValueError("a re-ranker and its budget are set together")
        if self.rerank_budget is not None and self.rerank_budget < 1:
            raise ValueError("rerank_budget must be 1 or more")

    @property
    def filtered(self) -> bool:
        """Whether a condition leaves out records before lists are made."""
        return any((self.projects, self.source_kinds, self.excluded_files, self.categories, self.authors, self.modified_after is not None))

    @classmethod
    def parse(cls, arguments: dict) -> tuple[str, Request]:
        """The query and request of a call's arguments; anything odd is refused with what is wrong."""
        if unknown := sorted(set(arguments) - set(FIELDS)):
            raise ValueError(f"unexpected: {', '.join(unknown)}")
        query = arguments.get("query")
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query must be text that is not empty")
        names = {}
        for name in ("excluded_files", "scope_projects"):
            names[name] = arguments.get(name, [])
            if not isinstance(names[name], list | tuple) or not all(isinstance(x, str) for x in names[name]):
                raise ValueError(f"{name} must be a list of texts")
        unique, mode, preferred = arguments.get("uniqueness_mode", "one_per_document"), arguments.get("scope_mode") or "global", arguments.get("preferred_project")
        if unique not in ("allow_multiple", "one_per_document"):
            raise ValueError("uniqueness_mode must be allow_multiple or one_per_document")
        if mode not in ("global", "active_project", "explicit_projects"):
            raise ValueError("scope_mode must be global, active_project or explicit_projects")
        if (mode == "explicit_projects") != bool(names["scope_projects"]):
            raise ValueError("scope_projects belong to explicit_projects, which needs them")
        if preferred is not None and (mode == "global" or not isinstance(preferred, str)):
            raise ValueError("preferred_project must be text, and not with a global scope")
        return query.strip(), cls(
            top_n=arguments.get("top_n", 5), min_score=arguments.get("min_score"), similarity_threshold=arguments.get("similarity_threshold", 0.85),
            excluded_files=tuple(names["excluded_files"]), projects=tuple(names["scope_projects"]), project_context=preferred, max_chunks_per_doc=int(unique == "one_per_document"),
        )

    def authorised(self, scopes: list[str], claimed: list[str] | None) -> Request:
        """This request within a caller's claim; refused without the scope, or beyond the claim."""
        if SCOPE not in scopes:
            raise PermissionError(f"missing scope: {SCOPE}")
        return replace(self, projects=tuple(allowed_projects(claimed, list(self.projects))))


#: Tables of a segment; folders that records, counts and vectors are dealt to by source kind and by project; columns that these share.
TABLES, FOLDERS, SHARED = ("records", "counts", "embeddings", "edges", "frequencies", "postings"), 16, ("source_kind", "project")
#: Tables that go by documents, not by keys.
OF_DOCUMENTS = ("files", "links")
#: Queries that are answered from blocks of postings, one by one, and not by a pass over all counts.
FEW_QUERIES = 4


def local(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The rows of a list (qid, key, score, rank) as a relation that the plan holds itself."""
    names = [("qid", pa.int64()), ("key", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())]
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * 4, names, strict=True)], names=[n for n, _ in names]))


def folder_of(value: str | None) -> int:
    return zlib.crc32((value or "").encode()) % FOLDERS


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with the folders that their source kind and project go to."""
    at = lambda c: (F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")) % FOLDERS).cast("int")
    return rows.withColumns({"_kind": at("source_kind"), "_project": at("project")})


class Index:
    """Tables of an index: records (key long, doc_id, title, body, file_path, header_path, project, source_kind, and if
    they are to be searched by them, category, author, modified_at in seconds and tags), edges between keys (src, dst),
    counts (of `term_counts`) and embeddings (key, embedding). The last two are made from records if they are not given.

    A written index lies in a `Store`, and has frequencies and blocks of postings too. What was opened is one manifest's:
    it stays as it is, whatever others write, until it is opened anew."""

    def __init__(self, records: DataFrame, edges: DataFrame | None = None, counts: DataFrame | None = None, embeddings: DataFrame | None = None, provider: Provider | None = None, frequencies: DataFrame | None = None):
        self.records, self.edges, self.provider, self.frequencies = records, edges, provider or Hashed(), frequencies
        self.counts = counts if counts is not None else staged(S.term_counts(records, "key", {"content": "body"}), "counts")
        self.embeddings = embeddings if embeddings is not None else self.provider.embed(records, "key", "body")
        self.store: Store | None = None
        self.manifest: Manifest | None = None
        self.postings: DataFrame | None = None
        self.files: DataFrame | None = None

    def write(self, folder: str) -> Index:
        """The index as the only segment of a store, in place of what the folder held: no text is tokenised or encoded
        again by later searches. Readers of what it held go on; its tables stay until they are cleaned."""
        spark = self.records.sparkSession
        store = Store(spark, folder)
        first = not store.numbers() and not store._fs.exists(store._path("records"))
        part = _segment(store, "." if first else f"segments/{uuid.uuid4().hex}", self.records, self.counts, self.embeddings, self.edges)
        store.commit(lambda m: Manifest(segments=(replace(part, commit=m.number + 1, model=self.provider.name),)))
        return Index.open(spark, folder, provider=self.provider, probed=False)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, provider: Provider | None = None) -> Index:
        """The index in a folder, an empty one if there is none."""
        store = Store(spark, folder)
        store.commit(lambda m: None if m.number else Manifest())
        return cls.open(spark, folder, provider=provider, probed=False)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, records: DataFrame | None = None, provider: Provider | None = None, number: int | None = None, probed: bool = True) -> Index:
        """The index in a folder, at its last manifest or that of a number. A table that is missing or cannot be read is made
        again from records, the given ones where the folder's are lost too; without those the error stands. Tables are looked
        into for that, unless not `probed`."""
        provider = provider or Hashed()

        def sound(part: Part, name: str) -> DataFrame | None:
            try:
                if (frame := store.read(part, name)) is not None and probed:
                    frame.limit(1).collect()
            except (PySparkException, Py4JError):  # footers that cannot be read come as the latter
                return None
            return frame

        store = Store(spark, folder)
        manifest = store.manifest(number) if number or store._fs.exists(store._path(MANIFESTS)) else None
        if manifest is None:
            if records is None:
                raise FileNotFoundError(f"no index in {folder}")
            return cls(records, provider=provider)
        if others := {p.model for p in manifest.segments if p.model and "embeddings" in p.tables} - {provider.name}:
            raise ValueError(f"the index in {folder} has vectors of {', '.join(sorted(others))}, not of {provider.name}")
        frames: dict[str, list[tuple[Part, DataFrame]]] = {name: [] for name in (*TABLES, *OF_DOCUMENTS)}
        for part in manifest.segments:
            held = {name: sound(part, name) for name in (*TABLES, *OF_DOCUMENTS)}
            if held["records"] is None:
                if records is None:
                    raise FileNotFoundError(f"no records in {folder}")
                return cls(records, provider=provider)
            if held["counts"] is None:
                held["counts"] = counted(held["records"])
            if held["embeddings"] is None and "embeddings" in part.tables:
                held["embeddings"] = embedded(held["records"], provider)
            for name, frame in held.items():
                if frame is not None:
                    frames[name].append((part, frame))
        empty = lambda schema: spark.createDataFrame([], schema)
        live = {name: store.live(manifest, frames[name]) for name in ("records", "counts", "embeddings")}
        out = cls(
            live["records"] if live["records"] is not None else empty(RECORD), None,
            live["counts"] if live["counts"] is not None else empty("key long, length double, terms array<string>, tfs array<double>"),
            live["embeddings"] if live["embeddings"] is not None else empty("key long, embedding array<double>"), provider,
        )
        out.store, out.manifest = store, manifest
        out.files = store.live(manifest, frames["files"], "docs", "doc_id")
        links = store.live(manifest, frames["links"], "docs", "doc_id")
        edges = store.live(manifest, [(p, f.withColumn("key", F.col("src"))) for p, f in frames["edges"]])
        if edges is not None:
            edges = edges.drop("key")
            # An edge into what was replaced holds, into what is gone it does not.
            out.edges = edges if not manifest.deletions else edges.join(out.records.select(F.col("key").alias("dst")), "dst", "left_semi")
        if links is not None:
            linked = document_edges(links, out.records)
            out.edges = linked if out.edges is None else out.edges.select("src", "dst").unionByName(linked.select("src", "dst"))
        if len(frames["frequencies"]) == len(manifest.segments):
            sums = [f for _, f in frames["frequencies"]] + [store.read(p, "frequencies").withColumn("df", -F.col("df")) for p in manifest.deletions]
            if sums:
                df = functools.reduce(DataFrame.unionByName, sums)
                out.frequencies = df if len(sums) == 1 else df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            out.stats = (manifest.rows, manifest.length / manifest.rows if manifest.rows > 0 else None)
        if frames["postings"] and len(frames["postings"]) == len(manifest.segments):
            out.postings = functools.reduce(DataFrame.unionByName, [f.withColumn("_commit", F.lit(p.commit)) for p, f in frames["postings"]])
        return out

    @classmethod
    def together(cls, indexes: dict[str, Index]) -> Index:
        """Several indexes as one: scores compare, as frequencies, numbers and lengths are summed before anything is scored.

        Records keep their columns and get `index`, the name of theirs; keys are hashes of it and the key, and documents of
        different indexes are different ones, `name:doc_id`. Vectors are those of each index, so providers must agree."""
        first = next(iter(indexes.values()))
        if len({(x.provider.name, x.provider.dimension) for x in indexes.values()}) > 1:
            raise ValueError("indexes with vectors of different providers cannot be searched as one")

        def of(frame: DataFrame, name: str, keys: tuple[str, ...] = ("key",)) -> DataFrame:
            return frame.withColumns({k: F.xxhash64(F.lit(name), k) for k in keys})

        def every(make: Callable[[str, Index], DataFrame | None]) -> DataFrame | None:
            frames = [f for name, x in indexes.items() if (f := make(name, x)) is not None]
            return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

        out = cls(
            every(lambda name, x: of(_dealt(x.records), name).withColumns({"doc_id": F.concat_ws(":", F.lit(name), F.col("doc_id").cast("string")), "index": F.lit(name)})),
            every(lambda name, x: of(x.edges.select("src", "dst"), name, ("src", "dst")) if x.edges is not None else None),
            every(lambda name, x: of(_shared(x.counts, x.records), name)), every(lambda name, x: of(_shared(x.embeddings, x.records), name)), first.provider,
        )
        each = [x.frequencies if x.frequencies is not None else S.frequencies(x.counts) for x in indexes.values()]
        out.frequencies = functools.reduce(DataFrame.unionByName, [f.select("term", "df") for f in each]).groupBy("term").agg(F.sum("df").alias("df"))
        sums = [x.stats for x in indexes.values()]
        n = sum(s[0] for s in sums)
        out.stats = (n, sum(s[0] * s[1] for s in sums if s[0]) / n if n else None)
        return out

    # Upkeep of a written index

    def fresh(self) -> bool:
        """Whether nothing was committed since this was opened."""
        return self.store.numbers()[-1] == self.manifest.number

    def refreshed(self) -> Index:
        return self if self.fresh() else Index.open(self.store.spark, self.store.folder, provider=self.provider, probed=False)

    def change(self, records: DataFrame | None = None, removed: DataFrame | None = None, edges: DataFrame | None = None, files: DataFrame | None = None, links: DataFrame | None = None, stream: tuple[str, int] | None = None, vectors: bool = True) -> Index:
        """The index after a commit: documents of `records` take the place of what had their doc_id, those of `removed`
        (doc_id) go; the rest is not touched. Keys are unique, but a document may keep its own.

        edges: src and dst of the new records; files: doc_id and what is to be known of the documents' files; links: doc_id,
        target, priority, target_doc and edge_type, of which the first target that is in the index holds. A batch
        of a stream (its name and number) that is in already changes nothing. Without `vectors` the records are found by
        words first; `embed_missing` makes the vectors. Two writers never lose each other's changes: the later one looks
        again at what its documents replace."""
        store, spark = self.store, self.store.spark
        part = docs = None
        # Without documents or files nothing is written.
        names = [x.select(F.col("doc_id").cast("string").alias("doc_id")) for x in (records, removed, files) if x is not None]
        if not names:
            return self
        docs = staged(functools.reduce(DataFrame.unionByName, names).distinct(), "changed-docs")
        if records is not None:
            part = _segment(store, f"segments/{uuid.uuid4().hex}", records, None, embedded(records, self.provider) if vectors else None, edges, files, links)

        def next_(m: Manifest) -> Manifest | None:
            if stream is not None and m.streams.get(stream[0], -1) >= stream[1]:
                return None
            number = m.number + 1
            gone = _deletion(store, m, docs, number)
            if vectors and (others := {p.model for p in m.segments} - {"", self.provider.name}):
                raise ValueError(f"the index has vectors of {', '.join(sorted(others))} by now: open it with that provider")
            own = () if part is None else (replace(part, commit=number, model=self.provider.name if vectors else ""),)
            segments = m.segments + own
            return Manifest(m.number, segments, m.deletions + ((gone,) if gone is not None else ()), m.streams | (dict([stream]) if stream is not None else {}))

        return Index.open(spark, store.folder, provider=self.provider, number=store.commit(next_).number, probed=False)

    def embed_missing(self) -> Index:
        """The index with the vectors of segments that were written without."""
        store = self.store
        for part in self.manifest.segments:
            if "embeddings" not in part.tables:
                at = f"{part.path}/vectors-{uuid.uuid4().hex}"
                table = {"embeddings": store.write(sorted_by_key(embedded(store.read(part, "records"), self.provider)), at, "embeddings", ("_kind", "_project"))}

                def next_(m: Manifest, part=part, table=table, at=at) -> Manifest | None:
                    if part not in m.segments:
                        return None
                    done = replace(part, tables=part.tables | table, places=part.places | {"embeddings": at}, model=self.provider.name)
                    if {p.model for p in m.segments} - {"", self.provider.name}:
                        raise ValueError(f"the index has vectors of another model than {self.provider.name}")
                    return Manifest(m.number, tuple(done if p == part else p for p in m.segments), m.deletions, m.streams)

                store.commit(next_)
        return self.refreshed()

    def merged(self) -> Index:
        """The index with one segment in place of those of a crowded size class, without the rows that are gone. No text is
        read for words or vectors again. Deletions that apply to no segment any more are taken off the sums, and go."""
        store, m = self.store, self.manifest
        some = store.crowded(m)
        if not some:
            return self
        if any(store.read(p, name) is None for p in some for name in ("records", "counts", "frequencies", "postings")):
            return self
        if len({"embeddings" in p.tables for p in some}) > 1:
            return self.embed_missing().merged()
        live = lambda name, table="keys", key="key": store.live(m, [(p, f) for p in some if (f := store.read(p, name)) is not None], table, key)
        edges = store.live(m, [(p, f.withColumn("key", F.col("src"))) for p in some if (f := store.read(p, "edges")) is not None])
        last = max(p.commit for p in some)
        left = [p for p in m.segments if p not in some]
        folded = tuple(d for d in m.deletions if all(p.commit >= d.commit for p in left) and last >= d.commit)
        sums = [store.read(p, "frequencies") for p in some] + [store.read(d, "frequencies").withColumn("df", -F.col("df")) for d in folded]
        sums = functools.reduce(DataFrame.unionByName, sums).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").sort("term")
        part = _segment(store, f"segments/{uuid.uuid4().hex}", live("records"), live("counts"), live("embeddings"), edges.drop("key") if edges is not None else None, live("files", "docs", "doc_id"), live("links", "docs", "doc_id"), sums)
        part = replace(part, commit=last, model=next((p.model for p in some if "embeddings" in p.tables), ""), rows=sum(p.rows for p in some) - sum(d.rows for d in folded), length=sum(p.length for p in some) - sum(d.length for d in folded))

        def next_(now: Manifest) -> Manifest | None:
            if not set(_ids(some)) <= set(_ids(now.segments)):
                return None
            held = [p for p in now.segments if p.path not in _ids(some)]
            # A writer that came between may still need them.
            kept = tuple(d for d in now.deletions if d not in folded)
            return Manifest(now.number, (*held, part), kept, now.streams)

        return Index.open(store.spark, store.folder, provider=self.provider, number=store.commit(next_).number, probed=False)

    @functools.cached_property
    def stats(self) -> tuple[int, float]:
        """Number and mean length of rows."""
        return tuple(self.counts.agg(F.count("*"), F.avg("length")).first())

    def _folders(self, rows: DataFrame, request: Request) -> DataFrame:
        """The rows of the folders that a request's source kinds and projects lie in, and of these the ones that it wants."""
        for column, at, wanted in (("project", "_project", request.projects), ("source_kind", "_kind", request.source_kinds)):
            if wanted:
                if at in rows.columns:
                    rows = rows.where(F.col(at).isin(sorted({folder_of(x) for x in wanted})))
                if column in rows.columns:
                    rows = rows.where(F.col(column).isin(list(wanted)))
        return rows

    def scope(self, request: Request) -> DataFrame:
        """Records that filters leave: they are applied before any list is made."""
        rows = self._folders(self.records, request)
        for column, wanted in (("category", request.categories), ("author", request.authors)):
            if wanted:
                rows = rows.where(F.col(column).isin(list(wanted)))
        if request.modified_after is not None:
            rows = rows.where(F.col("modified_at") > request.modified_after)
        if request.excluded_files:
            rows = rows.where(~R.file_excluded(F.coalesce("file_path", F.lit("")), F.lit(""), F.array(*map(F.lit, request.excluded_files))))
        return rows

    def _terms(self, queries: DataFrame, request: Request) -> DataFrame:
        terms = S.query_terms(queries, "qid", F.col("query"))
        if not request.correct:
            return terms
        known = self.counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("count"))
        better = S.corrected(terms, known)
        return terms.unionByName(terms.join(better, "term").select("qid", F.col("correction").alias("term"))).distinct()

    def _few(self, queries: DataFrame, request: Request, limit: int) -> dict[str, Callable]:
        """How each strategy makes the lists of a few queries, as rows (qid, key, score, rank) that the driver holds: up to
        `limit` of each list. Every list is the k best of tasks' k best, without a window."""
        inside = self._inside(request)

        def numbered(qid: int, found: DataFrame) -> list[tuple]:
            return [(qid, r["key"], r["score"], i) for i, r in enumerate(found.collect(), 1)]

        def vector(_):
            return [x for qid, v in vectors_of(self.provider, queries, "qid", "query").items() for x in numbered(qid, S.cosine_one(inside(self.embeddings), v, "key", "embedding", limit))]

        def keyword(_):
            if self.postings is None or request.filtered or request.correct:
                return None
            each = {r["qid"]: r["terms"] for r in queries.select("qid", F.array_distinct(words(F.col("query"))).alias("terms")).collect()}
            every = sorted({t for x in each.values() for t in x})
            df = {r["term"]: r["df"] for r in self.frequencies.where(F.col("term").isin(every)).collect()} if every else {}
            alive = lambda rows: self.store.left(self.manifest, rows)
            return [x for qid, own in each.items() for x in numbered(qid, block_top(self.postings, self.counts, "key", own, df, self.stats, limit, alive))]

        def graph(made):
            if self.edges is None or not made:
                return None
            out = []
            for qid in sorted({r[0] for rows in made.values() for r in rows}):
                seeds = sorted({r[1] for rows in made.values() for r in rows if r[0] == qid})
                ends = [self.edges.where(F.col(a).isin(seeds) & ~F.col(b).isin(seeds)).select(F.col(a).alias("seed"), F.col(b).alias("key")) for a, b in (("src", "dst"), ("dst", "src"))]
                near = inside(ends[0].unionByName(ends[1]).distinct().groupBy("key").agg(F.count("*").cast("double").alias("score")))
                out += numbered(qid, near.orderBy(F.desc("score"), "key").limit(limit))
            return out

        return {"vector": vector, "keyword": keyword, "graph": graph}

    def _inside(self, request: Request) -> Callable[[DataFrame], DataFrame]:
        """Leaves the rows of a frame with the column `key` that are in a request's scope."""
        scope = self.scope(request).select("key")
        # Kinds and projects are columns of written tables; other conditions are those of records.
        other = any((request.excluded_files, request.categories, request.authors, request.modified_after is not None))

        def inside(f: DataFrame) -> DataFrame:
            if not request.filtered:
                return f
            own = self._folders(f, request)
            return own if not other and set(SHARED) <= set(f.columns) else own.join(scope, "key", "left_semi")

        return inside

    def lists(self, queries: DataFrame, request: Request, limit: int) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame | None]]:
        """How each strategy makes its list (qid, key, score, rank) from those made before."""
        inside = self._inside(request)

        def vector(_):
            # Queries have negative keys here: no query is a record.
            vectors = self.provider.embed(queries, "qid", "query").select((-F.col("qid") - 1).alias("key"), "embedding")
            return S.cosine_top(inside(self.embeddings), vectors, "key", "embedding", limit).select((-F.col("query_id") - 1).alias("qid"), "key", "score", "rank")

        def keyword(_):
            terms = self._terms(queries, request)
            if request.filtered:
                return S.bm25_top(inside(self.counts), "key", terms, "qid", limit)
            return S.bm25_top(self.counts, "key", terms, "qid", limit, self.frequencies, self.stats)

        def seeds(made):
            out = None
            for f in made.values():
                out = f.select("qid", "key") if out is None else out.unionByName(f.select("qid", "key"))
            return out.distinct()

        def graph(made):
            if self.edges is None or not made:
                return None
            first = seeds(made)
            both = self.edges.select("src", "dst").unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
            near = first.withColumnRenamed("key", "src").join(both, "src").select("qid", F.col("dst").alias("key")).groupBy("qid", "key").agg(F.count("*").cast("double").alias("score"))
            return S.top(inside(near.join(first, ["qid", "key"], "left_anti")), "qid", "key", limit)

        def expansion(made):
            if not request.expand_tags or not made:
                return None
            return S.shared_tags(seeds(made), inside(self.records.select("key", "tags")), "qid", "key", limit)

        return {"vector": vector} if request.semantic_only else {"vector": vector, "keyword": keyword, "graph": graph, "expansion": expansion}

    def hits(self, queries: DataFrame, request: Request, failures: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """qid, key, strategy, score and rank of the candidates of each list. queries: qid long and query.

        With a list of failures, each strategy is run by itself: one that fails is named there, and the others answer."""
        limit = limit or S.candidate_limit(request.top_n, request.top_k, bool(request.projects), request.max_chunks_per_doc, request.source_kinds == ("git_commit",))
        made: dict[str, DataFrame] = {}
        for name, make in self.lists(queries, request, limit).items():
            found = self._tried(name, lambda make=make: make(dict(made)), failures)
            if found is not None:
                found = found.select("qid", "key", "score", "rank")
                made[name] = found if failures is None and name in ("graph", "expansion") else staged(found, name)
        out = queries.sparkSession.createDataFrame([], "qid long, key long, strategy string, score double, rank int")
        for name, found in made.items():
            out = out.unionByName(found.select("qid", "key", F.lit(name).alias("strategy"), "score", F.col("rank").cast("int").alias("rank")))
        return out

    @staticmethod
    def _tried(name: str, run: Callable, failures: list[str] | None):
        try:
            return run()
        except Exception as error:  # a strategy may fail in any way that its provider does
            if failures is None:
                raise
            failures.append(f"{name}: {str(error).splitlines()[0][:200] if str(error) else type(error).__name__}")
            return None

    def few_hits(self, queries: DataFrame, request: Request, failures: list[str] | None = None) -> list[tuple]:
        """As `hits`, of a few queries, on the driver: (qid, key, strategy, score, rank). Vectors and words are looked up side by side."""
        limit = S.candidate_limit(request.top_n, request.top_k, bool(request.projects), request.max_chunks_per_doc, request.source_kinds == ("git_commit",))
        few, all_ = self._few(queries, request, limit), self.lists(queries, request, limit)
        made: dict[str, list[tuple]] = {}

        def run(name: str) -> list[tuple] | None:
            def make():
                rows = few[name](dict(made)) if name in few else None
                if rows is None and (name not in few or name == "keyword"):
                    frames = {n: local(queries.sparkSession, x) for n, x in made.items()}
                    found = all_[name](frames)
                    rows = None if found is None else [tuple(r) for r in found.select("qid", "key", F.col("score").cast("double"), F.col("rank").cast("int")).collect()]
                return rows

            return self._tried(name, make, failures)

        alone = [name for name in all_ if name in ("vector", "keyword")]
        with ThreadPoolExecutor(len(alone)) as pool:
            made |= {name: rows for name, rows in zip(alone, list(pool.map(run, alone)), strict=True) if rows is not None}
        for name in all_:
            if name not in alone and (rows := run(name)) is not None:
                made[name] = rows
        return [(qid, key, name, score, rank) for name, rows in made.items() for qid, key, score, rank in rows]

    def results(self, queries: DataFrame, request: Request, hits: DataFrame, keys: list[int] | None = None) -> DataFrame:
        """All results of hits, with their rank: floor or abstention, metadata rank, re-ranking, limit by document."""
        records, embeddings = self.records, self.embeddings
        if keys is not None:
            # Some hundred keys: records are read by their pages, and what is left is one task's work.
            records, embeddings = records.where(F.col("key").isin(keys)), embeddings.where(F.col("key").isin(keys))
        if request.adaptive:
            fused = R.rrf(R.type_weights(hits, queries, "qid", "query"), "qid", "key")
        else:
            fused = R.rrf(hits, "qid", "key", request.weights)
        # Equal sums of reciprocals may differ in their last bits.
        fused = fused.withColumn("score", F.round("score", 12))
        rows = fused.join(records, "key").join(queries.select("qid", "query"), "qid")
        rows = rows.repartition(1) if keys is not None else rows
        if request.uplift and request.project_context:
            rows = rows.withColumn("score", R.uplift(F.col("score"), F.col("project"), F.lit(request.project_context)))
        place = F.concat_ws(" ", "title", "header_path", "file_path")
        if request.min_score is not None:
            rows = rows.where(F.col("score") >= request.min_score)
        elif request.source_kinds != ("git_commit",):
            rows = rows.where((F.col("score") >= R.FLOOR) | lexical_match(F.col("query"), place, F.col("body"), F.array_contains("strategies", "keyword")))
        rows = rows.withColumn("metadata_rank", metadata_rank(F.col("query"), F.col("title"), F.col("header_path"), F.col("file_path")))
        order = [F.desc("metadata_rank"), F.desc("score"), "key"]
        if request.reranker is not None:
            rows = R.reranked(rows, "qid", "key", "query", "body", request.reranker, request.rerank_budget).drop("rank")
            order = [F.desc("metadata_rank"), F.desc_nulls_last("rerank_score"), F.desc("score"), "key"]
        document = F.coalesce(F.nullif(F.col("doc_id").cast("string"), F.lit("")), F.concat(F.lit("file:"), F.col("file_path")), F.col("key").cast("string"))
        rows = R.first_of(rows.withColumn("_document", document), ["qid", "_document"], order, request.max_chunks_per_doc).drop("_document")
        if request.similarity_threshold is not None:
            kept = R.semantic_dedup(rows.join(embeddings, "key", "left"), "qid", "key", "embedding", request.similarity_threshold).select("qid", "key")
            rows = rows.join(kept, ["qid", "key"], "left_semi")
        if request.calibrate:
            rows = rows.withColumn("confidence", R.calibrated(F.col("score")))
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))

    def search(self, queries: DataFrame, request: Request | None = None, failures: list[str] | None = None) -> DataFrame:
        """qid, rank, key, doc_id, score, strategies and record columns of the results of every query, the first top_n."""
        request = request or Request()
        return self.results(queries, request, self.hits(queries, request, failures)).where(F.col("rank") <= request.top_n)

    def search_few(self, queries: list[str], request: Request | None = None, failures: list[str] | None = None) -> DataFrame:
        """As `search`, of up to FEW_QUERIES queries, numbered from 0, that the driver holds: their lists are made side by
        side and come to the driver, keywords are looked up in the blocks of their terms, and nothing is written."""
        request, spark = request or Request(), self.records.sparkSession
        asked = list(enumerate(queries))
        if len(asked) > FEW_QUERIES:
            return self.search(spark.createDataFrame(asked, "qid long, query string"), request, failures)
        frame = spark.createDataFrame(pa.table({"qid": pa.array([i for i, _ in asked], pa.int64()), "query": pa.array([q for _, q in asked], pa.string())}))
        hits = self.few_hits(frame, request, failures)
        names = [("qid", pa.int64()), ("key", pa.int64()), ("strategy", pa.string()), ("score", pa.float64()), ("rank", pa.int32())]
        table = pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*hits, strict=True) if hits else [[]] * 5, names, strict=True)], names=[n for n, _ in names])
        return self.results(frame.coalesce(1), request, spark.createDataFrame(table).coalesce(1), sorted({h[1] for h in hits})).where(F.col("rank") <= request.top_n)

    def _said(self, query: str) -> str:
        if not query.strip():
            raise ValueError("the query is empty")
        return query.strip()

    def _one(self, query: str) -> DataFrame:
        return self.records.sparkSession.createDataFrame([(0, self._said(query))], "qid long, query string")

    def query_documents(self, query: str, request: Request | None = None) -> DataFrame:
        """Results of one query."""
        return self.search_few([self._said(query)], request).orderBy("rank")

    def answer(self, arguments: dict) -> dict:
        """The response to a call: status, results and whether a strategy failed, or what is wrong with the call."""
        try:
            query, request = Request.parse(arguments)
        except ValueError as error:
            return {"status": "error", "error": "validation_error", "message": str(error)}
        failures: list[str] = []
        rows = self.search_few([self._said(query)], request, failures)
        shown = rows.select("rank", F.col("key").alias("chunk_id"), "doc_id", "file_path", "header_path", "score", content(F.col("query"), F.col("body")).alias("content"), F.col("project").alias("project_id")).orderBy("rank").drop("rank")
        return {"status": "ok", "results": [r.asDict() for r in shown.collect()], "degraded": bool(failures), "failures": failures}

    def search_with_hypothesis(self, hypothesis: str, request: Request | None = None) -> DataFrame:
        """Results near a made-up answer, by vectors alone."""
        return self.query_documents(hypothesis, replace(request or Request(), semantic_only=True))

    def search_git_history(self, query: str, files_glob: str | None = None, after: int | None = None, before: int | None = None, top_n: int = 5, include_diff: bool = False) -> DataFrame:
        """One result a commit, the first top_n commits.

        Time and file conditions are applied before candidates are taken. Each list has WIDE times top_n chunks, WIDER times
        with a condition that is not empty, and 20 at least; all of them count for their commits. Records of commits have
        commit_id, section, committed_at (seconds) and files_changed besides, and may have author. A message is told of a chunk of the
        body, a diff of one of a diff and only if asked for."""
        rows = self.records.where("source_kind = 'git_commit'")
        if after is not None:
            rows = rows.where(F.col("committed_at") > after)
        if before is not None:
            rows = rows.where(F.col("committed_at") < before)
        if files_glob:
            pattern = glob_pattern(files_glob)
            rows = rows.where(F.exists("files_changed", lambda f: f.rlike(pattern)))
        keys = rows.select("key")
        part = Index(rows, self.edges, self.counts.join(keys, "key", "left_semi"), self.embeddings.join(keys, "key", "left_semi"), self.provider)
        request = Request(top_n=min(100, top_n), source_kinds=("git_commit",), max_chunks_per_doc=0)
        queries = self._one(query)
        found = staged(part.results(queries, request, part.hits(queries, request, limit=max(20, top_n * (WIDER if files_glob or after or before else WIDE)))), "commits")
        hits = found.select("qid", "commit_id", F.col("key").alias("chunk_id"), "section", "score", F.col("rank").alias("position"))
        commits = R.commit_results(hits, "qid").orderBy(F.desc("score"), "commit_id").limit(top_n)
        author = "author" if "author" in found.columns else F.lit(None).cast("string").alias("author")
        own = found.select(F.col("key").alias("chunk_id"), "title", author, F.col("committed_at").alias("timestamp"), "files_changed", "section", "body")
        message, diff = F.when(F.col("section") == "body", F.col("body")), F.when(F.lit(include_diff) & (F.col("section") == "diff"), F.col("body"))
        return commits.join(own, "chunk_id").select(*commits.columns, "title", "author", "timestamp", "files_changed", message.alias("message"), diff.alias("diff")).orderBy(F.desc("score"), "commit_id")


def document_edges(links: DataFrame, records: DataFrame) -> DataFrame:
    """src, dst and edge_type: every record of a linking document to every record of the one that its link leads to."""
    docs = records.select(F.col("doc_id").alias("target_doc")).distinct()
    first = links.join(docs, "target_doc").groupBy("doc_id", "target").agg(F.min_by(F.struct("target_doc", "edge_type"), "priority").alias("to")).select("doc_id", "to.*").where("doc_id <> target_doc").distinct()
    a, b = records.select(F.col("key").alias("src"), "doc_id"), records.select(F.col("key").alias("dst"), F.col("doc_id").alias("target_doc"))
    return first.join(a, "doc_id").join(b, "target_doc").select("src", "dst", "edge_type")


def _ids(parts) -> list[str]:
    return [p.path for p in parts]


#: What an empty index has of records.
RECORD = "key long, doc_id string, title string, body string, file_path string, header_path string, project string, source_kind string"


def _dealt(records: DataFrame) -> DataFrame:
    return records if {"_kind", "_project"} <= set(records.columns) else dealt(records)


def _shared(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Rows with their records' kind and project, and the folders of these."""
    if {"_kind", "_project", *SHARED} <= set(rows.columns):
        return rows
    return dealt(rows.join(records.select("key", *SHARED), "key"))


def counted(records: DataFrame) -> DataFrame:
    return _shared(S.term_counts(records, "key", {"content": "body"}), records)


def embedded(records: DataFrame, provider: Provider) -> DataFrame:
    return _shared(provider.embed(records, "key", "body"), records)


def sorted_by_key(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks by folder, large folders to several, and sorted, so that a key is found by its pages."""
    return rows.hint("rebalance", "_kind", "_project").sortWithinPartitions("_kind", "_project", "key")


def _segment(store: Store, path: str, records: DataFrame, counts: DataFrame | None, embeddings: DataFrame | None, edges: DataFrame | None = None, files: DataFrame | None = None, links: DataFrame | None = None, sums: DataFrame | None = None) -> Part:
    """A segment's tables, written; its sums are those of its counts."""
    records = records.withColumn("doc_id", F.col("doc_id").cast("string")) if not {"_kind", "_project"} <= set(records.columns) else records
    records = _dealt(records)
    by = ("_kind", "_project")
    tables = {"records": store.write(sorted_by_key(records), path, "records", by)}
    records = store.read(Part(path, 0, tables=tables), "records")
    tables["counts"] = store.write(sorted_by_key(_shared(counts, records) if counts is not None else counted(records)), path, "counts", by)
    counts = store.read(Part(path, 0, tables=tables), "counts")
    rows, length = counts.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0.0))).first()
    work = {
        "frequencies": lambda: store.write(sums if sums is not None else S.frequencies(counts), path, "frequencies", **SMALL_GROUPS),
        "postings": lambda: store.write(blocked(counts, "key", length / rows if rows else 1.0), path, "postings", **SMALL_GROUPS),
    }
    if embeddings is not None:
        work["embeddings"] = lambda: store.write(sorted_by_key(_shared(embeddings, records)), path, "embeddings", by)
    if edges is not None:
        work["edges"] = lambda: store.write(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst", "_commit")]), path, "edges")
    for name, frame in zip(OF_DOCUMENTS, (files, links), strict=True):
        if frame is not None:
            work[name] = lambda name=name, frame=frame: store.write(frame.withColumn("doc_id", F.col("doc_id").cast("string")), path, name)
    with ThreadPoolExecutor(len(work)) as pool:
        for name, schema in zip(work, pool.map(lambda f: f(), work.values()), strict=True):
            tables[name] = schema
    return Part(path, 0, rows, length, tables)


def _deletion(store: Store, m: Manifest, docs: DataFrame, commit: int) -> Part | None:
    """What a commit takes away: keys of the documents that a manifest holds, and their share of frequencies and sums."""
    held = store.live(m, [(p, store.read(p, "records").select("key", "doc_id")) for p in m.segments])
    told = store.live(m, [(p, f.select("doc_id")) for p in m.segments for name in OF_DOCUMENTS if (f := store.read(p, name)) is not None], "docs", "doc_id")
    path = f"deletions/{uuid.uuid4().hex}"
    none = docs.sparkSession.createDataFrame([], "key long, doc_id string")
    tables = {"keys": store.write((held if held is not None else none).join(docs, "doc_id", "left_semi").select("key"), path, "keys")}
    keys = store.read(Part(path, commit, tables=tables), "keys")
    gone = docs.join(told, "doc_id", "left_semi") if told is not None else docs.limit(0)
    tables["docs"] = store.write(gone.distinct(), path, "docs")
    if keys.isEmpty() and store.read(Part(path, commit, tables=tables), "docs").isEmpty():
        return None
    counts = store.live(m, [(p, store.read(p, "counts")) for p in m.segments])
    lost = counts.join(keys, "key", "left_semi")
    tables["frequencies"] = store.write(S.frequencies(lost), path, "frequencies", **SMALL_GROUPS)
    rows, length = lost.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0.0))).first()
    return Part(path, commit, rows, length, tables)


def content(query, body):
    """What an answer shows of a body: the first characters alone of one to a factual query."""
    short = F.when(F.length(body) > FACTUAL, F.concat(F.left(body, F.lit(FACTUAL)), F.lit("..."))).otherwise(body)
    return F.when(query_type(query) == "factual", short).otherwise(body)


def safe_metadata(metadata):
    """The fields of a map that answers show."""
    return F.map_filter(metadata, lambda k, _: k.isin(*SAFE))


def shown_hits(results: DataFrame) -> DataFrame:
    """Hits as other services read them: of results with qid, rank, score, project, source_kind, key, title, body, uri,
    file_path and metadata (a map of texts), source_rank, snippet, citation and safe metadata."""
    uri = F.coalesce(F.nullif(F.col("uri"), F.lit("")), F.concat(F.lit("file://"), F.nullif(F.col("file_path"), F.lit(""))))
    return results.select("qid", F.col("project").alias("workspace_id"), "source_kind", F.col("key").alias("source_id"), "title", F.left("body", F.lit(SNIPPET)).alias("snippet"), F.col("rank").alias("source_rank"), uri.alias("uri"), F.col("score").alias("native_score"), safe_metadata(F.col("metadata")).alias("metadata"))
