"""Records, edges, counts, changes of files, checkpoints and the whole search, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embed as E
from ..operators import projects as P
from ..operators import rank as R
from ..operators import records as N
from ..operators import retrieve as S
from ..operators import state as U
from ..plans.search import FACTUAL, SNIPPET, Index, Request, content, shown_hits
from ..scratch import staged
from ..session import table
from ..sources import files
from .chunks import commits
from .fusion import LISTS, lists
from .parsing import pages
from .registry import query
from .search import KEYWORD, VOCABULARY, embedding_sql, keyword_hits, scores_sql
from .upkeep import URLS, page_paths

NOTES = """select conv_id, turn, text, role, 'p' || conv_id % 3 || '|note|' || conv_id || '_chunk_' || turn as storage_key, 'c/' || conv_id || '.md' as file_path from conversations"""


def notes(spark, folder):
    """Conversations as documents, turns as their chunks."""
    rows = table(spark, folder, "conversations")
    text = lambda c: F.col(c).cast("string")
    none = F.array().cast("array<string>")
    documents = rows.select("conv_id").distinct().select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("c/"), text("conv_id"), F.lit(".md")).alias("file_path"), F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project"), F.lit(0).cast("timestamp").alias("modified_time"),
        F.create_map(F.lit("lang"), F.lit("of the document"), F.lit("kind"), F.lit("chat")).alias("metadata"), none.alias("links"), F.array(F.lit("chat")).alias("tags"),
    )
    header = F.when(F.col("role") == "user", F.concat(F.lit("Talk > "), text("turn"))).otherwise("")
    chunks = rows.select(F.col("conv_id").alias("doc_id"), F.concat(text("conv_id"), F.lit("_chunk_"), text("turn")).alias("chunk_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"), header.alias("header_path"), F.create_map(F.lit("lang"), F.col("role")).alias("metadata"))
    return N.note_records(chunks, documents)


@query(f"""select storage_key, case when role = 'user' then 'Talk > ' || turn else conv_id::varchar end as title, md5(text) as digest, role as lang, 'chat' as kind, turn::varchar as chunk_index, '["chat"]' as tags, 'file://' || file_path as uri from ({NOTES})""")
def chunk_records(spark, folder):
    """Metadata of the chunk win over those of the document."""
    m = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return notes(spark, folder).select("storage_key", "title", F.md5("body").alias("digest"), m("lang"), m("kind"), m("chunk_index"), m("tags"), "uri")


def commit_notes(spark, folder):
    from ..operators import chunk as C

    rows = commits(spark, folder).withColumn("timestamp", F.lit(0).cast("long")).withColumn("hash", F.col("hash").cast("string"))
    return N.commit_records(C.commit_chunks(rows), rows, "shop")


@query("select 'shop|git_commit|git:' || o_orderkey || ':' || s || ':0' as storage_key, 'git:' || o_orderkey as commit_id, o_orderpriority as title, s as section, 2 as chunk_count, 'shop' as project_id from orders, (values ('summary'), ('body')) v(s)")
def commit_records(spark, folder):
    return commit_notes(spark, folder).select("storage_key", "commit_id", "title", "section", F.col("chunk_count").cast("int").alias("chunk_count"), F.col("metadata")["project_id"].alias("project_id"))


@query("select conv_id, turn, md5(case when role = 'user' then 'Talk > ' || turn || chr(10) || chr(10) || text else text end) as digest from conversations")
def heading_weighted_text(spark, folder):
    rows = notes(spark, folder).select(F.col("doc_id").alias("conv_id"), F.col("metadata")["chunk_index"].cast("long").alias("turn"), N.weighted_text(F.col("header_path"), F.col("body")).alias("t"))
    return rows.select("conv_id", "turn", F.md5("t").alias("digest"))


@query("select 'note' as source_kind, count(*) as n from conversations union all select 'git_commit', count(*) from orders")
def record_counts(spark, folder):
    """Commits count once, whatever their chunks."""
    both = notes(spark, folder).select("source_kind", "source_id").unionByName(commit_notes(spark, folder).select("source_kind", "source_id"))
    return N.counts(both)


@query("select conv_id as doc_id, 'c/' || conv_id || '.md' as file_path, 'note' as source_kind, count(*) as chunk_count from conversations group by conv_id")
def document_descriptions(spark, folder):
    return N.descriptions(notes(spark, folder))


@query("""with r as (select l_orderkey, l_linenumber, 'o' || l_orderkey as doc, 'q' || l_orderkey % 4 as project from lineitem), p as (select p_partkey, 'p' || p_partkey as doc, c, 'q' || p_partkey % 4 as project from part, (values (0), (1)) v(c)), l as (select distinct l_orderkey, l_partkey from lineitem where l_linenumber = 1)
select r.project || '|note|' || r.doc || '_' || l_linenumber as src, p.project || '|note|' || p.doc || '_' || c as dst, 'links_to' as edge_type from l join r using (l_orderkey) join p on p_partkey = l_partkey""")
def graph_edges(spark, folder):
    """Orders link to the part of their first line: every chunk of an order to both chunks of the part."""
    text = lambda c: F.col(c).cast("string")
    item = table(spark, folder, "lineitem")
    named = lambda rows, letter, key, chunk: rows.select(F.concat(F.lit(letter), text(key)).alias("doc_id"), F.concat(F.lit("q"), (F.col(key) % 4).cast("string")).alias("project"), chunk.cast("string").alias("c"))
    records = named(item, "o", "l_orderkey", F.col("l_linenumber")).unionByName(named(table(spark, folder, "part").withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))), "p", "p_partkey", F.col("c")))
    records = records.withColumn("storage_key", N.storage_key(F.col("project"), F.lit("note"), F.concat_ws("_", "doc_id", "c")))
    links = item.where("l_linenumber = 1").select(F.concat(F.lit("o"), text("l_orderkey")).alias("source"), F.concat(F.lit("p"), text("l_partkey")).alias("target"), F.concat(F.lit("q"), (F.col("l_orderkey") % 4).cast("string")).alias("project"))
    return N.edges(links, records)


@query(f"""with p as (select page_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as folder from ({URLS})), c as (select 'folder' as kind, folder as "group" from p union all select 'tag', 't' || page_id % 9 from p) select kind, "group", count(*) as documents from c group by all""")
def implicit_edges(spark, folder):
    """Documents by their folder and tag, which stand between them."""
    rows = page_paths(spark, folder).select(F.col("page_id").alias("doc_id"), F.concat_ws("/", F.slice(F.split("path", "/"), 1, 2)).alias("f"), F.array(F.concat(F.lit("t"), (F.col("page_id") % 9).cast("string"))).alias("tags"))
    return N.implicit_edges(rows.withColumn("path", F.concat("f", F.lit("/x"))), "path", "tags").groupBy("kind", "group").agg(F.count("*").alias("documents"))


@query(f"""with p as (select page_id, path from ({URLS})), r as (select root, row_number() over (order by length(root), root) as i from (select distinct split_part(path, '/', 1) as root from p union select distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from p where split_part(path, '/', 2) = 'de') order by length(root), root limit 40),
f as (select page_id, coalesce(arg_min(root, i), '(none)') as root from p left join r on path = root or starts_with(path, root || '/') group by page_id), s as (select root, count(*) as discovered, count(*) filter (page_id % 3 <> 0) as documents, coalesce(cast(sum(page_id % 5 + 1) filter (page_id % 3 <> 0) as bigint), 0) as chunks from f group by root)
select root, discovered, documents, chunks, discovered - documents as remaining from s union all select '(all)', cast(sum(discovered) as bigint), cast(sum(documents) as bigint), cast(sum(chunks) as bigint), cast(sum(discovered) - sum(documents) as bigint) from s""")
def root_stats(spark, folder):
    """Forty roots, of which the first that holds a page has it."""
    rows = page_paths(spark, folder)
    part = F.split("path", "/")
    roots = rows.select(part[0].alias("root")).union(rows.where(part[1] == "de").select(F.concat_ws("/", part[0], part[1]))).distinct()
    names = [r["root"] for r in roots.orderBy(F.length("root"), "root").limit(40).collect()]
    return N.root_stats(rows, rows.where("page_id % 3 <> 0").select(F.col("path").alias("file_path"), (F.col("page_id") % 5 + 1).alias("chunk_count")), names)


@query("select 'moved|git_commit|git:' || o_orderkey || ':' || s || ':0' as storage_key, 'shop|git_commit|git:' || o_orderkey || ':' || s || ':0' as stale from orders, (values ('summary'), ('body')) v(s) where o_orderkey % 4 = 0")
def git_attribution(spark, folder):
    """Commits of one repository go to another project, under new keys; the old keys are stale."""
    records = commit_notes(spark, folder)
    right, stale = N.reattributed(records, commits(spark, folder).where("hash % 4 = 0").select("hash"), "moved")
    old = stale.withColumn("source_id", F.substring_index("storage_key", "|", -1)).withColumnRenamed("storage_key", "stale")
    return right.select("storage_key", "source_id").join(old, "source_id").select("storage_key", "stale")


@query("""with b as (select user_id, user_id % 3 as request, count(*) filter (event_type = 'click') as clicks, min(ts) as started from events where ts < timestamp '2024-01-15' group by user_id), n as (select user_id, case when user_id % 5 = 0 then 9 else user_id % 3 end as request, count(*) filter (event_type = 'click') as clicks, case when user_id % 2 = 0 then min(ts) end as started from events where ts >= timestamp '2024-01-15' group by user_id)
select user_id, n.request, case when n.request = b.request then greatest(n.clicks, b.clicks) else n.clicks end as clicks, case when n.request = b.request then coalesce(n.started, b.started) else n.started end as started from n left join b using (user_id)""")
def monotone_status(spark, folder):
    rows = table(spark, folder, "events")
    half = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    clicks = F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks")
    before = rows.where(F.col("ts") < half).groupBy("user_id").agg(clicks, F.min("ts").alias("started")).withColumn("request", F.col("user_id") % 3)
    now = rows.where(F.col("ts") >= half).groupBy("user_id").agg(clicks, F.min("ts").alias("s")).withColumn("request", F.when(F.col("user_id") % 5 == 0, 9).otherwise(F.col("user_id") % 3)).withColumn("started", F.when(F.col("user_id") % 2 == 0, F.col("s"))).drop("s")
    return U.monotone(before, now, "user_id", "request", ["clicks"], ["started"])


@query(f"""with o as (select page_id, path || '#' || page_id as path, page_id % 3 as m from ({URLS}) where page_id % 7 <> 0), n as (select page_id, path || '#' || page_id as path, page_id % 3 + case when page_id % 4 = 0 then 1 else 0 end as m from ({URLS}) where page_id % 5 <> 0)
select coalesce(n.path, o.path) as path, case when o.path is null then 'created' when n.path is null then 'deleted' else 'modified' end as change, case when n.path is null then 'remove' else 'index' end as action from o full join n on o.path = n.path where o.path is null or n.path is null or o.m <> n.m""")
def file_changes(spark, folder):
    """Two looks at the same pages as files."""
    rows = page_paths(spark, folder).select("page_id", F.concat_ws("#", "path", F.col("page_id").cast("string")).alias("path")).withColumn("file_path", F.col("path")).withColumn("size", F.lit(1))
    before = rows.where("page_id % 7 <> 0").withColumn("modified_time", F.col("page_id") % 3)
    now = rows.where("page_id % 5 <> 0").withColumn("modified_time", F.col("page_id") % 3 + F.when(F.col("page_id") % 4 == 0, 1).otherwise(0))
    return U.file_changes(before, now).select("path", "change", "action")


@query("select date_trunc('day', ts) as tick, least(count(*), 300) as taken, greatest(count(*) - 300, 0) as dropped, count(*) > 300 as reconcile from events group by 1")
def bounded_intake(spark, folder):
    rows = U.bounded_intake(table(spark, folder, "events"), F.date_trunc("day", F.col("ts").cast("timestamp")), 300)
    return rows.withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("select doc_id, lang from documents where doc_id > 40 order by doc_id limit 100")
def keyset_page(spark, folder):
    return U.page_after(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", 40, 100)


@query("select doc_id as path, n_chars as size from documents where doc_id % 3 <> 0 or doc_id % 2 <> 0 or lang <> 'en'")
def resume_identity(spark, folder):
    """Checkpoints of English documents were made with this configuration, of others with another."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("modified_time"), F.col("n_chars").alias("size"), "lang")
    own = U.identity(encoder="hashed", size=384)
    done = rows.where("path % 3 = 0").withColumn("modified_time", (F.col("path") % 2).cast("int")).withColumn("identity", F.when(F.col("lang") == "en", own).otherwise(U.identity(encoder="other", size=384)))
    return U.resumed(rows.drop("lang"), done, own).select("path", "size")


@query("select lang, 'available' as lexical, 'available' as graph, case when count(*) = count(*) filter (doc_id % 2 = 0) then 'complete' else 'backfilling' end as semantic from documents group by lang")
def availability(spark, folder):
    """Vectors of every other document are in."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), "lang")
    out = None
    for lang in sorted(r[0] for r in rows.select("lang").distinct().collect()):  # a handful of languages
        own = rows.where(F.col("lang") == lang)
        one = U.availability(own, own, own.where("path % 2 = 0")).select(F.lit(lang).alias("lang"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("select 'new' as model, 'old' as previous, true as whole, count(*) as kept, 'old' as after_rollback from embeddings")
def model_flip(spark, folder):
    """A new model's vectors are whole, so the pointer is set to it; a part of them would not do."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    vectors = rows.withColumn("model", F.lit("old")).unionByName(rows.withColumn("model", F.lit("new"))).unionByName(rows.where("key % 2 = 0").withColumn("model", F.lit("part")))
    pointer = spark.createDataFrame([("old", None)], "model string, previous string")
    flipped = U.flipped(pointer, vectors, "new")
    refused = U.flipped(pointer, vectors, "part").select((F.col("model") == "old").alias("stays"))
    kept = U.contracted(vectors, flipped).agg(F.count("*").alias("kept"))
    back = U.rolled_back(flipped).select(F.col("model").alias("after_rollback"))
    return flipped.join(F.broadcast(refused), "stays" == F.lit("stays")).where("stays").drop("stays").join(F.broadcast(kept)).join(F.broadcast(back))


@query(f"""with p as (select distinct path as place from ({URLS}) union select distinct split_part(path, '/', 1) from ({URLS})), r as (select distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as root from ({URLS}) where split_part(path, '/', 2) in ('de', 'fr')),
x as (select place, (select r.root from r where place = r.root or starts_with(place, r.root || '/') order by length(r.root) desc limit 1) as inside, exists (select 1 from r where starts_with(r.root, place || '/')) as holds from p)
select place, case when inside = place then 'already_registered' when inside is not null then 'inside_registered_project' when holds then 'contains_registered_project' else 'registered' end as reason, case when inside is not null then 'n ' || inside end as project from x where inside is not null or holds""")
def registration(spark, folder):
    """Places that are no new projects, and why; the names of new ones are tested."""
    rows = page_paths(spark, folder)
    part = F.split("path", "/")
    root = F.concat_ws("/", part[0], part[1])
    roots = rows.where(part[1].isin("de", "fr")).select(root.alias("root")).distinct().withColumn("project", F.concat(F.lit("n "), "root"))
    places = rows.select(F.col("path").alias("place")).union(rows.select(part[0])).distinct()
    return P.registration(places, roots, ["/", "/etc"]).where("reason <> 'registered'")


@query(f"select page_id as doc_id, path as file_path from ({URLS}) where split_part(path, '/', 2) = 'de' and split_part(path, '/', 1) in (select split_part(path, '/', 1) as h from ({URLS}) group by h order by h limit 10)")
def rebuild_scope(spark, folder):
    rows = page_paths(spark, folder).select(F.col("page_id").alias("doc_id"), F.col("path").alias("file_path"))
    host = F.substring_index("file_path", "/", 1)
    hosts = [r[0] for r in rows.select(host.alias("h")).distinct().orderBy("h").limit(10).collect()]
    return P.rebuild_scope(rows, [f"{h}/de/" for h in hosts])


@query("select o_custkey as repository, arg_min(case o_orderkey % 3 when 0 then 'w/main' when 1 then 'w/fix' else 'x/master' end || '', struct_pack(a := o_orderkey % 3 = 1, b := o_orderstatus <> 'O', c := o_orderstatus <> 'O', d := case o_orderkey % 3 when 0 then 'w/main' when 1 then 'w/fix' else 'x/master' end)) as root from orders group by 1")
def worktree_choice(spark, folder):
    """The main copy of each repository, by the names of folders and branches."""
    root = F.when(F.col("o_orderkey") % 3 == 0, "w/main").when(F.col("o_orderkey") % 3 == 1, "w/fix").otherwise("x/master")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("repository"), root.alias("root"), F.when(F.col("o_orderstatus") == "O", "main").otherwise("topic").alias("branch"))
    return P.main_copy(rows, "repository", "root", "branch")


@query("select p_partkey, p_brand as target, p_type as header from part union all select p_partkey, p_type, 'Tests' from part")
def link_headings(spark, folder):
    """The last heading before each link of a Markdown page."""
    return files.links_with_context(pages(spark, folder), "p_partkey", "page")


@query(f"""with v as materialized ({VOCABULARY}), t as (select distinct substr(w, 1, 1) || substr(w, 3) as term from (select unnest(regexp_extract_all(regexp_replace(lower(text), '[^\\x00-\\x7f]', 'é', 'g'), '(?:^|[^a-z0-9_-])?([a-z][a-z0-9_-]*)', 1)) as w from benchmark) where length(w) >= 5)
select t.term, arg_min(v.term, struct_pack(c := -count, t := v.term)) as correction from t join v on levenshtein(t.term, v.term) <= 1 where t.term not in (select term from v) and length(t.term) >= {S.LEAST_LENGTH} group by t.term""")
def typo_corrections(spark, folder):
    """Words of the benchmark that lack their second letter, and what the vocabulary has for them."""
    blank = lambda name: table(spark, folder, name).select(F.regexp_replace(F.lower("text"), r"[^\x00-\x7f]", " ").alias("text"))
    words = blank("benchmark").select(F.explode(T.vocabulary_terms(F.col("text"))).alias("w")).where(F.length("w") >= 5)
    typed = words.select(F.concat(F.substring("w", 1, 1), F.expr("substring(w, 3)")).alias("term")).distinct()
    return S.corrected(typed, staged(S.vocabulary(blank("documents"), "text"), "vocabulary"))


@query(f"""with {scores_sql()}, {KEYWORD}, g as (select doc_id, [source, lang] as tags from documents), w as (select item_id, list_distinct(flatten(list(tags))) as wanted, list(doc_id) as held from k join g using (doc_id) where rank <= 5 group by item_id),
f as (select item_id, doc_id, len(list_intersect(wanted, tags))::double as score from w join g on list_has_any(wanted, tags) and not list_contains(held, doc_id)) select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from f qualify rank <= 20""")
def tag_expansion_hits(spark, folder):
    """Documents that share the source or language of the best hits, as a list of its own."""
    tags = table(spark, folder, "documents").select("doc_id", F.array("source", "lang").alias("tags"))
    return S.shared_tags(keyword_hits(spark, folder, 5), tags, "item_id", "doc_id", 20)


@query("""with d as (select sha256(text) as h, count(*) as n, count(*) filter (doc_id % 2 = 0) as old from documents group by 1) select cast(sum(n) as bigint) as rows, count(*) filter (old > 0) as hits, count(*) filter (old = 0) as misses, cast(sum(n) as bigint) as embedded from d""")
def embedding_cache(spark, folder):
    """Texts of even documents are in the cache; the others are encoded, each once."""
    rows = table(spark, folder, "documents").select("doc_id", "text")
    provider = E.Hashed()
    cache = rows.where("doc_id % 2 = 0").select(E.content_hash("text").alias("content_hash")).distinct().select("content_hash", F.lit(provider.name).alias("model"), F.array(F.lit(0.0)).alias("embedding"))
    out, _, counts = E.cached(rows, "doc_id", "text", provider, cache)
    return counts.join(F.broadcast(out.where("embedding is not null").agg(F.count("*").alias("embedded"))))


@query(f"""with {scores_sql()}, {KEYWORD}, h as (select item_id, doc_id, score, rank, length(text)::double as s from k join documents using (doc_id) where rank <= 20)
select item_id, doc_id, case when rank <= 5 then s end as rerank_score, row_number() over (partition by item_id order by case when rank <= 5 then s end desc nulls last, rank) as rank from h""")
def rerank_budget(spark, folder):
    """The five best hits by another scorer, here the length of texts; the others follow as they were."""
    hits = keyword_hits(spark, folder, 20).drop("rank").join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").join(table(spark, folder, "benchmark").select("item_id", F.col("text").alias("query")), "item_id")
    return R.reranked(hits, "item_id", "doc_id", "query", "text", lambda: lambda _, texts: [float(len(t)) for t in texts], 5).select("item_id", "doc_id", "rerank_score", "rank")


TYPES = """case when regexp_matches(text, '[a-z][A-Z]|[A-Z]{2,}[a-z]|\\b[a-z]+_[a-z_]+\\b|`[^`]+`|\\b[vV]?\\d+\\.\\d+(\\.\\d+)?(-\\w+)?\\b|"[^"]+"') then 'factual' when regexp_matches(lower(text), 'section|chapter|guide|tutorial|documentation|docs') or regexp_matches(text, '\\[\\[[^\\]]+\\]\\]') then 'navigational' else 'exploratory' end"""


@query(f"""with {LISTS}, kinds as (select item_id, {TYPES} as kind from benchmark) select item_id, doc_id, round(sum(case when kind = 'factual' and strategy = 'keyword' then 1.5 else 1.0 end / (60 + rank)), 6) as score from u join kinds using (item_id) group by all""")
def adaptive_weights(spark, folder):
    """The list that suits a query's type counts more."""
    hits = R.type_weights(lists(spark, folder), table(spark, folder, "benchmark"), "item_id", "text")
    return R.rrf(hits, "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""with {scores_sql()}, {KEYWORD}, h as (select * from k join documents using (doc_id) where rank <= 5)
select item_id as qid, source as workspace_id, doc_id as source_id, md5(left(text, {SNIPPET})) as snippet, rank as source_rank, 'file://' || source || '/' || doc_id || '.md' as uri, map {{'doc_id': doc_id::varchar, 'file_path': source || '/' || doc_id || '.md'}}::varchar as metadata from h""")
def shown_results(spark, folder):
    """Hits as others read them: a snippet, a citation, and safe fields of metadata alone."""
    docs = table(spark, folder, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    metadata = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("file_path"), path, F.lit("secret"), F.lit("not shown"))
    hits = keyword_hits(spark, folder, 5).join(docs, "doc_id").select(F.col("item_id").alias("qid"), F.col("source").alias("project"), F.lit("note").alias("source_kind"), F.col("doc_id").alias("key"), F.lit("").alias("title"), F.col("text").alias("body"), "rank", F.lit("").alias("uri"), path.alias("file_path"), "score", metadata.alias("metadata"))
    written = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ", "), F.lit("}"))
    return shown_hits(hits).select("qid", "workspace_id", "source_id", F.md5("snippet").alias("snippet"), F.col("source_rank"), "uri", written.alias("metadata"))


@query(f"select conv_id, turn, length(case when {TYPES} = 'factual' and length(text) > {FACTUAL} then left(text, {FACTUAL}) || '...' else text end) as n_chars from conversations")
def shown_content(spark, folder):
    """What an answer shows where the text itself is the query."""
    return table(spark, folder, "conversations").select("conv_id", "turn", F.length(content(F.col("text"), F.col("text"))).cast("long").alias("n_chars"))


INDEXED = f"""{scores_sql()}, {KEYWORD}, de as materialized ({embedding_sql('documents', 'doc_id')}), qe as materialized ({embedding_sql('benchmark', 'item_id')}),
c as (select item_id, doc_id, round(sum(qe.value * de.value), 9) as score from qe join de using (place) group by all), n as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from c),
two as (select item_id, doc_id, 'keyword' as strategy, rank from k where rank <= 20 union all select item_id, doc_id, 'vector', rank from n where rank <= 20),
e as (select a.doc_id as src, b.doc_id as dst from documents a join documents b on b.doc_id = a.doc_id + 1 and a.lang = b.lang), b2 as (select src, dst from e union select dst, src from e), seeds as (select distinct item_id, doc_id from two),
g as (select item_id, dst as doc_id, count(*) as score from seeds join b2 on doc_id = src group by all), g2 as (select g.* from g anti join seeds using (item_id, doc_id)), g3 as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from g2),
u as (select * from two union all select item_id, doc_id, 'graph', rank from g3 where rank <= 20), f as (select item_id, doc_id, round(sum(1.0 / (60 + rank)), 12) as score, list_sort(list(strategy)) as strategies from u group by all),
m as (select f.*, d.text, b.text as query, d.source, d.lang, case when contains(lower(d.source), lower(trim(b.text))) or contains(lower(d.source || '/' || d.doc_id || '.md'), lower(trim(b.text))) or contains(lower(d.lang), lower(trim(b.text))) then 2 else 0 end as metadata_rank from f join documents d using (doc_id) join benchmark b using (item_id)),
z as (select *, row_number() over (partition by item_id order by metadata_rank desc, score desc, doc_id) as rank from m where score >= 0.01)"""


def document_index(spark, folder):
    docs = table(spark, folder, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    records = docs.select(F.col("doc_id").alias("key"), "doc_id", F.col("source").alias("title"), F.col("text").alias("body"), path.alias("file_path"), F.col("lang").alias("header_path"), F.col("source").alias("project"), F.lit("note").alias("source_kind"))
    edges = docs.select(F.col("doc_id").alias("src"), "lang", (F.col("doc_id") + 1).alias("dst")).join(docs.select(F.col("doc_id").alias("dst"), "lang"), ["dst", "lang"]).select("src", "dst")
    return Index(records, edges)


@query(f"with {INDEXED} select item_id as qid, rank, doc_id, round(score, 6) as score, strategies from z where rank <= 5")
def index_search(spark, folder):
    """The whole plan: keyword, hashed-vector and graph lists, fusion, abstention, metadata rank and limits."""
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    rows = document_index(spark, folder).search(queries, Request(top_n=5))
    return rows.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"), "strategies")


@query(f"""select doc_id, chunk_index, md5(c) as digest from (select doc_id, unnest(l) as c, generate_subscripts(l, 1) - 1 as chunk_index from (select doc_id, list_transform(range(0, greatest(1, cast(ceil((length(text) - 200) / 800.0) as bigint))), lambda i: substr(text, i * 800 + 1, 1000)) as l from documents where length(text) > 0))""")
def window_chunks(spark, folder):
    """Sliding windows of 1,000 characters, 200 of them shared."""
    from ..operators import chunk as C

    return table(spark, folder, "documents").select("doc_id", F.posexplode(C.windows(F.col("text"), 1000, 200)).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.md5("c").alias("digest"))
