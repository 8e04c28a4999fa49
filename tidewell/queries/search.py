"""Postings, BM25, vectors, graph neighbours, vocabulary; the flagship hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import hash_embedding
from ..operators import rank as R
from ..operators import retrieve as S
from ..operators.cells import Cells
from ..scratch import staged
from ..session import table
from .registry import query

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
POSTINGS = f"select doc_id, term, count(*) as tf from (select doc_id, unnest({WORDS.format('text')}) as term from documents) group by all"
TERMS = f"select distinct item_id, unnest({WORDS.format('text')}) as term from benchmark"


def scores_sql(postings: str = POSTINGS) -> str:
    """CTEs p (postings), q (query terms) and s (scores), as `bm25` has them."""
    return f"""p as materialized ({postings}), q as materialized ({TERMS}), l as (select doc_id, sum(tf) as length from p group by all), t as (select count(*) as n, avg(length) as mean from l),
d as (select term, count(*) as df from p group by all), s as (select item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {S.K1 + 1} / (tf + {S.K1} * (1 - {S.B} + {S.B} * length / mean))) as score
from q join d using (term) join p using (term) join l using (doc_id), t group by all)"""


def item_terms(spark, folder):
    return S.query_terms(table(spark, folder, "benchmark"), "item_id", F.col("text"))


def keyword_hits(spark, folder, k):
    """Scores have 9 digits, so that equal ones tie on either engine."""
    counts = staged(S.term_counts(table(spark, folder, "documents"), "doc_id", {"content": "text"}), "postings")
    return S.bm25_top(counts, "doc_id", item_terms(spark, folder), "item_id", k)


KEYWORD = "k as (select item_id, doc_id, round(score, 9) as score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from s)"


@query(POSTINGS)
def tokenize_postings(spark, folder):
    return S.postings(table(spark, folder, "documents"), "doc_id", "text")


@query(f"select term, count(*) as df, cast(sum(tf) as bigint) as cf from ({POSTINGS}) group by all")
def doc_freq(spark, folder):
    return S.document_frequencies(S.postings(table(spark, folder, "documents"), "doc_id", "text"))


@query(f"select count(*) as n, round(avg(length), 6) as mean_length, max(length) as longest from (select doc_id, cast(sum(tf) as bigint) as length from ({POSTINGS}) group by all)")
def corpus_stats(spark, folder):
    size = S.lengths(S.postings(table(spark, folder, "documents"), "doc_id", "text"), "doc_id")
    return size.agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean_length"), F.max("length").alias("longest"))


@query(f"with {scores_sql()}, {KEYWORD} select item_id, doc_id, round(score, 6) as score, rank from k where rank <= 10")
def bm25_topk(spark, folder):
    return keyword_hits(spark, folder, 10).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


PAGE_FIELDS = r"""select page_id as doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_replace(regexp_replace(html, '(?s)<(script|style|head)[^>]*>.*?</(script|style|head)>', ' ', 'g'), '<[^>]*>', ' ', 'g') as body from pages"""


@query(
    f"with {scores_sql(f'''select doc_id, term, sum(boost) as tf from (select doc_id, 3.0::double as boost, unnest({WORDS.format('title')}) as term from ({PAGE_FIELDS}) union all select doc_id, 1.0::double, unnest({WORDS.format('body')}) from ({PAGE_FIELDS})) group by all''')}, {KEYWORD} select item_id, doc_id as page_id, round(score, 6) as score, rank from k where rank <= 10"
)
def bm25f_fields(spark, folder):
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style|head)[^>]*>.*?</(script|style|head)>", " "), "<[^>]*>", " ")
    rows = table(spark, folder, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), body.alias("body"))
    counts = staged(S.term_counts(rows, "page_id", {"title": "title", "content": "body"}), "postings")
    return S.bm25_top(counts, "page_id", item_terms(spark, folder), "item_id", 10).select("item_id", "page_id", F.round("score", 6).alias("score"), "rank")


@query(r"""select p_partkey, list_sort(list_distinct(list_transform(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]*') || regexp_extract_all(t, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)))) as tokens
from (select p_partkey, replace(p_name, ' ', '_') || ' ' || p_type || replace(p_name, ' ', 'Http') || p_size as t from part)""")
def code_tokens(spark, folder):
    code = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" "), "p_type", F.replace("p_name", F.lit(" "), F.lit("Http")), F.col("p_size").cast("string"))
    return table(spark, folder, "part").select("p_partkey", T.code_tokens(code).alias("tokens"))


#: Words of any script that are made of ASCII letters alone.
ASCII = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9_]+'))"


def embedding_sql(table_: str, key: str) -> str:
    """Entries (key, place, value) of the hashed embedding of a table's texts."""
    return f"""select {key}, place, v / n as value from (select *, sqrt(sum(v * v) over (partition by {key})) as n from (select {key}, place, sum(v) as v from (
select {key}, cast(('0x' || substr(d, 1, 16))::ubigint % 384 as integer) as place, c::double as v from (select *, sha256(token) as d from (select {key}, token, count(*) as c from (select {key}, unnest(case when len(w) > 0 then w else ['__empty__'] end) as token from (select {key}, {ASCII} as w from {table_})) group by all))
union all select {key}, cast(('0x' || substr(d, 17, 16))::ubigint % 384 as integer), c * case when ('0x' || substr(d, 34, 1))::integer % 2 = 0 then 0.5 else -0.5 end from (select *, sha256(token) as d from (select {key}, token, count(*) as c from (select {key}, unnest(case when len(w) > 0 then w else ['__empty__'] end) as token from (select {key}, {ASCII} as w from {table_})) group by all))) group by all))"""


@query(f"select doc_id, place, round(value, 6) as value from ({embedding_sql('documents', 'doc_id')})")
def hash_embedding_entries(spark, folder):
    return hash_embedding(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "place", F.round("value", 6).alias("value"))


COSINE = """v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), c as (select q.vec_id as query_id, d.vec_id, round(list_cosine_similarity(q.e, d.e), 9) as score
from v q join v d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id), n as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from c)"""


def nearest(spark, folder, k):
    vectors = table(spark, folder, "embeddings")
    return S.cosine_top(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", k)


@query(f"with {COSINE} select query_id, vec_id, round(score, 6) as score, rank from n where rank <= 10")
def cosine_topk_batch(spark, folder):
    return nearest(spark, folder, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {COSINE} select query_id, vec_id, round(score, 6) as score, rank from n where rank <= 10")
def cosine_cells(spark, folder):
    """The same lists by trained cells: codes of all cells that can matter, then the vectors of what may be in a list."""
    vectors = table(spark, folder, "embeddings")
    found = Cells.made(vectors, "vec_id", "embedding").top(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def cells_recall(spark, folder):
    """query_id, recall at 10 against the exact lists, codes and vectors that were read of all rows: with as many probes as
    200 other rows, drawn by hashes, needed for 0.95 as queries."""
    vectors = table(spark, folder, "embeddings")
    cells = Cells.made(vectors, "vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0")
    probes = cells.probes(vectors, vectors.where("vec_id % 50 <> 0").orderBy(F.xxhash64("vec_id")).limit(200), "vec_id", "embedding", 10)
    found = cells.candidates(asked, "vec_id", "embedding", 10, probes)
    lists = cells.exact(found, vectors, asked, "vec_id", "embedding", 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    recall = nearest(spark, folder, 10).join(lists, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
    told = found.groupBy("query_id").agg(F.first("read").alias("codes"), F.count("*").alias("vectors"))
    return recall.join(told, "query_id").crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n_rows"))))


@query(f"""with {COSINE}, r as (select query_id, rank, q.label = d.label as hit from n join embeddings q on q.vec_id = query_id join embeddings d on d.vec_id = n.vec_id where rank <= 10)
select label, count(*) as queries, round(avg(rr), 6) as mrr from (select query_id, coalesce(max(1.0 / rank) filter (hit), 0.0) as rr from r group by all) join embeddings on vec_id = query_id group by all""")
def knn_by_label_mrr(spark, folder):
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    hits = nearest(spark, folder, 10).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    rr = hits.groupBy("query_id", "own").agg(F.coalesce(F.max(F.when(F.col("label") == F.col("own"), 1 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return rr.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("queries"), F.round(F.avg("rr"), 6).alias("mrr"))


def edges(spark, folder):
    return table(spark, folder, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()


def seeds(spark, folder):
    return table(spark, folder, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))


EDGES = "e as (select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem), s as (select 'o' || o_orderkey as node from orders where o_orderkey % 50 = 0), a as (select distinct dst as node from e join s on src = node)"


@query(f"with {EDGES} select node, 1 as hop from a")
def graph_neighbors_1hop(spark, folder):
    return S.neighbours(edges(spark, folder), seeds(spark, folder))


@query(f"with {EDGES} select node, 1 as hop from a union all select distinct src, 2 from e join a on dst = node where src not in (select node from s)")
def graph_neighbors_2hop(spark, folder):
    return S.neighbours(edges(spark, folder), seeds(spark, folder), 2)


@query(f"""with {scores_sql()}, {KEYWORD}, h as (select item_id, source as tag, count(*) as held from k join documents using (doc_id) where rank <= 10 group by all), n as (select source as tag, count(*) as n from documents group by all)
select item_id, tag, n - held as expanded from h join n using (tag)""")
def tag_expansion(spark, folder):
    tags = table(spark, folder, "documents").select("doc_id", F.col("source").alias("tag"))
    return S.tag_expansion(keyword_hits(spark, folder, 10), tags, "item_id", "doc_id")


VOCABULARY = f"""select term, count(*) as count from (select unnest(regexp_extract_all(regexp_replace(lower(text), '[^\\x00-\\x7f]', 'é', 'g'), '(?:^|[^a-z0-9_-])?([a-z][a-z0-9_-]*)', 1)) as term from documents) where length(term) >= {S.LEAST_LENGTH} and term not in ({', '.join(f"'{w}'" for w in T.STOPWORDS)})
group by all having count(*) >= {S.LEAST_COUNT} order by count desc, term limit {S.VOCABULARY}"""


@query(VOCABULARY)
def vocabulary_topn(spark, folder):
    """Letters other than ASCII's end words here, as on the other engine."""
    rows = table(spark, folder, "documents").select(F.regexp_replace(F.lower("text"), r"[^\x00-\x7f]", " ").alias("text"))
    return S.vocabulary(rows, "text")


@query(f"""with v as materialized ({VOCABULARY}), h as (select term, sha256(lower(term)) as d from v where regexp_full_match(term, '[a-z0-9_]+')), e as (select term, cast(('0x' || substr(d, 1, 16))::ubigint % 384 as integer) as place, 1.0::double as v from h union all select term, cast(('0x' || substr(d, 17, 16))::ubigint % 384 as integer), case when ('0x' || substr(d, 34, 1))::integer % 2 = 0 then 0.5 else -0.5 end from h),
t as (select term, place, v / sqrt(sum(v * v) over (partition by term)) as v from (select term, place, sum(v) as v from e group by all)), q as ({embedding_sql('benchmark', 'item_id')}), n as (select item_id, term, round(sum(q.value * t.v), 9) as score from q join t using (place) group by all),
b as (select item_id, term, row_number() over (partition by item_id order by score desc, term) as r from n where score >= {S.LEAST_COSINE}), x as (select item_id, list(term order by r) as terms from b where r <= {S.EXPANDED} group by all)
select item_id, text || ' ' || coalesce(list_aggregate(list_filter(terms, lambda x: not list_contains({WORDS.format('text')}, x)), 'string_agg', ' '), '') as expanded from benchmark left join x using (item_id)""")
def query_expansion(spark, folder):
    """The vocabulary's terms that are nearest to each whole query, by hashed embeddings."""
    rows = table(spark, folder, "documents").select(F.regexp_replace(F.lower("text"), r"[^\x00-\x7f]", " ").alias("text"))
    terms = S.vocabulary(rows, "text").where("term rlike '^[a-z0-9_]+$'").select("term", F.col("term").alias("text"))
    queries = table(spark, folder, "benchmark")
    near = S.near_terms(hash_embedding(queries, "item_id", "text"), hash_embedding(terms, "term", "text"), "item_id")
    return S.expanded_query(queries, near, "item_id", "text")


@query(f"""with {scores_sql()}, {KEYWORD}, v as (select doc_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings join documents on vec_id = doc_id),
c as (select q.doc_id as item_id, d.doc_id, round(list_cosine_similarity(q.e, d.e), 9) as score from v q join v d on q.doc_id in (select item_id from benchmark) and q.doc_id <> d.doc_id),
n as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from c), u as (select item_id, doc_id, 'keyword' as strategy, rank from k where rank <= 20 union all select item_id, doc_id, 'vector', rank from n where rank <= 20),
f as (select item_id, doc_id, sum(1.0 / (60 + rank)) as score, list_sort(list(strategy)) as strategies from u group by all), j as (select f.*, source from f join documents using (doc_id) where round(f.score, 9) >= 0.01 and source <> 'src7'),
r as (select *, row_number() over (partition by item_id, source order by round(score, 9) desc, doc_id) as d from j), z as (select item_id, doc_id, score, strategies, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from r where d <= 2)
select item_id, rank, doc_id, round(score, 6) as score, strategies from z where rank <= 5""")
def hybrid_search(spark, folder):
    """Benchmark texts as queries: keyword and vector lists fused, one source left out, floor, two results a source, five in all.
    The vector of a query is that with its number."""
    docs, vectors = table(spark, folder, "documents"), table(spark, folder, "embeddings")
    items = table(spark, folder, "benchmark")
    rows = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = rows.join(items.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    vector = S.cosine_top(rows, asked, "doc_id", "embedding", 20).select(F.col("query_id").alias("item_id"), "doc_id", F.lit("vector").alias("strategy"), "score", "rank")
    keyword = keyword_hits(spark, folder, 20).select("item_id", "doc_id", F.lit("keyword").alias("strategy"), "score", "rank")
    fused = R.rrf(keyword.unionByName(vector), "item_id", "doc_id").withColumn("o", F.round("score", 9))
    kept = fused.join(docs.select("doc_id", "source"), "doc_id").where("o >= 0.01 and source <> 'src7'")
    few = R.first_of(kept, ["item_id", "source"], [F.desc("o"), "doc_id"], 2)
    return S.top(few.drop("score").withColumnRenamed("o", "score"), "item_id", "doc_id", 5).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"), "strategies")
