"""De-duplication, diversity, limits and aggregation of results; conversations stand for documents and commits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunk as C
from ..operators import rank as R
from ..session import table
from .registry import query
from .search import COSINE, KEYWORD, keyword_hits, nearest, scores_sql


@query("select doc_id, md5(text) as digest from documents qualify row_number() over (partition by md5(text) order by doc_id) = 1")
def content_hash_dedup(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


def _greedy_sql(pool: str, close: str) -> str:
    """Rows of pool (q, n from 1 in order, k, x) less those close to a row that stays, one row a round."""
    return f"""g as (select q, 1::bigint as n, [1::bigint] as kept from pool where n = 1 union all
select g.q, g.n + 1, case when exists (select 1 from pool o where o.q = g.q and list_contains(g.kept, o.n) and {close}) then g.kept else list_append(g.kept, p.n) end from g join pool p on p.q = g.q and p.n = g.n + 1),
f as (select q, arg_max(kept, n) as kept from g group by all)"""


TRI = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr(lower({0}), i, 3)))"


@query(f"""with recursive {scores_sql()}, {KEYWORD}, pool as materialized (select item_id as q, rank as n, doc_id, k.score, {TRI.format('text')} as x from k join documents using (doc_id) where rank <= 20),
{_greedy_sql('pool', 'len(list_intersect(o.x, p.x)) / greatest(len(o.x) + len(p.x) - len(list_intersect(o.x, p.x)), 1) >= 0.7')}
select q as item_id, doc_id, row_number() over (partition by q order by n) as rank from f join pool using (q) where list_contains(kept, n)""")
def ngram_dedup(spark, folder):
    """Of all candidates of every item: the 20 of a search for five results."""
    hits = keyword_hits(spark, folder, 20).drop("rank").join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return R.ngram_dedup(hits, "item_id", "doc_id", "text").select("item_id", "doc_id", "rank")


@query(f"""with recursive {COSINE}, pool as materialized (select query_id as q, rank as n, n.vec_id, n.score, list_transform(embedding, lambda y: cast(y as double)) as x from n join embeddings using (vec_id) where rank <= 20),
{_greedy_sql('pool', 'list_cosine_similarity(o.x, p.x) >= 0.35')} select q as query_id, vec_id, row_number() over (partition by q order by n) as rank from f join pool using (q) where list_contains(kept, n)""")
def semantic_dedup(spark, folder):
    """Of the 20 nearest vectors of every query; the threshold suits these vectors."""
    hits = nearest(spark, folder, 20).drop("rank").join(table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id")
    return R.semantic_dedup(hits, "query_id", "vec_id", "embedding", 0.35).select("query_id", "vec_id", "rank")


@query(f"""with recursive {COSINE}, pool as materialized (select query_id as q, n.vec_id as k, score as s, list_transform(embedding, lambda y: cast(y as double)) as x from n join embeddings using (vec_id) where rank <= 20),
m as (select q, 0::bigint as n, []::bigint[] as kept from pool group by q union all
select q, n + 1, kept || [arg_min(k, struct_pack(v := -round(0.7 * s - 0.3 * near, 12), k := k))] from (
select m.q, m.n, m.kept, p.k, p.s, coalesce((select max(list_cosine_similarity(o.x, p.x)) from pool o where o.q = m.q and list_contains(m.kept, o.k)), 0) as near from m join pool p on p.q = m.q and not list_contains(m.kept, p.k) where m.n < 4) group by q, n, kept)
select q as query_id, unnest(kept) as vec_id, generate_subscripts(kept, 1) as rank from m where n = 4""")
def mmr(spark, folder):
    hits = nearest(spark, folder, 20).drop("rank").join(table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id")
    return R.mmr(hits, "query_id", "vec_id", "embedding", 4).select("query_id", "vec_id", "rank")


@query("select conv_id, turn, length(text) as score from conversations qualify row_number() over (partition by conv_id order by length(text) desc, turn) <= 2")
def per_document_limit(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("score"))
    return R.first_of(rows, ["conv_id"], [F.desc("score"), "turn"], 2)


PARENTS = f"""with recursive o as (select *, row_number() over (partition by conv_id order by turn) as i from conversations), p as (select conv_id, turn, text, i, 0 as number, length(text) as size from o where i = 1 union all
select o.conv_id, o.turn, o.text, o.i, case when size > 0 and (size >= {C.PARENT_LEAST} or size + length(o.text) > {C.PARENT_MOST}) then number + 1 else number end, case when size > 0 and (size >= {C.PARENT_LEAST} or size + length(o.text) > {C.PARENT_MOST}) then length(o.text) else size + length(o.text) end
from p join o on o.conv_id = p.conv_id and o.i = p.i + 1) select conv_id, turn, text, conv_id || '_parent_' || number as parent_chunk_id from p"""


@query(f"select conv_id, parent_chunk_id, length(string_agg(text, chr(10) || chr(10) order by turn)) as n_chars, md5(string_agg(text, chr(10) || chr(10) order by turn)) as digest from ({PARENTS}) group by all")
def parent_chunks(spark, folder):
    rows = C.parents(table(spark, folder, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")
    out = C.parent_texts(rows, "conv_id", "turn", "text")
    return out.select("conv_id", "parent_chunk_id", F.length("parent_content").cast("long").alias("n_chars"), F.md5("parent_content").alias("digest"))


@query(f"select conv_id, turn, parent_chunk_id, length(text) as score from ({PARENTS}) qualify row_number() over (partition by parent_chunk_id order by length(text) desc, lpad(turn::varchar, 6, '0')) = 1")
def parent_expand(spark, folder):
    rows = C.parents(table(spark, folder, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")
    hits = rows.select("conv_id", "turn", "parent_chunk_id", F.lpad(F.col("turn").cast("string"), 6, "0").alias("chunk_id"), F.length("text").cast("long").alias("score"), F.lit(0).alias("qid"))
    return C.expanded_parents(hits, "qid").select("conv_id", "turn", "parent_chunk_id", "score")


@query("""with r as (select conv_id, role, min(turn) as first from conversations group by all), s as (select conv_id, list(role order by first) as matched_sections from r group by all)
select conv_id as commit_id, arg_max(turn, struct_pack(s := length(text), p := -turn)) as chunk_id, max(length(text)) as score, any_value(matched_sections) as matched_sections, count(*) as matched_chunk_count
from conversations join s using (conv_id) group by conv_id""")
def commit_aggregate(spark, folder):
    rows = table(spark, folder, "conversations").select(F.lit(0).alias("qid"), F.col("conv_id").alias("commit_id"), F.col("turn").alias("chunk_id"), F.col("role").alias("section"), F.length("text").cast("long").alias("score"), F.col("turn").alias("position"))
    return R.commit_results(rows, "qid").drop("qid")


@query("select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rank from orders where o_totalprice > 100000)")
def dense_positions(spark, folder):
    """Positions from 1 without gaps after a filter."""
    rows = table(spark, folder, "orders").where("o_totalprice > 100000")
    return rows.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"))


@query(f"""with recursive {scores_sql()}, {KEYWORD}, h as materialized (select item_id, k.doc_id, k.score, source, text from k join documents using (doc_id) where rank <= 20), f1 as (select * from h where score >= 5),
f2 as materialized (select * from f1 qualify row_number() over (partition by item_id, md5(text) order by score desc, doc_id) = 1), pool as materialized (select item_id as q, row_number() over (partition by item_id order by score desc, doc_id) as n, doc_id, {TRI.format('text')} as x from f2),
{_greedy_sql('pool', 'len(list_intersect(o.x, p.x)) / greatest(len(o.x) + len(p.x) - len(list_intersect(o.x, p.x)), 1) >= 0.7')}, f3 as materialized (select f2.* from f join pool using (q) join f2 on f2.item_id = q and f2.doc_id = pool.doc_id where list_contains(kept, n)),
vec as materialized (select f3.item_id as q, row_number() over (partition by item_id order by score desc, f3.doc_id) as n, f3.doc_id, list_transform(embedding, lambda y: cast(y as double)) as x from f3 left join embeddings on vec_id = f3.doc_id),
g2 as (select q, 1::bigint as n, [1::bigint] as kept from vec where n = 1 union all select g2.q, g2.n + 1, case when exists (select 1 from vec o where o.q = g2.q and list_contains(g2.kept, o.n) and coalesce(list_cosine_similarity(o.x, p.x) >= 0.3, false)) then g2.kept else list_append(g2.kept, p.n) end from g2 join vec p on p.q = g2.q and p.n = g2.n + 1),
w as (select q, arg_max(kept, n) as kept from g2 group by all), f4 as materialized (select f3.* from w join vec using (q) join f3 on f3.item_id = q and f3.doc_id = vec.doc_id where list_contains(kept, n)), f5 as (select * from f4 qualify row_number() over (partition by item_id, source order by score desc, doc_id) = 1),
c as (select item_id, 0 as s, count(*) as n from h group by all union all select item_id, 1, count(*) from f1 group by all union all select item_id, 2, count(*) from f2 group by all union all select item_id, 3, count(*) from f3 group by all union all select item_id, 4, count(*) from f4 group by all union all select item_id, 5, count(*) from f5 group by all)
select item_id, coalesce(sum(n) filter (s = 0), 0)::bigint as original, coalesce(sum(n) filter (s = 1), 0)::bigint as after_threshold, coalesce(sum(n) filter (s = 2), 0)::bigint as after_content_dedup, coalesce(sum(n) filter (s = 3), 0)::bigint as after_ngram_dedup, coalesce(sum(n) filter (s = 4), 0)::bigint as after_dedup, coalesce(sum(n) filter (s = 5), 0)::bigint as after_doc_limit,
(coalesce(sum(n) filter (s = 1), 0) - coalesce(sum(n) filter (s = 4), 0))::bigint as clusters_merged from c group by item_id""")
def compression_stats(spark, folder):
    """What each step of result compression leaves of all candidates; the vector threshold suits these vectors."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    hits = keyword_hits(spark, folder, 20).drop("rank").join(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id").join(vectors, "doc_id", "left")
    return R.compressed(hits, "item_id", "doc_id", "text", "source", 5.0, embedding="embedding", semantic=0.3)[1]
