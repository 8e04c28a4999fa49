"""Fusion and score steps over keyword lists of two weightings, and over orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rank as R
from ..operators import retrieve as S
from ..operators import state as U
from ..scratch import sent, staged
from ..session import table
from .registry import query
from .search import KEYWORD, item_terms, keyword_hits, scores_sql

#: Two lists for each item: BM25, and the share of the item's terms that a document holds.
LISTS = f"""{scores_sql()}, {KEYWORD}, c as (select item_id, doc_id, round(count(*) / max(n), 9) as score from q join p using (term) join (select item_id, count(*) as n from q group by all) using (item_id) group by all),
o as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from c), u as (select item_id, doc_id, 'keyword' as strategy, score, rank from k where rank <= 20 union all select item_id, doc_id, 'code', score, rank from o where rank <= 20)"""


def lists(spark, folder):
    counts = staged(S.term_counts(table(spark, folder, "documents"), "doc_id", {"content": "text"}), "postings")
    terms = staged(item_terms(spark, folder), "query-terms")
    tagged = lambda f, s: f.select("item_id", "doc_id", F.lit(s).alias("strategy"), "score", "rank")
    return tagged(S.bm25_top(counts, "doc_id", terms, "item_id", 20), "keyword").unionByName(tagged(S.coverage_top(counts, "doc_id", terms, "item_id", 20), "code"))


@query(f"with {LISTS} select item_id, doc_id, round(sum(1.0 / (60 + rank)), 6) as score, list_sort(list(strategy)) as strategies from u group by all")
def rrf_fuse(spark, folder):
    return R.rrf(lists(spark, folder), "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), "strategies")


@query(f"with {LISTS} select item_id, doc_id, round(sum(case strategy when 'keyword' then 1.5 else 0.5 end / (60 + rank)), 6) as score from u group by all")
def rrf_weighted(spark, folder):
    return R.rrf(lists(spark, folder), "item_id", "doc_id", {"keyword": 1.5, "code": 0.5}).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""with {LISTS}, v as (select item_id, strategy, var_pop(score) as v from u group by all), w as (select item_id, strategy, case when v < 0.1 then greatest(0.25, v / 0.1) else 1.0 end as raw from v)
select item_id, strategy, round(raw * count(*) over (partition by item_id) / sum(raw) over (partition by item_id), 6) as weight from w""")
def variance_weights(spark, folder):
    return R.variance_weights(lists(spark, folder), "item_id").select("item_id", "strategy", F.round("weight", 6).alias("weight"))


@query(f"""with {LISTS}, m as (select *, min(score) over w as lo, max(score) over w as hi from u window w as (partition by item_id, strategy))
select item_id, doc_id, round(sum(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end) + sum(1.0 / (60 + rank)), 6) as score from m group by all""")
def combsum(spark, folder):
    return R.comb_sum(lists(spark, folder), "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"with {LISTS} select item_id, strategy, count(*) as results from u group by all")
def strategy_counts(spark, folder):
    counts = R.strategy_counts(R.rrf(lists(spark, folder), "item_id", "doc_id"), "item_id")
    return counts.unpivot("item_id", ["keyword", "code"], "strategy", "results").where("results > 0")


@query("""with a as (select max(o_orderdate) as as_of from orders) select o_orderkey, case when d <= 7 then 1.2 when d <= 30 then 1.1 else 1.0 end as boost, round(o_totalprice * case when d <= 7 then 1.2 when d <= 30 then 1.1 else 1.0 end, 6) as score
from (select o_orderkey, o_totalprice, date_diff('day', o_orderdate, as_of) as d from orders, a)""")
def recency_boost(spark, folder):
    rows = table(spark, folder, "orders")
    as_of = rows.agg(F.max("o_orderdate").alias("as_of"))  # one row
    boosted = rows.join(F.broadcast(as_of)).withColumn("boost", R.recency(F.col("o_orderdate"), F.col("as_of")))
    return boosted.select("o_orderkey", "boost", F.round(F.col("o_totalprice") * F.col("boost"), 6).alias("score"))


@query(f"with {LISTS}, f as (select item_id, doc_id, sum(1.0 / (60 + rank)) as score from u group by all) select item_id, doc_id, round(1 / (1 + exp(-150 * (score - 0.035))), 6) as confidence from f")
def calibrate(spark, folder):
    return R.rrf(lists(spark, folder), "item_id", "doc_id").select("item_id", "doc_id", F.round(R.calibrated(F.col("score")), 6).alias("confidence"))


@query("select s_suppkey, s_nationkey, round(case when max(s_acctbal) over w = min(s_acctbal) over w then 1.0 else (s_acctbal - min(s_acctbal) over w) / (max(s_acctbal) over w - min(s_acctbal) over w) end, 6) as score from supplier window w as (partition by s_nationkey)")
def minmax(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", F.round(R.min_max(F.col("s_acctbal"), ["s_nationkey"]), 6).alias("score"))


@query(f"""with {LISTS}, f as (select item_id, doc_id, sum(1.0 / (60 + rank)) as score from u group by all)
select item_id, doc_id, round(case when source = 'src' || item_id % 20 then score * 1.2 else score end, 6) as score from f join documents using (doc_id)""")
def project_uplift(spark, folder):
    fused = R.rrf(lists(spark, folder), "item_id", "doc_id").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    mine = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    return fused.select("item_id", "doc_id", F.round(R.uplift(F.col("score"), F.col("source"), mine), 6).alias("score"))


EDGES = "e as materialized (select distinct l_suppkey * 2 as a, l_partkey * 2 + 1 as b from lineitem), b as materialized (select a as src, b as dst from e union select b, a from e)"
ROUNDS = "l0 as (select distinct src as node, src as community from b)" + "".join(
    f", n{i} as (select src, community, count(*) as n from b join l{i - 1} on dst = node group by all), l{i} as (select src as node, arg_max(community, struct_pack(n := n, c := -community)) as community from n{i} group by all)" for i in (1, 2, 3)
)


def bulk_edges(spark, folder):
    return table(spark, folder, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


@query(f"with {EDGES}, {ROUNDS} select node, community from l3")
def community_labels(spark, folder):
    """Suppliers and parts of all orders, three rounds."""
    return U.communities(bulk_edges(spark, folder), 3)


@query()
def community_settled(spark, folder):
    """Suppliers and parts of all orders, until no node has a label that another is more frequent than around it."""
    return U.settled_communities(bulk_edges(spark, folder))


@query(f"""with {EDGES}, {ROUNDS}, s as (select distinct community from l3 where node % 100 = 0) select p_partkey, round(p_retailprice * case when community in (select community from s) then 1.1 else 1.0 end, 6) as score
from part left join l3 on node = p_partkey * 2 + 1""")
def community_boost(spark, folder):
    label = U.communities(bulk_edges(spark, folder), 3)
    seeded = label.where("node % 100 = 0").select("community").distinct().withColumn("seeded", F.lit(True))
    part = table(spark, folder, "part").withColumn("node", F.col("p_partkey") * 2 + 1)
    boosted = part.join(label, "node", "left").join(seeded, "community", "left")
    return boosted.select("p_partkey", F.round(F.col("p_retailprice") * F.when(F.col("seeded"), R.COMMUNITY).otherwise(1.0), 6).alias("score"))


RANKED = """select q, p_partkey, p_retailprice, case when contains(lower(p_name), q) or contains(lower(p_type), q) or contains(lower(p_brand), q) then 2 when len(list_filter(regexp_extract_all(q, '[a-z0-9_./-]+'), lambda t: not list_contains(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9_./-]+'), t))) = 0 then 1 else 0 end as metadata_rank
from part, (select distinct lower(p_type) as q from part union select distinct lower(p_name) from part union select distinct lower(split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)) from part) q"""


@query(f"select q, p_partkey, metadata_rank, position from (select *, row_number() over (partition by q order by metadata_rank desc, p_retailprice desc, p_partkey) as position from ({RANKED})) where position <= 100")
def metadata_rank_sort(spark, folder):
    """For types and names of parts, as they are and turned round, the first 100 as a result page has a length."""
    part = table(spark, folder, "part")
    words = F.split(F.lower("p_name"), " ")
    asked = part.select(F.explode(F.array(F.lower("p_type"), F.lower("p_name"), F.concat_ws(" ", F.get(words, 1), F.get(words, 0)))).alias("q")).distinct()
    # A stated set of queries, counted.
    rows = part.join(sent(asked, asked.count()), how="cross").withColumn("metadata_rank", T.metadata_rank(F.col("q"), F.col("p_name"), F.col("p_type"), F.col("p_brand")))
    order = Window.partitionBy("q").orderBy(F.desc("metadata_rank"), F.desc("p_retailprice"), "p_partkey")
    return rows.withColumn("position", F.row_number().over(order)).where("position <= 100").select("q", "p_partkey", "metadata_rank", "position")


@query(f"with {LISTS}, f as (select item_id, doc_id, sum(1.0 / (60 + rank)) as score from u group by all) select item_id, doc_id, round(score, 6) as score from f where round(score, 9) >= 0.02")
def score_floor(spark, folder):
    return R.rrf(lists(spark, folder), "item_id", "doc_id").where(F.round("score", 9) >= 0.02).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("""with q as (select conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./-]+')) as t from conversations where turn = 0)
select conv_id, turn, len(t) > 0 and len(list_filter(t, lambda x: contains(lower(text), x))) > 0 as matched from conversations join q using (conv_id)""")
def lexical_match(spark, folder):
    """Whether a turn has any token of its conversation's first one."""
    rows = table(spark, folder, "conversations")
    first = rows.where("turn = 0").select("conv_id", F.col("text").alias("query"))
    return rows.join(first, "conv_id").select("conv_id", "turn", T.lexical_match(F.col("query"), F.lit(""), F.col("text"), F.lit(True)).alias("matched"))


@query(f"with {LISTS}, f as (select item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score, list_contains(list(strategy), 'keyword') as kw from u group by all), tokens as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./-]+')) as t from benchmark) select item_id, doc_id from f join tokens using (item_id) join documents d using (doc_id) where score >= 0.016 or (kw and len(list_filter(t, lambda x: contains(lower(d.text), x))) > 0)")
def abstention(spark, folder):
    fused = R.rrf(lists(spark, folder), "item_id", "doc_id")
    rows = fused.join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").join(table(spark, folder, "benchmark").withColumnRenamed("text", "query"), "item_id")
    match = T.lexical_match(F.col("query"), F.lit(""), F.col("text"), F.array_contains("strategies", "keyword"))
    return rows.where((F.round("score", 9) >= 0.016) | match).select("item_id", "doc_id")


@query(r"""with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '.html' as path from pages), x as (select page_id, path, regexp_extract(path, '[^/]*$') as name from p)
select page_id, path, name in ('25.html', '7', '676') or regexp_replace(name, '\.[^./]*$', '') in ('25.html', '7', '676') as excluded from x""")
def excluded_files(spark, folder):
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), F.lit(".html"))
    rows = table(spark, folder, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", R.file_excluded(F.col("path"), F.substring_index("path", "/", 1), F.array(*map(F.lit, ("25.html", "7", "676")))).alias("excluded"))


@query(r"""with p as (select event_id, ts, 'src/' || event_type || '/u' || user_id || case when user_id % 2 = 0 then '.py' else '.md' end as path from events)
select event_id, path from p where ts > timestamp '2024-01-02' and ts < timestamp '2024-01-20' and regexp_matches(path, '(^|/)src/[^/]*/[^/]*\.py$')""")
def commit_filters(spark, folder):
    name = F.concat(F.lit("src/"), "event_type", F.lit("/u"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, ".py").otherwise(".md"))
    rows = table(spark, folder, "events").where("ts > timestamp_ntz'2024-01-02' and ts < timestamp_ntz'2024-01-20'").select("event_id", name.alias("path"))
    return rows.where(F.col("path").rlike(T.glob_pattern("src/**/*.py")))


@query(f"""with {LISTS}, b as (select item_id, doc_id, true as hit from benchmark i join documents d on contains(d.text, i.text)), n as (select item_id, count(*) as n from b group by all),
r as (select item_id, min(rank) as first, count(*) filter (rank <= 1) as h1, count(*) filter (rank <= 3) as h3, count(*) filter (rank <= 5) as h5, sum(1 / log2(rank + 1)) filter (rank <= 3) as g3, sum(1 / log2(rank + 1)) filter (rank <= 5) as g5 from b join k using (item_id, doc_id) where rank <= 20 group by all),
i as (select item_id, n, (select sum(1 / log2(x + 1)) from range(1, least(n, 3) + 1) t(x)) as i3, (select sum(1 / log2(x + 1)) from range(1, least(n, 5) + 1) t(x)) as i5 from n)
select item_id, round(coalesce(1.0 / first, 0), 6) as reciprocal_rank, round(coalesce(h1 / n, 0), 6) as recall_at_1, round(coalesce(h3 / n, 0), 6) as recall_at_3, round(coalesce(h5 / n, 0), 6) as recall_at_5, round(coalesce(g3 / i3, 0), 6) as ndcg_at_3, round(coalesce(g5 / i5, 0), 6) as ndcg_at_5 from i left join r using (item_id)""")
def ranking_metrics(spark, folder):
    """Documents that hold a benchmark text are what its search should find. A text's words but the first and last stand
    whole in a document that holds it, so documents are met by the rarest of them; texts without such words go to all."""
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    inner = F.filter(F.slice(T.words(F.col("item")), F.lit(2), F.greatest(F.size(T.words(F.col("item"))) - 2, F.lit(0))), lambda w: w != "")
    asked = staged(items.withColumn("inner", F.array_distinct(inner)), "judged-items")
    words = asked.select("item_id", F.explode("inner").alias("word"))
    known = words.select("word").distinct()
    held = staged(docs.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).join(sent(known, known.count(), 64), "word", "left_semi"), "judged-words")
    rare = words.join(held.groupBy("word").agg(F.count("*").alias("df")), "word", "left").groupBy("item_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    met = rare.join(held, "word").select("item_id", "doc_id")
    short = asked.where(F.size("inner") == 0).select("item_id", "item")
    pairs = met.join(asked.select("item_id", "item"), "item_id").join(docs, "doc_id").where(F.contains("text", "item")).select("item_id", "doc_id")
    judged = pairs.unionByName(docs.join(sent(short, short.count(), 1000), F.contains("text", "item")).select("item_id", "doc_id"))
    out = R.ranking_metrics(keyword_hits(spark, folder, 20), staged(judged, "judged"), "item_id", "doc_id")
    return out.select("item_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])
