"""Chunking of documents, conversations and made-up commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, git_document
from ..operators import chunk as C
from ..session import table
from .parsing import PAGE_SQL, pages
from .registry import query


@query("select doc_id, greatest(1, cast(ceil(length(text) / 3) as integer)) as tokens from documents")
def token_estimate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", estimated_tokens(F.col("text")).alias("tokens"))


#: Paragraphs are lines here, as the tables have no blank lines.
@query(f"""with recursive t as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as l from documents),
p as (select doc_id, list_reduce(list_prepend([]::varchar[], list_transform(flatten(list_transform(l, lambda x: list_transform(range(0, (length(x) + {C.MOST - 1}) // {C.MOST}), lambda i: substr(x, i * {C.MOST} + 1, {C.MOST})))), lambda x: [x])),
lambda a, x: case when len(a) = 0 then x when length(a[-1]) + 2 + length(x[1]) <= {C.MOST} then a[:-2] || [a[-1] || chr(10) || chr(10) || x[1]] else a || x end) as c from t)
select doc_id, generate_subscripts(c, 1) - 1 as chunk_index, md5(unnest(c)) as digest from p where len(c) > 0""")
def paragraph_chunks(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return C.paragraph_chunks(rows, "doc_id", "text").select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(f"""with t as (select doc_id, flatten(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '{C.LINE_END}', chr(10), 'g'), chr(10)), lambda x: list_transform(range(0, greatest(1, (length(x) + {C.TOKENS * 3 - 1}) // {C.TOKENS * 3})), lambda i: substr(x, i * {C.TOKENS * 3} + 1, {C.TOKENS * 3})))) as l from documents),
p as (select doc_id, list_reduce(list_prepend([]::varchar[], list_transform(l, lambda x: [x])), lambda a, x: case when len(a) = 0 then x when length(a[-1]) + length(x[1]) + 1 > {C.TOKENS * 3} then a || x else a[:-2] || [a[-1] || chr(10) || x[1]] end) as c from t),
f as (select doc_id, list_filter(list_transform(c, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as c from p) select doc_id, generate_subscripts(c, 1) - 1 as chunk_index, md5(unnest(c)) as digest from f where len(c) > 0""")
def line_pack_chunks(spark, folder):
    """Without overlap."""
    return table(spark, folder, "documents").select("doc_id", F.posexplode(C.line_chunks(F.col("text"), C.TOKENS, 0)).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.md5("c").alias("digest"))


@query(f"""with t as (select doc_id, flatten(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '{C.LINE_END}', chr(10), 'g'), chr(10)), lambda x: list_transform(range(0, greatest(1, (length(x) + {C.TOKENS * 3 - 1}) // {C.TOKENS * 3})), lambda i: substr(x, i * {C.TOKENS * 3} + 1, {C.TOKENS * 3})))) as l from documents),
p as (select doc_id, list_reduce(list_prepend([]::varchar[][], list_transform(l, lambda x: [[x]])), lambda a, x: case when len(a) = 0 then x when list_sum(list_transform(a[-1], lambda y: length(y))) + len(a[-1]) - 1 + length(x[1][1]) + 1 > {C.TOKENS * 3}
then a || [a[-1][len(a[-1]) + 1 - list_max([1] || list_filter(range(1, len(a[-1]) + 1), lambda k: list_sum(list_transform(a[-1][len(a[-1]) + 1 - k:], lambda y: length(y))) <= {C.TOKEN_OVERLAP * 3})):] || x[1]] else a[:-2] || [a[-1] || x[1]] end) as c from t),
f as (select doc_id, list_filter(list_transform(c, lambda x: trim(list_aggregate(x, 'string_agg', chr(10)), ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as c from p) select doc_id, generate_subscripts(c, 1) - 1 as chunk_index, md5(unnest(c)) as digest from f where len(c) > 0""")
def line_pack_overlap(spark, folder):
    """With the overlap of diffs."""
    return table(spark, folder, "documents").select("doc_id", F.posexplode(C.line_chunks(F.col("text"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.md5("c").alias("digest"))


@query(f"select conv_id, turn, md5(case when lag(text) over w is null then text else right(lag(text) over w, {C.OVERLAP}) || chr(10) || chr(10) || text end) as digest from conversations window w as (partition by conv_id order by turn)")
def sibling_overlap(spark, folder):
    rows = C.overlapped(table(spark, folder, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")
    return rows.select("conv_id", "turn", F.md5("text").alias("digest"))


@query(f"""with p as ({PAGE_SQL}), s as (select p.p_partkey, p_type, string_split(page, chr(10) || '## Tests' || chr(10)) as x from p join part using (p_partkey))
select p_partkey, 1 as section, 1 as level, p_type as header_path, md5(regexp_extract(x[1], '\\n# [^\\n]*\\n(.*)$', 1)) as digest from s union all select p_partkey, 2, 2, p_type || ' > Tests', md5(trim(x[2], chr(10))) from s""")
def header_chunks(spark, folder):
    rows = C.header_sections(pages(spark, folder).select("p_partkey", F.regexp_replace("page", r"(?s)^---\n.*?\n---\n", "").alias("page")), "p_partkey", "page")
    return rows.select("p_partkey", "section", "level", "header_path", F.md5("content").alias("digest"))


@query(f"""with p as (select conv_id, string_agg('# ' || role || chr(10) || text, chr(10) order by turn) as page from conversations group by conv_id), s as (select conv_id, list_transform(list_filter(string_split(chr(10) || page, chr(10) || '# '), lambda x: x <> ''), lambda x: split_part(x, chr(10), 1) || chr(10) || trim(substr(x, strpos(x, chr(10)) + 1), ' ' || chr(9) || chr(10) || chr(13))) as l from p),
m as (select conv_id, list_reduce(list_prepend([]::varchar[], list_transform(l, lambda x: [x])), lambda a, x: case when len(a) = 0 then x when length(a[-1]) < {C.LEAST} then a[:-2] || [a[-1] || chr(10) || chr(10) || x[1]] else a || x end) as c from s),
e as (select conv_id, case when length(c[-1]) < {C.LEAST} and len(c) > 1 then c[:-3] || [c[-2] || chr(10) || chr(10) || c[-1]] else c end as c from m), u as (select conv_id, unnest(c) as t, generate_subscripts(c, 1) - 1 as i from e),
q as (select conv_id, i, split_part(t, chr(10), 1) as header_path, case when length(t) > {C.MOST} then list_reduce(list_prepend([]::varchar[], list_transform(flatten(list_transform(list_filter(list_transform(string_split(regexp_replace(t, '\n[ \t\r\n\f]*\n', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), lambda x: list_transform(range(0, (length(x) + {C.MOST - 1}) // {C.MOST}), lambda k: substr(x, k * {C.MOST} + 1, {C.MOST})))), lambda x: [x])),
lambda a, x: case when len(a) = 0 then x when length(a[-1]) + 2 + length(x[1]) <= {C.MOST} then a[:-2] || [a[-1] || chr(10) || chr(10) || x[1]] else a || x end) else [t] end as c from u), z as (select conv_id, i, header_path, len(c) as n, unnest(c) as t, generate_subscripts(c, 1) - 1 as sub from q)
select conv_id, conv_id || '_chunk_' || i || case when n > 1 then '_sub_' || sub else '' end as chunk_id, header_path, length(case when sub > 0 then right(lag(t) over (partition by conv_id, i order by sub), {C.OVERLAP}) || chr(10) || chr(10) || t else t end) as n_chars from z""")
def merged_header_chunks(spark, folder):
    """Small sections merged, large ones split."""
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("# "), x["role"], F.lit("\n"), x["text"])), "\n").alias("page"))
    return C.merged_sections(C.header_sections(rows, "conv_id", "page"), "conv_id").select("conv_id", "chunk_id", "header_path", F.length("content").cast("long").alias("n_chars"))


COMMITS = "select o_orderkey, o_orderpriority as title, 'order of ' || o_custkey as message, 'C' || o_custkey || ' <c@x>' as author from orders"


def commits(spark, folder):
    """Orders as commits that touch their parts."""
    files = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit(".md")))).alias("files_changed"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("message"), F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(" <c@x>")).alias("author"))
    rows = orders.join(files, "o_orderkey", "left").withColumn("files_changed", F.coalesce("files_changed", F.array().cast("array<string>")))
    return rows.select(F.col("o_orderkey").alias("hash"), "title", "message", "author", F.lit("").alias("committer"), "files_changed", F.lit("").alias("delta_truncated"))


FILES = "select l_orderkey as o_orderkey, string_agg(distinct 'part/' || l_partkey || '.md', chr(10) order by 'part/' || l_partkey || '.md') as f from lineitem group by all"


@query(f"""with c as (select * from ({COMMITS}) left join ({FILES}) using (o_orderkey)), t as (select o_orderkey, 'summary' as section, 'Summary:' || chr(10) || title || chr(10) || chr(10) || 'Author: ' || author || coalesce(chr(10) || chr(10) || 'Files changed:' || chr(10) || f, '') as text from c
union all select o_orderkey, 'body', 'Body:' || chr(10) || message from c) select o_orderkey as hash, section, 0 as section_index, md5(text) as digest, greatest(1, cast(ceil(length(text) / 3) as integer)) as estimated_tokens from t""")
def commit_chunks(spark, folder):
    return C.commit_chunks(commits(spark, folder)).select("hash", "section", "section_index", F.md5("text").alias("digest"), "estimated_tokens")


@query(f"select o_orderkey as hash, md5(title || chr(10) || chr(10) || message || chr(10) || chr(10) || 'Author: ' || author || coalesce(chr(10) || chr(10) || 'Files changed:' || chr(10) || f, '')) as digest from ({COMMITS}) left join ({FILES}) using (o_orderkey)")
def commit_documents(spark, folder):
    c = commits(spark, folder)
    return c.select("hash", F.md5(git_document(c.title, c.message, c.author, c.committer, c.files_changed, c.delta_truncated)).alias("digest"))
