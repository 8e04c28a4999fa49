"""Scans, decoding and Markdown parts. The tables hold no Markdown, so it is made from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import state as U
from ..session import table
from ..sources import files, gitlog
from .registry import query

#: A Markdown page for each part.
PAGE_SQL = r"""select p_partkey, '---' || chr(10) || 'title: ' || p_name || chr(10) || 'tags: [' || p_brand || ', part]' || chr(10) || '---' || chr(10) || '# ' || p_type || chr(10)
    || 'See [[' || p_brand || '|brand]], ![[' || p_name || ']] and [kind](' || replace(p_type, ' ', '-') || '.md) #size' || p_size || ' #part' || chr(10)
    || '## Tests' || chr(10) || 'See [[' || p_type || ']].' || chr(10) || '```sql' || chr(10) || 'select ' || p_size || ' -- [[no]] #no' || chr(10) || '```' || chr(10) as page from part"""


def pages(spark, folder):
    text = F.concat(
        F.lit("---\ntitle: "), "p_name", F.lit("\ntags: ["), "p_brand", F.lit(", part]\n---\n# "), "p_type", F.lit("\nSee [["), "p_brand", F.lit("|brand]], ![["), "p_name", F.lit("]] and [kind]("),
        F.replace("p_type", F.lit(" "), F.lit("-")), F.lit(".md) #size"), F.col("p_size").cast("string"), F.lit(" #part\n## Tests\nSee [["), "p_type", F.lit("]].\n```sql\nselect "), F.col("p_size").cast("string"), F.lit(" -- [[no]] #no\n```\n"),
    )
    return table(spark, folder, "part").select("p_partkey", text.alias("page"))


@query("select doc_id, source, lang, length(text) as n_chars from documents where lang in ('en', 'de') and source <> 'src0'")
def scan_filter_project(spark, folder):
    return table(spark, folder, "documents").where(F.col("lang").isin("en", "de") & (F.col("source") != "src0")).select("doc_id", "source", "lang", F.length("text").cast("long").alias("n_chars"))


@query("select doc_id, md5(replace(text, chr(13), chr(10))) as digest, doc_id % 2 = 1 and regexp_matches(text, '[^\\x00-\\x7f]') and not regexp_matches(text, '[^\\x00-\\xff]') as latin from documents")
def decode_fallback(spark, folder):
    """Texts written as Latin-1, where it has all their letters, or UTF-8 by turns, and read without knowing which."""
    rows = table(spark, folder, "documents")
    content = F.when((F.col("doc_id") % 2 == 1) & ~F.col("text").rlike("[^\\x00-\\xff]"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    rows = rows.select("doc_id", content.alias("content"))
    return rows.select("doc_id", F.md5(T.decoded(F.col("content"))).alias("digest"), (~F.is_valid_utf8(F.col("content").cast("string"))).alias("latin"))


@query(f"""select p_partkey, regexp_extract(m, 'title: ([^\\n]*)', 1) as title, list_sort(string_split(regexp_extract(m, 'tags: \\[([^\\]]*)\\]', 1), ', ')) as tags, length(substr(page, instr(page, chr(10) || '---' || chr(10)) + 5)) - 1 as body_chars
from (select p_partkey, page, regexp_extract(page, '(?s)^---\\n(.*?)\\n---\\n', 1) as m from ({PAGE_SQL}))""")
def frontmatter_extract(spark, folder):
    rows = pages(spark, folder).withColumn("m", T.front_matter(F.col("page")))
    return rows.select("p_partkey", T.front_value(F.col("m"), "title").alias("title"), F.array_sort(T.front_list(F.col("m"), "tags")).alias("tags"), F.length(T.body(F.col("page"))).cast("long").alias("body_chars"))


@query(f"""select p_partkey, list_distinct_ordered as links from (select p_partkey, [brand, kind] || case when type <> brand then [type] else [] end as list_distinct_ordered from (
select p_partkey, regexp_extract(page, '[^!]\\[\\[([^\\]|]+)\\|', 1) as brand, regexp_extract(page, 'Tests\\nSee \\[\\[([^\\]|]+)\\]\\]', 1) as kind, regexp_extract(page, '\\]\\(([^)]*)\\)', 1) as type from ({PAGE_SQL})))""")
def wikilinks(spark, folder):
    return pages(spark, folder).select("p_partkey", T.wikilinks(T.without_code(T.body(F.col("page")))).alias("links"))


@query(f"select p_partkey, regexp_extract_all(page, '!\\[\\[([^\\]]+)\\]\\]', 1) as embeds from ({PAGE_SQL})")
def transclusions(spark, folder):
    return pages(spark, folder).select("p_partkey", T.transclusions(F.col("page")).alias("embeds"))


@query("select p_partkey, ['part', 'size' || p_size] as tags from part")
def inline_tags(spark, folder):
    return pages(spark, folder).select("p_partkey", T.inline_tags(T.without_code(T.body(F.col("page")))).alias("tags"))


@query("select p_partkey, 'sql' as language, 'select ' || p_size || ' -- [[no]] #no' || chr(10) as code from part")
def fenced_code(spark, folder):
    return pages(spark, folder).select("p_partkey", F.inline(T.fenced_code(F.col("page"))))


@query("""select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as header_turn,
case when contains(lower(last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row)), 'test') then 'tests' else 'links_to' end as edge_type
from conversations""")
def links_with_context(spark, folder):
    """The heading that stands before each link: user turns are the headings of their conversation."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    head = lambda c: F.last(F.when(F.col("role") == "user", F.col(c)), True).over(w)
    kind = F.when(F.contains(F.lower(head("text")), F.lit("test")), "tests").otherwise("links_to")
    return table(spark, folder, "conversations").select("conv_id", "turn", head("turn").alias("header_turn"), kind.alias("edge_type"))


#: Prefixes of paths, globs that leave files out, and whether these leave out what begins so.
PREFIXES = ["", "a/build/b/", "build/", "a/node_modules/", "node_modules/x/", "mybuild/", "a/.venv/lib/", ".git/", "docs/.hidden/", "my.folder/", "x-egg-info/"]
GONE = ["a/build/b/", "build/", "a/node_modules/", "node_modules/x/", "a/.venv/lib/", ".git/", "docs/.hidden/", "x-egg-info/"]


@query(f"""select page_id, prefix || p as path, prefix not in ({', '.join(f"'{x}'" for x in GONE)}) as accepted, prefix not in ({', '.join(f"'{x}'" for x in GONE)}) and regexp_matches(p, '/(en|de)/[^/]*$') and not regexp_matches(p, '7[^/]*$') as narrow
from (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as p from pages), (values {', '.join(f"('{x}')" for x in PREFIXES)}) v(prefix)""")
def path_predicate(spark, folder):
    """The default globs, and narrower ones, on pages as files in folders of many names."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = table(spark, folder, "pages").select("page_id", F.explode(F.array(*map(F.lit, PREFIXES))).alias("prefix"), path.alias("p")).select("page_id", F.concat("prefix", "p").alias("path"))
    narrow = files.accepted(F.col("path"), ["**/en/*", "**/de/*"], [*files.EXCLUDE, "*7*"])
    return rows.select("page_id", "path", files.accepted(F.col("path"), files.INCLUDE, files.EXCLUDE).alias("accepted"), narrow.alias("narrow"))


@query("""with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages), r as (select distinct split_part(path, '/', 1) as root, 'host ' || split_part(path, '/', 1) as project from p
union select distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 'lang ' || split_part(path, '/', 2) from p where split_part(path, '/', 2) in ('en', 'fr'))
select page_id, p.path, arg_max(r.project, length(r.root)) as project from p join r on p.path = r.root or starts_with(p.path, r.root || '/') group by page_id, p.path""")
def project_of_file(spark, folder):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = table(spark, folder, "pages").select("page_id", path.alias("path"))
    part = F.split("path", "/")
    hosts = rows.select(part[0].alias("root"), F.concat(F.lit("host "), part[0]).alias("project")).distinct()
    langs = rows.where(part[1].isin("en", "fr")).select(F.concat_ws("/", part[0], part[1]).alias("root"), F.concat(F.lit("lang "), part[1]).alias("project")).distinct()
    return rows.join(U.deepest_root(rows.select("path").distinct(), hosts.unionByName(langs), "path"), "path").select("page_id", "path", "project")


@query("""with l as (select l_orderkey, 'orders/' || l_orderkey || '.md' as source, case when l_linenumber % 3 = 0 then '/parts/' || l_partkey || '.md' when l_linenumber % 3 = 1 then '../x' when l_linenumber % 5 = 2 then 'https://x.y/' || l_partkey else 'part ' || l_suppkey end as target from lineitem)
select distinct source, target, case when starts_with(target, '/') then substr(target, 2) else 'orders/' || target || '.md' end as path from l
where (starts_with(target, '/parts/') and cast(regexp_extract(target, '[0-9]+') as bigint) in (select p_partkey from part where p_size <= 25)) or (starts_with(target, 'part ') and cast(regexp_extract(target, '[0-9]+') as bigint) in (select s_suppkey from supplier))""")
def resolved_links(spark, folder):
    n = F.col("l_linenumber")
    target = F.when(n % 3 == 0, F.concat(F.lit("/parts/"), F.col("l_partkey").cast("string"), F.lit(".md"))).when(n % 3 == 1, F.lit("../x")).when(n % 5 == 2, F.concat(F.lit("https://x.y/"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("part "), F.col("l_suppkey").cast("string")))
    links = table(spark, folder, "lineitem").select(F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit(".md")).alias("source"), target.alias("target")).distinct()
    known = table(spark, folder, "part").where("p_size <= 25").select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    near = table(spark, folder, "supplier").select(F.concat(F.lit("orders/part "), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"))
    return U.resolved_links(links.where("target <> '../x'"), known.unionByName(near))


@query("""select conv_id, turn, case when len(l) > 2 then list_aggregate(l[1:2], 'string_agg', chr(10)) || chr(10) || '... (' || (len(l) - 2) || ' lines omitted)' else text end as delta
from (select *, string_split(text, chr(10)) as l from conversations)""")
def delta_truncation(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", gitlog.truncated(F.col("text"), 2).alias("delta"))


@query("""select conv_id, turn, case when regexp_matches(text, '[a-z][A-Z]|[A-Z]{2,}[a-z]') or regexp_matches(text, '\\b[a-z]+_[a-z_]+\\b') or regexp_matches(text, '`[^`]+`') or regexp_matches(text, '\\b[vV]?\\d+\\.\\d+(\\.\\d+)?(-\\w+)?\\b') or regexp_matches(text, '"[^"]+"') then 'factual'
when regexp_matches(lower(text), 'section|chapter|guide|tutorial|documentation|docs') or regexp_matches(text, '\\[\\[[^\\]]+\\]\\]') then 'navigational' else 'exploratory' end as query_type from conversations""")
def query_classifier(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", T.query_type(F.col("text")).alias("query_type"))


@query("""select doc_id, s.section, s.level, s.title, s.path as header_path, md5(s.content) as digest from (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[`~]', '', 'g'), '^\\s+|\\s+$', '', 'g') as t from documents), unnest([
{'section': 1, 'level': 1, 'title': 'Doc ' || doc_id, 'path': 'Doc ' || doc_id, 'content': '```bash' || chr(10) || '# install it' || chr(10) || t || chr(10) || '```'},
{'section': 2, 'level': 2, 'title': 'Use', 'path': 'Doc ' || doc_id || ' > Use', 'content': '> # quoted' || chr(10) || chr(10) || '~~~~' || chr(10) || '~~~' || chr(10) || '## no' || chr(10) || '~~~~'},
{'section': 3, 'level': 1, 'title': 'End', 'path': 'End', 'content': 'x'}]) u(s)""")
def markdown_sections(spark, folder):
    """Sections of documents whose texts stand in fences with comments that look like headings."""
    from ..operators import chunk as C

    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[`~]", ""), r"^\s+|\s+$", "")
    number = F.col("doc_id").cast("string")
    page = F.concat(F.lit("Doc "), number, F.lit("\n=====\n```bash\n# install it\n"), text, F.lit("\n```\n\n  ## Use ##\n> # quoted\n\n~~~~\n~~~\n## no\n~~~~\nEnd\n=\nx\n"))
    rows = table(spark, folder, "documents").select("doc_id", page.alias("page"))
    return C.header_sections(rows, "doc_id", "page").select("doc_id", "section", "level", "title", "header_path", F.md5("content").alias("digest"))
