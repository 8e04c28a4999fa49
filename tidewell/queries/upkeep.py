"""Upserts, deltas, moves, bursts, leases, cursors, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projects as P
from ..operators import state as U
from ..session import table
from .registry import query

TS = "ts"


@query("select user_id, event_type, arg_max(event_id, struct_pack(t := ts, e := event_id)) as event_id, max(ts) as ts from events group by user_id, event_type")
def upsert_latest(spark, folder):
    """The last event of each user and type, merged from two halves of the table."""
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts")
    key = ["user_id", "event_type"]
    half = F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))
    old, new = (U.latest(rows.where(c), key, ["ts", "event_id"]) for c in (F.col("ts") < half, F.col("ts") >= half))
    return U.upsert(old, new, key).select("user_id", "event_type", "event_id", "ts")


@query("select distinct doc_id from documents where doc_id not in (select doc_id from labels)")
def stale_keys(spark, folder):
    return U.stale(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])


@query("""with f as (select distinct doc_id from documents where doc_id % 3 <> 0), i as (select distinct doc_id from labels) select doc_id, case when i.doc_id is null then 'added' else 'removed' end as change
from (select f.doc_id as a, i.doc_id as b, coalesce(f.doc_id, i.doc_id) as doc_id from f full join i on f.doc_id = i.doc_id) left join i using (doc_id) where a is null or b is null""")
def reconcile_added_removed(spark, folder):
    return U.reconciled(table(spark, folder, "documents").where("doc_id % 3 <> 0"), table(spark, folder, "labels"), "doc_id")


LINES = "select distinct doc_id, md5(l) as h, i from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)"


def line_digests(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).select("doc_id", F.md5("l").alias("h"), (F.col("i") + 1).alias("i"))


@query(f"""with l as materialized ({LINES}), o as (select distinct doc_id, h from l where (doc_id + i) % 4 <> 0), n as (select distinct doc_id, h from l where (doc_id * 7 + i) % 5 <> 0), c as (
select coalesce(o.doc_id, n.doc_id) as doc_id, cast(count(*) filter (o.h is null) as bigint) as added, cast(count(*) filter (n.h is null) as bigint) as removed, cast(count(*) filter (o.h = n.h) as bigint) as kept from o full join n on o.doc_id = n.doc_id and o.h = n.h group by 1)
select doc_id, added, removed, kept, round(greatest(added, removed) / (kept + greatest(added, removed)), 6) as ratio, case when added + removed = 0 then 'none' when kept + added = 0 then 'delete' when greatest(added, removed) / (kept + greatest(added, removed)) > 0.5 then 'reindex' else 'delta' end as action from c""")
def delta_by_hash(spark, folder):
    """Lines stand for chunks: some go and some come between two versions."""
    rows = line_digests(spark, folder)
    return U.deltas(rows.where("(doc_id + i) % 4 <> 0").select("doc_id", "h"), rows.where("(doc_id * 7 + i) % 5 <> 0").select("doc_id", "h"), "doc_id", "h")


@query(f"""with d as (select min(doc_id) as doc_id, text, doc_id % 2 as side from documents group by text, doc_id % 2), l as materialized (select distinct doc_id, side, md5(l) as h from (select doc_id, side, unnest(string_split(text, chr(10))) as l from d)), c as (select doc_id, count(*) as n from l group by all),
p as (select a.doc_id as o, b.doc_id as n, count(*) as m from l a join l b using (h) where a.side = 0 and b.side = 1 group by all), s as (select o, p.n as nw, m / (x.n + y.n - m) as s from p join c x on x.doc_id = o join c y on y.doc_id = p.n where m / (x.n + y.n - m) >= {U.MOVED}),
best as (select o, nw, s from s qualify row_number() over (partition by o order by s desc, nw) = 1) select e.doc_id as old, nw as new, round(s, 6) as similarity from best join d on d.doc_id = o and side = 0 join documents e on e.text = d.text and e.doc_id % 2 = 0""")
def move_detection(spark, folder):
    """Even documents went and odd ones came: all documents, with all their lines."""
    lines = line_digests(spark, folder)
    return U.moves(lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1"), "doc_id", "h")


@query()
def move_detection_whole(spark, folder):
    """Even documents went and odd ones came: all documents, with all their lines."""
    lines = line_digests(spark, folder)
    return U.moves(lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1"), "doc_id", "h")


@query("""with g as (select *, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as burst from g)
select user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) as event_type, count(*) as n, max(ts) as last_seen from s group by user_id, burst""")
def debounce_latest(spark, folder):
    rows = table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return U.debounced(rows, "user_id", "at", "event_type", "event_id", "30 minutes").withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("""with n as (select max(ts) as now from events), b as (select user_id, max(ts) as last_beat, count(*) as beats from events where event_type in ('view', 'click') group by all)
select user_id, last_beat, beats, cast(floor(epoch(now)) - floor(epoch(last_beat)) as bigint) as age, floor(epoch(now)) - floor(epoch(last_beat)) > 86400 as expired from b, n""")
def lease_expiry(spark, folder):
    """Views and clicks are heartbeats; a day is the timeout."""
    rows = table(spark, folder, "events")
    now = rows.agg(F.max("ts").alias("now"))  # one row
    beats = rows.where(F.col("event_type").isin("view", "click")).join(F.broadcast(now)).withColumn("at", F.col("ts").cast("timestamp"))
    state = U.lease_state(beats, "user_id", "at", F.lit("1970-01-01 00:00:00").cast("timestamp"), 0).select("user_id", "last_beat", "beats")
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp("last_beat")
    return state.join(F.broadcast(now)).select("user_id", F.col("last_beat").cast("timestamp_ntz").alias("last_beat"), "beats", age.alias("age"), (age > 86400).alias("expired"))


@query("""with l as (select user_id % 10 as operation, user_id as key, ts, event_id, case event_type when 'signup' then 'pending' when 'click' then 'claimed' when 'view' then 'running' when 'purchase' then 'succeeded' else 'failed' end as state from events)
select operation, key, arg_max(state, struct_pack(t := ts, e := event_id)) as state, cast(count(*) filter (state = 'claimed') as bigint) as attempts, max(ts) as updated_at from l group by all""")
def intent_latest_state(spark, folder):
    names = F.create_map(*[F.lit(x) for pair in (("signup", "pending"), ("click", "claimed"), ("view", "running"), ("purchase", "succeeded"), ("error", "failed")) for x in pair])
    log = table(spark, folder, "events").select((F.col("user_id") % 10).alias("operation"), F.col("user_id").alias("key"), "ts", "event_id", names[F.col("event_type")].alias("state"))
    return U.intents(log, "operation", "key", "ts", "state", "event_id").withColumn("attempts", F.col("attempts").cast("long"))


@query("select event_id, ts from events where floor(epoch(ts)) >= 1705000000 - 1")
def incremental_cursor(spark, folder):
    rows = table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return U.since(rows, "at", 1705000000).select("event_id", "ts")


@query("select coalesce(source, 'all') as root, count(*) as discovered, count(labels.doc_id) as indexed, greatest(count(*) - count(labels.doc_id), 0) as remaining from documents left join labels using (doc_id) group by rollup(source)")
def index_stats_rollup(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    out = rows.rollup("source").agg(F.count("*").alias("discovered"), F.count("l").alias("indexed"))
    return out.select(F.coalesce("source", F.lit("all")).alias("root"), "discovered", "indexed", F.greatest(F.col("discovered") - F.col("indexed"), F.lit(0)).alias("remaining"))


@query("select event_type as task, count(*) as n, round(count(*) / 10000, 6) as utilisation, max(ts) filter (value > 90) as last_failure from events group by all")
def task_counts(spark, folder):
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("n"), F.round(F.count("*") / 10000, 6).alias("utilisation"), F.max(F.when(F.col("value") > 90, F.col("ts"))).alias("last_failure"))


@query("""with d as (select user_id, count(*) filter (event_type = 'purchase') as done, count(*) as total, floor(epoch(max(ts))) - floor(epoch(min(ts))) as s from events group by all)
select user_id, round(done / nullif(s, 0), 6) as rate, round((total - done) / nullif(done / nullif(s, 0), 0), 6) as eta, round(100 * done / total, 6) as percent from d""")
def progress_eta(spark, folder):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    d = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("done"), F.count("*").alias("total"), (F.max(at) - F.min(at)).alias("s"))
    return d.select("user_id", *U.progress(F.col("done"), F.col("total"), F.col("s")))


@query("select event_type, count(*) as n, round(min(value), 6) as least, round(avg(value), 6) as mean, round(max(value), 6) as most, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by all")
def latency_percentiles(spark, folder):
    return U.latency(table(spark, folder, "events"), ["event_type"], "value")


@query("select o_custkey, o_orderkey, cast((row_number() over (partition by o_custkey order by o_orderkey) - 1) // 4 as bigint) as batch from orders")
def batches(spark, folder):
    return U.batches(table(spark, folder, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 4)


@query("select conv_id, sha256('[' || string_agg(turn::varchar, ',' order by turn) || ']') as batch_key from conversations group by all")
def batch_keys(spark, folder):
    return table(spark, folder, "conversations").groupBy("conv_id").agg(U.batch_key(F.array_sort(F.collect_list("turn"))).alias("batch_key"))


@query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_windows(spark, folder):
    """The batch form of the streaming windows."""
    rows = table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("select n_name, count(*) as suppliers, count(*) filter (s_acctbal < 0) as indebted, max(s_suppkey) as newest from supplier join nation on s_nationkey = n_nationkey group by all")
def dimension_rollup(spark, folder):
    rows = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("suppliers"), F.count(F.when(F.col("s_acctbal") < 0, 1)).alias("indebted"), F.max("s_suppkey").alias("newest"))


URLS = "select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages"


def page_paths(spark, folder):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, folder, "pages").select("page_id", path.alias("path"))


@query(f"""with c as (select page_id, case when c = '' then 'project' else c end as c from (select page_id, regexp_replace(regexp_replace(path, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') as c from (select page_id, split_part(path, '/', 1) as path from ({URLS})))),
n as (select *, row_number() over (partition by c order by page_id) as n from c) select page_id, case when n = 1 then c else c || '-' || n end as name from n""")
def unique_names(spark, folder):
    return P.unique_names(page_paths(spark, folder).withColumn("host", F.substring_index("path", "/", 1)), "page_id", "host")


@query(f"""with r as (select distinct split_part(path, '/', 1) as root from ({URLS}) union select distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from ({URLS}))
select o.root as "outer", i.root as "inner" from r o join r i on starts_with(i.root, o.root || '/')""")
def nested_roots(spark, folder):
    part = F.split("path", "/")
    rows = page_paths(spark, folder)
    roots = rows.select(part[0].alias("root")).union(rows.select(F.concat_ws("/", part[0], part[1]))).distinct()
    return P.nested(roots.withColumn("name", F.col("root")), "name", "root")


@query(f"select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as folder, list(page_id order by page_id) as keys from ({URLS}) group by 1 having count(*) > 1")
def duplicate_paths(spark, folder):
    """Folders that several pages share."""
    return P.duplicates(page_paths(spark, folder).withColumn("folder", F.concat_ws("/", F.slice(F.split("path", "/"), 1, 2))), "folder", "page_id")


@query("select o_custkey, arg_min(o_orderkey, struct_pack(a := o_orderpriority not in ('1-URGENT', '2-HIGH'), b := o_orderstatus <> 'O', c := o_orderkey)) as o_orderkey from orders group by all")
def canonical_choice(spark, folder):
    """The choice of a main copy, as orders of a customer."""
    order = F.struct(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus") != "O", F.col("o_orderkey"))
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("o_orderkey"))


@query("select doc_id as path, n_chars as size from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = d.n_chars % 2)")
def resume_remaining(spark, folder):
    """Documents whose checkpoint is missing or of another state; parity stands for the time of change."""
    found = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), (F.col("n_chars") % 2).alias("modified_time"), F.col("n_chars").alias("size"))
    done = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("path"), F.col("quality").cast("long").alias("modified_time"), F.col("n_chars").alias("size"))
    return U.remaining(found, done, "path").select("path", "size")


@query("select count(*) as old, count(*) filter (vec_id % 7 <> 0) as new, count(distinct len(embedding)) filter (vec_id % 7 <> 0) as sizes, count(*) filter (vec_id % 7 = 0) as missing, false as whole from embeddings")
def model_migration(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return U.migrated(vectors, vectors.where("vec_id % 7 <> 0"), "vec_id")
