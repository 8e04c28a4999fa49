"""Upkeep of an index as tables: upserts, deltas, moves, reconciliation, leases and intents, counts."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import released, sent, staged

#: From this share of changed chunks on a document is indexed anew, and of shared chunks on a file has moved.
REINDEX, MOVED = 0.5, 0.8
#: Seconds: a path is quiet after the first, a lease is stale after the second, and a cursor is read again from the third before it.
QUIET, STALE, AGAIN = 0.5, 60, 1


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, without a sort: all columns of the greatest order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new, and the rows of old whose key is not in it."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def stale(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys of old that new has no more."""
    return old.select(*key).distinct().join(new.select(*key), key, "left_anti")


def reconciled(found: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """key and change: added or removed."""
    a = found.select(key).distinct().withColumn("f", F.lit(True))
    b = indexed.select(key).distinct().withColumn("i", F.lit(True))
    return a.join(b, key, "full").where("f is null or i is null").select(key, F.when(F.col("i").isNull(), "added").otherwise("removed").alias("change"))


def deltas(old: DataFrame, new: DataFrame, doc: str, digest: str) -> DataFrame:
    """doc, added, removed, kept, ratio and action of documents in either; chunks are told by their digests."""
    a = old.select(doc, digest).distinct().withColumn("o", F.lit(1))
    b = new.select(doc, digest).distinct().withColumn("n", F.lit(1))
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    both = a.join(b, [doc, digest], "full").groupBy(doc).agg(count(F.col("o").isNull(), "added"), count(F.col("n").isNull(), "removed"), count(F.col("o").isNotNull() & F.col("n").isNotNull(), "kept"))
    ratio = F.greatest("added", "removed") / (F.col("kept") + F.greatest("added", "removed"))
    action = F.when(F.col("added") + F.col("removed") == 0, "none").when(F.col("kept") + F.col("added") == 0, "delete").when(ratio > REINDEX, "reindex").otherwise("delta")
    return both.select(doc, "added", "removed", "kept", F.round(ratio, 6).alias("ratio"), action.alias("action"))


def moves(gone: DataFrame, came: DataFrame, doc: str, digest: str) -> DataFrame:
    """old, new and similarity of documents that went and came with the same chunks, each with its best match.

    Exact over all chunks. Documents of one side with equal sets of chunks are one node, and equal sets of both sides are
    joined at once. Of the rest, two sets as close as MOVED have one of their rarest chunks in common: each set's first
    n - ceil(MOVED n) + 1, in one order for all. Such pairs are compared in full."""
    slack = 1e-9  # a bound that rounds up would lose a pair at MOVED

    def nodes(side):
        docs = side.select(F.col(doc).alias("doc"), F.col(digest).alias("h")).groupBy("doc").agg(F.array_sort(F.collect_set("h")).alias("hs"))
        return docs.where(F.size("hs") > 0).withColumn("node", batch_key(F.col("hs")))

    old, new = nodes(gone), nodes(came)
    # the best of equal nodes is the one with the least key
    a = old.groupBy("node").agg(F.first("hs").alias("hs"))
    b = new.groupBy("node").agg(F.first("hs").alias("hs"), F.min("doc").alias("new"))
    equal = a.select("node").join(b.select("node", "new"), "node").withColumn("similarity", F.lit(1.0))
    left = a.join(b.select("node"), "node", "left_anti")
    count = left.select("hs").unionAll(b.select("hs")).select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("df"))

    def prefix(side, name):
        rows = side.select("node", F.size("hs").alias("n"), F.explode("hs").alias("h")).join(count, "h")
        order = rows.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
        first = F.slice("o", F.lit(1), (F.col("n") - F.ceil(MOVED * F.col("n") - slack) + 1).cast("int"))
        return order.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.posexplode(first).alias(f"at{name}", "f")).select(name, f"n{name}", f"at{name}", F.col("f.h").alias("h"))

    na, nb = F.col("na"), F.col("nb")
    # at the first chunk in common, no more than what follows can be shared
    enough = F.least(na - F.col("ata"), nb - F.col("atb")) >= MOVED / (1 + MOVED) * (na + nb) - slack
    pairs = prefix(left, "a").join(prefix(b, "b"), "h").where(enough).select("a", "b").distinct()
    both = pairs.join(left.select(F.col("node").alias("a"), F.col("hs").alias("ha")), "a").join(b.select(F.col("node").alias("b"), F.col("hs").alias("hb"), "new"), "b")
    n = F.size(F.array_intersect("ha", "hb"))
    close = both.select(F.col("a").alias("node"), "new", (n / (F.size("ha") + F.size("hb") - n)).alias("similarity")).where(F.col("similarity") >= MOVED)
    best = close.groupBy("node").agg(F.min_by(F.struct("new", "similarity"), F.struct(-F.col("similarity"), "new")).alias("m")).select("node", "m.new", "m.similarity")
    return old.select("node", F.col("doc").alias("old")).join(equal.unionByName(best), "node").select("old", "new", F.round("similarity", 6).alias("similarity"))


def file_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, file_path, modified_time, size, change and action of files that differ between two looks: created or modified
    ones are to be indexed, deleted ones removed. Both: path, file_path, modified_time, size."""
    old = before.select("path", F.struct("file_path", "modified_time", "size").alias("old"))
    new = now.select("path", F.struct("file_path", "modified_time", "size").alias("new"))
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when((F.col("old.modified_time") != F.col("new.modified_time")) | (F.col("old.size") != F.col("new.size")), "modified")
    rows = old.join(new, "path", "full").withColumn("change", change).where("change is not null").withColumn("f", F.coalesce("new", "old"))
    return rows.select("path", "f.*", "change", F.when(F.col("change") == "deleted", "remove").otherwise("index").alias("action"))


def bounded_intake(events: DataFrame, by: Column, limit: int) -> DataFrame:
    """tick, taken, dropped and reconcile: what a bounded queue takes in each tick, and whether the rest calls for a look at all files."""
    return events.groupBy(by.alias("tick")).agg(F.count("*").alias("n")).select("tick", F.least("n", F.lit(limit)).alias("taken"), F.greatest(F.col("n") - limit, F.lit(0)).alias("dropped"), (F.col("n") > limit).alias("reconcile"))


def page_after(rows: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """The next n rows by key after a cursor, or the first n: for callers that read a page at a time."""
    return (rows if cursor is None else rows.where(F.col(key) > cursor)).orderBy(key).limit(n)


def monotone(before: DataFrame, now: DataFrame, key: str, request: str, counters: list[str], kept: list[str]) -> DataFrame:
    """now, with counters that never fall while the request is the same, and values in `kept` that are not lost."""
    old = before.select(key, F.col(request).alias("_request"), *[F.col(c).alias(f"_{c}") for c in (*counters, *kept)])
    same = F.col("_request") == F.col(request)
    rows = now.join(old, key, "left")
    out = [F.when(same & F.col(c).isNotNull(), F.greatest(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c in counters]
    out += [F.when(same, F.coalesce(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c in kept]
    return rows.select(*[c for c in now.columns if c not in (*counters, *kept)], *out)


def identity(**parts: object) -> Column:
    """One value for the configuration, encoder and repositories that a checkpoint was made with."""
    return F.sha2(F.to_json(F.struct(*[F.lit(str(v)).alias(k) for k, v in sorted(parts.items())])), 256)


def resumed(found: DataFrame, checkpoint: DataFrame, own: Column) -> DataFrame:
    """Files still to do: all of them if the checkpoint's identity is another, else those that it lacks or has with another
    time or size. Both: path, modified_time, size; checkpoint: identity besides."""
    return remaining(found, checkpoint.where(F.col("identity") == own), "path")


def availability(found: DataFrame, lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """lexical, graph and semantic: available once any file is in, complete once all are; words and links come first,
    vectors are filled in after. All: path."""
    n = lambda f, name: f.select("path").distinct().agg(F.count("*").alias(name))
    inside = lambda f: f.select("path").join(found.select("path"), "path", "left_semi")
    # one row each
    rows = n(found, "all").join(F.broadcast(n(inside(lexical), "words"))).join(F.broadcast(n(inside(semantic), "vectors")))
    words = F.when((F.col("words") == 0) & (F.col("all") > 0), "unavailable").otherwise("available")
    vectors = F.when(F.col("vectors") >= F.col("all"), "complete").when(F.col("words") > 0, "backfilling").otherwise("unavailable")
    return rows.select(words.alias("lexical"), words.alias("graph"), vectors.alias("semantic"))


def flipped(pointer: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """The pointer to the model that searches use, set to `model` if its vectors are whole: one for each that the present
    model has, all of one size. pointer: one row with model and previous; vectors: model, key, embedding. Else as it was."""
    old = vectors.join(F.broadcast(pointer.select("model")), "model").select("key").distinct()
    fresh = vectors.where(F.col("model") == model).select("key", F.size("embedding").alias("s"))
    state = migrated(old.select("key"), fresh.withColumn("embedding", F.array_repeat(F.lit(0), F.col("s"))), "key").select((F.col("whole") & (F.col("new") > 0)).alias("whole"))
    return pointer.join(F.broadcast(state)).select(F.when(F.col("whole"), F.lit(model)).otherwise(F.col("model")).alias("model"), F.when(F.col("whole"), F.col("model")).otherwise(F.col("previous")).alias("previous"), "whole")


def rolled_back(pointer: DataFrame) -> DataFrame:
    """The pointer set to the model before; as it was if there is none."""
    return pointer.select(F.coalesce("previous", "model").alias("model"), F.when(F.col("previous").isNotNull(), F.col("model")).alias("previous"))


def contracted(vectors: DataFrame, pointer: DataFrame) -> DataFrame:
    """The vectors of the model that searches use: those of others may go."""
    return vectors.join(F.broadcast(pointer.select("model")), "model", "left_semi")


def debounced(events: DataFrame, path: str, ts: str, kind: str, tie: str, quiet: str) -> DataFrame:
    """The last event of each burst of a path: a burst ends when nothing comes for the time `quiet`."""
    burst = F.session_window(ts, quiet)
    return events.groupBy(path, burst.alias("burst")).agg(F.max_by(kind, F.struct(ts, tie)).alias(kind), F.count("*").alias("n"), F.max(ts).alias("last_seen")).select(path, kind, "n", "last_seen")


def lease_state(beats: DataFrame, owner: str, ts: str, now: Column, timeout: int = STALE) -> DataFrame:
    """Last heartbeat of every owner, its age in seconds, and whether another may take its lease."""
    seen = beats.groupBy(owner).agg(F.max(ts).alias("last_beat"), F.count("*").alias("beats"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_beat")
    return seen.select(owner, "last_beat", "beats", age.alias("age"), (age > timeout).alias("expired"))


def intents(log: DataFrame, operation: str, key: str, ts: str, state: str, tie: str) -> DataFrame:
    """Current state of every (operation, key), attempts, and whether it is done; from a log of states."""
    return log.groupBy(operation, key).agg(F.max_by(state, F.struct(ts, tie)).alias("state"), F.sum((F.col(state) == "claimed").cast("int")).alias("attempts"), F.max(ts).alias("updated_at"))


def since(rows: DataFrame, ts: str, cursor: int) -> DataFrame:
    """Rows from just before a cursor in seconds: read twice is better than missed, and upserts make it harmless."""
    return rows.where(F.unix_timestamp(ts) >= max(0, cursor - AGAIN)) if cursor else rows


def progress(done: Column, total: Column, seconds: Column) -> list[Column]:
    rate = done / F.nullif(seconds, F.lit(0))
    return [F.round(rate, 6).alias("rate"), F.round((total - done) / F.nullif(rate, F.lit(0.0)), 6).alias("eta"), F.round(100 * done / F.nullif(total, F.lit(0)), 6).alias("percent")]


def batches(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """Number of the batch of n rows that each row is in, within its group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / n))


def batch_key(ids: Column) -> Column:
    """SHA-256 of a list of ids written as JSON."""
    return F.sha2(F.to_json(ids), 256)


def deepest_root(files: DataFrame, roots: DataFrame, path: str) -> DataFrame:
    """Project of each file: that of the deepest root that holds it; null if none does.

    A file's ancestors are exploded and joined by equality, so roots may be many."""
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    found = files.select(path, F.posexplode(up).alias("depth", "root")).join(roots, "root").groupBy(path).agg(F.max_by("project", "depth").alias("project"))
    return files.join(found, path, "left")


def tried_paths(source: Column, target: Column) -> Column:
    """Paths that a link from the document at `source` may lead to, the likeliest first: from the root, from the source's
    folder, and as it stands. Null of addresses with a scheme and of anchors, which are no files."""
    bare = F.regexp_replace(F.url_decode(F.replace(F.substring_index(target, "#", 1), F.lit("+"), F.lit("%2B"))), "^/+", "")
    named = F.when(F.endswith(bare, F.lit(".md")), bare).otherwise(F.concat(bare, F.lit(".md")))
    tried = F.array(named, F.concat(F.regexp_extract(source, r"^(.*/)?[^/]*$", 1), named), bare)
    return F.when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//|^#"), tried)


def resolved_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """source, target and path of links that lead to a known file: under the source's folder, or from the root.

    links: source, target; files: path. Addresses with a scheme and anchors are no files; targets without .md get it."""
    local = links.where(~F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//|^#"))
    w = Window.partitionBy("source", "target").orderBy("priority")
    found = local.select("source", "target", F.posexplode(tried_paths(F.col("source"), F.col("target"))).alias("priority", "path")).join(files.select("path").distinct(), "path")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "target", "path")


def communities(edges: DataFrame, rounds: int) -> DataFrame:
    """node and community after so many rounds of label propagation: each node takes its neighbours' most frequent label,
    the smallest of equals. The labels of a round are a table, so that the plan does not grow."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    label = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    both = staged(both, "edges")
    for _ in range(rounds):
        seen = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        label = staged(seen.groupBy(F.col("src").alias("node")).agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community")), "labels")
    return label


def settled_communities(edges: DataFrame) -> DataFrame:
    """node and community when every node has a label that none is more frequent than among its neighbours: label propagation
    until it is stable. Nodes without edges to others, null ends among them, have none.

    Labels that nodes want have an order that is drawn anew each round, and nodes move label by label. A node moves if that gains
    edges within its community whatever the nodes do that want an earlier label: their votes count for none that it wants, and
    against it if they have or want its own label. Nodes that want the same label do not stand in each other's way, and those of the
    first one all move; so each round brings more edges within communities, and it ends. Whole labels of a round at once may swing
    for ever, and one node of all neighbours at a time takes a round for each where many are neighbours. The smallest of equally
    frequent labels is taken."""
    both = edges.where("src <> dst").select("src", "dst")
    both = staged(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    label = staged(both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    n = label.count()
    for round_ in itertools.count():
        # Votes are summed before they are shuffled, a hub's too.
        votes = both.join(sent(label.withColumnRenamed("node", "dst"), n), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.count("*").alias("n"))
        held = votes.join(sent(label.withColumnRenamed("community", "held"), n), "node")
        best = held.groupBy("node", "held").agg(F.max(F.struct("n", (-F.col("community")).alias("c"))).alias("best"), F.max(F.when(F.col("community") == F.col("held"), F.col("n"))).alias("own"))
        wanted = -F.col("best.c")
        wants = best.where(F.col("best.n") > F.coalesce("own", F.lit(0))).select("node", "held", wanted.alias("wanted"), F.struct(F.xxhash64(wanted, F.lit(round_)).alias("h"), wanted.alias("k")).alias("turn"))
        wants = staged(wants, "wants")
        m = wants.count()
        if not m:
            released(wants)
            released(both)
            return label
        others = label.join(sent(wants.select("node", "wanted", "turn"), m, 48), "node", "left")
        others = others.select(F.col("node").alias("dst"), "community", F.col("wanted").alias("to"), F.col("turn").alias("other"))
        near = both.join(sent(wants.withColumnRenamed("node", "src"), m, 48), "src").join(sent(others, n, 56), "dst")
        early = F.coalesce(F.col("other") < F.col("turn"), F.lit(False))
        gained = (F.col("community") == F.col("wanted")) & ~early
        lost = (F.col("community") == F.col("held")) | (early & (F.col("to") == F.col("held")))
        moves = near.groupBy(F.col("src").alias("node"), "wanted").agg(F.sum(gained.cast("int") - lost.cast("int")).alias("more")).where("more > 0").select("node", "wanted")
        before, label = label, staged(label.join(sent(moves, m), "node", "left").select("node", F.coalesce("wanted", "community").alias("community")), "labels")
        released(before)
        released(wants)


def latency(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, least, mean, most, and the 50th, 95th and 99th percentile of each group."""
    p = F.percentile(value, [0.5, 0.95, 0.99])
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"), p.alias("p"))
    return out.select(*by, "n", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"), *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def fetch_limit(n: int, projects: bool, most: int = 100) -> int:
    return min(most, max(n, 10 * n if projects else n))


def remaining(found: DataFrame, done: DataFrame, path: str) -> DataFrame:
    """Files to do after a break: those not in the checkpoint with the same time and size."""
    return found.join(done.select(path, "modified_time", "size"), [path, "modified_time", "size"], "left_anti")


def migrated(vectors: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Counts that a change of model is judged by: rows of the old one, of the new, missing and of mixed size; `whole` if all are there."""
    have = fresh.select(key, F.size("embedding").alias("s"))
    n = have.agg(F.count("*").alias("new"), F.count_distinct("s").alias("sizes"))
    lost = vectors.select(key).join(have.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    # one row each
    counts = vectors.agg(F.count("*").alias("old")).join(F.broadcast(n)).join(F.broadcast(lost))
    return counts.withColumn("whole", (F.col("missing") == 0) & (F.col("sizes") <= 1))
