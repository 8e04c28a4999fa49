"""Links between similar sets: MinHash bands, odd sketches, exact Jaccard on full sets, and connected components.

Nodes are distinct sets. Bands give groups of candidates; odd sketches drop pairs that are surely apart. Each group has
a leader, the member that shares its keys with most others: the others are compared with it in full, so rows grow with
the group and not with its square. What one component holds then needs no comparison in it; members outside their
leader's component are held against all of the group, block by block, by sketches. What is near is told as forests, whose components are
families: they hold every candidate pair that is left. Of a family, the rest is compared with all, block by block, on
full sets. The components of all links are the classes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, mixed, staged

#: Bits of an odd sketch, and how many standard deviations under the threshold an estimate may lie.
SKETCH_BITS, DEVIATIONS = 256, 5.0
#: Members of a group in a block, at least and at most, and blocks of a group where these allow; members that a leader is compared with in a block; members of a family, and shingles, in a block.
GROUP_BLOCK, GROUP_MOST, GROUP_BLOCKS, LED_BLOCK, FAMILY_BLOCK, BLOCK_SHINGLES = 512, 8192, 64, 64, 256, 400_000
#: Columns of the 0/1 matrices that are multiplied at once.
COLUMNS = 8192
#: Shingles that are permuted at once: few enough to stay in the cache.
SLICE = 1 << 15
#: Bytes, and rows, that are sent to all tasks at most; beyond that both sides are shuffled.
SENT_BYTES, MOST_SENT = 16 << 20, 1_000_000
#: Edges that one task unites by itself; beyond that rounds of stars do.
FEW_EDGES = 2_000_000
EDGE = "src long, dst long"
#: Band keys that a task holds back to count together, and nodes for each range of keys.
HELD_KEYS, BUCKET_NODES = 1_000_000, 20_000


@functools.cache
def permutations(n: int) -> list[tuple[np.uint32, np.uint32]]:
    """Fixed odd multipliers and masks: bijections of 32-bit values."""
    draw = np.random.default_rng(977).integers(0, 1 << 32, (n, 2), dtype=np.uint64)
    return [(np.uint32(a | 1), np.uint32(b)) for a, b in draw.tolist()]


def min_hashes(shingle: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """n by sets: the least of n permutations of the 32 upper bits, over the shingles from each start to the next; no set is empty."""
    x = (shingle >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(start)), np.uint32)
    edge = np.append(start, len(x))
    # Whole sets of about SLICE shingles at a time, which stay in the cache for all permutations.
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(x) + SLICE, SLICE)), len(start)))
    room = np.empty((edge[cuts[1:]] - edge[cuts[:-1]]).max(initial=0), np.uint32)
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, at = x[edge[s] : edge[e]], start[s:e] - start[s]
        h = room[: len(own)]
        for i, (a, b) in enumerate(permutations(n)):
            np.bitwise_xor(own, b, out=h)
            np.multiply(h, a, out=h)
            np.minimum.reduceat(h, at, out=out[i, s:e])
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """sets by SKETCH_BITS / 64 words: each sample flips the bit that its value and place are hashed to."""
    n, sets = samples.shape
    place = np.arange(n, dtype=np.uint64)[:, None] << np.uint64(32)
    bit = (mixed(samples.astype(np.uint64) | place) >> np.uint64(64 - int(math.log2(SKETCH_BITS)))).astype(np.int64)
    word, mask = bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64)
    return np.stack([np.bitwise_xor.reduce(np.where(word == w, mask, np.uint64(0)), axis=0) for w in range(SKETCH_BITS // 64)], axis=1).view(np.int64) if sets else np.zeros((0, SKETCH_BITS // 64), np.int64)


def most_bits(similarity: float, samples: int) -> int:
    """Differing bits up to which a pair of at least this similarity may show, with DEVIATIONS to spare.

    Of the samples, a share 1 - s differs, and each of the two differing values flips a bit.
    """
    low = max(0.0, similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / samples))
    expected = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * samples * (1 - low)))
    return int(expected + 2 * math.sqrt(SKETCH_BITS) / 2)


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """sets by bands: 64-bit keys, different for different bands."""
    h = np.zeros((bands, samples.shape[1]), np.uint64)
    for r in range(rows):
        h = mixed(h * np.uint64(3) + samples[r : bands * rows : rows].astype(np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)[:, None])
    return h.view(np.int64).T


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal `names`, from batches sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        last = np.ones(t.num_rows, bool)
        for name in names:
            c = t.column(name).to_numpy()
            last &= c == c[-1]
        cut = t.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where each group begins, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in names:
        c = table.column(name).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for links a-b among n."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
    return root


def counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct band keys with their counts, some rows together, packed by range of keys."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def packed() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
        cut = np.concatenate(([0], np.searchsorted(key, edges), [len(key)]))
        full = np.flatnonzero(np.diff(cut))
        out = [key[cut[i] : cut[i + 1]].tobytes() + n[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in full.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(out, pa.binary())], ["bucket", "packed"])

    held, n = [], 0
    for batch in batches:
        held.append(batch.column("bands").flatten().to_numpy())
        n += len(held[-1])
        if n >= HELD_KEYS:
            yield packed()
            held, n = [], 0
    if n:
        yield packed()


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that stand more than once, and how often."""
    for t in grouped(batches, ["bucket"]):
        blobs = t.column("packed").to_pylist()
        key = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 12) for b in blobs])
        n = np.concatenate([np.frombuffer(b, np.uint32, -1, len(b) // 12 * 8) for b in blobs])
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        total = np.add.reduceat(n[order].astype(np.int64), first)
        yield pa.RecordBatch.from_arrays([pa.array(key[order][first][total > 1].view(np.int64)), pa.array(total[total > 1])], ["key", "n"])


def close_pairs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Forests over the members of blocks (key, i, j), of pairs of both sides and two components whose sketches are near."""
    for t in grouped(batches, ["key", "i", "j"]):
        node, side, own = (t.column(c).to_numpy() for c in ("node", "side", "c"))
        sketch = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        edge = starts(t, ["key", "i", "j"])
        size = np.diff(edge)
        group = np.repeat(np.arange(len(size)), size)
        left, right = [], []
        for d in range(1, int(size.max())):
            a = np.flatnonzero(group[d:] == group[:-d])
            if not len(a):
                break
            a = a[(side[a] != side[a + d]) & (own[a] != own[a + d])]
            near = np.bitwise_count(sketch[a] ^ sketch[a + d]).sum(1) <= bits
            left.append(a[near])
            right.append(a[near] + d)
        if left:
            root = roots(len(node), np.concatenate(left), np.concatenate(right))
            other = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[root[other]]), pa.array(node[other])], ["src", "dst"])


def hashes(items: list[bytes]) -> list[np.ndarray]:
    """Sets that were packed as sorted 64-bit hashes."""
    return [np.frombuffer(x, np.uint64) for x in items]


def dense(owner: np.ndarray, code: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
    """A row of 0 and 1 for each owner that is marked in `own`: which of `width` items it has."""
    mine, row = own[owner], np.cumsum(own) - 1
    out = np.zeros((np.count_nonzero(own), width), np.float32)
    out[row[owner[mine]], code[mine]] = 1
    return out


def links(batches: Iterator[pa.RecordBatch], percent: int, sets_of: Callable[[list[bytes]], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links in blocks (family, i, j): pairs of both sides with 100 * intersection >= percent * union, on full sets."""
    names = ["family", "i", "j"]
    for table in grouped(batches, names):
        edge = starts(table, names)
        every = sets_of(table.column("items").to_pylist())
        nodes, sides = table.column("node").to_numpy(), table.column("side").to_numpy()
        pairs = []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            node, side, sets = nodes[s:e], sides[s:e], every[s:e]
            if e - s == 2:
                if side[0] != side[1]:
                    both = np.concatenate(sets)
                    both.sort(kind="stable")
                    n = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * n >= percent * (len(both) - n):
                        pairs.append(s)
                continue
            # A member that stands on both sides counts once.
            node, first, place = np.unique(node, return_index=True, return_inverse=True)
            left, right = (np.bincount(place[side != k], minlength=len(node)) > 0 for k in (2, 1))
            rows, cols = np.flatnonzero(left), np.flatnonzero(right)
            if not len(rows) or not len(cols):
                continue
            sets = [sets[k] for k in first.tolist()]
            size = np.array([len(x) for x in sets])
            item = np.concatenate(sets)
            order = np.argsort(item)
            item, owner = item[order], np.repeat(np.arange(len(sets)), size)[order]
            # What one member alone has is in no intersection.
            same = item[1:] == item[:-1]
            many = (np.append(False, same) | np.append(same, False))[: len(item)]
            code, owner = np.cumsum(np.append(True, ~same)[: len(item)][many]) - 1, owner[many]
            n = int(code[-1]) + 1 if len(code) else 0
            both = np.zeros((len(rows), len(cols)), np.float32)
            for at in range(0, n, COLUMNS):
                lo, hi = np.searchsorted(code, (at, at + COLUMNS))
                one, two = (dense(owner[lo:hi], code[lo:hi] - at, own, min(COLUMNS, n - at)) for own in (left, right))
                both += one @ two.T
            union = size[rows][:, None] + size[cols][None] - both
            a, b = np.nonzero(100 * both.astype(np.float64) >= percent * union.astype(np.float64))
            root = roots(len(node), rows[a], cols[b])
            other = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[root[other]]), pa.array(node[other])], ["src", "dst"])
        at = np.array(pairs, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[at + 1])], ["src", "dst"])


def among(items: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which items are among some: each of these has a place in a table; those that another one put out are looked up."""
    bits = max(10, (8 * len(some)).bit_length())
    mask = np.uint64((1 << bits) - 1)
    table, shared = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool)
    at = (some & mask).astype(np.int64)
    table[at] = some
    out = some[table[at] != some]
    shared[(out & mask).astype(np.int64)] = True
    at = (items & mask).astype(np.int64)
    found = (table[at] == items) & (items != 0)
    rest = np.flatnonzero(shared[at] & ~found)
    found[rest] = np.isin(items[rest], out)
    if (some == 0).any():
        found |= items == 0
    return found


def star_links(batches: Iterator[pa.RecordBatch], percent: int, sets_of: Callable[[list[bytes]], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Links of the first of each block (family, i, j), of side 1, with the others, on full sets."""
    names = ["family", "i", "j"]
    for table in grouped(batches, names):
        edge = starts(table, names)
        sets = sets_of(table.column("items").to_pylist())
        node, size = table.column("node").to_numpy(), np.array([len(x) for x in sets])
        block = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        # A shingle counts in its own block alone.
        items = mixed(np.concatenate(sets) + np.repeat(block, size).astype(np.uint64) * np.uint64(BASE))
        first = np.zeros(len(node), bool)
        first[edge[:-1]] = True
        both = np.add.reduceat(among(items, items[np.repeat(first, size)]).astype(np.int64), np.cumsum(size) - size)
        head = edge[:-1][block]
        linked = np.flatnonzero(~first & (100 * both >= percent * (size + size[head] - both)))
        yield pa.RecordBatch.from_arrays([pa.array(node[head[linked]]), pa.array(node[linked])], ["src", "dst"])


def blocked(rows: DataFrame, size, others) -> DataFrame:
    """The rows of a group in blocks (i, j): each once for every block j of the rest as side 1, and those of the rest (by
    the column `rest`) once for every block i of all as side 2. size and others: how many blocks all and the rest have."""
    lot = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    out = rows.withColumn("size", size.cast("int")).withColumn("others", others.cast("int")).withColumn("i", lot(3, F.col("size"))).withColumn("j", lot(4, F.col("others")))
    one = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: cell(F.col("i"), j, 1))
    two = F.when(F.col("rest"), F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: cell(i, F.col("j"), 2)))
    return out.withColumn("cell", F.explode(F.concat(one, F.coalesce(two, F.array().cast("array<struct<i:int,j:int,side:int>>"))))).drop("i", "j", "size", "others", "rest").select("*", "cell.*").drop("cell")


def sent(small: DataFrame, rows: int, width: int = 16) -> DataFrame:
    """Sent to all tasks if its counted rows, of about `width` bytes each, are few; else a shuffled table of hashes, as no
    key has many rows of it, so that the other side, which may be whole texts, is not sorted."""
    return F.broadcast(small) if rows <= MOST_SENT and rows * width <= SENT_BYTES else small.hint("shuffle_hash")


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root, the least node of its component, for the nodes of all edges in the batches."""
    held = [(b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = node[roots(len(node), at[: len(a)], at[len(a) :])]
        for s in range(0, len(node), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(node[s : s + SLICE]), pa.array(root[s : s + SLICE])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for the nodes of edges src-dst: of FEW_EDGES at most by one task,
    beyond that by large and small stars in turn.

    Each round links the neighbours of every node to the least of them; a table in the shared folder ends a round.
    """
    edges = staged(edges.select("src", "dst").where("src <> dst"), "edges")
    if edges.count() <= FEW_EDGES:
        return edges.coalesce(1).mapInArrow(united, "node long, root long")
    edges = staged(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    count = edges.count()
    while count:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(sent(least, 2 * count), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(low, 2 * count), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = staged(small, "edges")
        # At the end every node has one parent, and no parent has one.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).select((F.col("up") + F.col("down") * F.sign("up") > 1).cast("int").alias("open"), "up")
        still, count = open_.agg(F.max("open"), F.sum("up")).first()
        if not still:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def in_blocks(rows: DataFrame, *names: str) -> DataFrame:
    return rows.repartition(*names).sortWithinPartitions(*names)


class Search:
    """The search for classes. nodes: node, bands array<long>, sketch array<long> and size (of the set), one row a node;
    full_sets(members, rows) gives node and items (binary) for the members' nodes, each once, sets_of makes sorted 64-bit shingles of items.
    Where groups (key, n and node, see there) are known, nodes are those in them, and need no bands."""

    def __init__(self, nodes: DataFrame, percent: int, samples: int, full_sets: Callable[[DataFrame, int], DataFrame], sets_of: Callable[[list[bytes]], list[np.ndarray]] = hashes, groups: DataFrame | None = None):
        self.known = groups
        self.nodes, self.percent, self.full_sets, self.sets_of = nodes, percent, full_sets, sets_of
        self.bits = most_bits(percent / 100, samples)

    def groups(self) -> DataFrame:
        """key, n (its nodes) and node, for keys that several nodes have."""
        if self.known is not None:
            return self.known
        buckets = max(32, self.nodes.count() // BUCKET_NODES)
        dealt = self.nodes.select("bands").mapInArrow(lambda b: counted(b, buckets), "bucket int, packed binary")
        shared = staged(in_blocks(dealt, "bucket").mapInArrow(summed, "key long, n long"), "shared")
        keys = self.nodes.select("node", F.explode("bands").alias("key"))
        return staged(keys.join(sent(shared, shared.count()), "key").select("key", "n", "node"), "groups")

    def sets(self, rows: DataFrame) -> DataFrame:
        """node and items of the nodes in the column of `rows`, each once."""
        members = staged(rows.distinct(), "members")
        return staged(self.full_sets(members, members.count()), "sets")

    def compared(self, rows: DataFrame, found_by: Callable = links) -> DataFrame:
        """Links of blocks: family, i, j, side, node and items; a leader, of side 1, is the first of its block."""
        percent, sets_of = self.percent, self.sets_of
        found = rows.select("family", "i", "j", "side", "node", "items").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side").mapInArrow(lambda b: found_by(b, percent, sets_of), EDGE)
        return staged(found.where("src <> dst"), "links")

    def led(self, groups: DataFrame, sketches: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """Links of each group's leader with its others; and the others, as key, node, leader."""
        rank = F.struct("degree", F.col("node").alias("node"))
        told = groups.join(sent(sketches.select("node", "degree"), n), "node")
        lead = staged(told.groupBy("key").agg(F.max(rank).alias("lead")).select("key", F.col("lead.node").alias("family")), "leaders")
        others = staged(groups.join(sent(lead, lead.count()), "key").where("node <> family").select("key", "node", "family"), "led")
        apart = sum((F.bit_count(F.get("sketch", k).bitwiseXOR(F.get("own", k))) for k in range(SKETCH_BITS // 64)), F.lit(0))
        own = sketches.select(F.col("node").alias("family"), F.col("sketch").alias("own"))
        pairs = others.select("family", "node").distinct().join(sent(sketches.select("node", "sketch"), n, 64), "node")
        near = staged(pairs.join(sent(own, n, 64), "family").where(apart <= self.bits).select("family", "node"), "near")
        sets = self.sets(near.select("node").unionByName(near.select(F.col("family").alias("node"))))
        # A block of a leader's pairs, with the leader's own set in each.
        blocks = staged(near.groupBy("family").agg(F.ceil(F.count("*") / LED_BLOCK).cast("int").alias("blocks")), "blocks")
        m = blocks.count()
        second = near.join(sent(blocks, m), "family").join(sets, "node").select("family", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("i"), F.lit(2).alias("side"), "node", "items")
        first = blocks.withColumn("node", F.col("family")).join(sets, "node").select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(1).alias("side"), "node", "items")
        return self.compared(first.unionByName(second).withColumn("j", F.lit(0)), star_links), others

    def rest(self, others: DataFrame, component: DataFrame, sketches: DataFrame, n: int) -> DataFrame | None:
        """Links between a group's members outside its leader's component and all but the leader; None if there are no such."""
        m = component.count()
        at = lambda name, c: component.select(F.col("node").alias(name), F.col("root").alias(c))
        rows = others.join(sent(at("node", "c"), m), "node", "left").join(sent(at("family", "main"), m), "family", "left")
        rows = rows.select("key", "node", F.coalesce("c", "node").alias("c"), F.coalesce("main", "family").alias("main")).withColumn("rest", F.col("c") != F.col("main"))
        # Pairs of one component need no comparison, and pairs with the leader had theirs.
        shape = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("rest").cast("int")).alias("r"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
        shape = staged(shape.select("key", "n", "r"), "rest-keys")
        if not (k := shape.count()):
            return None
        rows = rows.join(sent(shape, k, 24), "key").drop("main")
        size = F.greatest(F.lit(GROUP_BLOCK), F.least(F.lit(GROUP_MOST), F.ceil(F.col("n") / GROUP_BLOCKS)))
        rows = blocked(rows.join(sent(sketches.select("node", "sketch"), n, 64), "node"), F.ceil(F.col("n") / size), F.ceil(F.col("r") / size))
        bits = self.bits
        stars = in_blocks(rows.select("key", "i", "j", "side", "node", "c", "sketch"), "key", "i", "j").mapInArrow(lambda b: close_pairs(b, bits), EDGE)
        family = staged(components(stars).withColumnRenamed("root", "family"), "families")
        if family.isEmpty():
            return None
        sized = staged(family.join(self.nodes.select("node", "size"), "node").join(component, "node", "left").select("family", "node", "size", F.coalesce("root", "node").alias("c")), "family-members")
        main = sized.groupBy("family", "c").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        marked = sized.join(main, "family").withColumn("rest", F.col("c") != F.col("main"))
        blocks = lambda own: F.greatest(F.ceil(F.sum(own) / FAMILY_BLOCK), F.ceil(F.sum(F.col("size") * own) / BLOCK_SHINGLES), F.lit(1))
        pieces = marked.groupBy("family").agg(blocks(F.lit(1)).alias("all"), blocks(F.col("rest").cast("int")).alias("few"))
        rows = staged(blocked(marked.join(pieces, "family").select("family", "node", "rest", "all", "few"), F.col("all"), F.col("few")), "family-blocks")
        return self.compared(rows.join(self.sets(rows.select("node")), "node"))

    def classes(self) -> DataFrame:
        """node and root of the nodes that have links."""
        groups = self.groups()
        # Of each node the sizes of its groups, summed, and its sketch.
        degree = staged(groups.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
        n = degree.count()
        sketches = staged(self.nodes.select("node", "sketch").join(sent(degree, n), "node"), "sketches")
        found, others = self.led(groups, sketches, n)
        component = staged(components(found), "components")
        more = self.rest(others, component, sketches, n)
        if more is None or more.isEmpty():
            return component
        return components(component.select(F.col("root").alias("src"), F.col("node").alias("dst")).unionByName(more))


def classes(nodes: DataFrame, percent: int, samples: int, full_sets: Callable[[DataFrame, int], DataFrame], sets_of: Callable[[list[bytes]], list[np.ndarray]] = hashes, groups: DataFrame | None = None) -> DataFrame:
    """node and root of the nodes that have links with 100 * intersection >= percent * union; see Search."""
    return Search(nodes, percent, samples, full_sets, sets_of, groups).classes()
