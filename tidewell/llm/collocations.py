"""Phrase collocations by suffix pointers and a multikey three-way quicksort.

Each word begins a suffix of its piece. A task sorts the pointers of its texts by multikey quicksort: the partition of
keys equal to the pivot is a phrase, and its size a count. Suffixes go to tasks by a hash of the leading words that are
to be counted, with the task's own counts, so no word or phrase, however frequent, gathers anywhere. There they are
sorted in the same way, and partitions under the least count are abandoned: rare words and pairs first, then triples,
of whose suffixes those alone are sent whose two pairs are frequent.

Words are 64-bit hashes of language and bytes. The words of equal hashes are compared; if two ever differ, all is done
again with another seed, so counts are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, LOWER, MASK, PASS_BYTES, bounded, mixed, passes, prefix_hash, span_hash, staged

#: Bytes that end a piece, and those that end a word.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
GAP = SEPARATOR.copy()
GAP[[0x20, 0x09]] = True
#: Bytes of text whose suffixes a task sorts together, of text whose suffixes meet in a bucket, and of words that are hashed at once.
HELD_BYTES, BUCKET_BYTES, HASHED = 4 << 20, 8 << 20, 1 << 20
#: Pointers of a partition that is sorted column by column.
SMALL = 1 << 15
#: Bits of the filter of frequent pairs, at least and at most, for each pair, and in a piece of it.
LEAST_BITS, MOST_BITS, BITS_A_PAIR, PIECE_BITS = 24, 29, 64, 16
#: Candidates that are ranked in one task.
RANKED = 500_000
#: The language of documents that have none.
UNKNOWN = "und"


def equal_partitions(columns: list[np.ndarray], weight: np.ndarray, least: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth, a pointer into each partition of rows that agree in the columns up to it, and the sum of its weights.

    Multikey quicksort: pointers are parted by a pivot of the column; the equal ones go on with the next column, the
    others with the same one. Partitions that weigh less than `least` are abandoned, and so is a 0, which ends a suffix, beyond the first column.
    """
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in columns]
    work = [(np.arange(len(weight)), 0)]
    while work:
        at, depth = work.pop()
        if len(at) <= SMALL:
            _small(columns, weight, least, at, depth, out)
            continue
        if least > 1 and weight[at].sum() < least:
            continue
        key = columns[depth][at]
        pivot = np.sort(key[:: max(1, len(key) // 255)])
        pivot = pivot[len(pivot) // 2]
        less, more = key < pivot, key > pivot
        work += [(at[less], depth), (at[more], depth)]
        same = at[~(less | more)]
        total = int(weight[same].sum())
        if total >= least and (depth == 0 or pivot):
            out[depth].append((same[:1], np.array([total])))
            if depth + 1 < len(columns):
                work.append((same, depth + 1))
    none = np.zeros(0, np.int64)
    return [(np.concatenate([p for p, _ in x] or [none]), np.concatenate([n for _, n in x] or [none])) for x in out]


def _small(columns: list[np.ndarray], weight: np.ndarray, least: int, at: np.ndarray, depth: int, out: list) -> None:
    """The same for a small partition: sorted by the column; what is equal, and heavy enough, by the next one."""
    group = np.zeros(len(at), np.int64)
    for d in range(depth, len(columns)):
        if not len(at):
            return
        key = columns[d][at]
        by = np.argsort(key, kind="stable")
        if d > depth:
            by = by[np.argsort(group[by], kind="stable")]
        at, key, group = at[by], key[by], group[by]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        begin = np.flatnonzero(new)
        total = np.add.reduceat(weight[at], begin)
        heavy = total >= least
        if d:
            heavy &= key[begin] != 0
        out[d].append((at[begin[heavy]], total[heavy]))
        group = np.cumsum(new) - 1
        keep = heavy[group]
        at, group = at[keep], group[keep]


def suffixes(texts: list[bytes], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of lower-cased texts: its key (0 is none), whether a piece ends behind it, its text, and its place in the joined texts. salt: of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = GAP[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    key = np.empty(len(start), np.uint64)
    cut = np.unique(np.searchsorted(start, np.arange(0, len(data) + HASHED, HASHED)))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        p = prefix_hash(data[start[a] : end[b - 1]])
        key[a:b] = span_hash(p, start[a:b] - start[a], end[a:b] - start[a])
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    of = np.searchsorted(first, start, "right") - 1
    key = np.maximum(mixed(key + salt[of]), np.uint64(1))
    ends = np.flatnonzero(SEPARATOR[data])
    last = np.ones(len(start), bool)
    last[:-1] = np.searchsorted(ends, start[1:]) > np.searchsorted(ends, end[:-1])
    return key, last, of, start, end


def salted(langs: list[str], seed: int) -> np.ndarray:
    """A 64-bit number for each language."""
    out = np.zeros(len(langs), np.uint64)
    for i, x in enumerate(langs):
        b = np.frombuffer(x.encode("utf-8", "surrogatepass") + b"\0", np.uint8)
        out[i] = span_hash(prefix_hash(b), np.array([0]), np.array([len(b)]))[0]
    return mixed(out ^ np.uint64((seed * 2 + 1) * BASE & MASK))


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each start to its end."""
    size = end - start
    offset = np.append(0, np.cumsum(size))
    at = np.arange(offset[-1]) + np.repeat(start - offset[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(data[at])])


def routed(columns: list[np.ndarray], buckets: int) -> np.ndarray:
    """The bucket of each suffix, by all its leading words that are counted."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mixed(h * np.uint64(3) + c)
    return (h % np.uint64(buckets)).astype(np.int32)


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    by = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1)) if len(by) else by
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(bucket[by[a]]), by[a:b]


PACKED = "bucket int, lang string, keys binary, counts binary, sizes binary, words binary"


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "lang", "keys", "counts", "sizes", "words"])


def cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end where a piece ends; no phrase goes beyond it."""
    at = 0
    while len(text) - at > 2 * PASS_BYTES and (end := PIECE_END.search(text, at + PASS_BYTES)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:] if at else text


def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts of about HELD_BYTES together, lower-cased, with their languages; long ones in parts."""
    texts: list[bytes] = []
    langs: list[str] = []
    held = 0
    for batch in batches:
        for whole, x in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            for t in cut(whole.as_py() or b""):
                if t:
                    texts.append(t.translate(LOWER))
                    langs.append(x)
                    held += len(t)
                    if held >= HELD_BYTES:
                        yield texts, langs
                        texts, langs, held = [], [], 0
    if texts:
        yield texts, langs


def pointers(texts: list[bytes], langs: list[str], seed: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Languages; of all words of the texts: key, end of a piece, number of the language, place in the joined texts; and these."""
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    salt, of_text = salted(names, seed), np.array([number[x] for x in langs])
    parts, at = [], 0
    for part in passes([len(t) for t in texts]):
        key, last, of, start, end = suffixes(texts[part], salt[of_text[part]])
        parts.append((key, last, of_text[part][of], start + at, end + at))
        at += sum(len(t) + 1 for t in texts[part])
    return names, *(np.concatenate(c) for c in zip(*parts, strict=True)), np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)


def after(key: np.ndarray, last: np.ndarray, n: int = 1) -> np.ndarray:
    """The key n words on in the piece, 0 where it ends before."""
    out = np.zeros_like(key)
    if len(key) > n:
        inside = ~last[: len(key) - n]
        for i in range(1, n):
            inside = inside & ~last[i : len(key) - n + i]
        out[: len(key) - n] = np.where(inside, key[n:], 0)
    return out


def words_and_pairs(batches: Iterator[pa.RecordBatch], buckets: int, seed: int) -> Iterator[pa.RecordBatch]:
    """By bucket, the words and the pairs of a task's texts with their counts; words with their language and bytes."""
    for texts, langs in collected(batches):
        names, key, last, of, start, end, data = pointers(texts, langs, seed)
        if not len(key):
            continue
        second = after(key, last)
        (word, n_word), (pair, n_pair) = equal_partitions([key, second], np.ones(len(key), np.int64))
        rows = []
        for lang, name in enumerate(names):
            own = np.flatnonzero(of[word] == lang)
            for b, at in dealt(routed([key[word[own]]], buckets)):
                p = word[own[at]]
                rows.append((b, name, key[p].tobytes(), n_word[own[at]].tobytes(), (end[p] - start[p]).tobytes(), gathered(data, start[p], end[p]).buffers()[2].to_pybytes()))
        for b, at in dealt(routed([key[pair], second[pair]], buckets)):
            p = pair[at]
            rows.append((b, None, np.stack((key[p], second[p])).tobytes(), n_pair[at].tobytes(), None, None))
        yield packed(rows)


def triples(batches: Iterator[pa.RecordBatch], buckets: int, seed: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """By bucket, the triples whose two pairs are in the filter, with their counts."""
    for texts, langs in collected(batches):
        _, key, last, *_ = pointers(texts, langs, seed)
        second, third = after(key, last), after(key, last, 2)
        ok = np.zeros(len(key) + 1, bool)
        ok[:-1] = second != 0
        bit = paired(key, second) & np.uint64(8 * len(bits) - 1)
        ok[:-1] &= (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(ok[:-1] & ok[1:] & (third != 0))
        if not len(at):
            continue
        columns = [key[at], second[at], third[at]]
        p, n = equal_partitions(columns, np.ones(len(at), np.int64))[2]
        columns = [c[p] for c in columns]
        yield packed([(b, None, np.stack([c[i] for c in columns]).tobytes(), n[i].tobytes(), None, None) for b, i in dealt(routed(columns, buckets))])


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) * np.uint64(3) + second)


COUNTED = "lang string, k1 long, k2 long, k3 long, word binary, f long, clash boolean"
EMPTY = {"lang": pa.string(), "k1": pa.int64(), "k2": pa.int64(), "k3": pa.int64(), "word": pa.binary(), "f": pa.int64(), "clash": pa.bool_()}


def counted(table: pa.Table, least: int, depth: int) -> pa.Table:
    """Of a bucket, the words (k1 and their bytes), pairs (k1, k2) or triples that are as frequent as `least`; languages with all their words (k1 null); and words of one key (clash)."""
    parts: list[dict] = []
    has = np.array(pc.is_valid(table.column("lang")).to_pylist(), bool) if table.num_rows else np.zeros(0, bool)
    frames = table.select(["lang", "keys", "counts", "sizes", "words"]).to_pylist()
    for name in sorted({r["lang"] for r in frames if r["lang"] is not None}):
        own = [r for r in frames if r["lang"] == name]
        key = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in own])
        n = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in own])
        offset = np.append(0, np.cumsum(np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in own])))
        words = pa.Array.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(offset), pa.py_buffer(b"".join(r["words"] for r in own))])
        by = np.argsort(key, kind="stable")
        twin = by[1:][key[by[1:]] == key[by[:-1]]], by[:-1][key[by[1:]] == key[by[:-1]]]
        apart = ~pc.equal(words.take(pa.array(twin[0])), words.take(pa.array(twin[1]))).to_numpy(zero_copy_only=False).astype(bool)
        parts.append({"lang": [name], "f": [int(n.sum())], "clash": [bool(apart.any())]})
        p, f = equal_partitions([key], n, least)[0]
        parts.append({"lang": [name] * len(p), "k1": key[p].view(np.int64), "word": words.take(pa.array(p)).cast(pa.binary()), "f": f})
    own = [r for r in frames if r["lang"] is None]
    if own and not has.all():
        columns = [np.concatenate(c) for c in zip(*(np.frombuffer(r["keys"], np.uint64).reshape(depth, -1) for r in own), strict=True)]
        n = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in own])
        p, f = equal_partitions(columns, n, least)[depth - 1]
        parts.append({f"k{i + 1}": c[p].view(np.int64) for i, c in enumerate(columns)} | {"f": f})
    tables = []
    for x in parts:
        rows = len(x["f"])
        tables.append(pa.table({c: pa.array(x[c], t) if c in x and not isinstance(x[c], (pa.Array, pa.ChunkedArray)) else x.get(c, pa.nulls(rows, t)) for c, t in EMPTY.items()}))
    return pa.concat_tables(tables) if tables else pa.table({c: pa.array([], t) for c, t in EMPTY.items()})


def pair_filter(pairs: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes of all pairs, at most 2 ** MOST_BITS of them; where they are few for the pairs, it lets more triples pass, and never one too few."""
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_A_PAIR).bit_length()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = paired(b.column("k1").to_numpy().view(np.uint64), b.column("k2").to_numpy().view(np.uint64)) & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(PIECE_BITS)).astype(np.int32)), pa.array((bit & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int32))], ["piece", "bit"])

    def one(table: pa.Table) -> pa.Table:
        held = np.zeros(1 << PIECE_BITS, np.uint8)
        held[table.column("bit").to_numpy()] = 1
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << PIECE_BITS) // 8
    for r in pairs.select("k1", "k2").mapInArrow(hashed, "piece int, bit int").distinct().groupBy("piece").applyInArrow(one, "piece int, bits binary").toLocalIterator():
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def phrases(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written tables: languages (lang, n), words (lang, k1, word, f), pairs (k1, k2, f) and triples (k1, k2, k3, f) that occur `least` times or more.

    Documents without language are of `und`. A word is lower-cased in A to Z; a phrase lies in one piece.
    """
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col("text").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    for seed in range(8):
        deal = rows.mapInArrow(lambda b, seed=seed: words_and_pairs(b, buckets, seed), PACKED)
        first = staged(deal.groupBy("bucket").applyInArrow(lambda t: counted(t, least, 2), COUNTED), "phrases-pairs")
        if not first.where("clash").limit(1).count():
            break
    else:
        raise ValueError("words share hashes under all seeds")
    pairs = first.where("k2 is not null").select("k1", "k2", "f")
    bits = spark.sparkContext.broadcast(pair_filter(pairs, pairs.count()))
    deal = rows.mapInArrow(lambda b: triples(b, buckets, seed, bits.value), PACKED)
    third = staged(deal.groupBy("bucket").applyInArrow(lambda t: counted(t, least, 3), COUNTED), "phrases-triples")
    bits.unpersist()
    languages = first.where("k1 is null").groupBy("lang").agg(F.sum("f").alias("n"))
    words = first.where("k1 is not null and k2 is null").select("lang", "k1", F.col("word").cast("string").alias("word"), "f")
    return languages, words, pairs, third.select("k1", "k2", "k3", "f")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two and three words.

    docs: text and lang; a null text is empty, a null language `und`, apart from an `und` of their own in nothing. a, l and
    r are the occurrences of the phrase and of the two parts of its lowest-scoring cut, the first of equal ones; score is
    floor(1000000 a a / (l r)), in whole numbers. Phrases with a < least are none; a pair goes if a triple around it has
    at least `share` percent of its occurrences. Ranks are by score, then a, then the phrase's bytes. Repeated rows
    count each. No rows give no rows; other columns are not read.
    """
    languages, words, pairs, threes = phrases(docs, least)
    score = lambda a, l, r: f"cast((cast({a} as decimal(16, 0)) * cast({a} as decimal(16, 0)) * cast(1000000 as decimal(7, 0))) div (cast({l} as decimal(19, 0)) * cast({r} as decimal(19, 0))) as long)"  # noqa: E731, E741
    word = lambda i: words.select(*(["lang"] if i == 1 else []), F.col("k1").alias(f"k{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"))
    around = (
        threes.select("k1", "k2", "f").unionByName(threes.select(F.col("k2").alias("k1"), F.col("k3").alias("k2"), "f")).groupBy("k1", "k2").agg(F.max("f").alias("longer"))
    )
    two = (
        pairs.join(around, ["k1", "k2"], "left").where(f"longer is null or 100 * longer < {share} * f")
        .join(word(1), "k1").join(word(2), "k2")
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), F.expr(score("f", "f1", "f2")).alias("score"))
    )
    head, tail = pairs.select("k1", "k2", F.col("f").alias("f12")), pairs.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("f").alias("f23"))
    three = (
        threes.join(head, ["k1", "k2"]).join(tail, ["k2", "k3"]).join(word(1), "k1").join(word(2).drop("f2"), "k2").join(word(3), "k3")
        .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), "f1", "f23", "f12", "f3", F.expr(score("f", "f1", "f23")).alias("s1"), F.expr(score("f", "f12", "f3")).alias("s2"))
        .select("lang", "phrase", "a", F.expr("if(s1 <= s2, f1, f12)").alias("l"), F.expr("if(s1 <= s2, f23, f3)").alias("r"), F.expr("least(s1, s2)").alias("score"))
    )
    every = staged(two.unionByName(three), "phrases-scored")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    lots = -(-max(1, every.count()) // RANKED)
    # The best of each lot of a language, and then the best of these.
    some = every.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(lots))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top).drop("lot", "rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(languages, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
