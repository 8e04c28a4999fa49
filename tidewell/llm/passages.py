"""Repeated passages by sorted suffixes: every byte of a 50-byte string that an earlier document has too.

Of all suffixes, those are taken whose leading 20 bytes have the least hash in some window of LENGTH bytes: two equal
windows choose the same one, so no repeat is missed, and one suffix in 16 is kept. With each goes the stretch of
windows that chose it. Sampled splitters deal the suffixes into ranges by their leading tokens; each range is sorted
by several keys in turn (leading token, stretch, document), which brings equal stretches together. Equal leading
tokens never lie in two ranges. Suffixes that share a token but not the stretch are compared window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, bounded, mixed, powers, prefix_hash, span_hash, staged
from .near import grouped, sent, starts

#: Bytes of a repeated string, of a leading token, and windows that a suffix may stand for.
LENGTH, TOKEN = 50, 20
REACH = LENGTH - TOKEN + 1
#: Bytes of text in a numpy pass; longer texts are cut, with LENGTH - 1 bytes in both pieces.
PIECE = 1_000_000
#: Bytes of text for a range of suffixes, suffixes sampled for each splitter, and suffixes that a task holds back to send together.
RANGE_BYTES, SAMPLED, HELD = 8_000_000, 64, 400_000
#: Splitters at most, as they go to the driver and to all tasks: beyond them ranges are cut into pieces of equal width. Ranges a task sorts one by one, and tasks at most.
MOST_SPLITTERS, RANGES_A_TASK, MOST_TASKS = 4096, 1, 100_000
#: Added to the number of windows, of REACH at most, of stretches that are known to come again, and of those with a common token.
AGAIN, COMMON = 128, 64
#: A leading token with more stretches than this is compared by its windows' first documents instead.
MANY = 20_000
#: A token that is so often among those sampled for the splitters would fill a quarter of a range: it goes to all ranges.
OFTEN = SAMPLED // 4
#: Packed bytes up to which removed runs are sent to all tasks.
MOST_BYTES = 64_000_000
FOUND = "open boolean, token long, doc long, version long, at int, windows int"


def suffixes(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """token, stretch hash, piece, start in the piece and number of windows of the chosen suffixes."""
    data = np.frombuffer(b"\n".join([*pieces, b""]), np.uint8)
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    prefix = prefix_hash(data)
    token = mixed((prefix[TOKEN:] - prefix[:-TOKEN]) * powers(n + 1)[1][: n - TOKEN + 1])
    bits = np.uint64(max(1, n.bit_length()))
    least = (token >> bits << bits) | np.arange(len(token), dtype=np.uint64)
    span = 1
    while span * 2 <= REACH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < REACH:
        least = np.minimum(least[: len(least) - (REACH - span)], least[REACH - span :])
    chosen = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.array([len(p) + 1 for p in pieces])
    end = np.cumsum(size)
    new = np.zeros(len(chosen), bool)
    new[0] = True
    new[1:] = chosen[1:] != chosen[:-1]
    begin = end - size
    new[begin[begin < len(new)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(chosen) - 1)
    piece = np.searchsorted(end, first, side="right")
    last = np.minimum(last, end[piece] - 1 - LENGTH)
    inside = last >= first
    first, last, piece = first[inside], last[inside], piece[inside]
    return token[chosen[first]], span_hash(prefix, first, last + LENGTH), piece, first - begin[piece], last - first + 1


def cut(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, piece): pieces share LENGTH - 1 bytes, so that each window is in one."""
    for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        yield at, text[at : at + PIECE + LENGTH - 1]


def chosen(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """token, stretch, number of the text, place in it and windows, some texts at a time."""
    owner, offset, pieces, total = [], [], [], 0
    for i, text in enumerate(texts):
        for at, piece in cut(text):
            if pieces and total + len(piece) > PIECE:
                token, stretch, p, a, w = suffixes(pieces)
                yield token, stretch, np.array(owner)[p], np.array(offset)[p] + a, w
                owner, offset, pieces, total = [], [], [], 0
            owner.append(i)
            offset.append(at)
            pieces.append(piece)
            total += len(piece)
    if pieces:
        token, stretch, p, a, w = suffixes(pieces)
        yield token, stretch, np.array(owner)[p], np.array(offset)[p] + a, w


def utf8(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of one suffix in 8, drawn by the token and its place, so that a token comes as often as its share."""
    for batch in batches:
        for token, *_ in chosen(utf8(batch)):
            drawn = mixed(token + np.arange(len(token), dtype=np.uint64)) % np.uint64(8) == 0
            yield pa.RecordBatch.from_arrays([pa.array(token[drawn].view(np.int64))], ["token"])


def bucket_of(token: np.ndarray, cuts: np.ndarray, pieces: int) -> np.ndarray:
    """The range of each token, by splitters, each range cut into so many pieces of equal width."""
    edge = np.concatenate(([np.uint64(0)], cuts, [np.uint64(MASK)])).astype(np.float64)
    at = np.searchsorted(cuts, token, side="right")
    part = (token.astype(np.float64) - edge[at]) / np.maximum(edge[at + 1] - edge[at], 1) * pieces
    return at * pieces + np.clip(part.astype(np.int64), 0, pieces - 1)


def dealt(batches: Iterator[pa.RecordBatch], cuts: np.ndarray, often: np.ndarray, pieces: int = 1) -> Iterator[pa.RecordBatch]:
    """Suffixes packed by range: columns one after another, hashes cut to 6 bytes, documents as differences.

    A stretch that a smaller document of the same batch has is known to come again: it is marked by AGAIN and goes to
    any range, so that a passage of very many documents weighs on its range by batches, not by documents. So do
    stretches whose token is in `often` (upper 6 bytes): they are marked by COMMON and all stay open.
    """

    def packed() -> pa.RecordBatch:
        token, stretch, doc, version, at, windows = (np.concatenate(c) for c in zip(*held, strict=True))
        token &= ~np.uint64(0xFFFF)  # tokens are compared by their upper 6 bytes
        bucket = bucket_of(token, cuts, pieces)
        by = np.lexsort((token, stretch))
        new = np.append(True, (stretch[by][1:] != stretch[by][:-1]) | (token[by][1:] != token[by][:-1]))
        again = np.empty(len(by), bool)
        again[by] = doc[by] > np.minimum.reduceat(doc[by], np.flatnonzero(new))[np.cumsum(new) - 1]
        common = np.isin(token, often) & ~again
        spread = again | common
        bucket[spread] = np.arange(spread.sum()) % ((len(cuts) + 1) * pieces)
        windows = windows + AGAIN * again + COMMON * common
        order = np.argsort(bucket, kind="stable")
        edge = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        out = []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            o = order[s:e]
            six = [x[o].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for x in (token, stretch)]
            d = doc[o]
            out.append(b"".join([*six, np.diff(d, prepend=0).astype("<i8").tobytes(), version[o].astype("<i8").tobytes(), at[o].astype("<u4").tobytes(), windows[o].astype(np.uint8).tobytes()]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[order[edge[:-1]]], pa.int32()), pa.array(out, pa.binary())], ["bucket", "packed"])

    held, n = [], 0
    for batch in batches:
        ids, versions = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
        for token, stretch, i, at, windows in chosen(utf8(batch)):
            held.append((token, stretch, ids[i], versions[i], at, windows))
            n += len(token)
            if n >= HELD:
                yield packed()
                held, n = [], 0
    if n:
        yield packed()


def unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    columns = []
    for b in blobs:
        n = len(b) // 33
        at, parts = 0, []
        for width, kind in ((6, None), (6, None), (8, "<i8"), (8, "<i8"), (4, "<u4"), (1, "u1")):
            raw = np.frombuffer(b, np.uint8, n * width, at)
            at += n * width
            if kind is None:
                wide = np.zeros((n, 8), np.uint8)
                wide[:, 2:] = raw.reshape(n, 6)
                parts.append(wide.view("<u8").ravel())
            else:
                parts.append(raw.view(kind))
        parts[2] = np.cumsum(parts[2])
        columns.append(parts)
    return [np.concatenate(c) for c in zip(*columns, strict=True)]


def sorted_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: stretches that an earlier document has (not open), and the first holders' stretches whose token
    other documents have in other stretches (open). Those with a common token are passed on as open."""
    for t in grouped(batches, ["bucket"]):
        edge = starts(t, ["bucket"])
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            token, stretch, doc, version, at, windows = unpacked(t.column("packed").slice(s, e - s).to_pylist())
            known = windows >= COMMON
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows[known] < AGAIN), pa.array(token[known].view(np.int64)), pa.array(doc[known]), pa.array(version[known]), pa.array(at[known].astype(np.int32)), pa.array((windows[known] % COMMON).astype(np.int32))],
                ["open", "token", "doc", "version", "at", "windows"],
            )
            token, stretch, doc, version, at, windows = (x[~known] for x in (token, stretch, doc, version, at, windows))
            if not len(token):
                continue
            order = np.lexsort((doc, stretch, token))
            token, stretch, doc = token[order], stretch[order], doc[order]
            new_token = np.append(True, token[1:] != token[:-1])
            new = new_token | np.append(True, stretch[1:] != stretch[:-1])
            head = np.flatnonzero(new)
            holder = doc[head][np.cumsum(new) - 1]
            again = doc > holder
            of_token = np.cumsum(new_token) - 1
            top = np.flatnonzero(new_token[head])
            low, high = np.minimum.reduceat(doc[head], top), np.maximum.reduceat(doc[head], top)
            open_ = ~again & (low < high)[of_token]
            keep = again | open_
            o = order[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(open_[keep]), pa.array(token[keep].view(np.int64)), pa.array(doc[keep]), pa.array(version[o]), pa.array(at[o].astype(np.int32)), pa.array(windows[o].astype(np.int32))],
                ["open", "token", "doc", "version", "at", "windows"],
            )


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: its open stretches, packed."""
    for t in grouped(batches, ["doc", "version"]):
        edge = starts(t, ["doc", "version"])
        token, at, windows = t.column("token").to_numpy(), t.column("at").to_numpy(), t.column("windows").to_numpy()
        packed = [token[s:e].tobytes() + at[s:e].tobytes() + windows[s:e].astype(np.uint8).tobytes() for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([t.column("doc").combine_chunks().take(pa.array(edge[:-1])), t.column("version").combine_chunks().take(pa.array(edge[:-1])), pa.array(packed, pa.binary())], ["doc_id", "version", "places"])


def stretches(batches: Iterator[pa.RecordBatch], hot: np.ndarray, by_window: bool) -> Iterator[pa.RecordBatch]:
    """The bytes of open stretches of tokens that are not hot, by token; by_window: windows of hot tokens, by their hash of 16 bytes."""
    for batch in batches:
        key, doc, version, place, content = [], [], [], [], []
        ids, versions = batch.column("doc_id").to_pylist(), batch.column("version").to_pylist()
        for d, v, text, packed in zip(ids, versions, utf8(batch), batch.column("places").to_pylist(), strict=True):
            n = len(packed) // 13
            token = np.frombuffer(packed, np.int64, n)
            at, windows = np.frombuffer(packed, np.int32, n, 8 * n), np.frombuffer(packed, np.uint8, n, 12 * n)
            mine = np.isin(token, hot) == by_window
            for k, a, w in zip(token[mine].tolist(), at[mine].tolist(), windows[mine].tolist(), strict=True):
                if by_window:
                    place += range(a, a + w)
                    key += [hashlib.blake2b(text[i : i + LENGTH], digest_size=16).digest() for i in range(a, a + w)]
                else:
                    key.append(k)
                    place.append(a)
                    content.append(text[a : a + w - 1 + LENGTH])
            doc += [d] * (len(key) - len(doc))
            version += [v] * (len(key) - len(version))
        columns = [pa.array(key, pa.binary() if by_window else pa.int64()), pa.array(doc, pa.int64()), pa.array(version, pa.int64()), pa.array(place, pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, *([] if by_window else [pa.array(content, pa.binary())])], ["key", "doc", "version", "at", *([] if by_window else ["content"])])


def later_windows(windows: DataFrame) -> DataFrame:
    """doc, version, at and windows (1) of windows whose key a smaller document has. Nothing gathers by key: first documents
    are told by partial sums, and joined back."""
    first = staged(windows.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key", "first"), "passage-windows")
    return windows.join(sent(first, first.count()), "key").where("doc > first").select("doc", "version", "at", F.lit(1).alias("windows"))


def windows_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that a smaller document has under the same key."""
    for t in grouped(batches, ["key"]):
        content = t.column("content").to_pylist()
        edge = starts(t, ["key"])
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        size = np.array([len(c) for c in content])
        data = np.frombuffer(b"".join(content), np.uint8)
        prefix = prefix_hash(data)
        begin = np.cumsum(size) - size
        count = size - LENGTH + 1
        row = np.repeat(np.arange(len(size)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[row] + step
        h = span_hash(prefix, at, at + LENGTH)
        doc = t.column("doc").to_numpy()[row]
        order = np.lexsort((doc, h, group[row]))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (group[row][order][1:] != group[row][order][:-1]))
        again = np.zeros(len(row), bool)
        again[order] = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        edges = np.diff(np.concatenate(([0], np.where(again, row + 1, 0), [0])))
        first = np.flatnonzero((edges[:-1] != 0) & again)
        last = np.flatnonzero((edges[1:] != 0) & again)
        r = row[first]
        yield pa.RecordBatch.from_arrays(
            [t.column("doc").combine_chunks().take(pa.array(r)), t.column("version").combine_chunks().take(pa.array(r)), pa.array((t.column("at").to_numpy()[r] + step[first]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
            ["doc", "version", "at", "windows"],
        )


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: its maximal removed runs as packed starts and ends."""
    for t in grouped(batches, ["doc", "version"]):
        edge = starts(t, ["doc", "version"])
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        start = t.column("at").to_numpy().astype(np.int64)
        end = start + t.column("windows").to_numpy() - 1 + LENGTH
        reach = end + group * (1 << 40)  # rows are sorted by document and start
        far = np.maximum.accumulate(reach)
        new = np.append(True, (start[1:] + group[1:] * (1 << 40)) > far[:-1])
        head = np.flatnonzero(new)
        last = far[np.append(head[1:], len(far)) - 1] - group[head] * (1 << 40)
        runs, of = np.stack((start[head], last), 1).astype("<i8"), group[head]
        cuts = np.searchsorted(of, np.arange(len(edge)))
        packed = [runs[s:e].tobytes() for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([t.column("doc").combine_chunks().take(pa.array(edge[:-1])), t.column("version").combine_chunks().take(pa.array(edge[:-1])), pa.array(packed, pa.binary())], ["doc_id", "version", "runs"])


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs, copy in zip(utf8(batch), batch.column("runs").to_pylist(), batch.column("copy").to_pylist(), strict=True):
            if copy and len(text) >= LENGTH:
                spans = [(0, len(text))]
            else:
                spans = np.frombuffer(runs, "<i8").reshape(-1, 2).tolist() if runs else []
            kept, at = [], 0
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            kept = b"".join([*kept, text[at:]])
            out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _unsigned(tokens: list[int]) -> np.ndarray:
    """Tokens whose upper bit was turned over, so that signed numbers are in the order of unsigned ones."""
    return np.array(tokens, np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for every document.

    A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller doc_id. Strings are judged
    on the input. Equal texts are found first: of those only the first is sorted, the others go whole.

    A null text is an empty one. A document without doc_id stays whole and takes nothing from others. Rows that share a
    doc_id are told apart by their texts and take nothing from each other; equal rows are treated alike. No rows give no
    rows. Other columns of `docs` are not read.

    Texts are equal by SHA-256; a stretch comes again if its token and itself agree in 96 bits, a window if its token and
    itself agree in 128. What reaches the driver: MOST_SPLITTERS splitters, and the few tokens that would fill a range.
    """
    table = bounded(docs).select("doc_id", "text", F.sha2("text", 256).alias("hash"))
    known = table.where("doc_id is not null and octet_length(text) >= 50")
    copies = staged(known.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first"), "passage-copies")
    n_copies = copies.count()
    # Ids that several rows have: their rows are told apart by a version, and equal rows are one.
    several = staged(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("several")), "passage-ids")
    n_several = several.count()
    total = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def judged(t: DataFrame) -> DataFrame:
        t = t.join(sent(copies, n_copies, 80), "hash", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
        t = t.join(sent(several, n_several), "doc_id", "left") if n_several else t.withColumn("several", F.lit(None).cast("boolean"))
        return t.withColumn("version", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long"))

    heads = judged(known).where("not copy").select("doc_id", "version", "several", "text")
    if n_several:
        heads = heads.where("several is null").unionByName(heads.where("several").dropDuplicates(["doc_id", "version"]))
    heads = heads.drop("several")

    ranges = -(-total // RANGE_BYTES)
    part = min(1.0, ranges * SAMPLED * 8 * REACH / 2 / max(1, total))
    lot = F.pmod(F.xxhash64("doc_id", "version", F.lit(11)), F.lit(1 << 20)) < F.lit(int(part * (1 << 20)) + 1)
    cuts, often, pieces = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 1
    if ranges > 1:
        # About SAMPLED tokens for each range, in the order of unsigned numbers.
        drawn = staged(heads.where(lot).select("text").mapInArrow(sampled, "token long").select(F.col("token").bitwiseXOR(F.lit(-(1 << 63))).alias("token")), "passage-sample")
        upper = F.col("token").bitwiseAND(F.lit(-65536))
        common = drawn.groupBy(upper.alias("token")).agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).select("token")
        often = _unsigned([r[0] for r in common.collect()])
        splitters = min(ranges, MOST_SPLITTERS)
        rest = drawn.withColumn("upper", upper).join(F.broadcast(common.withColumnRenamed("token", "upper")), "upper", "left_anti") if len(often) else drawn
        cuts = np.unique(_unsigned(rest.agg(F.percentile_approx("token", [i / splitters for i in range(1, splitters)], 10 * splitters)).first()[0] or []) & ~np.uint64(0xFFFF))
        pieces = -(-ranges // splitters)

    suffix = heads.mapInArrow(lambda b: dealt(b, cuts, often, pieces), "bucket int, packed binary")
    tasks = max(1, min(ranges // RANGES_A_TASK, MOST_TASKS))
    found = staged(suffix.repartitionById(tasks, F.pmod(F.col("bucket"), F.lit(tasks))).sortWithinPartitions("bucket").mapInArrow(sorted_range, FOUND), "passage-suffixes")
    opened = found.where("open")
    hot = np.array([r[0] for r in opened.groupBy("token").count().where(F.col("count") > MANY).select("token").collect()], np.int64)
    listed = staged(opened.select("doc", "version", "token", "at", "windows").repartition("doc", "version").sortWithinPartitions("doc", "version").mapInArrow(places, "doc_id long, version long, places binary"), "passage-places")
    held = heads.join(listed, ["doc_id", "version"]).select("doc_id", "version", "text", "places")
    pieces = held.mapInArrow(lambda b: stretches(b, hot, False), "key long, doc long, version long, at int, content binary")
    runs = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(windows_again, "doc long, version long, at int, windows int")
    if len(hot):
        windows = staged(held.mapInArrow(lambda b: stretches(b, hot, True), "key binary, doc long, version long, at int"), "passage-hot")
        runs = runs.unionByName(later_windows(windows))

    gone = found.where("not open").select("doc", "version", "at", "windows").unionByName(runs)
    spans = staged(gone.repartition("doc", "version").sortWithinPartitions("doc", "version", "at").mapInArrow(merged, "doc_id long, version long, runs binary"), "passage-runs")
    bytes_ = spans.agg(F.coalesce(F.sum(F.octet_length("runs") + 40), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if bytes_ <= MOST_BYTES else spans
    rows = judged(table).join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "copy", "runs")
    return rows.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
