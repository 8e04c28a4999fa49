"""What the corpus operators share: small batches and vectorised hashing of texts inside tasks; tables that cut lineage come from the library."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..scratch import staged  # noqa: F401, the operators take it from here

MASK = (1 << 64) - 1
#: Odd base of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
PASS_BYTES = 1_000_000
#: Rows, and bytes, that Python takes from Spark at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: UTF-8 bytes 0x20 and 0x09-0x0D end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE = np.random.default_rng(20240607).integers(1, MASK, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def bounded(frame: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends rows to Python few at a time, by number and by bytes, as texts may be long."""
    conf = frame.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(BATCH_ROWS, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or BATCH_ROWS))
    return frame


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, kept by the worker."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, PASS_BYTES + 4096)
        _powers = tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64)))) for b in (BASE, INVERSE))
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = BASE**s times the hash of data[s:e], modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal bytes, wherever they stand."""
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def passes(sizes, limit: int = PASS_BYTES):
    """Slices of consecutive texts of about `limit` bytes together."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end in the joined text of each word, and the number of words before each text (one more than texts)."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    gap = SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    first = np.zeros(len(texts) + 1, np.int64)
    first[1:] = np.cumsum([len(t) + 1 for t in texts])
    return span_hash(prefix_hash(data), start, end), start, end, np.searchsorted(start, first)


def shingles(texts: list[bytes | None], n: int):
    """For each text, the distinct hashes of its n-word shingles, sorted; of the whole sequence if it has fewer words, none if it has no words. A-Z are lower-cased; nothing else changes."""
    low = [b"" if t is None else t.translate(LOWER) for t in texts]
    for part in passes([len(t) for t in low]):
        h, _, _, count = words(low[part])
        gram = sum((h[i : len(h) - n + 1 + i] * np.uint64(pow(BASE, 3 * i + 1, 1 << 64)) for i in range(n)), np.uint64(0)) if len(h) >= n else h[:0]
        gram = mixed(gram)
        for a, b in zip(count[:-1].tolist(), count[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(gram[a : b - n + 1])
            elif b > a:
                whole = 0
                for i, x in enumerate(h[a:b].tolist()):
                    whole = (whole + x * pow(BASE, 3 * i + 1, 1 << 64)) & MASK
                yield mixed(np.array([whole ^ (b - a)], np.uint64))
            else:
                yield h[:0]
