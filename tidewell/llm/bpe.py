"""Byte-pair encoding and decoding by a contiguous rank array.

A short word is an array of part boundaries and an array of the ranks of adjacent parts. The smallest rank is
looked for, its boundary deleted, and the two neighbouring ranks refreshed, until no pair has a rank. A word of
more than SHORT parts keeps its candidate pairs in a heap instead: the same merges, without a scan for each.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path
from struct import pack

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import bounded

#: Parts up to which a scan for the smallest rank is cheaper than a heap.
SHORT = 96
#: Words that a worker remembers before it begins anew, and the longest that it remembers.
REMEMBERED, LONGEST = 300_000, 64
NO_RANK = 1 << 62
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in printed else next(rest)) for b in range(256)]


class Vocabulary:
    """Ranks, ids and word rules, read from a tokenizer file of the `tokenizers` library (BPE with word ends)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.token = {i: t for t, i in model["vocab"].items()}
        ids, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.pairs: dict[int, int] = {}  # by the first id times 2**20 plus the second
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])
        symbols = byte_symbols()
        self.byte = [ids[s] for s in symbols]
        self.last = [ids[s + self.suffix] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.known: dict[str, bytes] = {}

    def merged(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        parts = [self.byte[b] for b in data[:-1]] + [self.last[data[-1]]]
        return self._scanned(parts) if len(parts) <= SHORT else self._heaped(parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        rank = self.pairs.get
        ranks = [rank(a << 20 | b, NO_RANK) for a, b in pairwise(parts)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            at = ranks.index(low)
            parts[at] = low & 0xFFFFF
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 20 | parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = rank(parts[at] << 20 | parts[at + 1], NO_RANK)
        return parts

    def _heaped(self, parts: list[int]) -> list[int]:
        rank, n = self.pairs.get, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = r & 0xFFFFF, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := rank(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, as little-endian 32-bit integers."""
        if chunk.isalpha():
            return self._word(chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ",.!?;:":
            found = (chunk[:-1], chunk[-1])
        else:
            found = self.word.findall(chunk)
        known = self.known.get
        out = b"".join([known(w) or self._word(w) for w in found])
        return self._remembered(chunk, out)

    def _word(self, word: str) -> bytes:
        ids = self.merged(word)
        return self._remembered(word, pack(f"<{len(ids)}I", *ids))

    def _remembered(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text. Strings of special tokens stand for those tokens; white space only separates."""
        out = []
        for piece in self.mark.split(text) if "<|" in text else (text,):
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
                continue
            if not piece.isascii():
                # Lower case goes letter by letter: no final sigma.
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            known, chunks = self.known.get, _SPLIT(piece.lower())
            got = [known(c) for c in chunks]
            if None in got:
                got = [x if x is not None else self._chunk(c) for x, c in zip(got, chunks, strict=True)]
            out += got
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a space between each two, special tokens included."""
        return " ".join(map(self.token.__getitem__, memoryview(ids).cast("I").tolist()))


def _SPLIT(text: str) -> list[str]:  # noqa: N802
    """Runs without white space; the four separators U+001C to U+001F are no white space here."""
    return text.split() if not _SEPARATORS.search(text) else _BLANK.split(text)


_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANK = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)


@functools.cache
def vocabulary(data: bytes) -> Vocabulary:
    """One for each worker and file."""
    return Vocabulary(data)


def shipped(frame: DataFrame, path: str) -> Broadcast:
    """The file's bytes for all executors: the driver alone reads the path."""
    return frame.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encoded(batches: Iterator[pa.RecordBatch], data: bytes, keep: bool = False) -> Iterator[pa.RecordBatch]:
    v = vocabulary(data)
    for batch in batches:
        n, ids_sha, text_sha, kept = [], [], [], []
        for text in batch.column("text"):
            ids = v.encode(text.as_py() or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(v.decode(ids).encode("utf-8")).hexdigest())
            if keep:
                kept.append(memoryview(ids).cast("I").tolist())
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document, and the ids themselves if asked for.

    One pass without a shuffle. A null text is an empty one: no tokens, digests of nothing. doc_id may be null or
    repeated: each row gives one row; no rows give no rows. Other columns of `docs` are not read.
    """
    file = shipped(docs, path)
    return bounded(docs).select("doc_id", "text").mapInArrow(lambda b: encoded(b, file.value, keep_ids), SCHEMA + (", ids array<int>" if keep_ids else ""))


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    file = shipped(rows, path)

    def run(batches):
        v = vocabulary(file.value)
        for batch in batches:
            texts = [" ".join(v.token[i] for i in x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
