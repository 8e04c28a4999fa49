"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from its words, hashed into signed counts, and from shares of
letter kinds, word shapes and repeats; gated attention weighs the passages, and the weighted mean of their codes is
scored. Only documents have labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded, passes, staged, words

#: Words in a passage.
PASSAGE = 64
#: Bound of the sample that is learned from: labelled documents of each class, and passages of them all together, and of one document, evenly spread over it. Scoring reads all passages of all documents.
SAMPLE, SAMPLE_PASSAGES, SAMPLE_BAG = 4000, 40_000, 625
#: Places that words are hashed to.
HASHED = 128
#: Sizes of the code and of the attention, passes over the sample, documents of a step and its length at first, and decay of weights.
CODE, GATE, EPOCHS, STEP_DOCS, STEP, DECAY = 16, 8, 12, 256, 0.02, 1e-4
#: From this score on a document is predicted to be good.
GOOD = 0.3

LOWER, UPPER, DIGIT, STOP, SIGN, OTHER = range(6)
KIND = np.full(256, OTHER, np.int64)
KIND[33:127] = SIGN
KIND[97:123], KIND[65:91], KIND[48:58] = LOWER, UPPER, DIGIT
KIND[[ord(c) for c in ".,;:?'\"-()"]] = STOP
LAGS = (1, 2, 3, 4, 5, 7, 10, 15, 20, 30)
WIDTH = 6 + 6 + 36 + len(LAGS) + 5 + HASHED


def encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages before each text (one more than texts). A text without words is one passage of zeros."""
    h, start, end, count = words(texts)
    n = np.diff(count)
    bags = np.maximum(1, -(-n // PASSAGE))
    first = np.cumsum(bags) - bags
    out = np.zeros((bags.sum(), WIDTH), np.float32)
    if len(h):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        doc = np.repeat(np.arange(len(texts)), n)
        bag = first[doc] + (np.arange(len(h)) - count[doc]) // PASSAGE
        rows = len(out)
        size = np.bincount(bag, minlength=rows).astype(np.float32)
        kind = KIND[data]
        letters = np.zeros((rows, 6))
        begin = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
        stop = np.append(begin[1:], len(bag)) - 1
        for k in range(6):
            sums = np.concatenate(([0], np.cumsum((kind == k) & ~SPACE[data])))
            letters[bag[begin], k] = sums[end[stop]] - sums[start[begin]]
        length = (end - start).astype(np.float64)
        total = np.maximum(letters.sum(1), 1)
        head, tail, before = kind[start], kind[end - 1], kind[np.maximum(end - 2, start)]
        parts = [letters / total[:, None]]
        safe = np.maximum(size, 1)[:, None]
        parts.append(np.bincount(bag * 6 + head, minlength=rows * 6).reshape(rows, 6) / safe)
        parts.append(np.bincount(bag * 36 + before * 6 + tail, minlength=rows * 36).reshape(rows, 36) / safe)
        again = np.zeros((rows, len(LAGS)))
        for i, lag in enumerate(LAGS):
            same = np.flatnonzero((h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])) + lag
            again[:, i] = np.bincount(bag[same], minlength=rows) / safe[:, 0]
        parts.append(again)
        mean = np.bincount(bag, length, rows) / safe[:, 0]
        spread = np.sqrt(np.maximum(np.bincount(bag, length**2, rows) / safe[:, 0] - mean**2, 0))
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        lines = np.zeros(rows)
        lines[bag[begin]] = breaks[end[stop]] - breaks[start[begin]]
        upper = np.bincount(bag, (head == UPPER) & (tail == UPPER) & (end - start > 1), rows) / safe[:, 0]
        parts.append(np.stack((mean / 10, spread / 10, size / PASSAGE, lines / safe[:, 0], upper), 1))
        place = (h >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64)
        sign = np.where(h & np.uint64(1), 1.0, -1.0)
        parts.append(np.bincount(bag * HASHED + place, sign, rows * HASHED).reshape(rows, HASHED) / np.sqrt(safe))
        out[:] = np.concatenate(parts, 1)
    return out, np.append(first, len(out))


class Model:
    """Codes tanh(xA + a); weights softmax(w . (tanh(cV) * sigmoid(cU))); score sigmoid(k . mean + d)."""

    def __init__(self, x: np.ndarray):
        rng = np.random.default_rng(13)
        self.mean, self.scale = x.mean(0), 1 / np.maximum(x.std(0), 0.02)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"A": draw(x.shape[1], CODE), "a": np.zeros(CODE), "V": draw(CODE, GATE), "U": draw(CODE, GATE), "w": draw(GATE), "k": draw(CODE), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(np.append(start, len(x)))
        x = np.clip((x - self.mean) * self.scale, -8, 8)
        c = np.tanh(x @ p["A"] + p["a"])
        t, g = np.tanh(c @ p["V"]), 1 / (1 + np.exp(-c @ p["U"]))
        s = (t * g) @ p["w"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, start), n))
        weight = e / np.repeat(np.add.reduceat(e, start), n)
        z = np.add.reduceat(weight[:, None] * c, start, axis=0)
        return {"x": x, "n": n, "c": c, "t": t, "g": g, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["k"] + p["d"], -30, 30)))}

    def gradients(self, f: dict[str, np.ndarray], start: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, f["n"]
        dy = (f["score"] - y) * importance
        dz = np.repeat(dy[:, None] * p["k"], n, axis=0)
        dw = (dz * f["c"]).sum(1)
        ds = f["weight"] * (dw - np.repeat(np.add.reduceat(f["weight"] * dw, start), n))
        dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dc = (f["weight"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["c"] ** 2)
        return {"A": f["x"].T @ dc, "a": dc.sum(0), "V": f["c"].T @ dt, "U": f["c"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "k": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, start: np.ndarray, y: np.ndarray, importance: np.ndarray) -> Model:
        """By Adam's rule over STEP_DOCS documents at a time, in one fixed order a pass, with steps that shrink to none."""
        m = {k: [0 * v, 0 * v] for k, v in self.p.items()}
        end, rng = np.append(start[1:], len(x)), np.random.default_rng(29)
        importance = importance / importance.mean()
        steps = EPOCHS * -(-len(y) // STEP_DOCS)
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), STEP_DOCS):
                docs = order[at : at + STEP_DOCS]
                size = end[docs] - start[docs]
                first = np.cumsum(size) - size
                own = x[np.arange(size.sum()) + np.repeat(start[docs] - first, size)]
                step += 1
                for k, g in self.gradients(self.forward(own, first), first, y[docs], importance[docs] / len(docs)).items():
                    g = g + DECAY * self.p[k]
                    m[k][0], m[k][1] = 0.9 * m[k][0] + 0.1 * g, 0.99 * m[k][1] + 0.01 * g * g
                    self.p[k] = self.p[k] - STEP * (1 - (step - 1) / steps) * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.99**step)) + 1e-8)
        return self


def held_out(doc_id) -> F.Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and number of the passages of every text; of a text with more than SAMPLE_BAG, so many from all over it."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
        out, n = [], []
        for part in passes([len(t) for t in texts]):
            x, first = encoded(texts[part])
            n += np.minimum(np.diff(first), SAMPLE_BAG).tolist()
            out += [x[s + np.arange(min(e - s, SAMPLE_BAG)) * (e - s) // max(1, min(e - s, SAMPLE_BAG))].tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "label", "n", "bag"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fitted to at most SAMPLE documents of each class, drawn by a hash of doc_id, and of these to the first that have
    SAMPLE_PASSAGES passages together; of a longer document SAMPLE_BAG passages, evenly spread, are learned from. Each class is weighed by its share of the labels. None without labels. A
    document with several labels has the lowest; rows that share a doc_id and the text are one."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not count:
        return None
    drawn = None
    for label in sorted(count):
        one = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        drawn = one if drawn is None else drawn.unionByName(one)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label", F.sha2("text", 256)).agg(F.first("text").alias("text"))
    found = staged(texts.select("doc_id", "label", "text").mapInArrow(bags, "doc_id long, label int, n long, bag binary").where("length(bag) > 0").withColumn("place", F.xxhash64("doc_id", "bag")), "quality-bags")
    # Numbers alone, at most those of the sample's rows; texts that share an id beyond that are not learned from.
    sizes = found.select("place", "n").orderBy("place").limit(2 * SAMPLE).collect()
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if total > SAMPLE_PASSAGES:
            break
        last = r["place"]
    if last is None:
        return None
    rows = found.where(F.col("place") <= last).toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    each = [np.frombuffer(b.as_buffer(), np.float32).reshape(-1, WIDTH) for b in rows.column("bag")]
    x = np.concatenate(each)
    y = rows.column("label").to_numpy().astype(float)
    start = np.cumsum([0, *map(len, each)])[:-1]
    del rows, each
    share = np.bincount(y.astype(int), minlength=2)
    return Model(x).fit(x, start, y, np.array([count[label] / share[label] for label in y.astype(int)]))


def scored(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
        score = [np.full(len(texts), 0.5)] if model is None else []
        for part in passes([len(t) for t in texts]) if model else ():
            x, first = encoded(texts[part])
            score.append(model.forward(x, first[:-1])["score"])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(score) if score else [], pa.float64())], ["doc_id", "score"])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document, from all passages of its whole text.

    Learned from documents that are not held out (crc32 of doc_id as text, modulo 5, is not 0); inputs are texts alone.
    A null text is an empty one: it has a score like any text. A null doc_id is not held out. Without any labels all
    scores are 0.5. Repeated rows are rows of their own; no rows give no rows. Other columns are not read.
    """
    model = train(bounded(docs), labels)
    out = docs.select("doc_id", "text").mapInArrow(lambda b: scored(b, model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is predicted to be good."""
    model = train(bounded(docs), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = next(scored(iter([batch.select(["doc_id", "text"])]), model)).column("score").to_numpy()
            yield batch.filter(pa.array(score >= GOOD))

    return docs.mapInArrow(run, docs.schema)
