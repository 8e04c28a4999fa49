"""Collocations, hard negatives and chat formatting against brute force."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewell.llm import chat, collocations, negatives

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11


def plain_phrases(rows, least=10, top=2000, share=50):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for n in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        some = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        scored = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * some[q] >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in some):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.add((lang, rank, p.decode(), -a, l, r, n, -s))
    return out


def told(frame):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in frame.collect()}


def phrase_rows():
    rng = random.Random(4)
    pool = ["a", "of", "the", "New", "york", "é", "K", "x" * 300, "to-do", "İ", "b c"]
    mark = [" ", "  ", "\t", ", ", ".", "\n", " \r\n", "\x0b", "? ", " ; "]
    text = lambda n: "".join(rng.choice(pool[: rng.choice([4, 11])]) + rng.choice(mark[: rng.choice([3, 10])]) for _ in range(n))
    rows = [(rng.choice(["en", "en", None, "und", "fr"]), text(rng.randrange(60))) for _ in range(200)]
    return rows + [("en", "united states of america " * 400), ("en", None), (None, ""), ("xx", ". , !"), ("fr", "one word"), *[("de", "twin rows here, twin rows")] * 12]


def test_collocations(spark, monkeypatch):
    rows = phrase_rows()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, f int")
    want = plain_phrases(rows)
    assert want and told(collocations.collocations(frame)) == want
    for name, value in (("HELD_BYTES", 2000), ("BUCKET_BYTES", 1500), ("SMALL", 8), ("RANKED", 3), ("PASS_BYTES", 500)):
        monkeypatch.setattr(collocations, name, value)
    assert told(collocations.collocations(frame.repartition(7), top=20)) == plain_phrases(rows, top=20)
    assert collocations.collocations(frame.limit(0)).collect() == []
    assert collocations.collocations(frame.where("text is null")).collect() == []


def test_collocations_hot_pair(spark):
    """One pair in front of many words; counts whose products pass 64 bits; a tie that only bytes decide."""
    rows = [("en", " ".join(f"hot pair w{i % 40}" for i in range(3000)))] + [("en", f"zz{i} yy{i}, " * 10) for i in range(30)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), top=15)
    assert told(got) == plain_phrases(rows, top=15)


def test_whole_scores(spark):
    """The score's arithmetic where a * a * 1000000 has some 100 bits."""
    score = spark.sql("select cast((cast(f as decimal(16, 0)) * cast(f as decimal(16, 0)) * cast(1000000 as decimal(7, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as long) as s, f, l, r from values (4000000000001L, 4000000000003L, 4000000000007L), (10L, 10L, 10L), (999999999999999L, 999999999999999L, 9999999999999999L) t(f, l, r)")
    for x in score.collect():
        assert x["s"] == 1000000 * x["f"] ** 2 // (x["l"] * x["r"])


@pytest.mark.parametrize("small", [1, 7, 1 << 15])
@pytest.mark.parametrize("least", [1, 4])
def test_equal_partitions(monkeypatch, small, least):
    monkeypatch.setattr(collocations, "SMALL", small)
    rng = np.random.default_rng(small + least)
    columns = [rng.integers(d > 0 and 0 or 1, 6, 600).astype(np.uint64) for d in range(3)]
    # A 0 ends a suffix.
    columns[2][columns[1] == 0] = 0
    weight = rng.integers(1, 3, 600)
    count = [collections.Counter() for _ in columns]
    for row, w in zip(zip(*columns, strict=True), weight, strict=True):
        for d in range(3):
            if all(row[: d + 1]):
                count[d][row[: d + 1]] += int(w)
    for d, (p, n) in enumerate(collocations.equal_partitions(columns, weight, least)):
        got = {tuple(c[i] for c in columns[: d + 1]): int(x) for i, x in zip(p, n, strict=True)}
        assert len(got) == len(p) and got == {k: v for k, v in count[d].items() if v >= least}


def test_clashing_words():
    """Words that share a key are told, whatever they count."""
    one = lambda words: (0, "en", np.full(len(words), 5, np.uint64).tobytes(), np.ones(len(words), np.int64).tobytes(), np.array([len(w) for w in words]).tobytes(), "".join(words).encode())
    for words, clash in ((["ab", "ab"], False), (["ab", "ba"], True), (["ab", "abc"], True)):
        out = collocations.counted(pa.Table.from_batches([collocations.packed([one([w]) for w in words])]), 10, 2)
        assert any(x for x in out.column("clash").to_pylist()) == clash and out.column("f").to_pylist()[0] == 2


def test_pair_filter(spark, monkeypatch):
    rng = np.random.default_rng(2)
    k = rng.integers(-(1 << 63), 1 << 63, (2, 500))
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in k.T], "k1 long, k2 long")
    for most in (29, 10):
        monkeypatch.setattr(collocations, "MOST_BITS", max(most, collocations.PIECE_BITS))
        monkeypatch.setattr(collocations, "LEAST_BITS", collocations.PIECE_BITS)
        bits = collocations.pair_filter(frame, 500)
        has = lambda a, b: [bool(bits[x >> 3] >> (x & 7) & 1) for x in (collocations.paired(a.view(np.uint64), b.view(np.uint64)) & np.uint64(8 * len(bits) - 1)).tolist()]  # noqa: E731, B023
        assert all(has(k[0], k[1])) and sum(has(k[1], k[0])) < 50


# 12


def plain_negatives(rows, positives=5, negatives_=5, scale=256):
    v = [(i, label, [int(np.floor(scale * float(x))) for x in e]) for i, label, e in rows if i is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    v = [(n, *r) for n, r in enumerate(v) if sum(x * x for x in r[2]) < 2**62]
    out = []
    for _, i, label, e in v:
        if i % 100:
            continue
        score = sorted((-sum(a * b for a, b in zip(e, x)), j, n, other == label) for n, j, other, x in v if j != i)  # noqa: B905
        for p, j, _, _ in [s for s in score if s[3]][:positives]:
            some = [s for s in score if not s[3] and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives_]
            out += [(i, j, rank, s[1], -p, -s[0]) for rank, s in enumerate(some, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>"


def vector_rows(seed=3, n=600):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 20))
    rows = [(int(i), int(rng.integers(4)), (centre[rng.integers(6)] * 0.2 + rng.normal(size=20) * 0.1).astype(np.float32).tolist()) for i in range(n)]
    rows += [(100, 1, rows[5][2]), (200, 2, [0.0] * 20), (300, 1, [1.0] * 8), (301, 2, [1.0] * 8), (302, 1, [1.0] * 8), (None, 1, [1.0] * 20), (1000, None, [1.0] * 20), (1100, 1, None), (1200, 1, [1.0, None] + [0.0] * 18), (1300, 1, [float("nan")] * 20), (1400, 2, [float("inf")] * 20), (1500, 7, [0.1] * 20), (1600, 3, [])]
    return rows + [(700 + i, i % 2, [0.5] * 20) for i in range(40)]


@pytest.mark.parametrize("blocks", [False, True])
def test_negatives(spark, monkeypatch, blocks):
    rows = vector_rows()
    if blocks:
        for name, value in (("LEAST_ROWS", 40), ("MOST_ROWS", 50), ("MOST_ASKS", 3), ("HELD_ROWS", 16), ("HELD_ASKS", 2), ("GROUP", 3)):
            monkeypatch.setattr(negatives, name, value)
    frame = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("place", F.lit(1))
    got = negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0)
    want = plain_negatives(rows)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want and len(want) > 50


def test_negatives_wide(spark):
    """Products beyond 53 bits are exact; vectors whose scores may be no 64-bit numbers take no part."""
    rng = np.random.default_rng(9)
    rows = [(int(i) * 20, int(i % 3), (rng.integers(-(1 << 20), 1 << 20, 8) + (1 << 20)).astype(float).tolist()) for i in range(120)] + [(1, 1, [1e30] * 8), (2, 1, [3e38] * 8)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_negatives_none(spark):
    frame = spark.createDataFrame(vector_rows(n=20), VECTORS)
    for none in (frame.limit(0), frame.where("vec_id % 100 != 0"), frame.where("embedding is null"), frame.where("label = 7")):
        assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("least", [-50, 0, 30, 200])
def test_index(least, monkeypatch):
    """Every pair that reaches its threshold is told with its score, whatever was left out."""
    monkeypatch.setattr(negatives, "GROUP", 4)
    rng = np.random.default_rng(least + 60)
    x, q = rng.integers(-6, 7, (300, 18)).astype(float) * rng.integers(0, 3, (300, 1)), rng.integers(-6, 7, (20, 18)).astype(float)
    order = np.argsort(-(x**2).sum(0))
    low = least + rng.integers(0, 20, 20)
    score, reach = negatives.Index(x, order).reached(q[:, order], low)
    full = q @ x.T
    assert (reach == (full >= low[:, None])).all() and (score[reach] == full[reach]).all()


# 13


def test_layouts_are_apart():
    assert len(chat.fingerprints()) > 20
    with pytest.raises(ValueError, match="same fields"):
        chat.fingerprints((*chat.LAYOUTS, chat.Layout("twin", (chat.Part("user", ("question",)), chat.Part("tool", ("answer",))))))
    for bad in ("x", "<|im", "a\\b", "|>"):
        with pytest.raises(ValueError, match="overlap|no control"):
            chat.Template(closing=bad)


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages", [("user", "hi"), ("assistant", "yo")]),
    ({"system": "s", "messages": [{"role": "user", "content": None}, {"role": "assistant"}], "id": 7}, "messages", [("system", "s"), ("user", ""), ("assistant", "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, "from_value", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ({"prompt": "p", "completion": "<|im_end|>"}, "prompt_completion", [("user", "p"), ("assistant", "<|im_end|>")]),
    ({"prompt": "p", "response": "r", "system": ""}, "prompt_response", [("system", ""), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": "a", "meta": {"prompt": "x"}}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"role": "user", "text": "t"}, "turn", [("user", "t")]),
    ({"instruction": "i", "answer": "o"}, None, None),
    ({"prompt": "p"}, None, None),
]


def test_canonical(spark):
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(98, "{broken"), (99, None)], "id long, record string")
    got = {r["id"]: r for r in chat.canonical(frame, json="record").collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i]["layout"] == layout and (turns is None) == (got[i]["turns"] is None), RECORDS[i]
        assert turns is None or [tuple(t) for t in got[i]["turns"]] == turns
    assert got[98]["layout"] == got[99]["layout"] == "turn" and [tuple(t) for t in got[99]["turns"]] == [("", "")]
    # As columns, with a field of another kind that is not read.
    own = spark.createDataFrame([("p", "c", 5, [("user", "x")]), ("p", "c", 5, None), (None, None, 5, [("user", "x")])], "prompt string, completion string, system int, messages array<struct<role: string, content: string>>")
    assert [r["layout"] for r in chat.canonical(own).collect()] == [None, "prompt_completion", "messages"]


def plain_digest(turns, learned=("assistant",)):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r in learned)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat(spark):
    rng = random.Random(5)
    bits = [*chat.CONTROLS, "<", "\\", "|", "[", "/", "s>", "]", "<\\|im_end|>", "<\\\\|im_end|>", "[\\INST]", "é", "\U0001f600", "\n", "user", "<|im_", "im_sep|>", ""]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "assistant", None, text()]), rng.choice([text(), text(), None])) for _ in range(300)]
    rows += [(7, 1, "assistant", "x" * 200000), (7, 0, "user", "\\" * 5000 + "<" * 5000), (8, 0, "assistant", ""), (9, 0, "user", "same"), (9, 0, "user", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("key", F.lit(1))
    made = chat.formatted(frame).cache()
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    none = lambda x: (x is not None, x)
    for conv in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (none(r[1]), r[2] or "", r[3] or ""))]
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == plain_digest(turns)
    for r in made.collect():
        assert r["formatted"] == "".join(p["text"] for p in r["pieces"])
        inside = [p["text"] for i, p in enumerate(r["pieces"]) if i % 3 == 1]
        assert not any(c in t for t in inside for c in chat.CONTROLS)
    assert chat.digests(chat.formatted(frame.limit(0))).collect() == []


def test_chat_records(spark):
    """Whole records, mixed with turns, of another template; nothing is shuffled where no record is a turn."""
    llama = chat.Template("[INST]", "[/INST]", "</s>", ("assistant", "tool"))
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)], "conv_id long, record string")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(frame, json="record", template=llama), template=llama).collect()}
    for i, (_, _, turns) in enumerate(RECORDS):
        want = plain_digest(turns, llama.learned) if turns is not None else (None,) * 4
        assert (got[i]["n_turns"], got[i]["turns_sha256"], got[i]["loss_chars"], got[i]["loss_sha256"]) == want
    whole = spark.createDataFrame([(1, "p", "c")], "conv_id long, prompt string, completion string")
    plan = chat.formatted(whole)
    assert plan.collect()[0]["formatted"] == "<|im_start|>user<|im_sep|>p<|im_end|><|im_start|>assistant<|im_sep|>c<|im_end|>"
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises((PySparkException, AttributeError)):
        chat.formatted(whole, key="none").collect()


def test_no_python_in_chat(spark, folder):
    plan = chat.digests(chat.formatted(spark.read.parquet(f"{folder}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_new_queries_sql(spark, folder):
    from pathlib import Path

    import duckdb

    from tests.test_queries import rows
    from tidewell.llm.queries import QUERIES, SQL

    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    for name in ("op11_collocations", "op12_negatives", "op13_chat"):
        got, want = QUERIES[name](spark, folder).toPandas(), c.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
