"""Secrets: patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, staged

#: The patterns of the three base kinds, and the lengths below which a match fails.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]

#: Runs that may encode random bytes, and the alphabets that the tests infer, smallest first.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = [
    ("decimal", DIGITS),
    ("hex", DIGITS + LOWER[:6]),
    ("hex", DIGITS + UPPER[:6]),
    ("lower", LOWER),
    ("upper", UPPER),
    ("base32", LOWER + "234567"),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("base36", DIGITS + UPPER),
    ("letters", UPPER + LOWER),
    ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
]
ORDERS = [(name, {c: i for i, c in enumerate(letters)}) for name, letters in ALPHABETS]
#: A test of uniformity, runs or serial correlation under this rules randomness out.
RULED_OUT = 1e-3
#: Share of neighbours in ordinary words, names and numbers whose classes (lower, upper, digit, sign) differ; taken high, so that the chance of an ordinary run is not understated.
TURN = 0.12
#: The chance of a change of class after each class: capitals are often alone, and signs nearly always.
LEAVE = [TURN, 0.5, TURN, 1 - TURN]
#: Ordinary words, from which the chances of a letter after another are taken, whatever its case.
WORDS = """
the of and that have for not with you this but his from they say her she will one all would there their what out about who get which when make can like time just him know take people into year your good some
could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us information between another system number
question government development through against should before great while those where being under during without nothing something different important possible business history example network service server
user password connection document description version application configuration transaction management performance international communication understanding relationship organization responsible
der die und das nicht ein eine ich ist sie mit sich auf des dem den von werden haben auch nach bei einer noch wie aber wenn durch wird sein oder zwischen gegen unter immer schon mehr kein diese dieser seine
geschichte gesellschaft wirtschaft entwicklung verbindung bedeutung regierung wissenschaft freiheit sicherheit zusammenhang verantwortung unternehmen verschiedene eigentlich nachrichten beispiel arbeit pfeife
le la les des une est pas que qui dans pour sur plus avec tout faire son mais comme nous vous elle cette bien sont leur aussi deux entre temps toujours quelque beaucoup pourquoi maintenant homme femme eaux aux
gouvernement question information administration nouvelle heureux travail peut premier situation personne quelle iere eur ement
el los las por con para una como pero sus este esta entre cuando muy sin sobre hasta donde quien desde todo nos durante todos uno les contra otros ese eso ante ellos cion dad mente gobierno desarrollo tiempo
informacion educacion sociedad historia mundo trabajo mismo gran hacer cada mejor nuestro siempre entonces pueblo ciudad
"""
#: Expected share of false finds, held for each class of lengths.
RATE = 0.001
#: Length classes: up to 31, 63, 127 letters, and longer.
CLASSES = [32, 64, 128]
#: Chances are kept as tenths of -log10, up to here.
DEEPEST = 400
SCHEMA = "doc_id long, base array<struct<kind:int,start:int,end:int>>, maybe array<struct<start:int,end:int,length:int,depth:int>>"


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def chi_square_tail(x: float, df: int) -> float:
    """By Wilson and Hilferty's cube root."""
    return normal_tail(((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))


def battery(run: str) -> tuple[float, float, float] | None:
    """Chances, under uniform random letters of the inferred alphabet, of letters as unequal, of runs above and below
    the alphabet's middle as few or many, and of neighbours as correlated; None if the run fits no alphabet."""
    letters = run.rstrip("=")
    for _, order in ORDERS:
        if all(c in order for c in letters):
            break
    else:
        return None
    x, n, k = [order[c] for c in letters], len(letters), len(order)
    count = [0] * k
    for i in x:
        count[i] += 1
    uniform = chi_square_tail(sum(c * c for c in count) * k / n - n, k - 1)
    high = [2 * i >= k for i in x]
    a = sum(high)
    b = n - a
    if not a or not b:
        return uniform, 0.0, 0.0
    mean = 2 * a * b / n + 1
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    turns = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
    runs = 2 * normal_tail(max(0.0, abs(turns - mean) - 0.5) / spread)
    m = sum(x) / n
    var = sum((i - m) ** 2 for i in x)
    serial = sum((p - m) * (q - m) for p, q in zip(x, x[1:], strict=False)) / var
    return uniform, runs, 2 * normal_tail(abs(serial + 1 / n) * math.sqrt(n))


def neighbours() -> dict[str, dict[str, float]]:
    """Log10 of the chance of each small letter after another, or after none, in WORDS; a tenth is spread over all letters alike."""
    pairs = Counter(w[max(i - 1, 0) : i] + c for w in WORDS.split() for i, c in enumerate(w))
    ones = Counter(c for w in WORDS.split() for c in w)
    total = sum(ones.values())
    alone = {c: 0.9 * ones[c] / total + 0.1 / 26 for c in LOWER}
    after = {a: sum(pairs[a + c] for c in LOWER) for a in LOWER}
    chance = lambda a, c: 0.75 * pairs[a + c] / after[a] + 0.25 * alone[c] if after[a] else alone[c]
    return {"": {c: math.log10(alone[c]) for c in LOWER}} | {a: {c: math.log10(chance(a, c)) for c in LOWER} for a in LOWER}


NEXT = neighbours()


def ordinary(letters: str) -> float:
    """Log10 of the chance that ordinary text gives these letters: a chain of classes, letters in it as they follow each other in words, digits and signs alike."""
    out, last, before = 0.0, None, ""
    for c in letters:
        kind = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
        if last is None:
            out -= math.log10(4)
        else:
            out += math.log10(1 - LEAVE[last] if kind == last else LEAVE[last] / 3)
        if kind < 2:
            # a capital before small letters begins their word
            c = c.lower()
            out += NEXT[before if kind == last or (last, kind) == (1, 0) else ""][c]
        else:
            out -= 1 if kind == 2 else math.log10(4)
        last, before = kind, c
    return out


def depth(run: str) -> int | None:
    """Tenths of -log10 of the chance that ordinary text gives a run that looks as random; None if it fits no alphabet.

    The odds of ordinary against uniform letters, these spread over all alphabets alike, are such a chance (by Markov's
    inequality). They are divided by the battery's chance, which is the least of its three with Bonferroni's factor: it
    is at most 1, so the chance stays one. What a test rules out gets 0, but is counted as tested.
    """
    chances = battery(run)
    if chances is None:
        return None
    if min(chances) < RULED_OUT:
        return 0
    letters = run.rstrip("=")
    fit = min(len(order) for _, order in ORDERS if all(c in order for c in letters))
    odds = ordinary(letters) + len(letters) * math.log10(fit) + math.log10(len(ORDERS))
    return max(0, min(DEEPEST, int(-10 * (odds - math.log10(min(1, 3 * min(chances)))))))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind: leftmost matches of each kind that do not overlap; too short ones fail."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def random_runs(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """All runs apart from base spans that fit an alphabet, with their length class and the depth of their chance."""
    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        if not any(a < e and s < b for _, a, b in base) and (d := depth(m[0])) is not None:
            out.append({"start": s, "end": e, "length": sum(e - s >= c for c in CLASSES), "depth": d})
    return out


def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    maybe_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length", pa.int32()), ("depth", pa.int32())]))
    for batch in batches:
        base, maybe = [], []
        for x in batch.column("text"):
            spans = base_spans(text := x.as_py() or "")
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            maybe.append(random_runs(text, spans))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, base_type), pa.array(maybe, maybe_type)], ["doc_id", "base", "maybe"])


def discoveries(counts: list[tuple[int, int, int]], tested: int) -> dict[int, int]:
    """Least depth that Benjamini and Hochberg's rule lets pass, by length class.

    counts: rows (length class, depth, runs). A class is weighed alike, so each takes RATE of its own finds; tested is
    the number of runs that were tested in a class.
    """
    out = {}
    for length in {c[0] for c in counts}:
        seen = 0
        for depth, n in sorted(((d, n) for k, d, n in counts if k == length), reverse=True):
            seen += n
            if 10 ** (-depth / 10) <= RATE * seen / max(1, tested):
                out[length] = depth
    return out


def scan_documents(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every document: doc_id and spans array<struct<kind,start,end>>, by start, then kind.

    Kinds assign, access and hex are pattern matches. Kind random holds runs of 20 letters and more that no test of
    the battery rules out as random and that ordinary text would hardly give; one threshold for each class of lengths,
    from counts over all documents, bounds the share of false finds among all runs that were tested. These counts are
    some 4 times DEEPEST rows.

    Offsets are code points, the end exclusive. A null or empty text has no spans. doc_id may be null or repeated: each
    row gives one row. Other columns of `docs` are not read.
    """
    spans = staged(bounded(docs).select("doc_id", "text").mapInArrow(found, SCHEMA), "secrets")
    runs = spans.select(F.explode("maybe").alias("m")).groupBy("m.length", "m.depth").count()
    counts = [tuple(r) for r in runs.collect()]
    passed = {}
    for length in {c[0] for c in counts}:
        alike = [c for c in counts if c[0] == length]
        passed |= discoveries(alike, sum(n for _, _, n in alike))
    keep = lambda m: m["depth"] >= _least(m["length"], passed)
    added = F.transform(F.filter("maybe", keep), lambda m: F.struct(F.lit(3).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    ordered = F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = F.array(*map(F.lit, KINDS))
    return spans.select("doc_id", F.transform(ordered, lambda s: F.struct(F.element_at(name, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def _least(length, passed: dict[int, int]):
    out = F.lit(DEEPEST + 1)
    for k, depth in passed.items():
        out = F.when(length == k, depth).otherwise(out)
    return out


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with each span, or overlap of spans, replaced by one mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digests(spans: DataFrame) -> DataFrame:
    """Counts by base kind and the spans written out as kind:start:end."""
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "random"), written), ",")
    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", written), ",").alias("spans"))

