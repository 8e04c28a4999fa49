"""Stems by the examples of the published algorithm, and a search that finds other forms."""

from __future__ import annotations

import pytest

from tidewell.functions import stems as M
from tidewell.operators import retrieve as S

PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate
cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_published_pairs(word, want):
    assert M.stem(word) == want


def test_other_words():
    assert M.stem("is") == "is" and M.stem("naïve") == "naïve" and M.stem("x1s") == "x1s" and M.stem("") == ""
    assert M.folded("Éléphant naïve") == "Elephant naive" and M.analysed("élèves") == ["élèves", "=elev"]


def test_recall_rises(spark):
    rows = spark.createDataFrame([(1, "He was motoring along."), (2, "The motors were loud."), (3, "A café by the sea."), (4, None), (5, "")], "key long, body string")
    tokens = M.analysed_terms(rows, "key", "body")
    got = {r["key"]: r["tokens"] for r in tokens.collect()}
    assert got[3] == ["a", "=a", "café", "=cafe", "by", "=by", "the", "=the", "sea", "=sea"] and got[4] == got[5] == []
    plain = S.term_counts(rows, "key", {"content": "body"})
    stemmed = S.counted_tokens(tokens, "key", "tokens")
    ask = lambda words: spark.createDataFrame([(0, w) for w in words], "qid long, term string")
    found = lambda counts, words: {r["key"] for r in S.bm25_top(counts, "key", ask(words), "qid", 5).collect()}
    assert found(plain, ["motor"]) == set() and found(stemmed, M.analysed("motor")) == {1, 2}
    assert found(plain, ["cafe"]) == set() and found(stemmed, M.analysed("cafe")) == {3}
    # The word itself counts beside its stem.
    assert [r["key"] for r in S.bm25_top(stemmed, "key", ask(M.analysed("motors")), "qid", 5).orderBy("rank").collect()][0] == 2
