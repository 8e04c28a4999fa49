"""An analyser that finds other forms of a word: Porter's published suffix stripping, and accents folded, beside the word itself."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import words

#: Fixed values of the published algorithm: suffixes and what takes their place, by step.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: What marks a stem in a list of terms: no word begins with it.
MARK = "="


def _shape(word: str) -> str:
    """v for vowels, c for consonants; a y after a consonant is a vowel."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How many times vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last no w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of an English word in lower case; other words and short ones are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    # Plurals.
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    # Past forms and -ing.
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif (s := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-1:] == word[-2:-1] and _shape(word)[-1:] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (SECOND, THIRD):
        s = _longest(word, table)
        if s and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    s = _longest(word, FOURTH)
    if s and _measure(rest := word[: -len(s)]) > 1 and (s != "ion" or rest[-1:] in "st"):
        word = rest
    # A last e, and a double l.
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or m == 1 and not _short(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def folded(word: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def analysed(term: str) -> list[str]:
    """A term, and its stem of folded letters behind MARK."""
    return [term, MARK + stem(folded(term))]


def analysed_terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and tokens of every text: each word, and its marked stem. Equal words of a batch are stemmed once; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens").fill_null([])
            held = lists.flatten().dictionary_encode()
            each = [analysed(w) for w in held.dictionary.to_pylist()]
            pairs = pa.array([x for two in each for x in two], pa.string())
            code = held.indices.to_numpy()
            twice = pairs.take(pa.array([i for c in code.tolist() for i in (2 * c, 2 * c + 1)], pa.int64()))
            size = lists.value_lengths().to_numpy()
            edge = pa.array([0, *(2 * size).cumsum().tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(edge, twice)], [key, "tokens"])

    return rows.select(key, words(F.col(text)).alias("tokens")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, tokens array<string>")
