"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: compatibility forms are resolved and case is dropped, letters of other alphabets
that look like Latin ones become these, digits and signs that stand for letters too
(``1d10t``); what is neither letter nor digit is a single space.

The lexicon holds whole words and beginnings of words, as inflected and compounded
forms share these.  Its weights are log ratios of how often labelled toxic and clean
texts have a term, over at most ``MAX_DOCUMENTS`` labelled rows, the first ones in the
order of a hash of their id; a term must be more frequent in toxic texts than chance explains among as many terms as there are (a likelihood
ratio), and the strongest ``LEXICON`` are kept; a beginning goes if one word makes up most of it.
A word counts with the largest weight of
what matches it, and once in a text, so that a repeated line is not a sum of itself.
Exception phrases are pairs of words with a lexicon word that
clean texts have as a rule; words inside one do not count.

The score is a logistic function of the weights' sum and of that sum divided by the
number of words, so a long text is not toxic for one chance word.

A null or empty text has no words and gets the curve's value for that.  Several labels of
one id count as their largest; null labels and ids are left out.  Without labels of both
kinds nothing is learned and every score is 0.  Extra columns are kept by ``scored``;
one with the name of the score is replaced.  Whole texts are read in slices of batches,
so a task holds some MB of text, or one text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import saved, slices, stored, texts_of

#: Most terms of the lexicon, most exception phrases, most labelled rows it is learned from.
LEXICON, EXCEPTIONS, MAX_DOCUMENTS = 20_000, 5_000, 50_000
#: Lengths of the beginnings of words that may be terms.
STEMS = (4, 5, 6)
#: Least log ratio of a term, and clean texts that an exception phrase needs.
LEAST_WEIGHT, LEAST_CLEAN = 2.5, 3
#: Texts that a term needs to be tested, and tested terms that may pass by chance.
LEAST_TEXTS, BY_CHANCE = 4, 2
THRESHOLD = 0.5

# Letters of other alphabets that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ø": "o", "ł": "l", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "!": "i", "|": "l",
}
#: Signs that fold only inside a word, as they end sentences or stand alone elsewhere.
_SIGNS = "@$€!|"
_TABLE = {ord(k): v for k, v in LOOKALIKES.items() if k not in _SIGNS}
_SIGN = re.compile(rf"(?<=\w)[{re.escape(_SIGNS)}](?=\w)")
_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words of a text with a space before and after each; a single space if there are none."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _SIGN.sub(lambda m: LOOKALIKES[m[0]], text.lower().translate(_TABLE))
    return " " + _GAP.sub(" ", text).strip() + " "


def terms_of(folded: str) -> set[str]:
    """What of a text may be in the lexicon: words between spaces, beginnings after one."""
    found = set()
    for word in set(folded.split()):
        if len(word) > 1:
            found.add(f" {word} ")
            found.update(f" {word[:k]}" for k in STEMS if len(word) >= k)
    return found


@dataclass(frozen=True)
class Lexicon:
    """Terms with their weights, exception phrases, and the curve (of no use before it is fitted)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matched(automaton: ahocorasick.Automaton | None, folded: str) -> dict[int, float]:
    """Weight by the place of the space before each word that counts."""
    at: dict[int, float] = {}
    covered = []
    if automaton is None:
        return at
    for last, (length, weight) in automaton.iter(folded):
        start = last - length + 1
        if weight is None:
            covered.append((start, last))
        elif weight > at.get(start, 0.0):
            at[start] = weight
    for start, stop in covered:
        for place in [p for p in at if start <= p < stop]:
            del at[place]
    return at


def features(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(1000 * weight / (words + 50))


def text_features(automaton: ahocorasick.Automaton | None, text: str) -> tuple[float, float]:
    folded = fold(text)
    words = {folded[at + 1 : folded.index(" ", at + 1)]: weight for at, weight in matched(automaton, folded).items()}
    return features(math.fsum(words.values()), folded.count(" ") - 1)


def _labelled(docs: DataFrame, labels: DataFrame, usable: Column | None, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled ids; only their ids are sent to the texts."""
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if usable is not None:
        known = known.filter(usable)
    known = saved(known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).withColumn("at", F.xxhash64("doc_id")))
    share = min(1.0, 1.2 * most / max(known.count(), 1))  # about as many, so that the top-k is a small one
    near = known.filter(F.col("at") < F.lit(int((2 * share - 1) * 2**63) - 1 if share < 1 else 2**63 - 1))
    chosen = near.orderBy("at", "doc_id").limit(most).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _counted(labelled: DataFrame, extract) -> DataFrame:
    """(term, t, c): in how many toxic and clean texts each term is, summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            terms = list(dict.fromkeys([*counts[0], *counts[1]]))
            columns = [pa.array(terms, pa.string()), *(pa.array([counts[k][x] for x in terms], pa.int64()) for k in (1, 0))]
            return pa.RecordBatch.from_arrays(columns, names=["term", "t", "c"])

        counts = (Counter(), Counter())
        for batch in slices(batches, "text", 1 << 20):
            for text, toxic in zip(texts_of(batch.column("text")).to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(extract(fold(text)))
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield told()
                counts = (Counter(), Counter())
        if counts[0] or counts[1]:
            yield told()

    found = labelled.select("text", "toxic").mapInArrow(run, "term string, t bigint, c bigint")
    return found.groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None,
    lexicon: int = LEXICON, exceptions: int = EXCEPTIONS, max_documents: int = MAX_DOCUMENTS,
) -> Lexicon | None:
    """The model that ``labels`` (doc_id, toxic) teach; ``usable`` (over doc_id) says which may be used."""
    labelled = stored(_labelled(docs, labels, usable, max_documents), "labelled")
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}  # two rows
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return None
    counts = saved(_counted(labelled, terms_of).filter(F.col("t") + F.col("c") >= LEAST_TEXTS))
    total = counts.count()
    t, c = F.col("t"), F.col("c")
    share = toxic / (toxic + clean)
    chance = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    strong = counts.filter((t > 0) & (chance > 2 * math.log(max(total / BY_CHANCE, 2))) & (weight >= LEAST_WEIGHT))
    chosen = strong.withColumn("g", F.round(chance, 6)).orderBy(F.desc("g"), "term").limit(lexicon)
    weights = _without_idle_stems(chosen.select("term", "t", weight.alias("weight")).collect())  # at most ``lexicon`` terms
    automaton = _Lazy(Lexicon(weights))

    def phrases(folded: str) -> set[str]:
        found = set()
        for place in matched(automaton.get(), folded):
            start, stop = folded.index(" ", place + 1), folded.rfind(" ", 0, place)
            after, before = folded.find(" ", start + 1), stop
            if after > 0:
                found.add(folded[place : after + 1])
            if before >= 0:
                found.add(folded[before : start + 1])
        return found

    usual = _counted(labelled, phrases).filter((c >= LEAST_CLEAN) & (c / F.lit(clean) > 4 * (t + 0.5) / F.lit(toxic + 1)))
    usual = usual.orderBy(F.desc("c"), "term").limit(exceptions)
    model = Lexicon(weights, tuple(r["term"] for r in usual.collect()))  # at most ``exceptions`` phrases
    automaton = _Lazy(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            x = [text_features(automaton.get(), v) for v in texts_of(batch.column("text")).to_pylist()]
            columns = [batch.column("toxic"), *(pa.array([r[k] for r in x], pa.float64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "x", "y"])

    # summed by rounded features: repeated ids and any number of rows are some thousand sums
    rows = labelled.select("text", "toxic").mapInArrow(measured, "toxic boolean, x double, y double")
    rows = rows.groupBy("toxic", F.round("x", 2).alias("x"), F.round("y", 2).alias("y")).count().orderBy("toxic", "x", "y").collect()
    return Lexicon(model.weights, model.exceptions, _fitted(rows))


def _without_idle_stems(rows: list) -> dict[str, float]:
    """Weights of the terms; a beginning that stands for hardly more than one word leaves it to the word."""
    most = Counter()
    for r in rows:
        if r["term"].endswith(" "):
            for k in STEMS:
                most[r["term"][: k + 1]] = max(most[r["term"][: k + 1]], r["t"])
    return {r["term"]: r["weight"] for r in rows if r["term"].endswith(" ") or most[r["term"]] < 0.8 * r["t"]}


class _Lazy:
    """An automaton that is built once in each task, as only the lexicon is sent."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.built = lexicon, None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "built": None}

    def get(self) -> ahocorasick.Automaton | None:
        if self.built is None:
            self.built = (self.lexicon.automaton(),)
        return self.built[0]


def _fitted(rows: Iterable) -> tuple[float, float, float]:
    """Logistic regression of toxic on x and y, with a weak pull to 0 that keeps separable classes finite."""
    rows = list(rows)
    x = np.array([[r["x"], r["y"], 1.0] for r in rows])
    target, n = np.array([1.0 if r["toxic"] else 0.0 for r in rows]), np.array([float(r["count"]) for r in rows])
    w = np.zeros(3)
    pull = np.diag([0.05, 0.05, 0.001])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (n * (p * (1 - p) + 1e-9))[:, None]).T @ x + pull, x.T @ (n * (target - p)) - pull @ w)
    return tuple(float(v) for v in w)


def scored(docs: DataFrame, model: Lexicon | None, score: str = "score") -> DataFrame:
    """``docs`` with the score of each text in ``score``."""
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c != score])
    schema = kept.withColumn(score, F.lit(0.0)).schema
    automaton = _Lazy(model) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = np.zeros(batch.num_rows)
            if model:
                x = np.array([(*text_features(automaton.get(), v), 1.0) for v in texts_of(batch.column("text")).to_pylist()])
                found = 1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, score])

    return kept.mapInArrow(run, schema)
