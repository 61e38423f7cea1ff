"""Document quality by a linear-chain conditional random field over lines.

Every line that is not blank is a place of a chain with two states, good and bad.
Features are ratios of character classes, lengths and repeats of words, of the
line itself and of the lines before and after it; transitions tie neighbouring
states.  Each line's probability of being good is its forward-backward marginal;
a document's score is the mean over its lines weighted by their length, put on the
scale of the label by a logistic curve.

A text without lines (null, empty, only white space) counts as one empty line, so
it has a score too.  Rows are scored one by one: ties, repeated rows and other
columns have no influence.  Without any usable label, all scores are 0.5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import saved, slices, texts_of, words_of

#: Bounds of the training sample.
MAX_DOCUMENTS, MAX_LINES = 3000, 40_000
THRESHOLD = 0.3
#: Bytes of text that a task looks at together; its arrays take many times as much.
PIECE = 1 << 20

OTHER, LOWER, UPPER, DIGIT, SYMBOL, BAR, MARK, POINT, SPACE, LEAD = range(10)
_CLASS = np.full(256, OTHER, dtype=np.int64)
for _name, _chars in (
    (LOWER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, b"0123456789"),
    (SYMBOL, b"#$%&*@^~_=+<>\\/{}[]`"), (BAR, b"|"), (MARK, b"!?"), (POINT, b".,;:'\"()-"), (SPACE, b" \t\r\x0b\x0c"),
):
    _CLASS[list(_chars)] = _name
_CLASS[0xC0:] = LEAD

OWN_FEATURES = 12


@dataclass
class CrfModel:
    """Weights of the chain and of the curve from mean marginal to score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    curve: tuple[float, float]


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines that are not blank, and their number per text (an empty line where there is none)."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy()
    filled = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    some = np.bincount(owner, weights=filled, minlength=len(texts)) > 0
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    kept = filled | (first & ~some[owner])
    return lines.filter(pa.array(kept)), np.bincount(owner[kept], minlength=len(texts)).astype(np.int64)


def line_features(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of single lines (rows x OWN_FEATURES) and their lengths in bytes."""
    n = len(lines)
    lines = pa.concat_arrays([lines.cast(pa.large_string())])
    lengths = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + n + 1]
    body = lines.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    kinds = _CLASS[data]
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] & 0xC0 == 0x80)) + 1
    kinds[accented] = np.where(data[accented] < 0x9F, UPPER, LOWER)
    counts = np.bincount(np.repeat(np.arange(n), lengths) * 10 + kinds, minlength=n * 10).reshape(n, 10).astype(float)
    chars = np.maximum(counts[:, :LEAD].sum(axis=1), 1)
    words, per_line = words_of(lines)
    owner = np.repeat(np.arange(n), per_line)
    repeats = np.zeros(n)
    if len(words) > 1:
        codes = words.dictionary_encode().indices.to_numpy()
        same = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        repeats = np.bincount(owner[1:][same], minlength=n).astype(float)
    filled = np.maximum(per_line, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER], 1)
    features = np.column_stack([
        counts[:, UPPER] / letters,
        counts[:, DIGIT] / chars,
        counts[:, SYMBOL] / chars,
        counts[:, BAR] / chars,
        counts[:, MARK] / chars,
        counts[:, POINT] / chars,
        counts[:, SPACE] / chars,
        np.log1p(lengths),
        np.log1p(per_line),
        np.log1p(chars / filled),
        repeats / filled,
        counts[:, OTHER] / chars,
    ])
    return features, lengths


def with_neighbours(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its text, and border marks."""
    n = len(features)
    first = np.zeros(n, bool)
    last = np.zeros(n, bool)
    ends = np.cumsum(counts)
    first[(ends - counts)[counts > 0]] = True
    last[(ends - 1)[counts > 0]] = True
    before = np.zeros_like(features)
    after = np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[first], after[last] = 0, 0
    return np.column_stack([np.ones(n), first, last, features, before, after])


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.empty_like(left)
    for i in (0, 1):
        for j in (0, 1):
            out[:, i, j] = left[:, i, 0] * right[:, 0, j] + left[:, i, 1] * right[:, 1, j]
    return out / out.sum(axis=(1, 2), keepdims=True)


def marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Forward and backward vectors and the marginals of all chains of a batch.

    Products of 2 x 2 matrices are built by doubling, so the number of steps grows
    with the logarithm of the longest chain.
    """
    n = len(scores)
    ends = np.cumsum(counts)
    place = np.arange(n) - np.repeat(ends - counts, counts)
    left = np.repeat(ends, counts) - np.arange(n) - 1
    good = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
    emit = np.clip(np.column_stack([1 - good, good]), 1e-12, None)
    moves = np.exp(transitions)
    ahead = moves[None] * emit[:, None, :]
    ahead[place == 0] = (np.exp(start)[None] * emit[place == 0])[:, None, :]
    back = np.ones((n, 2, 2))
    inner = np.flatnonzero(left > 0)
    back[inner] = moves[None] * emit[inner + 1][:, None, :]
    ahead /= ahead.sum(axis=(1, 2), keepdims=True)
    back /= back.sum(axis=(1, 2), keepdims=True)
    step, longest = 1, int(counts.max(initial=0))
    while step < longest:
        at = np.flatnonzero(place >= step)
        ahead[at] = _joined(ahead[at - step], ahead[at])
        at = np.flatnonzero(left >= step)
        back[at] = _joined(back[at], back[at + step])
        step *= 2
    forward, backward = ahead[:, 0, :], back[:, :, 0]
    both = forward * backward
    return forward, backward, emit, both / both.sum(axis=1, keepdims=True)


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 200) -> CrfModel:
    """Weights of largest regularised likelihood; each line has the label of its document."""
    mean = features.mean(axis=0)
    scale = features.std(axis=0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    x = (features - mean) / scale
    state = np.repeat(labels, counts).astype(int)
    n, size = len(x), x.shape[1]
    first = np.zeros(n, bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[inner - 1], state[inner]), 1)
    began = np.bincount(state[first], minlength=2)
    theta, m, v = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)
    for r in range(1, rounds + 1):
        w, moves, start = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        forward, backward, emit, marginal = marginals(x @ w, counts, moves, start)
        pair = forward[inner - 1][:, :, None] * np.exp(moves)[None] * (emit * backward)[inner][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        gradient = np.concatenate([
            x.T @ (state - marginal[:, 1]), (seen - pair.sum(axis=0)).ravel(), began - marginal[first].sum(axis=0)
        ]) / max(1, len(counts)) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    model = CrfModel(mean, scale, theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :], (1.0, 0.0))
    model.curve = _curve(mean_goodness(model, features, counts, lengths), labels)
    return model


def _curve(goodness: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from mean marginal to label, by Newton steps."""
    x = np.column_stack([goodness, np.ones(len(goodness))])
    t = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ t))
        t = t + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (labels - p) - 0.05 * t)
    return float(max(t[0], 1e-6)), float(t[1])


def mean_goodness(model: CrfModel, features: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, per document."""
    good = marginals(((features - model.mean) / model.scale) @ model.weights, counts, model.transitions, model.start)[3][:, 1]
    owner = np.repeat(np.arange(len(counts)), counts)
    weight = np.maximum(lengths, 1)
    total = np.bincount(owner, weights=weight, minlength=len(counts))
    return np.bincount(owner, weights=weight * good, minlength=len(counts)) / np.maximum(total, 1)


def text_scores(model: CrfModel | None, texts: pa.Array) -> np.ndarray:
    """Scores of an array of texts."""
    if model is None or not len(texts):
        return np.full(len(texts), 0.5)
    lines, counts = split_lines(texts)
    own, lengths = line_features(lines)
    goodness = mean_goodness(model, with_neighbours(own, counts), counts, lengths)
    return 1 / (1 + np.exp(-(model.curve[0] * goodness + model.curve[1])))


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None,
    max_documents: int = MAX_DOCUMENTS, max_lines: int = MAX_LINES,
) -> CrfModel | None:
    """The model of a bounded sample: ``max_documents`` labelled rows in the order of the hash of their id,
    as far as they have ``max_lines`` lines in all (a longer text is left out whole).

    ``usable`` (over doc_id) says which labels may be used.  Several labels of one
    id count as their largest; null labels and ids are left out.
    """
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("__label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "__label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            lines, counts = split_lines(texts_of(batch.column("text")))
            own, lengths = line_features(lines)
            ends = np.cumsum(counts)
            long = counts > max_lines
            data = [own[e - c : e].astype("<f4").tobytes() if not x else None for e, c, x in zip(ends, counts, long, strict=True)]
            sizes = [lengths[e - c : e].astype("<i8").tobytes() if not x else None for e, c, x in zip(ends, counts, long, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__label"), pa.array(counts), pa.array(data, pa.binary()), pa.array(sizes, pa.binary())],
                names=["doc_id", "label", "lines", "features", "lengths"],
            )

    kind, of = dict(texts.dtypes)["doc_id"], dict(texts.dtypes)["__label"]
    found = texts.mapInArrow(run, f"doc_id {kind}, label {of}, lines bigint, features binary, lengths binary")
    found = saved(found.withColumn("at", F.xxhash64("doc_id")))
    # at most max_documents small rows (repeated ids cut at the bound), then at most max_lines lines
    listed = found.filter("features IS NOT NULL").select("at", "label", "lines", F.sha2("features", 256).alias("sum"))
    chosen, total = [], 0
    for r in listed.orderBy("at", "sum").limit(max_documents).collect():
        if total + r["lines"] <= max_lines:
            total += r["lines"]
            chosen.append((r["at"], r["sum"]))
    wanted = set(chosen)
    rows = [
        r for r in found.filter(F.col("at").isin([at for at, _ in chosen]) & F.col("features").isNotNull()).collect()
        if (r["at"], hashlib.sha256(r["features"]).hexdigest()) in wanted
    ]
    rows.sort(key=lambda r: (r["at"], bytes(r["features"])))
    own = [np.frombuffer(r["features"], "<f4").reshape(-1, OWN_FEATURES) for r in rows]
    lengths = [np.frombuffer(r["lengths"], "<i8") for r in rows]
    counts = [r["lines"] for r in rows]
    marks = [1 if r["label"] else 0 for r in rows]
    if not counts:
        return None
    counts = np.array(counts, dtype=np.int64)
    features = with_neighbours(np.concatenate(own).astype(float), counts)
    return fit(features, counts, np.array(marks), np.concatenate(lengths))


def scored(docs: DataFrame, model: CrfModel | None, score: str = "score") -> DataFrame:
    """``docs`` with the score of each text in ``score`` (replacing a column of that name)."""
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c != score])
    schema = kept.withColumn(score, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            found = pa.array(text_scores(model, texts_of(batch.column("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, score])

    return kept.mapInArrow(run, schema)


def good_documents(docs: DataFrame, model: CrfModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            keep = text_scores(model, texts_of(batch.column("text"))) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
