"""Katz backoff language model of word n-grams, trained and applied over one corpus.

Tokens are the words of a text, A-Z lowered, and one end mark per text.  An n-gram
seen r times in training has the Good-Turing discount d_r for r up to ``GOOD_TURING``
(where the counts of counts give no value between 0 and 1, an absolute discount of a
half); higher counts are discounted by a ten-thousandth, so that every history keeps
mass for words not seen after it.  That mass goes to the next lower order, in
proportion, by the history's backoff weight

    a(h) = (1 - sum of P*(w | h)) / (1 - sum of P(w | h')),   sums over w seen after h,

so each history's probabilities sum to 1 exactly.  Single words end the recursion:
what their discounts leave is the probability of the unknown word.

The corpus is cut into chunks of whole texts.  A chunk sends the sorted hashes (64
bits) of its distinct n-grams with their training counts to buckets of the hash
range; the buckets add up, keep the totals as the model's table, and answer each chunk.
For every n-gram one of the chunks that have it in training adds it to the sums of its
history, which the history's bucket turns into backoff weights.  Chunks and
messages are packed arrays, so a shuffle moves a few bytes per distinct n-gram of a
chunk.  Buckets split the range of n-gram hashes and no history has to fit in one
task: neither a hot word nor a hot pair makes one bucket larger than others, as a
chunk names each n-gram once.

Nulls count as empty text (the end mark alone).  Rows are scored one by one; repeated
rows, also of one doc_id, count as often as they occur.  Without training text every
token has probability 1 (score 0).  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import slices, stored, texts_of, words_of

ORDER = 2
GOOD_TURING = 5
CHUNK_BYTES = 8 << 20
BUCKET_ENTRIES = 1_000_000
SPARE = 1e-4

_SEED = 42
END = np.uint64(xxhash.xxh64_intdigest(b" end", _SEED))
START = np.uint64(xxhash.xxh64_intdigest(b" start", _SEED))


# packed arrays


def pack(values: np.ndarray) -> bytes:
    """Integers or doubles, bytes of equal place together, compressed."""
    if values.dtype.kind in "iu" and values.dtype != np.uint64:
        most = int(values.max(initial=0))
        values = values.astype(next(t for t in ("u1", "u2", "u4", "u8") if most < 1 << (8 * int(t[1]))))
    spread = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    body = pa.compress(spread, codec="zstd", asbytes=True) if spread else b""
    return f"{values.dtype.str}{len(values)} ".encode() + body


def unpack(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b" ")
    kind, n = np.dtype(head[:3].decode()), int(head[3:])
    if not n:
        return np.zeros(0, kind)
    flat = pa.decompress(body, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def joined_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram from its history's key and its last word's."""
    x = history * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bucket_borders(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the hash range begins and ends among sorted keys."""
    firsts = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, firsts), [len(keys)]])


# chunks


def chunked(docs: DataFrame, train: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The corpus as stored chunks: texts as codes into the chunk's sorted word keys."""
    kind = dict(docs.dtypes)["doc_id"]
    chosen = docs.select("doc_id", "text", train.alias("__train"))
    shape = (
        f"chunk bigint, doc_ids array<{kind}>, train binary, lengths binary, codes binary, words binary, "
        "n_words bigint, n_tokens bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", chunk_bytes):
            flat, counts = words_of(texts_of(batch.column("text")))
            coded = flat.dictionary_encode()
            keys = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            keys = np.append(keys, END)
            words, place = np.unique(keys, return_inverse=True)
            lengths = counts + 1
            codes = np.full(int(lengths.sum()), place[-1])
            inner = np.ones(len(codes), bool)
            inner[np.cumsum(lengths) - 1] = False
            codes[inner] = place[coded.indices.to_numpy()]
            flags = np.array([bool(x) for x in batch.column("__train").to_pylist()], dtype=np.uint8)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), ids, *[pa.array([pack(x)], pa.binary()) for x in (flags, lengths, codes)],
                 pa.array([pack_sorted(words)], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([len(codes)], pa.int64())],
                names=[c.split(" ")[0] for c in shape.split(", ")],
            )
            number += 1

    return stored(chosen.mapInArrow(run, shape), "language-model-chunks")


class Chunk:
    """One chunk in memory: keys of all its n-grams, by token."""

    def __init__(self, row: dict, order: int):
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.words = unpack_sorted(row["words"])
        self.codes = unpack(row["codes"]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = unpack(row["train"]).astype(bool)[self.owner]
        self.order = order
        pad = order - 1
        at = np.arange(len(self.codes)) + pad * (self.owner + 1)
        padded = np.full(len(self.codes) + pad * len(self.lengths), START)
        padded[at] = self.words[self.codes]
        # every order's keys are kept, as the longer ones are made of the shorter
        self.grams = {1: padded}
        for k in range(2, order + 1):
            history = np.concatenate([[START], self.grams[k - 1][:-1]])
            self.grams[k] = joined_key(history, padded)
        self.at = at

    def keys(self, k: int) -> np.ndarray:
        return self.grams[k][self.at]

    def histories(self, k: int) -> np.ndarray:
        return self.grams[k - 1][self.at - 1]

    def distinct(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, the place of each token's key among them, and training counts."""
        if k == 1:
            return self.words, self.codes, np.bincount(self.codes[self.train], minlength=len(self.words))
        keys, place = np.unique(self.keys(k), return_inverse=True)
        return keys, place, np.bincount(place[self.train], minlength=len(keys))


def _messages(rows: list[tuple], shape: str) -> pa.RecordBatch:
    names, kinds = zip(*[c.split(" ") for c in shape.split(", ")], strict=True)
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


# counting

_COUNTS = "bucket int, chunk bigint, keys binary, counts binary"
_RISING = ", ".join(f"n{r} bigint" for r in range(1, GOOD_TURING + 2))
_TOTALS = f"chunk bigint, bucket int, keys binary, counts binary, total bigint, kinds bigint, {_RISING}"


def count_ngrams(chunks: DataFrame, order: int, k: int, buckets: int) -> DataFrame:
    """Totals of k-grams by bucket (rows with a null chunk, the model's table), and what each chunk gets as answer.

    An answer holds, for the chunk's keys in the bucket, twice the training total,
    plus one where the chunk is the one that stands for the n-gram.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, _, counts = Chunk(row, order).distinct(k)
                cut = bucket_borders(keys, buckets)
                yield _messages([
                    (b, row["chunk"], pack_sorted(keys[i:j]), pack(counts[i:j]))
                    for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i
                ], _COUNTS)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        keys = [unpack_sorted(x) for x in rows["keys"].to_pylist()]
        counts = [unpack(x).astype(np.int64) for x in rows["counts"].to_pylist()]
        sizes = [len(x) for x in keys]
        every, own = np.concatenate(keys), np.concatenate(counts)
        kinds, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, weights=own, minlength=len(kinds)).astype(np.int64)
        first = np.full(len(kinds), -1)
        trained = np.flatnonzero(own > 0)[::-1]
        first[place[trained]] = trained  # the last write, so the smallest, stays
        answer = total[place] * 2 + (first[place] == np.arange(len(every)))
        seen = total > 0
        rising = np.bincount(np.minimum(total[seen], GOOD_TURING + 2), minlength=GOOD_TURING + 3)
        bucket, nothing = key[0].as_py(), (None,) * (GOOD_TURING + 1)
        out = [(None, bucket, pack_sorted(kinds[seen]), pack(total[seen]), int(total.sum()), int(seen.sum()), *rising[1 : GOOD_TURING + 2].tolist())]
        ends = np.cumsum(sizes)
        out += [
            (chunk, bucket, None, pack(answer[e - n : e]), None, None, *nothing)
            for chunk, n, e in zip(rows["chunk"].to_pylist(), sizes, ends, strict=True)
        ]
        return pa.Table.from_batches([_messages(out, _TOTALS)])

    sent = _one_by_one(chunks).mapInArrow(send, _COUNTS)
    return stored(sent.groupBy("bucket").applyInArrow(add, _TOTALS), f"language-model-{k}-grams")


def _one_by_one(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", "train", "lengths", "codes", "words")


def discounts(rising: list[int]) -> np.ndarray:
    """d_r for r = 0 .. GOOD_TURING + 1 (the last for all higher counts) from the counts of counts n_1, n_2, ..."""
    out = np.full(GOOD_TURING + 2, 1 - SPARE)
    n = [0, *rising]
    tail = (GOOD_TURING + 1) * n[GOOD_TURING + 1] / n[1] if n[1] else 1.0
    for r in range(1, GOOD_TURING + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (ratio - tail) / (1 - tail) if tail < 1 else 0.0
        out[r] = min(d, 1 - SPARE) if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.minimum(counts, len(d) - 1)]


def totals_of(table: DataFrame) -> tuple[int, int, list[int]]:
    """Tokens, distinct n-grams and counts of counts of one order."""
    names = ["total", "kinds", *[f"n{r}" for r in range(1, GOOD_TURING + 2)]]
    row = table.filter("chunk IS NULL").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    return row["total"], row["kinds"], [row[n] for n in names[2:]]


# evaluation


class Grades:
    """What a model knows of a chunk's n-grams, filled order by order."""

    def __init__(self, chunk: Chunk, answers: dict, totals: dict, weights: dict):
        self.chunk, self.answers, self.totals, self.weights = chunk, answers, totals, weights

    def counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Training count of each of the chunk's distinct k-grams, and whether the chunk stands for it."""
        found = np.concatenate([unpack(x).astype(np.int64) for _, x in sorted(self.answers[k])])
        return found >> 1, (found & 1).astype(bool)

    def words(self) -> np.ndarray:
        """log10 of the probability of each distinct word."""
        total, _, rising = self.totals[1]
        d = discounts(rising)
        counts = self.counts(1)[0]
        # all discounts together leave this for the unknown word
        left = sum((1 - d[r]) * r * rising[r - 1] for r in range(1, GOOD_TURING + 1))
        high = total - sum(r * rising[r - 1] for r in range(1, GOOD_TURING + 1))
        left += high * SPARE
        return np.log10(np.where(counts > 0, discounted(counts, d), max(left, 1e-300)) / max(total, 1))

    def log_probability(self, order: int) -> np.ndarray:
        """log10 P of each token given its history, by recursion."""
        chunk = self.chunk
        if order == 1:
            return self.words()[chunk.codes]
        shorter = self.log_probability(order - 1)
        _, place, _ = chunk.distinct(order)
        counts = self.counts(order)[0][place]
        before = history_counts(self, order)
        seen = counts > 0
        d = discounts(self.totals[order][2])
        out = shorter + self.backoff(order)
        out[seen] = np.log10(discounted(counts[seen], d) / before[seen])
        return out

    def backoff(self, order: int) -> np.ndarray:
        """log10 of the backoff weight of each token's history; 0 for histories not seen, or not yet known."""
        if order not in self.weights:
            return np.zeros(len(self.chunk.codes))
        keys = np.unique(self.chunk.histories(order))
        found = np.concatenate([unpack(x) for _, x in sorted(self.weights[order])])
        return found[np.searchsorted(keys, self.chunk.histories(order))]


def history_counts(grades: Grades, order: int) -> np.ndarray:
    """Training count of each token's history; every training token but the end mark goes before another."""
    chunk = grades.chunk
    if order == 2:
        counts = grades.counts(1)[0]
        texts = counts[np.searchsorted(chunk.words, END)]  # a text's start is counted as its end
        history = chunk.histories(2)
        at = np.minimum(np.searchsorted(chunk.words, history), len(chunk.words) - 1)
        return np.where(history == START, texts, counts[at])
    keys, _, _ = chunk.distinct(order - 1)
    counts = grades.counts(order - 1)[0]
    history = chunk.histories(order)
    at = np.minimum(np.searchsorted(keys, history), len(keys) - 1)
    found = np.where(keys[at] == history, counts[at], 0)
    # a history of start marks alone is no n-gram: it was there once for each training text
    starts = np.zeros(len(found), bool)
    starts[np.cumsum(chunk.lengths) - chunk.lengths] = True
    return np.where(starts, grades.counts(1)[0][np.searchsorted(chunk.words, END)], found)


_SUMS = "bucket int, chunk bigint, keys binary, left binary, lower binary"
_WEIGHTS = "chunk bigint, bucket int, keys binary, weights binary"
_ANSWER = "chunk bigint, k int, what int, bucket int, body binary"


def backoff_weights(chunks: DataFrame, answers: DataFrame, totals: dict, order: int, k: int, buckets: int) -> DataFrame:
    """Backoff weights (log10) of the histories of order k: the model's table (null chunk), and answers to chunks."""
    d = discounts(totals[k][2])

    def send(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        grades = _grades(row, told, totals, order)
        chunk = grades.chunk
        _, place, _ = chunk.distinct(k)
        total, stands = grades.counts(k)
        first = np.zeros(len(total), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        mine = first[stands]  # a token of each n-gram that this chunk stands for
        history = chunk.histories(k)
        keys, at = np.unique(history, return_inverse=True)
        shares = total[stands] - discounted(total[stands], d)
        before = history_counts(grades, k)[mine]
        left = np.bincount(at[mine], weights=shares / np.maximum(before, 1), minlength=len(keys))
        lower = np.bincount(at[mine], weights=10 ** grades.log_probability(k - 1)[mine], minlength=len(keys))
        cut = bucket_borders(keys, buckets)
        return pa.Table.from_batches([_messages([
            (b, row["chunk"], pack_sorted(keys[i:j]), pack(left[i:j]), pack(lower[i:j]))
            for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i
        ], _SUMS)])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        keys = [unpack_sorted(x) for x in rows["keys"].to_pylist()]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        left, lower = (
            np.bincount(place, weights=np.concatenate([unpack(x) for x in rows[c].to_pylist()]), minlength=len(every))
            for c in ("left", "lower")
        )
        seen = left > 0
        weight = np.where(seen, np.log10(np.where(seen, left, 1) / np.maximum(1 - lower, 1e-12)), 0.0)
        bucket = key[0].as_py()
        out = [(None, bucket, pack_sorted(every[seen]), pack(weight[seen]))]
        ends = np.cumsum([len(x) for x in keys])
        out += [
            (c, bucket, None, pack(weight[place[e - len(x) : e]]))
            for c, x, e in zip(rows["chunk"].to_pylist(), keys, ends, strict=True)
        ]
        return pa.Table.from_batches([_messages(out, _WEIGHTS)])

    sent = _beside(chunks, answers, send, _SUMS)
    return stored(sent.groupBy("bucket").applyInArrow(add, _WEIGHTS), f"language-model-{k}-weights")


def _grades(row: dict, told: pa.Table, totals: dict, order: int) -> Grades:
    found: dict = {0: {}, 1: {}}
    for r in told.to_pylist():
        found[r["what"]].setdefault(r["k"], []).append((r["bucket"], r["body"]))
    return Grades(Chunk(row, order), found[0], totals, found[1])


def _beside(chunks: DataFrame, answers: DataFrame, fn, shape: str) -> DataFrame:
    """``fn`` for each chunk and the answers to it."""
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(fn, shape)


def _told(table: DataFrame, k: int, what: int, body: str) -> DataFrame:
    return table.filter("chunk IS NOT NULL").select(
        "chunk", F.lit(k).alias("k"), F.lit(what).alias("what"), "bucket", F.col(body).alias("body")
    )


def scores(docs: DataFrame, train: Column, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of (doc_id, text): tokens and scores under the model of the rows where ``train`` holds.

    Columns: doc_id, n_tokens, n_known, train_tokens, base_score (add-one single
    words) and score, both log10.
    """
    chunks = chunked(docs, train, chunk_bytes)
    size = chunks.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    few, many = (max(1, -(-(size[c] or 0) // BUCKET_ENTRIES)) for c in ("words", "tokens"))
    tables, totals, answers = {}, {}, None
    for k in range(1, order + 1):
        tables[k] = count_ngrams(chunks, order, k, few if k == 1 else many)
        totals[k] = totals_of(tables[k])
        more = _told(tables[k], k, 0, "counts")
        answers = more if answers is None else answers.unionByName(more)
        if k > 1:
            weights = backoff_weights(chunks, answers, totals, order, k, few if k == 2 else many)
            answers = answers.unionByName(_told(weights, k, 1, "weights"))
    kind = dict(docs.dtypes)["doc_id"]
    shape = f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def grade(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        ids = rows["doc_ids"].combine_chunks().flatten()
        grades = _grades(row, told, totals, order)
        chunk, n = grades.chunk, len(ids)
        total, distinct, _ = totals[1]
        counts = grades.counts(1)[0][chunk.codes]
        base = np.log10((counts + 1) / (total + distinct + 1))
        token = grades.log_probability(order) if total else np.zeros(len(counts))

        def by_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(chunk.owner, weights=values, minlength=n)

        return pa.table([
            ids, pa.array(chunk.lengths), pa.array(by_text(counts > 0).astype(np.int64)), pa.array(np.full(n, total)),
            pa.array(by_text(base)), pa.array(by_text(token)),
        ], names=[c.split(" ")[0] for c in shape.split(", ")])

    return _beside(chunks.select("chunk", "doc_ids", "train", "lengths", "codes", "words"), answers, grade, shape)
