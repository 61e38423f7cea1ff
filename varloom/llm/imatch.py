"""I-Match fingerprints: hashes of a document's terms within randomised lexicons.

The lexicon holds the terms whose share of the documents lies in a band (and that are in
two at least): between ``least_common`` and ``most_common``, which is a band of inverse
document frequency.  The edges are shares, so they mean the same for any corpus, and
they bound the lexicon: if texts have d distinct words on average, at most
d / ``least_common`` terms can be that common, however many texts there are.  So it may
be broadcast.

``subsets`` families of randomised sub-lexicons are drawn from it; in each, level l
keeps a term with chance 2**-l.  A text uses the two levels at which about one of
its terms, and about half of one, is kept: so a long and a short text both have
hashes that survive an edit about as often as their terms do.  Each hash is over
the sorted distinct terms that are kept.  The likeness of two fingerprints is the
share of equal hashes among those levels that both use, without the sub-lexicons
of which neither text has a term; 0 if they share no level.

A text without terms of the lexicon has the hash of all its terms as fingerprint,
which is like an equal one only.  Nulls count as empty text.  Equal texts have
equal fingerprints.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.llm.common import scratch, slices, stored, texts_of, words_of

SUBSETS = 32
LEAST_COMMON, MOST_COMMON = 1e-4, 0.05
#: Hexadecimal digits of one hash; all zero where no term is kept.
WIDTH = 6


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all texts, summed within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in slices(batches, "text", 8 << 20):
            words, counts = words_of(texts_of(batch.column("text")))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(counts)), counts)
            once = np.unique(owner * len(coded.dictionary) + codes) % len(coded.dictionary)
            held.append(pa.table({"term": coded.dictionary.cast(pa.string()), "df": np.bincount(once)}))
            size += len(coded.dictionary)
            if size > 1 << 20:
                yield from _summed(held)
                held, size = [], 0
        if held:
            yield from _summed(held)

    return docs.select("text").mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _summed(tables: list[pa.Table]) -> list[pa.RecordBatch]:
    total = pa.concat_tables(tables).group_by("term").aggregate([("df", "sum")])
    return pa.table({"term": total["term"], "df": total["df_sum"]}).to_batches(max_chunksize=50_000)


def lexicon(docs: DataFrame, least_common: float = LEAST_COMMON, most_common: float = MOST_COMMON) -> pa.Array:
    """The sorted terms of the band, as shares of all documents."""
    n = docs.count()
    least, most = max(2, math.ceil(least_common * n)), max(2, int(most_common * n))
    with scratch(docs.sparkSession) as put:
        band = put(document_frequencies(docs).filter(F.col("df").between(least, most)).select("term"), "band")
        return pa.array(sorted(band.toArrow().column("term").to_pylist()), pa.large_string())


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Matcher:
    """Fingerprints by one lexicon, for one worker."""

    def __init__(self, terms: pa.Array, subsets: int = SUBSETS):
        self.terms, self.subsets = terms, subsets
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(t) for t in terms.to_pylist()), np.uint64, len(terms))
        # the deepest level at which each family of sub-lexicons keeps a term
        self.depth = np.zeros((len(terms), subsets), dtype=np.uint8)
        for j in range(subsets):
            drawn = _mixed(self.hashes + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
            low = drawn & (~drawn + np.uint64(1))
            self.depth[:, j] = np.where(drawn == 0, 64, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.uint8)

    def hashes_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Levels (-1: no term of the lexicon) and hashes (texts x 2 x subsets; 0: nothing kept)."""
        n = len(texts)
        words, counts = words_of(texts)
        level = np.full(n, -1)
        out = np.zeros((n, 2, self.subsets), dtype=np.uint64)
        if not len(words) or not len(self.terms):
            return level, out
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary.cast(pa.large_string()), value_set=self.terms)
        known = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        ids = known[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(n), counts)[ids >= 0]
        once = np.unique(owner * len(self.terms) + ids[ids >= 0])
        owner, ids = np.divmod(once, len(self.terms))
        sizes = np.bincount(owner, minlength=n)
        level[sizes > 0] = np.ceil(np.log2(sizes[sizes > 0])).astype(int)
        for k in (0, 1):
            row, family = np.nonzero(self.depth[ids] >= (level[owner] + k)[:, None])
            # by text, then family; within these the terms stay sorted
            order = np.lexsort((row, family, owner[row]))
            row, family = row[order], family[order]
            group = owner[row] * self.subsets + family
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
            if len(start):
                place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
                parts = _mixed(self.hashes[ids[row]] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                total = np.add.reduceat(parts, start)
                out[owner[row][start], k, family[start]] = _mixed(total) >> np.uint64(64 - 4 * WIDTH) | np.uint64(1)
        return level, out

    def fingerprints(self, texts: pa.Array) -> list[tuple[int, np.ndarray, str]]:
        """(level, hashes, spelling) of each text."""
        level, hashes = self.hashes_of(texts)
        out = []
        for i, (l, h) in enumerate(zip(level.tolist(), hashes, strict=True)):
            if l < 0:
                words, _ = words_of(texts.slice(i, 1))
                name = hashlib.sha256(" ".join(sorted(set(words.to_pylist()))).encode()).hexdigest()[:32]
                out.append((-1, h, f"--{name}"))
            else:
                out.append((l, h, f"{l:02x}" + "".join([f"{x:0{WIDTH}x}" for x in h.ravel().tolist()])))
        return out


def likeness(a: tuple[int, np.ndarray, str], b: tuple[int, np.ndarray, str]) -> float:
    if a[2] == b[2]:
        return 1.0
    if a[0] < 0 or b[0] < 0 or abs(a[0] - b[0]) > 1:
        return 0.0
    first, last = max(a[0], b[0]), min(a[0], b[0]) + 1
    x, y = a[1][first - a[0] : last - a[0] + 1], b[1][first - b[0] : last - b[0] + 1]
    some = (x > 0) | (y > 0)
    return float(((x == y) & some).sum() / some.sum()) if some.any() else 0.0


#: The matcher of this worker process, kept between tasks.
_own: dict[str, Matcher] = {}

_FOUND = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _compared(own: Matcher, texts: list[str], following: list[str], prints: list, next_prints: list) -> list[list]:
    """Columns of ``_FOUND`` for texts whose next texts and fingerprints are given."""
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]
    changed = own.fingerprints(pa.array(edited, pa.large_string()))
    return [
        [len(t) for t in texts],
        [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        [p[2] for p in prints],
        [c[2] for c in changed],
        [likeness(p, c) for p, c in zip(prints, changed, strict=True)],
        [likeness(p, f) for p, f in zip(prints, next_prints, strict=True)],
    ]


def edited_likeness(docs: DataFrame, terms: pa.Array, subsets: int = SUBSETS) -> DataFrame:
    """Per row of (doc_id, text): its fingerprint beside those of its edited text and of the next text.

    The next text is that of the next row by doc_id, then text, nulls first; after the
    last comes the first.  The edited text ends with the beginning of the next one
    instead of its own last quarter.  Texts are shuffled once, into ranges of
    doc_id; a row meets the next one while its range streams by.  Only the last row of
    each range waits for the first of the following one.
    """
    spark = docs.sparkSession
    name = hashlib.sha256("\0".join(terms.to_pylist()).encode()).hexdigest() + f"/{subsets}"
    shared = spark.sparkContext.broadcast(terms)  # bounded by the band, see above

    def matcher() -> Matcher:
        if name not in _own:
            _own.clear()
            _own[name] = Matcher(shared.value, subsets)
        return _own[name]

    kind = dict(docs.dtypes)["doc_id"]
    # the head of the text lets a range end between rows of one id
    placed = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    placed = placed.withColumn("part", F.spark_partition_id())
    shape = f"doc_id {kind}, {_FOUND}, part int, is_last boolean, first_text string, last_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher()
        held = None  # the row that waits for its next one
        seen = False

        def rows(ids: pa.Array, columns: list, part: int, last: bool, firsts: list, lasts: list) -> pa.RecordBatch:
            kinds = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], pa.array([part] * n, pa.int32()),
                 pa.array([last] * n), pa.array(firsts, pa.string()), pa.array(lasts, pa.string())],
                names=[c.split(" ")[0] for c in shape.split(", ")],
            )

        for batch in slices(batches, "text", 4 << 20):
            texts = texts_of(batch.column("text"))
            prints, spelt = own.fingerprints(texts), texts.to_pylist()
            ids, part = batch.column("doc_id"), batch.column("part")[0].as_py()
            if held:
                ids = pa.concat_arrays([held[0], ids])
                prints, spelt = [held[1], *prints], [held[2], *spelt]
            n = len(spelt) - 1
            if n:
                columns = _compared(own, spelt[:-1], spelt[1:], prints[:-1], prints[1:])
                yield rows(ids.slice(0, n), columns, part, False, [None if seen else spelt[0], *[None] * (n - 1)], [None] * n)
                seen = True
            held = (ids.slice(n, 1), prints[n], spelt[n], part)
        if held:
            nothing = [[None]] * 6
            yield rows(held[0], nothing, held[3], True, [None if seen else held[2]], [held[2]])

    found = stored(placed.mapInArrow(run, shape), "likeness-by-range")
    # one row per range of doc_id
    lasts = found.filter("is_last").select("part", "doc_id", "last_text")
    firsts = found.filter("first_text IS NOT NULL").select("part", "first_text")
    by_part = Window.orderBy("part")
    start = F.min("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = lasts.select("part", F.coalesce(F.lead("part").over(by_part), start).alias("following"))
    open_rows = lasts.join(ranges, "part").join(firsts.withColumnRenamed("part", "following"), "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher()
        for batch in slices(batches, "last_text", 4 << 20):
            texts, following = texts_of(batch.column("last_text")), texts_of(batch.column("first_text"))
            columns = _compared(
                own, texts.to_pylist(), following.to_pylist(), own.fingerprints(texts), own.fingerprints(following)
            )
            kinds = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", *[c.split(" ")[0] for c in _FOUND.split(", ")]],
            )

    closed = open_rows.select("doc_id", "last_text", "first_text").mapInArrow(close, f"doc_id {kind}, {_FOUND}")
    return found.filter("NOT is_last").select(closed.columns).unionByName(closed)
