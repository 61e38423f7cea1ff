"""Near duplicates with a Jaccard similarity of 0.8 or more on five-word shingles.

A text is lower-cased (A-Z), cut into words at ASCII white space, and stands for the
set of its runs of five words, as 64-bit hashes; a text of fewer words has one run, a
text without words the empty set.  Texts of equal sets are one class (``fp``, a hash
of the set).

Candidates come from two searches.  SimHash fingerprints of the five-word runs are linked
within two bits by the pigeonhole search of ``simhash``.  Pairs of similarity 0.8 differ
in about ten of its 64 bits, more than any such search can reach, so classes also share
buckets where ``ROWS`` MinHash values agree: one of ``BANDS`` buckets does with a chance
of 0.99 at a similarity of 0.8, and nearly always above.

In a bucket each class is compared with one centre, the first class in the order of a
hash, which is another order in each band; those that are not similar to it are compared
with the second class of the bucket, and so on for up to ``ROUNDS`` centres, so the work
of a bucket is linear in its size.  Every link is verified on the whole sets, and groups
are the components of the links.  Of the classes that met in no round, all pairs of a
bucket whose sizes allow a link are compared then, unless a chain of links joins them
already: no link of a bucket is lost, and a group of near copies is not expanded.

Texts are shuffled once, after one row of each class and task was chosen; otherwise only
hashes are, and the sets of classes that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from varloom.llm import simhash
from varloom.llm.common import scratch, slices, stored, texts_of, words_of
from varloom.llm.components import connected_components, one_per_class

SHINGLE = 5
BANDS, ROWS, ROUNDS = 12, 5, 6
#: Classes of a bucket that meet the bucket in one task, where all pairs are compared.
SLICE = 256
#: Bytes of text that a task looks at together; its arrays take many times as much.
PIECE = 512 << 10
#: Name of the column with the class, which no document has.
MARK = "__varloom_class"


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within a text, and the number per text."""
    words, counts = words_of(texts)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    coded = words.dictionary_encode()
    known = np.fromiter(
        (xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()),
        dtype=np.uint64, count=len(coded.dictionary),
    )
    codes = known[coded.indices.to_numpy(zero_copy_only=False)]
    per_text = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), per_text)
    begin = (np.cumsum(counts) - counts)[owner] + np.arange(len(owner)) - (np.cumsum(per_text) - per_text)[owner]
    end = np.cumsum(counts)[owner]
    hashes = np.zeros(len(owner), dtype=np.uint64)
    for k in range(shingle):
        there = begin + k < end
        word = np.where(there, codes[np.minimum(begin + k, len(codes) - 1)], np.uint64(0))
        hashes = _mixed(hashes ^ word) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
    hashes = _mixed(hashes)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(texts))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def set_hashes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set, signed."""
    data, ends = hashes.tobytes(), (np.cumsum(sizes) * 8).tolist()
    found = (xxhash.xxh64_intdigest(data[s:e], 42) for s, e in zip([0, *ends[:-1]], ends, strict=True))
    return np.fromiter(found, dtype=np.uint64, count=len(ends)).view(np.int64)


def band_keys(hashes: np.ndarray, sizes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets x bands) keys that agree where ``rows`` MinHash values do; of no use for an empty set."""
    keys = np.zeros((len(sizes), bands), dtype=np.uint64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return keys.view(np.int64)
    starts = (np.cumsum(sizes) - sizes)[filled]
    draw = np.random.default_rng(1).integers(0, 1 << 63, size=(bands * rows, 2), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(filled), band, dtype=np.uint64)
        for a, b in draw[band * rows : (band + 1) * rows]:
            least = np.minimum.reduceat((hashes * (a | np.uint64(1)) + b) >> np.uint64(16), starts)
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ least)
        keys[filled, band] = key
    return keys.view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """(fp, doc_id, sim, bands) of each row: class, SimHash fingerprint, band keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            texts = texts_of(batch.column("text"))
            hashes, sizes = shingle_sets(texts)
            sim = simhash.text_fingerprints(texts, SHINGLE).view(np.int64)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(hashes, sizes).ravel()), BANDS).cast(pa.list_(pa.int64()))
            keys = pc.if_else(pa.array(sizes > 0), keys, pa.scalar(None, keys.type))
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_hashes(hashes, sizes)), batch.column("doc_id"), pa.array(sim), keys], names=["fp", "doc_id", "sim", "bands"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"fp bigint, doc_id {kind}, sim bigint, bands array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    """(fp, codes): the set of each row, as its ascending hashes in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            hashes, sizes = shingle_sets(texts_of(batch.column("text")))
            data, ends = hashes.tobytes(), (np.cumsum(sizes) * 8).tolist()
            codes = pa.array([data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(hashes, sizes)), codes], names=["fp", "codes"])

    return docs.select("text").mapInArrow(run, "fp bigint, codes binary")


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` after a column with the class of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            fp = set_hashes(*shingle_sets(texts_of(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(fp), *batch.columns], names=[MARK, *batch.schema.names])

    return docs.mapInArrow(run, StructType([StructField(MARK, LongType()), *docs.schema.fields]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(name).to_pylist() for name in ("x", "y"))
            yes = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    first = pairs.join(sets.select(F.col("fp").alias("a"), F.col("codes").alias("x")), "a")
    both = first.join(sets.select(F.col("fp").alias("b"), F.col("codes").alias("y")), "b")
    # sizes far apart need no look at the sets
    x, y = F.octet_length("x"), F.octet_length("y")
    both = both.filter(F.least(x, y) * 5 >= F.greatest(x, y) * 4)
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _pairs_apart(members: DataFrame, sets: DataFrame, parts: DataFrame, tried: DataFrame) -> DataFrame:
    """(a, b): the pairs of a bucket that no chain of links joins, were not compared and have sizes that allow it.

    A bucket is dealt in slices of about ``SLICE`` classes, each of which meets the bucket in a task of its own.
    """
    sizes = sets.select("fp", F.octet_length("codes").alias("size"))
    known = members.select("band", "key", "fp").join(sizes, "fp").join(parts, "fp", "left")
    known = known.withColumn("part", F.coalesce("component", "fp")).drop("component")
    mixed = known.groupBy("band", "key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.filter("low <> high").select("band", "key", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    rest = known.join(mixed, ["band", "key"])
    own = F.pmod(F.xxhash64("fp"), "slices").cast("int").alias("slice")
    first = rest.select("band", "key", own, F.col("fp").alias("a"), F.col("part").alias("pa"), F.col("size").alias("x"))
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    second = rest.select("band", "key", every, F.col("fp").alias("b"), F.col("part").alias("pb"), F.col("size").alias("y"))
    met = first.join(second, ["band", "key", "slice"]).filter("a < b AND pa <> pb AND least(x, y) * 5 >= greatest(x, y) * 4")
    return met.select("a", "b").distinct().join(tried.distinct(), ["a", "b"], "left_anti")


def kept_classes(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(fp): of each group of near duplicates among ``docs`` the class of the smallest doc_id (null last, then fp)."""
    spark = docs.sparkSession
    with scratch(spark) as put:
        head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
        classes = put(
            _sketches(docs).groupBy("fp").agg(F.min(head).alias("head"), F.min("sim").alias("sim"), F.first("bands").alias("bands")), "classes"
        )
        # the sets of one fingerprint are a bucket too, those of linked fingerprints are compared through their smallest
        by_sim = classes.filter("bands IS NOT NULL").groupBy("sim").agg(F.min("fp").alias("fp"))
        near = simhash.links(put(by_sim.select(F.col("sim").alias("fp")), "fingerprints"))
        near = near.join(by_sim.select(F.col("sim").alias("a"), F.col("fp").alias("x")), "a")
        near = near.join(by_sim.select(F.col("sim").alias("b"), F.col("fp").alias("y")), "b")
        near = put(near.select(F.col("x").alias("a"), F.col("y").alias("b")), "near-fingerprints")
        places = classes.select("fp", F.posexplode(F.concat("bands", F.array("sim"))).alias("band", "key"))
        shared = places.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "key")
        turn = F.xxhash64("fp", "band").alias("turn")
        members = put(places.join(put(shared, "shared-buckets"), ["band", "key"]).select("band", "key", turn, "fp"), "buckets")
        nodes = members.select("fp").unionByName(near.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
        sets = _sets(docs).join(put(nodes, "compared"), "fp", "left_semi").groupBy("fp").agg(F.first("codes").alias("codes"))
        sets = put(sets, "sets")
        links = put(_verified(near, sets), "links")
        waiting, centres, tried = members, None, near
        for turns in range(rounds):
            rest = members
            if centres is not None:
                # only buckets where classes wait, and there what comes after the last centre
                last = waiting.select("band", "key").distinct().join(centres, ["band", "key"]).withColumnRenamed("turn", "after")
                rest = members.join(put(last.drop("centre"), "last-centres"), ["band", "key"]).filter("turn > after")
            best = rest.groupBy("band", "key").agg(F.min(F.struct("turn", "fp")).alias("best"))
            centres = put(best.select("band", "key", "best.turn", F.col("best.fp").alias("centre")), "centres")
            met = put(waiting.select("band", "key", "fp").join(centres.drop("turn"), ["band", "key"]), "met")
            pairs = met.filter("fp <> centre").select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
            pairs = put(pairs.distinct(), "pairs")
            if pairs.isEmpty():
                break
            found = put(_verified(pairs, sets), "links")
            links, tried = links.unionByName(found), tried.unionByName(pairs)
            same = (F.least("fp", "centre") == F.col("a")) & (F.greatest("fp", "centre") == F.col("b"))
            apart = met.join(found, same, "left_anti")
            # every class has met the first centre, which need not wait for others
            waiting = put((apart if turns else apart.filter("fp <> centre")).select("band", "key", "fp"), "waiting")
        # what met in no round: all pairs of a bucket whose classes no chain of links has joined
        parts = put(connected_components(links), "components").withColumnRenamed("node", "fp")
        apart = put(_pairs_apart(members, sets, parts, tried), "pairs-apart")
        if not apart.isEmpty():
            links = links.unionByName(put(_verified(apart, sets), "links"))
            parts = put(connected_components(links), "components").withColumnRenamed("node", "fp")
        grouped = classes.select("fp", "head").join(parts, "fp")
        first = grouped.groupBy("component").agg(F.min(F.struct("head", "fp")).alias("first")).select("first.fp")
        alone = classes.select("fp").join(parts.select("fp"), "fp", "left_anti")
        return stored(alone.unionByName(first), "kept-classes")


def one_of_each(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group one with the smallest doc_id.

    A null doc_id is larger than any other.  Among rows of one class and id the smallest
    text stays (null first), once; groups that share an id do not count as one.  Columns
    keep their order, whatever their names.
    """
    kept = kept_classes(docs, rounds)
    rows = one_per_class(_marked(docs), MARK).join(kept, "fp", "left_semi")
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])
