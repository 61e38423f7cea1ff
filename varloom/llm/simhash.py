"""Near duplicates by SimHash fingerprints and generalised pigeonhole search.

Fingerprint: a text is lower-cased (A-Z) and cut into words at ASCII white space;
the XXH64 (seed 42) of each run of three words votes on 64 bits, and a bit is set
where more than half the votes are for it.  Texts of fewer words have one run;
texts without words (null, empty, only white space) have fingerprint zero.

Search: fingerprints within ``radius`` bits are linked.  The 64 bits are dealt to
``parts`` groups, correlated bits together.  By the generalised pigeonhole
principle, if the thresholds of the groups sum to ``radius - parts + 1``, any two
fingerprints within ``radius`` bits differ by at most the threshold in one group.
Each fingerprint chooses its own thresholds (-1 leaves a group out) by dynamic
programming on the number of candidates they would bring, probes the chosen
groups, and verifies what it finds.

Buckets that hold more than ``crowded`` fingerprints are not probed by pairs.
Everything that is in or probes such a bucket is linked through the fingerprints
one bit away: two fingerprints within 2 bits share at least one of these, so tying
each to the smallest one around a shared centre gives the same components with 65
rows per fingerprint.  So the work is linear in the number of distinct
fingerprints, and no link is lost.

Equal texts meet in one fingerprint before the search.  Rows with equal doc_id,
repeated rows included, all keep their place; a null doc_id takes part and counts
as larger than any other.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import saved, slices, texts_of, words_of
from varloom.llm.components import connected_components

BITS = 64
PARTS = 3
CROWDED = 64
SHINGLE = 3


def text_fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Fingerprints of an array of texts as unsigned 64-bit integers."""
    words, counts = words_of(texts)
    out = np.zeros(len(texts), dtype=np.uint64)
    if not len(words):
        return out
    # words with single spaces between, so that a shingle is one slice of the bytes
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    data = b" ".join(words.cast(pa.large_binary()).to_pylist())
    per_text = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first_word = np.cumsum(counts) - counts
    first_run = np.cumsum(per_text) - per_text
    owner = np.repeat(np.arange(len(texts)), per_text)
    begin = first_word[owner] + np.arange(len(owner)) - first_run[owner]
    last = np.minimum(begin + shingle, (first_word + counts)[owner]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[s:e], seed) for s, e in zip(starts[begin].tolist(), ends[last].tolist(), strict=True)),
        dtype=np.uint64, count=len(owner),
    )
    filled = np.flatnonzero(per_text)
    at = 0
    while at < len(filled):  # some texts at a time, as the votes take 64 bytes a run
        base = first_run[filled[at]]
        stop = max(at + 1, int(np.searchsorted(first_run[filled] + per_text[filled], base + (1 << 14), side="right")))
        rows = filled[at:stop]
        part = hashes[base : first_run[rows[-1]] + per_text[rows[-1]]]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, first_run[rows] - base, axis=0, dtype=np.int64)
        chosen = (votes * 2 > per_text[rows, None]).astype(np.uint8)
        out[rows] = np.packbits(chosen, axis=1, bitorder="little").reshape(-1).view(np.uint64)
        at = stop
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of ``docs``; fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            fp = text_fingerprints(texts_of(batch.column("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(distinct: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """The 64 bits dealt to ``parts`` groups of nearly equal size, correlated bits together.

    Co-occurrence is counted over all distinct fingerprints, as 64 x 64 sums per
    task.  Each group grows from the free bit that correlates most with others by
    the bit most correlated with what it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            bits = _bit_matrix(np.ascontiguousarray(batch.column("fp").to_numpy())).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            i, j = np.divmod(np.arange(BITS * BITS), BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i), pa.array(j), pa.array(total.astype(np.int64).ravel()), pa.array(np.full(BITS * BITS, n))],
                names=["i", "j", "together", "n"],
            )

    sums = (
        distinct.select("fp").mapInArrow(run, "i bigint, j bigint, together bigint, n bigint")
        .groupBy("i", "j").agg(F.sum("together").alias("together"), F.sum("n").alias("n")).collect()  # 64 x 64 rows
    )
    together, n = np.zeros((BITS, BITS)), 1
    for r in sums:
        together[r["i"], r["j"]], n = r["together"], r["n"]
    p = np.diag(together) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((together / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        own = [max(free, key=lambda b: (related[b, list(free)].sum(), -b))]
        free.discard(own[0])
        while len(own) < size:
            best = max(free, key=lambda b: (related[b, own].sum(), -b))
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def _masks(groups: list[list[int]]) -> list[int]:
    """Bit masks of the groups as signed 64-bit integers."""
    return [int(np.array(sum(1 << b for b in g), dtype=np.uint64).astype(np.int64)) for g in groups]


def _balls(group: list[int], radius: int) -> list[int]:
    """What to flip to reach every value within ``radius`` bits inside a group."""
    flips = [sum(1 << b for b in c) for d in range(radius + 1) for c in combinations(group, d)]
    return [int(np.array(f, dtype=np.uint64).astype(np.int64)) for f in flips]


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds (rows x parts) that sum to ``total`` with the least cost, by dynamic programming.

    ``costs[row, part, t + 1]`` estimates the candidates of a part at threshold t,
    from -1 (not probed) on.
    """
    rows, parts, levels = costs.shape
    low, high = -parts, levels - 2
    best = np.full((rows, parts + 1, high * parts + parts + 1), np.inf)
    choice = np.zeros((rows, parts + 1, best.shape[2]), dtype=np.int8)
    best[:, 0, -low] = 0
    for part in range(parts):
        for t in range(-1, high + 1):
            for s in range(best.shape[2]):
                if 0 <= s + t < best.shape[2]:
                    new = best[:, part, s] + costs[:, part, t + 1]
                    better = new < best[:, part + 1, s + t]
                    best[:, part + 1, s + t] = np.where(better, new, best[:, part + 1, s + t])
                    choice[:, part + 1, s + t] = np.where(better, t, choice[:, part + 1, s + t])
    out = np.zeros((rows, parts), dtype=np.int64)
    at = np.full(rows, total - low)
    for part in range(parts, 0, -1):
        out[:, part - 1] = choice[np.arange(rows), part, at]
        at = at - out[:, part - 1]
    return out


def links(distinct: DataFrame, radius: int = 2, parts: int = PARTS, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (``distinct``: fp, no repeats) within ``radius`` bits.

    Verified pairs, but around crowded buckets each fingerprint is tied to the
    smallest one with a common centre; components are those of all pairs.
    """
    if radius != 2:
        raise ValueError("crowded buckets are exact for a radius of 2 bits")
    groups = bit_groups(distinct, parts)
    masks = _masks(groups)
    keys = F.explode(F.array(*[
        F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)
    ])).alias("k")
    index = distinct.select("fp", keys).select("fp", "k.part", "k.key")
    sizes = saved(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size")))
    # what a value one or two bits off holds on average, over all values of a part
    total = distinct.count()
    elsewhere = [total / 2.0 ** len(g) for g in groups]
    own_sizes = index.join(sizes, ["part", "key"]).groupBy("fp").agg(
        *[F.max(F.when(F.col("part") == k, F.col("size"))).alias(f"s{k}") for k in range(parts)]
    )
    levels = radius + 2
    flips = [[_balls(g, t) if t >= 0 else [] for t in range(-1, radius + 1)] for g in groups]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            costs = np.zeros((len(fp), parts, levels))
            for k in range(parts):
                found = batch.column(f"s{k}").to_numpy().astype(float)
                for t in range(radius + 1):
                    more = len(flips[k][t + 1]) - 1
                    # a probe costs about as much as a candidate; the own bucket is counted, others are a mean
                    costs[:, k, t + 1] = 1 + more + found + more * elsewhere[k]
            chosen = allocate(costs, radius - parts + 1)
            out_fp, out_part, out_key = [], [], []
            for k in range(parts):
                for t in range(radius + 1):
                    rows = fp[chosen[:, k] == t]
                    if len(rows):
                        reach = np.array(flips[k][t + 1], dtype=np.int64)
                        out_fp.append(np.repeat(rows, len(reach)))
                        out_key.append(((rows & masks[k])[:, None] ^ reach[None, :]).ravel())
                        out_part.append(np.full(len(rows) * len(reach), k, dtype=np.int32))
            if out_fp:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (out_fp, out_part, out_key)], names=["fp", "part", "key"]
                )

    probes = own_sizes.mapInArrow(probe, "fp bigint, part int, key bigint")
    met = saved(probes.join(sizes, ["part", "key"]))
    few, many = met.filter(F.col("size") <= crowded), met.filter(F.col("size") > crowded)
    pairs = (
        few.select(F.col("fp").alias("a"), "part", "key")
        .join(index.select(F.col("fp").alias("b"), "part", "key"), ["part", "key"])
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
    )
    full = many.select("part", "key").distinct()
    around = many.select("fp").unionByName(index.join(full, ["part", "key"]).select("fp")).distinct()
    centres = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in _balls(list(range(BITS)), 1)]))
    tied = around.select("fp", centres.alias("centre"))
    least = tied.groupBy("centre").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b <> top")
    through = tied.join(least, "centre").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(through).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, parts: int = PARTS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the smallest doc_id reachable over links."""
    marked = saved(fingerprints(docs))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = saved(classes)
    parts_of = connected_components(links(classes.select("fp"), radius, parts, crowded))
    named = classes.join(parts_of.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "first")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    moved = named.join(least, "component").select("fp", "least")
    ids = classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")
