"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words.  A document of the source is wanted
``target / source size`` times: the whole part of that for certain, the fraction by
chance.  The fractions are rounded in pairs: words are moved at random from one
document of a pair to the other until one of them is whole, such that each keeps
its expected number of copies and the words of the pair stay what they were.  What
is left of a bucket, one document, meets the rest of other buckets of its source a
level higher, and so on up a tree.  The last document of a source is rounded by
chance, and what that costs is made up for by swaps of shorter ones in the same task;
so a source misses its target by less than one document, mostly by a few words.

Rows of one source, id and size are interchangeable: they are one counted row of the
tree, and its copies are dealt out evenly at the end.  So buckets hold ``bucket_rows``
counted rows on average, however often a row is repeated or an id is missing.  Pairs are
formed in order of falling size and chance comes from a seed and the bucket's place, so
reruns agree on any cluster.  A null source is a source of its own, a
null text has size 0.  Documents of size 0 are taken as often as the whole part
says.  Repeated rows are documents of their own.  Extra columns are ignored by
``copies`` and kept by ``mixed``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import WORD, saved
from varloom.operators.ordering import with_row_index

BUCKET_ROWS = 8192
FAN_IN = 64


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, rows, target): ``share`` of all words by weight, at most ``cap`` times a source.

    Sources in the order of their code points, null last, take the weights in turn.
    What a capped source leaves goes to the others by weight, until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    placed = with_row_index(totals, [F.col("source").asc_nulls_last()], "__place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = saved(placed.withColumn("__weight", F.get(turn, F.col("__place") % len(weights))).drop("__place"))
    most = F.col("source_size") * cap
    level, capped = 0.0, -1
    while True:
        full = F.col("__weight") * level >= most if capped >= 0 else F.lit(False)
        state = placed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, most)).alias("fixed"),
            F.sum(F.when(~full, F.col("__weight"))).alias("free"), F.count(F.when(full, 1)).alias("n"),
        ).first()
        if state["n"] == capped or not state["free"]:
            break
        capped = state["n"]
        level = (share * state["all"] - (state["fixed"] or 0.0)) / state["free"]
    target = F.least(most, F.col("__weight") * F.lit(level)) if state["free"] else most
    return placed.select("source", "source_size", "rows", target.cast("double").alias("target"))


def pair_up(sizes: np.ndarray, wanted: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fractions rounded in pairs; at most one is left in between."""
    out = wanted.astype(float).copy()
    draws = rng.random(len(out))
    held = -1
    for i, (b, q) in enumerate(zip(sizes.tolist(), wanted.tolist(), strict=True)):
        if held < 0:
            held, a, p = i, b, q
            continue
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        if draws[i] * (up + down) < down:  # towards the held one
            p, q = (1.0, q - up / b) if up == (1 - p) * a else (p + up / a, 0.0)
        else:
            p, q = (0.0, q + down / b) if down == p * a else (p - down / a, 1.0)
        out[held], out[i] = p, q
        if 0 < q < 1:
            held, a, p = i, b, q
        elif not 0 < p < 1:
            held = -1
    return out


def evened(sizes: np.ndarray, out: np.ndarray, excess: float) -> np.ndarray:
    """``out`` after swaps, the largest that fit first, that make up for what rounding the last document cost.

    One document that is long beside all others of its source may be the last; the
    others then give up, or take, about its error.
    """
    out = out.copy()
    for i, size in enumerate(sizes.tolist()):
        if size <= excess and out[i] == 1:
            out[i], excess = 0.0, excess - size
        elif size <= -excess and out[i] == 0:
            out[i], excess = 1.0, excess + size
    return out


def _level(seed: int, last: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        source, bucket, level = (k.as_py() for k in key)
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("__wanted", "ascending")])
        name = f"{seed}/{level}/{bucket}/{source!r}".encode()
        rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little"))
        out = pair_up(rows["size"].to_numpy(), rows["__wanted"].to_numpy(), rng)
        if last:
            sizes = rows["size"].to_numpy()
            settled = np.where((out > 0) & (out < 1), rng.random(len(out)) < out, out).astype(float)
            out = evened(sizes, settled, float(sizes @ (settled - out)))
        return rows.set_column(rows.schema.get_field_index("__wanted"), "__wanted", pa.array(out))

    return run


def counted_copies(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    seed: int = 1, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rows, copies) for each kind of row of ``sizes`` (doc_id, source, size).

    ``rows`` says how many rows are of the kind, ``copies`` how often they are taken together.
    """
    kinds = saved(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    targets = saved(source_targets(sizes, weights, share, cap))
    largest = kinds.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    total = rate * F.col("n")
    whole = F.when(F.col("size") > 0, F.floor(total)).otherwise(F.floor(rate) * F.col("n")).cast("bigint")
    spread = F.greatest(F.ceil(F.col("rows") / bucket_rows), F.lit(1))
    # a hot source is one side of this join; its partition is split by adaptive execution
    rows = kinds.withColumnRenamed("rows", "n").alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.doc_id", "d.source", "d.size", "source_size", "target", "n",
        whole.alias("__whole"), (total - F.floor(total)).alias("__wanted"),
        F.pmod(F.xxhash64("doc_id", "size"), spread).alias("__bucket"), F.lit(0).alias("__level"),
    )
    open_ = (F.col("__wanted") > 0) & (F.col("__wanted") < 1) & (F.col("size") > 0)
    settled, waiting = [rows.filter(~open_).withColumn("__wanted", F.lit(0.0))], rows.filter(open_)
    buckets, level = max(1, -(-targets.agg(F.max("rows")).first()[0] // bucket_rows) if largest else 1), 0
    while True:
        last = buckets == 1
        done = saved(waiting.groupBy("source", "__bucket", "__level").applyInArrow(_level(seed, last), waiting.schema))
        settled.append(done.filter(~open_))
        if last:
            break
        level += 1
        buckets = -(-buckets // FAN_IN)
        waiting = done.filter(open_).withColumn("__bucket", F.floor(F.col("__bucket") / FAN_IN)).withColumn("__level", F.lit(level))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    taken = (F.col("__whole") + F.round("__wanted")).cast("bigint")
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("n").alias("rows"), taken.alias("copies"))


def _dealt(copies: Column, rows: Column, nth: Column) -> Column:
    """Copies of the n-th (from 0) of ``rows`` equal rows that have ``copies`` together."""
    return (F.floor(copies / rows) + F.when(nth < copies % rows, 1).otherwise(0)).cast("bigint")


def copies(sizes: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``sizes`` (doc_id, source, size)."""
    kinds = counted_copies(saved(sizes.select("doc_id", "source", "size")), **options)
    each = kinds.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)).alias("__nth"))
    own = _dealt(F.col("copies"), F.col("rows"), F.col("__nth"))
    return each.select("doc_id", "source", "size", "source_size", "target", own.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and others), each as often as the mix takes it.

    Texts meet the numbers once, by an equality join.  Rows that have the same id, source
    and size as others, and of which some are taken once more than the others, are
    numbered in the order of a hash of the row, by ranges.
    """
    names = docs.columns
    sized = docs.withColumn("__size", word_count())
    kinds = counted_copies(saved(sized.select("doc_id", "source", F.col("__size").alias("size"))), **options)
    kinds = saved(kinds.filter("copies > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__of"),
        F.col("rows").alias("__rows"), F.col("copies").alias("__copies"),
    ))

    def with_kinds(rows: DataFrame, own: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
        return rows.join(own, same & (F.col("__size") == F.col("__of")))

    even = with_kinds(sized, kinds.filter("__copies % __rows = 0")).withColumn("__own", F.expr("__copies div __rows"))
    found = _repeated(even, names)
    uneven = kinds.filter("__copies % __rows > 0")
    if uneven.isEmpty():
        return found
    order = [*(F.col(c).asc_nulls_first() for c in ("doc_id", "source", "__size")), F.xxhash64(*[F.col(f"`{c}`") for c in names])]
    placed = with_row_index(with_kinds(sized, uneven), order, "__place")
    first = placed.groupBy("__id", "__source", "__of").agg(F.min("__place").alias("__first"))
    first = first.select(*[F.col(c).alias(f"{c}_of_first") for c in ("__id", "__source", "__of")], "__first")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of_first")) for c in ("__id", "__source", "__of")]
    numbered = placed.join(first, same).withColumn(
        "__own", _dealt(F.col("__copies"), F.col("__rows"), F.col("__place") - F.col("__first"))
    )
    return found.unionByName(_repeated(numbered, names))


def _repeated(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each row as often as ``__own`` says."""
    times = rows.filter("__own > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__own").cast("int"))))
    return times.select([F.col(f"`{c}`") for c in names])
