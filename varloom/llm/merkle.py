"""Merkle manifest of a data set: proofs for every row, folded back to the root.

Leaves are hashes of rows.  The leaves of a source, in the order of ``doc_id`` (null
first, then by hash), are hashed in runs of ``FAN`` until one node is left; these nodes
of all sources, in the order of the source (null first), are the leaves of one more tree
of the same form, whose top is the root.  Digests are lower-case hex text, and a node is
the SHA-256 of its children's digests.  The proof of a row is what else stands in the
run at each level, left to right, from its leaf to the root.

Method: ``FAN ** DEPTH`` consecutive leaves of a source are a superblock, which one task
holds at a time (a few hundred kB).  First each superblock sends its node only.  The few
nodes above are hashed level by level as equality joins and groups of at most ``FAN``
rows, and on the way back each superblock gets the runs that its path needs outside of
it.  Then leaves and these outer nodes are cogrouped by superblock, and one function does
the local levels, joins the proof and folds it.

Rows of one source, whatever its share of the table, are numbered by range partitions
and never meet in one task.  No text is shuffled: only digests are.

Repeated rows are leaves of their own.  A null ``doc_id`` counts as empty text where ids
are hashed.  Other columns than the five are ignored.  An empty table has no leaves and
no root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import saved, stored
from varloom.operators.ordering import with_row_index

FAN = 16
DEPTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree bigint, at bigint, hash string, size bigint"


def field(value: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon, the text; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Hash of a row of documents, with some of its columns replaced."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


def _joined(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(hashes: list[str], size: int, depth: int) -> list[list[str]]:
    """The levels of a superblock from the leaves on; the only one of its source ends where one node is left, others at ``depth``."""
    levels = [hashes]
    while len(levels[-1]) > 1 if size <= FAN**depth else len(levels) <= depth:
        below = levels[-1]
        levels.append([_joined(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def _top(depth: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, size = frame.sort_values("at"), int(frame["size"].iloc[0])
        top = _levels(frame["leaf"].tolist(), size, depth)[-1][0]
        return pd.DataFrame({"tree": frame["tree"].iloc[:1], "at": frame["block"].iloc[:1], "hash": [top], "size": [-(-size // FAN**depth)]})

    return run


def _climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of trees from ``nodes`` (tree, at, hash, size) up, and the top of each tree (tree, hash).

    ``size`` is the number of nodes of the tree on that level.  A level has each node
    with what stands before and after it in its run.
    """
    levels, tops = [], nodes.filter("size = 1").select("tree", "hash")
    nodes = nodes.filter("size > 1")
    while not nodes.isEmpty():
        run = F.array_sort(F.collect_list(F.struct("at", "hash")))  # at most FAN rows
        runs = nodes.groupBy("tree", F.floor(F.col("at") / FAN).alias("above"), "size").agg(run.alias("run"))
        runs = saved(runs)
        text = lambda part: F.array_join(F.transform(part, lambda x: x["hash"]), "")
        each = runs.select("tree", "above", "run", F.posexplode("run").alias("k", "node"))
        levels.append(each.select(
            "tree", F.col("node.at").alias("at"), "above",
            text(F.slice("run", F.lit(1), F.col("k"))).alias("before"), text(F.slice("run", F.col("k") + 2, F.lit(FAN))).alias("after"),
        ))
        nodes = saved(runs.select(
            "tree", F.col("above").alias("at"), F.sha2(text(F.col("run")).cast("binary"), 256).alias("hash"),
            F.ceil(F.col("size") / FAN).cast("bigint").alias("size"),
        ))
        tops = tops.unionByName(nodes.filter("size = 1").select("tree", "hash"))
        nodes = nodes.filter("size > 1")
    return levels, tops


def _outer(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, at, outer) of the lowest nodes: the (before, after) of each level from theirs to the root.

    ``above`` (tree, outer) says what stands over the top of each tree.
    """
    known = above.select("tree", F.lit(0).cast("bigint").alias("at"), "outer")
    for level in reversed(levels):
        step = F.array(F.struct("before", "after"))
        own = level.alias("n").join(
            known.alias("p"), (F.col("n.tree") == F.col("p.tree")) & (F.col("n.above") == F.col("p.at"))
        ).select("n.tree", "n.at", F.concat(step, "outer").alias("outer"))
        # of trees that end below this level only the top is known so far
        there = level.select("tree").distinct()
        known = own.unionByName(known.join(there, "tree", "left_anti"))
    return known


def _finished(depth: int):
    """Leaves of a superblock and what it needs from outside, to its rows of the manifest."""

    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("at")
        levels = _levels(leaves["leaf"].tolist(), int(leaves["size"].iloc[0]), depth)
        above = [(r["before"], r["after"]) for r in outer["outer"].iloc[0]]
        root = outer["root"].iloc[0]
        local = [
            [("".join(level[i - i % FAN : i]), "".join(level[i + 1 : i - i % FAN + FAN])) for i in range(len(level))]
            for level in levels[:-1]
        ]
        proofs, folded = [], []
        for i, node in enumerate(leaves["changed"].tolist()):
            digest = hashlib.sha256()
            for before, after in [level[i // FAN**k] for k, level in enumerate(local)] + above:
                digest.update(before.encode())
                digest.update(after.encode())
                node = hashlib.sha256(f"{before}{node}{after}".encode()).hexdigest()
            proofs.append(digest.hexdigest())
            folded.append(node)
        return pd.DataFrame({
            "doc_id": leaves["doc_id"], "leaf": leaves["leaf"], "subroot": outer["subroot"].iloc[0], "root": root,
            "proof_sha256": proofs, "folded_root": folded, "verified": np.array(folded, dtype=object) == root,
        })

    return run


def manifest(docs: DataFrame, changed: Column, depth: int = DEPTH) -> DataFrame:
    """Leaf, subroot, root, proof and check of each row of ``docs``.

    The proof is checked against ``changed``, the leaf as it is found later (an expression
    over ``docs``): it is folded with the proof's digests, and verified if that gives the root.
    """
    rows = docs.select("doc_id", "source", leaf().alias("leaf"), changed.alias("changed"))
    # equal rows are interchangeable; the salt lets a range end between them
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("changed"), F.col("__salt")]
    placed = with_row_index(rows.withColumn("__salt", salt), order, "__place").drop("__salt")
    trees = placed.groupBy("source").agg(F.min("__place").alias("first"), F.count(F.lit(1)).alias("size"))
    trees = saved(with_row_index(trees, [F.col("source").asc_nulls_first()], "tree"))
    # a hot source is one side of this join, the other has a row a source
    leaves = placed.alias("d").join(trees.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "tree", (F.col("__place") - F.col("first")).alias("at"), "size", "doc_id", "leaf", "changed"
    )
    leaves = stored(leaves.withColumn("block", F.floor(F.col("at") / FAN**depth)), "leaves")
    kind = dict(docs.dtypes)["doc_id"]
    nodes = saved(leaves.select("tree", "block", "at", "size", "leaf").groupBy("tree", "block").applyInPandas(_top(depth), NODE))
    levels, subroots = _climbed(nodes)
    subroots = saved(subroots)
    n = trees.count()
    upper, roots = _climbed(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), "hash", F.lit(n).cast("bigint").alias("size")))
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    of_source = _outer(upper, roots.select("tree", nothing.alias("outer")))
    of_source = of_source.select(F.col("at").alias("tree"), "outer").join(subroots.withColumnRenamed("hash", "subroot"), "tree")
    of_block = _outer(levels, of_source.select("tree", "outer"))
    root = roots.first()  # one digest
    outer = of_block.withColumnRenamed("at", "block").join(of_source.select("tree", "subroot"), "tree")
    outer = outer.withColumn("root", F.lit(root["hash"] if root else None).cast("string"))
    # ids travel as text, as pandas has no integers beside nulls
    found = leaves.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        _finished(depth), "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def tampered(ids: Column) -> Column:
    """Whether the registered query changes a row: 5 divides the CRC-32 of its id."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
