"""Connected components of an undirected graph, for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps: every node is tied to the smallest
    node it knows until all components are stars.  Each step is an aggregate and an
    equality join, both spread over all tasks; neighbours are never listed, so a
    node of any degree is harmless.  The number of steps grows with the logarithm
    of the component size.  Every step is checkpointed.
    """
    links = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = saved(links.distinct())
    before = None
    while True:
        links = saved(_star(_star(links, large=True), large=False))
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before:
            break
        before = state
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step on links a > b; the result has a > b again and no duplicates.

    Large star: a node ties its larger neighbours to the smallest of its neighbours and itself.
    Small star: a node ties its smaller neighbours and itself to the smallest of them.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        tied = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tied = tied.unionByName(least.select("a", F.col("m").alias("b")))
    return tied.filter("a > b").distinct()


def one_per_class(docs: DataFrame, mark: str) -> DataFrame:
    """(fp, row): of all rows with one value of column ``mark`` the first, as a struct that sorts.

    First is the smallest doc_id (null last), then the smallest text (null first), then
    the other columns.  A minimum, so every task sends one row a class, however many
    rows the class has.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", mark)]
    row = F.struct(F.col("doc_id").isNull().alias("__no_id"), "doc_id", "text", *rest)
    return docs.groupBy(F.col(mark).alias("fp")).agg(F.min(row).alias("row"))
