"""Questions to an undirected graph of gene interactions.

Walks are unrolled joins.  Each hop keeps one row per (source, gene), so the
frontier never grows beyond the number of genes however many paths there are.  The
links of a walk and each frontier are written once to the shared folder, so a hop
evaluates itself only and the plan of a walk does not grow with what lies behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.filters import BadRequest
from varloom.operators.ordering import checkpointed, top_per_group

MAX_HOPS = 3


def filtered_edges(
    edges: DataFrame, types: Sequence[str] | None = None, min_confidence: float | None = None
) -> DataFrame:
    out = edges
    if types and "all" not in types:
        out = out.filter(F.col("interaction_type").isin(list(types)))
    if min_confidence is not None:
        out = out.filter(F.col("confidence_score") >= min_confidence)
    return out


def edges_touching(
    edges: DataFrame,
    genes: Sequence[str],
    types: Sequence[str] | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """Edges with one of the genes on either end."""
    near = F.col("gene_a").isin(list(genes)) | F.col("gene_b").isin(list(genes))
    return filtered_edges(edges, types, min_confidence).filter(near)


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each pair once."""
    ends = edges.filter(F.col("gene_a").isNotNull() & F.col("gene_b").isNotNull())
    there = ends.select(F.col("gene_a").alias("gene"), F.col("gene_b").alias("partner"))
    back = ends.select(F.col("gene_b").alias("gene"), F.col("gene_a").alias("partner"))
    return there.union(back).distinct()


def pair_edges(edges: DataFrame) -> DataFrame:
    """Every edge under its sorted pair, numbered within the pair.

    Parallel edges stay separate rows: a pair may hold any number of them.
    """
    ends = edges.filter(F.col("gene_a").isNotNull() & F.col("gene_b").isNotNull())
    return ends.select(
        F.least("gene_a", "gene_b").alias("gene1"), F.greatest("gene_a", "gene_b").alias("gene2"), "*"
    )


def pair_summary(edges: DataFrame) -> DataFrame:
    """One row per pair with its number of edges and best confidence."""
    return pair_edges(edges).groupBy("gene1", "gene2").agg(
        F.count(F.lit(1)).alias("edge_count"),
        F.max("confidence_score").alias("best_confidence"),
        F.array_sort(F.collect_set("interaction_type")).alias("types"),
    )


def direct_partners(
    edges: DataFrame,
    genes: Sequence[str],
    types: Sequence[str] | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """One row per interaction of a query gene; with both ends queried the row
    belongs to ``gene_a``."""
    touching = edges_touching(edges, genes, types, min_confidence)
    a_side = F.col("gene_a").isin(list(genes))
    rest = [c for c in touching.columns if c not in ("gene_a", "gene_b")]
    return touching.select(
        F.when(a_side, F.col("gene_a")).otherwise(F.col("gene_b")).alias("query_gene"),
        F.when(a_side, F.col("gene_b")).otherwise(F.col("gene_a")).alias("partner_gene"),
        *rest,
    )


def partner_counts(partners: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Interactions per query gene, 0 for genes without any."""
    asked = _literal_genes(partners, genes, "query_gene")
    counts = partners.groupBy("query_gene").agg(F.count(F.lit(1)).alias("partner_count"))
    return asked.join(counts, "query_gene", "left").select(
        "query_gene", F.coalesce("partner_count", F.lit(0)).cast("bigint").alias("partner_count")
    )


def best_partners(partners: DataFrame, k: int) -> DataFrame:
    """The k most confident interactions of each query gene."""
    order = [F.col("confidence_score").desc_nulls_last(), F.col("partner_gene").asc()]
    if "interaction_type" in partners.columns:
        order.append(F.col("interaction_type").asc())
    return top_per_group(partners, ["query_gene"], k, order, rank="rank")


def _literal_genes(df: DataFrame, genes: Sequence[str], name: str) -> DataFrame:
    one = df.sparkSession.range(1)
    return one.select(F.explode(F.array(*[F.lit(g) for g in dict.fromkeys(genes)])).alias(name))


def _check_hops(hops: int) -> None:
    if not 1 <= hops <= MAX_HOPS:
        raise BadRequest(f"distance must be in 1..{MAX_HOPS}")


def neighbours(
    edges: DataFrame,
    genes: Sequence[str],
    hops: int,
    types: Sequence[str] | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """Genes within ``hops`` edges of the query genes, at their least distance.

    The expansion runs over the full edge table, not just edges at the query
    genes.
    """
    _check_hops(hops)
    links = _links(filtered_edges(edges, types, min_confidence), hops)
    seen = _literal_genes(edges, genes, "gene").withColumn("distance", F.lit(0))
    frontier = seen.select("gene")
    for distance in range(1, hops + 1):
        reached = links.join(frontier, "gene", "left_semi").select(F.col("partner").alias("gene")).distinct()
        fresh = reached.join(seen.select("gene"), "gene", "left_anti").withColumn("distance", F.lit(distance))
        if distance < hops:
            fresh = checkpointed(fresh)
        seen = seen.unionByName(fresh)
        frontier = fresh.select("gene")
    return seen.filter(F.col("distance") > 0).withColumn("is_query_gene", F.col("gene").isin(list(genes)))


def _links(edges: DataFrame, hops: int) -> DataFrame:
    """Both directions of the edges, repeats included; written once if more than one hop reads them."""
    ends = edges.filter(F.col("gene_a").isNotNull() & F.col("gene_b").isNotNull())
    both = F.array(
        F.struct(F.col("gene_a").alias("gene"), F.col("gene_b").alias("partner")),
        F.struct(F.col("gene_b").alias("gene"), F.col("gene_a").alias("partner")),
    )
    links = ends.select(F.inline(both))
    return checkpointed(links) if hops > 1 else links


def shortest_paths(
    edges: DataFrame,
    sources: Sequence[str],
    targets: Sequence[str],
    hops: int,
    types: Sequence[str] | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """One shortest path of at most ``hops`` edges per (source, target).

    Among equally short paths the alphabetically first one is taken.

    The walks meet in the middle: from the sources ceil(hops / 2) edges, from the targets
    the rest.  The first path runs over some gene that both walks reach at their least
    distances; up to it, and from it on, it is the first one itself, so one path per
    (source, gene) and per (gene, target) is enough.
    """
    _check_hops(hops)
    links = _links(filtered_edges(edges, types, min_confidence), hops)
    out = _walked(links, _literal_genes(edges, sources, "end"), (hops + 1) // 2, forward=True)
    back = _walked(links, _literal_genes(edges, targets, "end"), hops // 2, forward=False)
    met = out.select(F.col("end").alias("source_gene"), "gene", F.col("path").alias("first")).join(
        back.select(F.col("end").alias("target_gene"), "gene", F.col("path").alias("last")), "gene"
    ).filter("source_gene <> target_gene")
    path = F.concat("first", F.slice("last", F.lit(2), F.size("last")))
    best = met.groupBy("source_gene", "target_gene").agg(F.min(F.struct(F.size(path).alias("n"), path.alias("path"))).alias("best"))
    return best.select(
        "source_gene",
        "target_gene",
        "best.path",
        (F.col("best.n") - 1).alias("path_length"),
        F.slice("best.path", F.lit(2), F.greatest(F.col("best.n") - 2, F.lit(0))).alias("intermediate_genes"),
    )


def _walked(links: DataFrame, ends: DataFrame, hops: int, forward: bool) -> DataFrame:
    """(end, gene, path): the first shortest path from each end to the genes within ``hops``, or from these to the end."""
    seen = ends.select("end", F.col("end").alias("gene"), F.array("end").alias("path"))
    frontier = seen
    for _ in range(hops):
        path = F.concat("path", F.array("partner")) if forward else F.concat(F.array("partner"), "path")
        step = frontier.join(links, "gene").select("end", F.col("partner").alias("gene"), path.alias("path"))
        fresh = step.groupBy("end", "gene").agg(F.min("path").alias("path"))
        frontier = checkpointed(fresh.join(seen.select("end", "gene"), ["end", "gene"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def common_partners(
    edges: DataFrame,
    genes: Sequence[str],
    types: Sequence[str] | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """Partners that every one of the query genes has."""
    wanted = list(dict.fromkeys(genes))
    links = adjacency(edges_touching(edges, wanted, types, min_confidence)).filter(F.col("gene").isin(wanted))
    shared = links.groupBy(F.col("partner").alias("common_partner")).agg(
        F.array_sort(F.collect_set("gene")).alias("shared_by")
    )
    return shared.withColumn("shared_count", F.size("shared_by")).filter(F.col("shared_count") == len(wanted))


def network_statistics(found: DataFrame) -> DataFrame:
    """Neighbours per distance."""
    return found.groupBy("distance").agg(F.count(F.lit(1)).alias("neighbours"))


def partner_statistics(partners: DataFrame, genes: Sequence[str]) -> DataFrame:
    n = len(list(dict.fromkeys(genes)))
    return partners.agg(
        F.countDistinct("partner_gene").alias("total_unique_partners"),
        F.count(F.lit(1)).alias("total_interactions"),
    ).select(
        F.lit(n).cast("bigint").alias("total_query_genes"),
        "total_interactions",
        "total_unique_partners",
        (F.col("total_unique_partners") / F.lit(float(n))).alias("avg_partners_per_gene"),
    )
