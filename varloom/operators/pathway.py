"""Gene sets: lookups and over-representation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import stats, text
from varloom.operators.filters import BadRequest
from varloom.roles import Roles, col


def mutated_genes(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Distinct genes of a table, without null."""
    return df.select(col(roles.gene).alias("gene")).filter(F.col("gene").isNotNull()).distinct()


def gene_counts(association: DataFrame, pathways: DataFrame, name_contains: str | None = None) -> DataFrame:
    """Each pathway with its number of genes and their sorted list."""
    chosen = pathways if not name_contains else pathways.filter(text.contains("pathway_name", name_contains))
    members = association.select(F.col("pathway_id").alias("id"), "gene").distinct()
    return chosen.join(members, "id").groupBy("id", "pathway_name").agg(
        F.count("gene").alias("gene_count"), F.array_sort(F.collect_list("gene")).alias("genes")
    )


def pathways_of_genes(
    association: DataFrame, pathways: DataFrame, genes: Sequence[str], name_contains: str | None = None
) -> DataFrame:
    """All (gene, pathway) rows of the given genes."""
    chosen = pathways if not name_contains else pathways.filter(text.contains("pathway_name", name_contains))
    members = association.filter(F.col("gene").isin(list(genes))).distinct()
    return members.join(chosen, members["pathway_id"] == chosen["id"]).select("gene", "pathway_id", "pathway_name")


def genes_of_pathway(association: DataFrame, pathway_id: str) -> DataFrame:
    return association.filter(F.col("pathway_id") == pathway_id).select("gene").distinct()


def lookup_totals(rows: DataFrame) -> DataFrame:
    """Distinct genes and pathways of a lookup."""
    return rows.agg(
        F.countDistinct("gene").alias("total_genes"), F.countDistinct("pathway_id").alias("total_pathways")
    )


def enrichment(
    background: DataFrame,
    association: DataFrame,
    pathways: DataFrame,
    genes: Sequence[str] | DataFrame,
    min_genes: int = 1,
    p_value_threshold: float = 1.0,
    name_contains: str | None = None,
) -> DataFrame:
    """One-sided Fisher test of every pathway against an input gene list.

    ``background`` holds the distinct genes of the table under study.  The
    overlap comes from a join count; the sorted overlap list is as long as the
    pathway at most.
    """
    if isinstance(genes, DataFrame):
        wanted = genes.select("gene").distinct()
    elif genes:
        wanted = association.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(g) for g in dict.fromkeys(genes)])).alias("gene")
        )
    else:
        raise BadRequest("enrichment needs a gene list")
    chosen = pathways if not name_contains else pathways.filter(text.contains("pathway_name", name_contains))
    members = association.select(F.col("pathway_id").alias("id"), "gene").distinct()
    # the totals go through the aggregate, which keeps their subqueries from
    # being copied into every use of them
    marked = (
        members.join(wanted.withColumn("hit", F.lit(1)), "gene", "left")
        .withColumn("total", background.agg(F.count(F.lit(1))).scalar())
        .withColumn("asked", wanted.agg(F.count(F.lit(1))).scalar())
    )
    counts = marked.groupBy("id").agg(
        F.count("gene").alias("pathway_genes"),
        F.count("hit").alias("overlap"),
        F.max("total").alias("total"),
        F.max("asked").alias("asked"),
        F.array_sort(F.collect_list(F.when(F.col("hit") == 1, F.col("gene")))).alias("overlapping_genes"),
    )
    out = chosen.join(counts, "id").filter(F.col("overlap") >= min_genes)
    a, k, n = F.col("overlap"), F.col("pathway_genes"), F.col("asked")
    out = out.withColumn("b", n - a).withColumn("c", k - a).withColumn(
        "d", F.greatest(F.lit(0).cast("bigint"), F.col("total") - k - n + a)
    )
    cells = [F.col(x) for x in ("overlap", "b", "c", "d")]
    expected = F.try_divide(n.cast("double") * k.cast("double"), F.col("total").cast("double"))
    fold = F.coalesce(F.try_divide(a.cast("double"), expected), F.lit(0.0))
    return out.select(
        F.col("id").alias("pathway_id"),
        "pathway_name",
        F.col("pathway_genes").alias("total_genes_in_pathway"),
        F.col("overlap").alias("genes_in_input"),
        "overlapping_genes",
        stats.fisher_greater(*cells).alias("p_value"),
        stats.rounded(fold, 3).alias("fold_enrichment"),
        stats.rounded(stats.odds_ratio(*cells), 3).alias("odds_ratio"),
    ).filter(F.col("p_value") <= p_value_threshold)
