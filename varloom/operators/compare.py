"""Comparison of data sets that are labelled slices of one or more tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import genomics, stats
from varloom.operators import filters as flt
from varloom.operators.filters import BadRequest
from varloom.roles import Roles, col

LABEL = "dataset"


def labelled(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Union of data sets, each row with the label of its own."""
    if not datasets:
        raise BadRequest("no data sets to compare")
    parts = [df.withColumn(LABEL, F.lit(name)) for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cohorts(df: DataFrame, names: Sequence[str] | None = None, roles: Roles = Roles()) -> DataFrame:
    """The cohorts of one table as data sets; one scan serves them all."""
    out = df if names is None else df.filter(col(roles.cohort).isin(list(names)))
    return out.withColumn(LABEL, col(roles.cohort))


def restricted(
    data: DataFrame,
    genes: Sequence[str] | None = None,
    classes: Sequence[str] | None = None,
    filters: Mapping[str, Any] | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    out = flt.apply(data, filters)
    if genes:
        out = flt.genes_in(out, genes, roles)
    return flt.by_type_and_class(out, None, classes, roles)


def _text(c: str):
    return F.nullif(col(c), F.lit(""))


def dataset_summary(data: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Mutations, samples, genes and mutations per sample of each data set."""
    # counted per sample and per gene first, so that no row is expanded
    per_sample_rows = data.groupBy(LABEL, _text(roles.sample).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    samples = per_sample_rows.groupBy(LABEL).agg(
        F.sum("n").alias("total_mutations"), F.count("s").alias("total_samples")
    )
    genes = data.select(F.col(LABEL).alias("_label"), _text(roles.gene).alias("g")).distinct().groupBy("_label").agg(
        F.count("g").alias("unique_genes")
    )
    out = samples.join(genes, F.col(LABEL).eqNullSafe(F.col("_label"))).drop("_label")
    per_sample = stats.rate(F.col("total_mutations"), F.col("total_samples"))
    return out.withColumn("mutation_rate", stats.rounded(per_sample, 4))


def _gene_counts(data: DataFrame, labels: Sequence[str], roles: Roles) -> DataFrame:
    """Per gene the mutations, mutated samples and all samples of each label.

    Counting per (gene, label) comes first, so the wide form is built from a
    table with one row per gene and data set.
    """
    rows = data.filter(F.col(LABEL).isin(list(labels)))
    counts = rows.groupBy(_text(roles.gene).alias("gene"), LABEL).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(_text(roles.sample)).alias("s")
    )
    # one entry per label: all totals come from one aggregate, which goes through
    # the next one so that the subquery is not copied into every use of it
    per_label = rows.groupBy(LABEL).agg(F.countDistinct(_text(roles.sample)).alias("t"))
    totals = per_label.agg(F.map_from_entries(F.collect_list(F.struct(LABEL, "t")))).scalar()
    counts = counts.withColumn("_totals", totals)
    wide = []
    for name in labels:
        here = F.col(LABEL) == name
        wide.append(F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"{name}_count"))
        wide.append(F.coalesce(F.sum(F.when(here, F.col("s"))), F.lit(0)).alias(f"{name}_samples"))
        total = F.element_at(F.first("_totals"), F.lit(name))
        wide.append(F.coalesce(total, F.lit(0)).alias(f"{name}_total"))
    return counts.filter(F.col("gene").isNotNull()).groupBy("gene").agg(*wide)


def gene_frequencies(
    data: DataFrame, labels: Sequence[str], test: str = "none", unit: str = "samples",
    p_value_threshold: float | None = None, roles: Roles = Roles(),
) -> DataFrame:
    """Mutation frequency of every gene in every data set.

    The first two data sets can be tested against each other: ``fisher_exact``
    or ``chi_square`` over mutated samples, or over mutation counts with
    ``unit="mutations"`` (where a count above the sample number gives p = 1).
    """
    if test not in ("none", "fisher_exact", "chi_square") or unit not in ("samples", "mutations"):
        raise BadRequest("unknown test or unit")
    wide = _gene_counts(data, labels, roles)
    columns = [F.col("gene")]
    for name in labels:
        share = stats.rate(F.col(f"{name}_count"), F.col(f"{name}_total"))
        columns += [F.col(f"{name}_count"), stats.rounded(share, 4).alias(f"{name}_frequency")]
    if test == "none" or len(labels) < 2:
        return wide.select(*columns)
    x, y = labels[0], labels[1]
    suffix = "samples" if unit == "samples" else "count"
    a, n1, c, n2 = (F.col(s) for s in (f"{x}_{suffix}", f"{x}_total", f"{y}_{suffix}", f"{y}_total"))
    gap = F.abs(stats.rate(F.col(f"{x}_count"), n1) - stats.rate(F.col(f"{y}_count"), n2))
    columns.append(stats.rounded(gap, 4).alias("frequency_difference"))
    wide = wide.withColumn("_a", a).withColumn("_b", n1 - a).withColumn("_c", c).withColumn("_d", n2 - c)
    cells = [F.col(k) for k in ("_a", "_b", "_c", "_d")]
    if test == "fisher_exact":
        columns.append(stats.rounded(stats.odds_ratio(*cells), 4).alias("odds_ratio"))
        columns.append(stats.fisher_two_sided(*cells).alias("p_value"))
    else:
        wide = wide.withColumn("_stat", goodness_of_fit(a, c, n1, n2))
        columns.append(F.col("_stat").alias("chi_square"))
        columns.append(stats.chi_square_p_1df(F.col("_stat")).alias("p_value"))
    out = wide.select(*columns)
    return out if p_value_threshold is None else out.filter(F.col("p_value") <= p_value_threshold)


def goodness_of_fit(a, c, n1, n2):
    """Chi-square of two counts against the shares their totals lead one to expect."""
    mutated = (a + c).cast("double")
    total = (n1 + n2).cast("double")
    left, right = mutated * n1 / total, mutated * n2 / total
    parts = [F.coalesce(stats.chi_square(o.cast("double"), e), F.lit(0.0)) for o, e in ((a, left), (c, right))]
    return parts[0] + parts[1]


def gene_union(data: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Genes that occur in any of the data sets."""
    return data.select(_text(roles.gene).alias("gene")).filter(F.col("gene").isNotNull()).distinct()


def variant_overlap(data: DataFrame, min_datasets: int = 1, roles: Roles = Roles()) -> DataFrame:
    """Each distinct variant with the data sets that have it."""
    rows = data.filter(_text(roles.chrom).isNotNull() & col(roles.start).isNotNull())
    ref, alt = _text(roles.ref), _text(roles.alt)
    both = ref.isNotNull() & alt.isNotNull()
    # a row per variant and data set first; lists and the text of the key are made of what is left
    place = {"k_chrom": col(roles.chrom), "k_start": col(roles.start), "k_ref": F.when(both, ref), "k_alt": F.when(both, alt)}
    details = F.struct(
        col(roles.chrom).alias("chromosome"), col(roles.start).alias("position"), col(roles.gene).alias("gene"),
        col(roles.ref).alias("reference_allele"), col(roles.alt).alias("alternate_allele"),
    )
    slim = rows.select(
        *[c.alias(n) for n, c in place.items()], F.col(LABEL), F.struct(col(roles.variant_id).alias("id"), details.alias("v")).alias("r")
    )
    per_set = slim.groupBy(*place, LABEL).agg(F.min_by("r", "r.id").alias("r"))
    out = per_set.groupBy(*place).agg(
        F.array_sort(F.collect_list(LABEL)).alias("present_in_datasets"),
        F.min_by("r.v", F.struct(LABEL, "r.id")).alias("v"),
    )
    out = out.withColumn("variant_key", genomics.variant_key("k_chrom", "k_start", "k_ref", "k_alt"))
    out = out.withColumn("dataset_count", F.size("present_in_datasets")).filter(F.col("dataset_count") >= min_datasets)
    return out.select(
        "variant_key", "v.*", "present_in_datasets", "dataset_count",
        (F.col("dataset_count") > 1).alias("is_shared"), (F.col("dataset_count") == 1).alias("is_unique"),
    )


def sample_statistics(data: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Mutations per sample of each data set: mean, largest, smallest."""
    per_sample = data.groupBy(LABEL, _text(roles.sample).alias("sample")).agg(F.count(F.lit(1)).alias("n"))
    out = per_sample.groupBy(LABEL).agg(
        F.count("sample").alias("total_samples"),
        F.sum("n").alias("total_mutations"),
        F.count(F.lit(1)).alias("samples_with_mutations"),
        stats.rounded(F.avg("n"), 2).alias("mean_mutations_per_sample"),
        F.max("n").alias("max_mutations_per_sample"),
        F.min("n").alias("min_mutations_per_sample"),
    )
    genes = data.groupBy(LABEL).agg(F.countDistinct(_text(roles.gene)).alias("unique_genes"))
    return out.join(genes, LABEL)
