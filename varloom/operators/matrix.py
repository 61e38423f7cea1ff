"""Sample x gene tables: alteration matrices, bars, axes, exports.

Everything stays in long form; a pivot is only made over a caller's gene list
or over the fixed list of annotations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.functions import genomics, stats
from varloom.operators import filters as flt
from varloom.operators import ordering
from varloom.operators.filters import BadRequest
from varloom.roles import Roles, col, require_columns

ANNOTATIONS = [name or "None" for name in genomics.CODE_ANNOTATION.values()]


def gene_list(df: DataFrame, genes: Sequence[str]) -> DataFrame:
    """The caller's genes with their place in the list."""
    wanted = list(dict.fromkeys(genes))
    if not wanted:
        raise BadRequest("the gene list is empty")
    axis = F.array(*[F.lit(g) for g in wanted])
    return df.sparkSession.range(1).select(F.posexplode(axis).alias("place", "gene"))


# --- cell tables: gene, tumor_sample_barcode, code, annotation -------------


def _cells(cells: DataFrame, genes: Sequence[str]) -> DataFrame:
    shown = cells.filter(F.col("gene").isin(list(genes)))
    label = F.when(F.coalesce("annotation", F.lit("")) == "", "None").otherwise(F.col("annotation"))
    return shown.withColumn("value", (F.col("code") != 0).cast("int")).withColumn("annotation", label)


def unmutated_counts(cells: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Per gene of the list, the number of cells without alteration."""
    return _cells(cells, genes).groupBy("gene").agg(F.count_if(F.col("code") == 0).alias("unmutated"))


def gene_annotation_bar(cells: DataFrame, genes: Sequence[str]) -> DataFrame:
    """gene x annotation, number of altered samples."""
    wide = _cells(cells, genes).groupBy("gene").pivot("annotation", ANNOTATIONS).sum("value")
    return wide.fillna(0)


def sample_annotation_bar(cells: DataFrame, genes: Sequence[str]) -> DataFrame:
    """sample x annotation, number of altered genes; unaltered cells have no bar."""
    shown = [a for a in ANNOTATIONS if a != "None"]
    wide = _cells(cells, genes).groupBy("tumor_sample_barcode").pivot("annotation", shown).sum("value")
    return wide.fillna(0)


def binary_matrix(cells: DataFrame, genes: Sequence[str]) -> DataFrame:
    """sample x gene with 1 for altered."""
    wanted = list(dict.fromkeys(genes))
    wide = _cells(cells, wanted).groupBy("tumor_sample_barcode").pivot("gene", wanted).max("value")
    return wide.fillna(0)


def gene_axis(cells: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Genes with index: most unmutated cells first, ties by name."""
    counts = unmutated_counts(cells, genes)
    axis = gene_list(cells, genes).join(counts, "gene", "left").fillna(0, ["unmutated"])
    # one row per gene of the caller's list, hence the window over everything
    order = Window.orderBy(F.col("unmutated").desc(), F.col("gene").asc())
    return axis.select("gene", "unmutated", (F.row_number().over(order) - 1).alias("gene_index"))


def waterfall(cells: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Each sample with the falling list of the axis indices altered in it.

    Rows of 0/1 compared from the last gene of the axis to the first are in the
    same order as these lists, so no zeros need to be filled in.
    """
    axis = gene_axis(cells, genes).select("gene", "gene_index")
    marks = _cells(cells, genes).join(axis, "gene")
    index = F.when(F.col("value") == 1, F.col("gene_index"))
    return marks.groupBy("tumor_sample_barcode").agg(
        F.sort_array(F.collect_set(index), asc=False).alias("altered_genes")
    )


def sample_axis(cells: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Samples with their index in waterfall order."""
    ordered = [F.col("altered_genes").desc(), F.col("tumor_sample_barcode").asc()]
    return ordering.with_row_index(waterfall(cells, genes), ordered, "sample_index")


def heatmap_cells(cells: DataFrame, genes: Sequence[str]) -> DataFrame:
    """(sample index, gene index, code) of every cell."""
    rows = _cells(cells, genes).select("gene", "tumor_sample_barcode", "code")
    samples = sample_axis(cells, genes).select("tumor_sample_barcode", "sample_index")
    return (
        rows.join(gene_axis(cells, genes).select("gene", "gene_index"), "gene")
        .join(samples, "tumor_sample_barcode")
        .select("sample_index", "gene_index", "code")
    )


# --- alteration matrix from variants ---------------------------------------


def altered(
    df: DataFrame,
    genes: Sequence[str],
    categories: Sequence[str] = ("all",),
    samples: Sequence[str] | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """Variants of the listed genes with sample, gene and alteration category."""
    rows = flt.by_alteration(flt.genes_in(df, genes, roles), categories, roles)
    if samples:
        rows = rows.filter(col(roles.sample).isin(list(samples)))
    rows = rows.filter((col(roles.sample).isNotNull()) & (col(roles.sample) != ""))
    return rows.select(
        col(roles.gene).alias("gene"),
        col(roles.sample).alias("sample"),
        genomics.alteration_category(roles.variant_class).alias("alteration"),
        col(roles.variant_id).alias("variant_id"),
    )


def alteration_matrix(rows: DataFrame) -> DataFrame:
    """(gene, sample) with the sorted set of its categories, five at most."""
    return rows.groupBy("gene", "sample").agg(F.array_sort(F.collect_set("alteration")).alias("types"))


def all_samples(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    rows = df.select(col(roles.sample).alias("sample"))
    return rows.filter(F.col("sample").isNotNull() & (F.col("sample") != "")).distinct()


def mutation_details(df: DataFrame, rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """The variants behind ``rows`` (see :func:`altered`): gene, sample, type, class, protein change, place."""
    named = {
        "gene": roles.gene, "sample": roles.sample, "variant_type": roles.variant_type, "variant_class": roles.variant_class,
        "protein_change": roles.protein_change, "chromosome": roles.chrom, "position": roles.start,
    }
    chosen = [col(c).alias(n) if c in df.columns else F.lit(None).cast("string").alias(n) for n, c in named.items()]
    return df.join(rows.select(F.col("variant_id").alias("_id")), col(roles.variant_id) == F.col("_id"), "left_semi").select(
        col(roles.variant_id).alias("variant_id"), *chosen
    )


def gene_frequency(
    df: DataFrame, rows: DataFrame, genes: Sequence[str], roles: Roles = Roles(), samples: DataFrame | None = None
) -> DataFrame:
    """Per listed gene: distinct (sample, type) and distinct samples over all samples.

    ``samples`` restricts both sides of the division to these samples.
    """
    if samples is not None:
        rows = rows.join(samples.select("sample"), "sample", "left_semi")
    counts = alteration_matrix(rows).groupBy("gene").agg(
        F.sum(F.size("types")).alias("alterations"), F.count(F.lit(1)).alias("samples")
    )
    axis = gene_list(df, genes).join(counts, "gene", "left").fillna(0, ["alterations", "samples"])
    everyone = all_samples(df, roles) if samples is None else samples.select("sample").distinct()
    out = axis.withColumn("total", everyone.agg(F.count(F.lit(1))).scalar())
    return out.select(
        "place", "gene", "alterations", "samples",
        stats.rate(F.col("alterations"), F.col("total")).alias("frequency"),
        stats.rate(F.col("samples"), F.col("total")).alias("sample_frequency"),
    )


def sample_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("alteration_count"))


def samples_with_counts(df: DataFrame, rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Every sample of the table, also those without a hit."""
    counts = sample_counts(rows)
    joined = all_samples(df, roles).join(counts, "sample", "left")
    return joined.select("sample", F.coalesce("alteration_count", F.lit(0)).cast("bigint").alias("alteration_count"))


def clinical_annotation(df: DataFrame, column: str, roles: Roles = Roles()) -> DataFrame:
    """Per sample the last non-empty value, by variant id."""
    require_columns(df, [column])
    rows = df.filter(col(column).isNotNull() & (col(column) != "")).filter(
        col(roles.sample).isNotNull() & (col(roles.sample) != "")
    )
    return rows.groupBy(col(roles.sample).alias("sample")).agg(
        F.max_by(col(column), col(roles.variant_id)).alias("annotation")
    )


def ordered_genes(frequency: DataFrame, order: str = "mutation_frequency", custom: Sequence[str] | None = None) -> DataFrame:
    if order == "mutation_frequency":
        return frequency.orderBy(F.col("alterations").desc(), F.col("place").asc())
    if order == "alphabetical":
        return frequency.orderBy("gene")
    if order == "custom":
        return ordering.by_list_position(frequency, "gene", custom) if custom else frequency.orderBy("place")
    raise BadRequest(f"unknown gene order {order!r}")


def ordered_samples(
    samples: DataFrame,
    order: str = "mutation_count",
    custom: Sequence[str] | None = None,
    annotation: DataFrame | None = None,
) -> DataFrame:
    if order == "mutation_count":
        return samples.orderBy(F.col("alteration_count").desc(), F.col("sample").asc())
    if order == "alphabetical":
        return samples.orderBy("sample")
    if order == "clinical_annotation" and annotation is not None:
        joined = samples.join(annotation, "sample", "left")
        return joined.orderBy(F.coalesce("annotation", F.lit("")), "sample")
    if order == "custom" and custom:
        return ordering.by_list_position(samples, "sample", custom)
    raise BadRequest(f"unknown sample order {order!r}")


def top_samples(samples: DataFrame, k: int) -> DataFrame:
    return ordering.top(samples, k, [F.col("alteration_count").desc(), F.col("sample").asc()])


def type_matrix(matrix: DataFrame, samples: DataFrame, genes: Sequence[str]) -> DataFrame:
    """samples x genes of ';'-joined categories, '' where there is none."""
    wanted = list(dict.fromkeys(genes))
    cells = matrix.select("sample", "gene", F.array_join("types", ";").alias("cell"))
    wide = cells.groupBy("sample").pivot("gene", wanted).agg(F.first("cell"))
    return samples.select("sample").join(wide, "sample", "left").fillna("", wanted)


def mutation_records(matrix: DataFrame) -> DataFrame:
    """One record per (gene, sample, category) under the exchange format's names."""
    return matrix.select(
        F.col("gene").alias("Hugo_Symbol"),
        F.col("sample").alias("Tumor_Sample_Barcode"),
        F.explode("types").alias("Variant_Classification"),
        F.lit("SNP").alias("Variant_Type"),
    )


def melt(wide: DataFrame, id_column: str, samples: Sequence[str] | None = None) -> DataFrame:
    """Wide code matrix to long cells with their annotation."""
    names = list(samples) if samples else [c for c in wide.columns if c != id_column]
    long = wide.unpivot([col(id_column)], [col(n) for n in names], "sample_id", "evalue")
    return long.withColumn("annotation", genomics.code_annotation("evalue"))


def indexed(long: DataFrame, keys: Sequence[str], name: str = "row_index") -> DataFrame:
    """Rows with their index in key order."""
    return ordering.with_row_index(long, [col(k).asc() for k in keys], name)
