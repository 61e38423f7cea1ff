"""Checked queries for sample x gene tables, sorting and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import genomics, stats
from varloom.operators import matrix, metrics, ordering, search
from varloom.plans import reports
from varloom.registry.core import query
from varloom.registry.fixtures import ROLES, cells, sql, table, variants
from varloom.sources import export

GENES = ["G3", "G11", "G25", "G40", "G7", "G18"]
_IN = "('G3', 'G11', 'G25', 'G40', 'G7', 'G18')"
_LABEL = "CASE WHEN annotation = '' THEN 'None' ELSE annotation END"


@query(
    "d19_unmutated_counts",
    sql(f"SELECT gene, count(*) FILTER (code = 0) AS unmutated FROM cells WHERE gene IN {_IN} GROUP BY gene", "cells"),
)
def d19(spark, sf):
    return matrix.unmutated_counts(cells(spark, sf), GENES)


def _bars(key, names):
    bars = ", ".join(
        f"""CAST(count(*) FILTER (code <> 0 AND {_LABEL} = '{a}') AS BIGINT) AS "{a}" """ for a in names
    )
    return sql(f"SELECT {key}, {bars} FROM cells WHERE gene IN {_IN} GROUP BY {key}", "cells")


@query("d20_gene_annotation_bar", _bars("gene", matrix.ANNOTATIONS))
def d20(spark, sf):
    return matrix.gene_annotation_bar(cells(spark, sf), GENES)


@query(
    "d21_binary_matrix",
    sql(
        "SELECT tumor_sample_barcode, "
        + ", ".join(f"CAST(coalesce(max(CASE WHEN gene = '{g}' AND code <> 0 THEN 1 END), 0) AS INTEGER) AS {g}" for g in GENES)
        + f" FROM cells WHERE gene IN {_IN} GROUP BY tumor_sample_barcode",
        "cells",
    ),
)
def d21(spark, sf):
    return matrix.binary_matrix(cells(spark, sf), GENES)


@query("d22_sample_annotation_bar", _bars("tumor_sample_barcode", [a for a in matrix.ANNOTATIONS if a != "None"]))
def d22(spark, sf):
    return matrix.sample_annotation_bar(cells(spark, sf), GENES)


_AXES = f"""ga AS (SELECT gene, unmutated, CAST(row_number() OVER (ORDER BY unmutated DESC, gene) - 1 AS INTEGER) AS gene_index FROM (
    SELECT gene, count(*) FILTER (code = 0) AS unmutated FROM cells WHERE gene IN {_IN} GROUP BY gene) x),
  sa AS (SELECT tumor_sample_barcode, row_number() OVER (ORDER BY marks DESC, tumor_sample_barcode) - 1 AS sample_index FROM (
    SELECT tumor_sample_barcode, coalesce(list(gene_index ORDER BY gene_index DESC) FILTER (code <> 0), []) AS marks
    FROM cells JOIN ga USING (gene) GROUP BY tumor_sample_barcode) y)"""


@query("e5_heatmap_cells", sql(
    "SELECT sample_index, gene_index, code FROM cells JOIN ga USING (gene) JOIN sa USING (tumor_sample_barcode)", "cells", ctes=_AXES
))
def e5(spark, sf):
    return matrix.heatmap_cells(cells(spark, sf), GENES)


@query("f10_waterfall_order", sql("SELECT tumor_sample_barcode, sample_index FROM sa", "cells", ctes=_AXES))
def f10(spark, sf):
    return matrix.sample_axis(cells(spark, sf), GENES).select("tumor_sample_barcode", "sample_index")


@query("k5_oncoplot", sql(
    """SELECT tumor_sample_barcode, gene, sample_index, gene_index, code, annotation FROM cells JOIN ga USING (gene)
    JOIN sa USING (tumor_sample_barcode) WHERE code <> 0""", "cells", ctes=_AXES
))
def k5(spark, sf):
    parts = reports.oncoplot(cells(spark, sf), GENES)
    c = cells(spark, sf).filter("code <> 0")
    return (
        c.join(parts["genes"].select("gene", "gene_index"), "gene")
        .join(parts["samples"].select("tumor_sample_barcode", "sample_index"), "tumor_sample_barcode")
        .select("tumor_sample_barcode", "gene", "sample_index", "gene_index", "code", "annotation")
    )


_ALTERED = f"""al AS (SELECT gene, tumor_sample_barcode AS sample, variant_id, CASE variant_class WHEN 'Missense_Mutation' THEN 'missense'
    WHEN 'Nonsense_Mutation' THEN 'truncating' WHEN 'Frame_Shift_Del' THEN 'truncating' WHEN 'In_Frame_Ins' THEN 'inframe'
    WHEN 'Splice_Region' THEN 'splice_site' ELSE 'mutation' END AS alteration FROM variants WHERE gene IN {_IN}),
  allsamples AS (SELECT DISTINCT tumor_sample_barcode AS sample FROM variants)"""


@query("d32_alteration_matrix", sql(
    "SELECT gene, sample, string_agg(DISTINCT alteration, ';' ORDER BY alteration) AS types FROM al GROUP BY gene, sample", ctes=_ALTERED
))
def d32(spark, sf):
    m = matrix.alteration_matrix(matrix.altered(variants(spark, sf), GENES, roles=ROLES))
    return m.withColumn("types", F.array_join("types", ";"))


_FREQUENCY = """fr AS (SELECT gene, count(DISTINCT (sample, alteration)) AS alterations, count(DISTINCT sample) AS samples,
  (SELECT count(*) FROM allsamples) AS total FROM al GROUP BY gene)"""


@query("d33_gene_frequency", sql(
    """SELECT gene, alterations, samples, round(alterations::DOUBLE / total, 8) AS frequency, round(samples::DOUBLE / total, 8)
    AS sample_frequency FROM fr""", ctes=f"{_ALTERED}, {_FREQUENCY}"
))
def d33(spark, sf):
    v = variants(spark, sf)
    f = matrix.gene_frequency(v, matrix.altered(v, GENES, roles=ROLES), GENES, ROLES).drop("place")
    return f.withColumn("frequency", stats.rounded(F.col("frequency"), 8)).withColumn(
        "sample_frequency", stats.rounded(F.col("sample_frequency"), 8)
    )


@query("d34_sample_counts", sql("SELECT sample, count(*) AS alteration_count FROM al GROUP BY sample", ctes=_ALTERED))
def d34(spark, sf):
    return matrix.sample_counts(matrix.altered(variants(spark, sf), GENES, roles=ROLES))


@query("f1_sort", "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1000000")
def f1(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return ordering.sort(s, "s_acctbal", ["s_suppkey"], descending=True)


@query("f2_deep_page", sql(
    "SELECT variant_id, start_pos FROM variants ORDER BY start_pos DESC, variant_id LIMIT 500 OFFSET 30000"
))
def f2_deep(spark, sf):
    found = search.search(
        variants(spark, sf), sort_by="start_pos", descending=True, page=61, page_size=500, roles=ROLES
    )
    return found.select("variant_id", F.col("start_pos").cast("bigint").alias("start_pos"))


@query("f7_gene_order", sql(
    """SELECT gene, row_number() OVER (ORDER BY alterations DESC, array_position(['G3', 'G11', 'G25', 'G40', 'G7', 'G18'], gene)) - 1
    AS rank FROM fr""", ctes=f"{_ALTERED}, {_FREQUENCY}"
))
def f7(spark, sf):
    v = variants(spark, sf)
    f = matrix.gene_frequency(v, matrix.altered(v, GENES, roles=ROLES), GENES, ROLES)
    order = [F.col("alterations").desc(), F.col("place").asc()]
    return ordering.with_row_index(matrix.ordered_genes(f), order, "rank").select("gene", "rank")


@query("f7_custom_gene_order", sql(
    "SELECT gene, alterations FROM fr WHERE gene IN ('G25', 'G3', 'G7')", ctes=f"{_ALTERED}, {_FREQUENCY}"
))
def f7_custom(spark, sf):
    v = variants(spark, sf)
    f = matrix.gene_frequency(v, matrix.altered(v, GENES, roles=ROLES), GENES, ROLES)
    return matrix.ordered_genes(f, "custom", ["G25", "G3", "G7"]).select("gene", "alterations")


_COUNTED = """sc AS (SELECT s.sample, count(al.sample) AS alteration_count FROM allsamples s LEFT JOIN al ON s.sample = al.sample
  GROUP BY s.sample)"""


@query("f8_sample_order", sql(
    "SELECT sample, alteration_count FROM sc ORDER BY alteration_count DESC, sample LIMIT 1000000", ctes=f"{_ALTERED}, {_COUNTED}"
))
def f8(spark, sf):
    v = variants(spark, sf)
    s = matrix.samples_with_counts(v, matrix.altered(v, GENES, roles=ROLES), ROLES)
    return matrix.ordered_samples(s)


@query("f8_clinical_sample_order", sql(
    """SELECT sample, alteration_count, annotation FROM sc JOIN (SELECT tumor_sample_barcode AS sample, max_by(disease, variant_id)
    AS annotation FROM variants GROUP BY 1) a USING (sample)""", ctes=f"{_ALTERED}, {_COUNTED}"
))
def f8_clinical(spark, sf):
    v = variants(spark, sf)
    s = matrix.samples_with_counts(v, matrix.altered(v, GENES, roles=ROLES), ROLES)
    return matrix.ordered_samples(s, "clinical_annotation", annotation=matrix.clinical_annotation(v, "disease", ROLES))


@query("f9_top_samples", sql(
    "SELECT sample, alteration_count FROM sc ORDER BY alteration_count DESC, sample LIMIT 25", ctes=f"{_ALTERED}, {_COUNTED}"
))
def f9(spark, sf):
    v = variants(spark, sf)
    s = matrix.samples_with_counts(v, matrix.altered(v, GENES, roles=ROLES), ROLES)
    return matrix.top_samples(s, 25)


_TYPE_CELLS = ", ".join(
    f"coalesce(string_agg(DISTINCT CASE WHEN gene = '{g}' THEN alteration END, ';' ORDER BY CASE WHEN gene = '{g}' THEN alteration END), '') AS {g}"
    for g in GENES
)


@query("a14_type_matrix", sql(
    f"SELECT s.sample, {_TYPE_CELLS} FROM allsamples s LEFT JOIN al ON s.sample = al.sample GROUP BY s.sample", ctes=_ALTERED
))
def a14(spark, sf):
    v = variants(spark, sf)
    m = matrix.alteration_matrix(matrix.altered(v, GENES, roles=ROLES))
    return matrix.type_matrix(m, matrix.all_samples(v, ROLES), GENES)


@query("a15_mutation_records", sql(
    """SELECT DISTINCT gene AS "Hugo_Symbol", sample AS "Tumor_Sample_Barcode", alteration AS "Variant_Classification",
    'SNP' AS "Variant_Type" FROM al""", ctes=_ALTERED
))
def a15(spark, sf):
    m = matrix.alteration_matrix(matrix.altered(variants(spark, sf), GENES, roles=ROLES))
    return matrix.mutation_records(m)


@query("k14_oncoplot_matrix", sql(
    """SELECT gene, sample, string_agg(DISTINCT alteration, ';' ORDER BY alteration) AS types FROM al
    WHERE alteration IN ('missense', 'truncating') AND sample IN (SELECT sample FROM (
      SELECT s.sample, count(x.sample) AS n FROM allsamples s LEFT JOIN (SELECT * FROM al WHERE alteration IN ('missense', 'truncating'))
      x ON s.sample = x.sample GROUP BY s.sample ORDER BY n DESC, s.sample LIMIT 40) t)
    GROUP BY gene, sample""", ctes=_ALTERED
))
def k14(spark, sf):
    parts = reports.oncoplot_matrix(
        variants(spark, sf), GENES, categories=["missense", "truncating"], max_samples=40, roles=ROLES
    )
    return parts["matrix"].withColumn("types", F.array_join("types", ";"))


_FEW = "('S1', 'S4', 'S10', 'S25', 'S40', 'S77')"


@query("k14_gene_frequency_of_samples", sql(
    f"""SELECT g.gene, count(DISTINCT (x.sample, x.alteration)) FILTER (x.sample IS NOT NULL) AS alterations,
      count(DISTINCT x.sample) AS samples, round(count(DISTINCT x.sample)::DOUBLE / nullif((SELECT count(*) FROM allsamples
        WHERE sample IN {_FEW}), 0), 8) AS sample_frequency
    FROM (SELECT unnest(['G3', 'G11', 'G25', 'G40', 'G7', 'G18']) AS gene) g
    LEFT JOIN (SELECT * FROM al WHERE sample IN {_FEW}) x ON x.gene = g.gene GROUP BY g.gene""", ctes=_ALTERED
))
def k14_frequency(spark, sf):
    parts = reports.oncoplot_matrix(
        variants(spark, sf), GENES, samples=["S1", "S4", "S10", "S25", "S40", "S77"], roles=ROLES
    )
    out = parts["genes"].select("gene", "alterations", "samples", "sample_frequency")
    return out.withColumn("sample_frequency", stats.rounded(F.col("sample_frequency"), 8))


@query("k14_mutation_details", sql(
    f"""SELECT v.variant_id, v.gene, v.tumor_sample_barcode AS sample, v.variant_type, v.variant_class, v.protein_change,
      v.chrom AS chromosome, v.start_pos AS position FROM variants v WHERE v.gene IN {_IN}"""
))
def k14_details(spark, sf):
    return reports.oncoplot_matrix(variants(spark, sf), GENES, roles=ROLES)["details"]


#: The wide matrix has a row per sample, under the id column's name, and a column per gene of the variant fixture.
_AXIS = [f"G{n}" for n in range(50)]
_WIDE = "wide AS (SELECT tumor_sample_barcode AS \"Gene\", " + ", ".join(
    f"CAST(coalesce(max(CASE WHEN gene = '{g}' THEN code END), 0) AS INTEGER) AS {g}" for g in _AXIS
) + " FROM cells GROUP BY tumor_sample_barcode)"
_LONG = f"""long AS (SELECT "Gene", sample_id, evalue, CASE evalue WHEN 1 THEN 'Missense_Mutation' WHEN 4 THEN 'Frame_Shift_Del'
  WHEN 5 THEN 'Nonsense_Mutation' WHEN 8 THEN 'In_Frame_Ins' ELSE '' END AS annotation FROM
  (UNPIVOT wide ON {", ".join(_AXIS)} INTO NAME sample_id VALUE evalue) u)"""


def _wide(spark, sf):
    # the cells of a sample are in one task, which holds a row of the axis for its own samples only
    c = cells(spark, sf)
    codes = [F.coalesce(F.max(F.when(F.col("gene") == g, F.col("code"))), F.lit(0)).alias(g) for g in _AXIS]
    return c.groupBy(F.col("tumor_sample_barcode").alias("Gene")).agg(*codes)


@query("a12_melt", sql('SELECT "Gene", sample_id, evalue, annotation FROM long', "cells", ctes=f"{_WIDE}, {_LONG}"))
def a12(spark, sf):
    return matrix.melt(_wide(spark, sf), "Gene")


@query("a13_sorted_export", sql(
    'SELECT row_number() OVER (ORDER BY "Gene", sample_id) - 1 AS row_index, "Gene", sample_id, evalue FROM long',
    "cells", ctes=f"{_WIDE}, {_LONG}",
))
def a13(spark, sf):
    long = matrix.indexed(matrix.melt(_wide(spark, sf), "Gene"), ["Gene", "sample_id"])
    return export.written_and_read(long.select("row_index", "Gene", "sample_id", "evalue"), sort_by=["row_index"])


@query("e6_row_index", """SELECT user_id, event_type, n, row_number() OVER (ORDER BY n DESC, user_id, event_type) - 1 AS row_index FROM (
    SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) x""")
def e6(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return ordering.with_row_index(g, [F.col("n").desc(), F.col("user_id").asc(), F.col("event_type").asc()])


@query("h12_code_annotation", sql(
    """SELECT gene, tumor_sample_barcode, CASE code WHEN 1 THEN 'Missense_Mutation' WHEN 4 THEN 'Frame_Shift_Del'
    WHEN 5 THEN 'Nonsense_Mutation' WHEN 8 THEN 'In_Frame_Ins' ELSE 'None' END AS label FROM cells""", "cells"
))
def h12(spark, sf):
    return cells(spark, sf).select(
        "gene", "tumor_sample_barcode", genomics.code_annotation("code", empty="None").alias("label")
    )


# --- sample metrics --------------------------------------------------------

_TMB = """b AS (SELECT tumor_sample_barcode, variant_class, count(*) AS n FROM variants GROUP BY ALL),
  m AS (SELECT tumor_sample_barcode, CAST(sum(n) AS BIGINT) AS mutation_count, sum(n) / 38.0::DOUBLE AS tmb FROM b GROUP BY 1)"""


def _metrics(spark, sf):
    return metrics.tmb(metrics.burden(variants(spark, sf), ROLES), 38)


@query("d43_burden", sql('SELECT tumor_sample_barcode, variant_class, n AS "count" FROM b', ctes=_TMB))
def d43(spark, sf):
    return metrics.burden(variants(spark, sf), ROLES)


@query("d42_tmb_statistics", sql(
    "SELECT min(tmb) AS min_tmb, max(tmb) AS max_tmb, round(avg(tmb), 8) AS mean_tmb, count(tmb) AS sample_count FROM m", ctes=_TMB
))
def d42(spark, sf):
    return metrics.tmb_statistics(_metrics(spark, sf)).withColumn("mean_tmb", stats.rounded(F.col("mean_tmb"), 8))


@query("b24_metric_ranges_tmb", sql(
    "SELECT tumor_sample_barcode, tmb FROM m WHERE tmb >= 0.8 AND tmb <= 1.5 AND mutation_count <= 50", ctes=_TMB
))
def b24_tmb(spark, sf):
    out = metrics.select_samples(_metrics(spark, sf), tmb_range=(0.8, 1.5), count_range=(None, 50))
    return out.select("tumor_sample_barcode", "tmb")


@query("k16_sample_metrics", sql(
    """SELECT tumor_sample_barcode, tmb, mutation_count::DOUBLE AS mutation_count, 38.0::DOUBLE AS genome_size_mb FROM m
    WHERE tmb >= 0.5 AND mutation_count <= 60 ORDER BY tmb DESC, tumor_sample_barcode LIMIT 50 OFFSET 50""", ctes=_TMB,
))
def k16_metrics(spark, sf):
    stored = {metrics.metric_table("cohort", "tmb"): _metrics(spark, sf)}
    return reports.sample_metrics(
        stored["cohort_sample_tmb"], tmb_range=(0.5, None), count_range=(None, 60), sort_by="tmb", descending=True, page=2,
        page_size=50,
    )


@query("k16_high_tmb_samples", sql(
    "SELECT tumor_sample_barcode, tmb, mutation_count, 38.0::DOUBLE AS genome_size_mb FROM m WHERE tmb >= 1.2 ORDER BY tmb DESC, tumor_sample_barcode LIMIT 30",
    ctes=_TMB,
))
def k16(spark, sf):
    return metrics.high_tmb(_metrics(spark, sf), 1.2, 30)
