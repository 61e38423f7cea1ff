"""Checked queries for positions, spectra, comparison and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import genomics, stats, text
from varloom.operators import compare as cmp
from varloom.operators import position, signature
from varloom.plans import reports
from varloom.registry.core import query
from varloom.registry.fixtures import ROLES, domains, sql, table, variants

# --- positions -------------------------------------------------------------


@query("d23_fixed_windows", sql(
    """SELECT chrom AS chromosome, start_pos // 500 * 500 AS window_start, start_pos // 500 * 500 + 500 AS window_end,
    count(*) AS mutation_count, min(start_pos) AS min_position, max(start_pos) AS max_position,
    string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM variants GROUP BY chrom, start_pos // 500 * 500
    HAVING count(*) >= 200"""
))
def d23(spark, sf):
    out = position.fixed_windows(variants(spark, sf), 500, 200, ROLES)
    return out.withColumn("genes", F.array_join("genes", ","))


@query("d23_gene_windows", sql(
    """SELECT gene, chrom AS chromosome, count(*) AS mutation_count, min(start_pos) AS window_start, max(start_pos) AS window_end
    FROM variants GROUP BY gene, chrom HAVING count(*) >= 1150"""
))
def d23_gene(spark, sf):
    return position.gene_windows(variants(spark, sf), 1150, ROLES)


@query("d24_density", sql(
    """SELECT chrom AS chromosome, start_pos // 700 * 700 AS bin_start, start_pos // 700 * 700 + 700 AS bin_end, count(*) AS
    mutation_count, round(count(*) / 700.0::DOUBLE * 1000, 3) AS density FROM variants GROUP BY chrom, start_pos // 700"""
))
def d24(spark, sf):
    return position.density(variants(spark, sf), 700, ROLES)


@query("d25_region_summary", sql(
    """SELECT chrom AS chromosome, start_pos AS position, count(*) AS mutation_count, string_agg(DISTINCT gene, ',' ORDER BY gene)
    AS genes, string_agg(DISTINCT variant_class, ',' ORDER BY variant_class) AS variant_classes FROM variants
    GROUP BY chrom, start_pos"""
))
def d25(spark, sf):
    out = position.by_position(variants(spark, sf), ROLES)
    return out.withColumn("genes", F.array_join("genes", ",")).withColumn(
        "variant_classes", F.array_join("variant_classes", ",")
    )


_RESIDUE = "CAST(regexp_extract(protein_change, '([0-9]+)', 1) AS BIGINT)"


@query("d26_codons", sql(
    f"""SELECT gene, {_RESIDUE} AS protein_position, count(*) AS mutation_count, string_agg(DISTINCT protein_change, ',' ORDER BY
    protein_change) AS protein_changes FROM variants WHERE gene = 'G12' GROUP BY gene, {_RESIDUE}"""
))
def d26(spark, sf):
    out = position.by_codon(variants(spark, sf), "G12", ROLES)
    return out.withColumn("protein_changes", F.array_join("protein_changes", ","))


@query("e4_sliding_windows", sql(
    """SELECT p.chrom AS chromosome, p.start_pos AS window_start, p.start_pos + 50 AS window_end, CAST(sum(q.n) AS BIGINT) AS
    mutation_count FROM pts p JOIN pts q ON p.chrom = q.chrom AND q.start_pos BETWEEN p.start_pos AND p.start_pos + 49
    GROUP BY p.chrom, p.start_pos HAVING sum(q.n) >= 25""",
    ctes="pts AS (SELECT chrom, start_pos, count(*) AS n FROM variants GROUP BY chrom, start_pos)",
))
def e4_sliding(spark, sf):
    return position.sliding_windows(variants(spark, sf), 50, 25, chunk=1000, roles=ROLES)


_HOTSPOTS = f"""pts AS (SELECT gene, {_RESIDUE} AS pos, count(*) AS n FROM variants
    GROUP BY ALL),
  w AS (SELECT gene, pos, n, sum(n) OVER (PARTITION BY gene ORDER BY pos RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead,
    min(pos) OVER (PARTITION BY gene) AS first_pos FROM pts),
  walk AS (SELECT gene, pos, ahead FROM w WHERE pos = first_pos
    UNION ALL SELECT x.gene, x.pos, x.ahead FROM (
      SELECT w.gene, w.pos, w.ahead, row_number() OVER (PARTITION BY w.gene ORDER BY w.pos) AS rn FROM walk JOIN w
      ON w.gene = walk.gene AND w.pos >= CASE WHEN walk.ahead >= 6 THEN walk.pos + 10 ELSE walk.pos + 1 END) x WHERE rn = 1),
  hot AS (SELECT gene, pos AS hotspot_start FROM walk WHERE ahead >= 6)"""


@query("e4_greedy_hotspots", sql(
    """SELECT hot.gene, hotspot_start, hotspot_start + 9 AS hotspot_end, CAST(sum(n * pos) // sum(n) AS BIGINT) AS hotspot_center,
    CAST(sum(n) AS BIGINT) AS mutation_count, round(sum(n) / 10.0::DOUBLE, 3) AS mutations_per_residue,
    string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, string_agg(CAST(n AS VARCHAR), ',' ORDER BY pos) AS position_counts
    FROM hot JOIN pts ON hot.gene = pts.gene AND pos BETWEEN hotspot_start AND hotspot_start + 9
    GROUP BY hot.gene, hotspot_start""", ctes=_HOTSPOTS,
).replace("WITH ", "WITH RECURSIVE ", 1))
def e4(spark, sf):
    rows = variants(spark, sf)
    out = position.greedy_hotspots(rows, 10, 6, ROLES)
    for c in ("positions", "position_counts"):
        out = out.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
    return out


@query("d41_domain_enrichment", sql(
    f"""SELECT coalesce(domain_name, domain_id) AS domain_name, domain_id, count(*) AS mutation_count, count(DISTINCT v.gene) AS
    gene_count, string_agg(DISTINCT v.gene, ',' ORDER BY v.gene) AS genes, round(count(*)::DOUBLE / (SELECT count(*) FROM variants), 4)
    AS frequency FROM variants v JOIN domains d ON v.gene = d.gene AND {_RESIDUE} BETWEEN domain_start AND domain_end
    GROUP BY 1, 2""", "variants", "domains",
))
def d41(spark, sf):
    out = position.domain_enrichment(variants(spark, sf), domains(spark, sf), roles=ROLES)
    return out.withColumn("genes", F.array_join("genes", ","))


@query("k9_position_analysis", sql(
    """SELECT chrom AS chromosome, start_pos // 1000 * 1000 AS bin_start, start_pos // 1000 * 1000 + 1000 AS bin_end, count(*) AS
    mutation_count, round(count(*) / 1000.0::DOUBLE * 1000, 3) AS density FROM variants
    GROUP BY chrom, start_pos // 1000"""
))
def k9(spark, sf):
    return reports.position_analysis(variants(spark, sf), "density", ROLES, bin_size=1000)


@query("k9_sorted_density", sql(
    """SELECT chrom AS chromosome, start_pos // 1000 * 1000 AS bin_start, count(*) AS mutation_count FROM variants
    GROUP BY chrom, start_pos // 1000 ORDER BY mutation_count DESC, chromosome, bin_start LIMIT 25"""
))
def k9_sorted(spark, sf):
    out = reports.position_analysis(
        variants(spark, sf), "density", ROLES, order_by="mutation_count", descending=True, limit=25, bin_size=1000
    )
    return out.select("chromosome", "bin_start", "mutation_count")


@query("k15_protein_mapping", sql(
    f"""SELECT coalesce(d.domain_id, 'none') AS domain, count(*) AS n FROM variants v LEFT JOIN domains d ON v.gene = d.gene
    AND {_RESIDUE} BETWEEN domain_start AND domain_end WHERE v.gene IN ('G1', 'G2', 'G3') GROUP BY 1""", "variants", "domains",
))
def k15(spark, sf):
    out = reports.protein_mapping(
        variants(spark, sf), "domain_mapping", domains(spark, sf), ["G1", "G2", "G3"], ROLES
    )
    return out.groupBy(F.coalesce("domain_id", F.lit("none")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


# --- spectra ---------------------------------------------------------------

_SUB = """CASE WHEN ref_allele IN ('A', 'G') THEN translate(ref_allele, 'ACGT', 'TGCA') || '>' || translate(tumor_seq_allele2, 'ACGT', 'TGCA')
  ELSE ref_allele || '>' || tumor_seq_allele2 END"""
_CTX = """CASE WHEN ref_allele IN ('A', 'G') THEN reverse(translate(trinucleotide_context, 'ACGT', 'TGCA'))
  ELSE trinucleotide_context END"""
_PROFILE = f"""snp AS (SELECT *, {_SUB} AS sub, {_CTX} AS ctx FROM variants),
  axis AS (SELECT s || '_' || a || left(s, 1) || b AS channel, s, a || left(s, 1) || b AS context
    FROM unnest(['C>A', 'C>G', 'C>T', 'T>A', 'T>C', 'T>G']) AS x(s), unnest(['A', 'C', 'G', 'T']) AS y(a),
    unnest(['A', 'C', 'G', 'T']) AS z(b)),
  prof AS (SELECT axis.channel, s AS substitution, context, count(snp.sub) AS mutation_count FROM axis LEFT JOIN snp
    ON snp.sub || '_' || snp.ctx = axis.channel AND substr(trinucleotide_context, 2, 1) = ref_allele GROUP BY ALL)"""


@query("d27_channel_profile", sql(
    """SELECT channel, substitution, context, mutation_count, round(mutation_count / sum(mutation_count) OVER (), 8) AS frequency
    FROM prof""", ctes=_PROFILE,
))
def d27(spark, sf):
    out = signature.profile(variants(spark, sf), ROLES)
    return out.withColumn("frequency", stats.rounded(F.col("frequency"), 8))


@query("d28_normalised_profile", sql(
    "SELECT channel, round(mutation_count / sum(mutation_count) OVER (), 8) AS frequency FROM prof",
    ctes=_PROFILE,
))
def d28(spark, sf):
    out = signature.profile(variants(spark, sf), ROLES)
    return out.select("channel", stats.rounded(F.col("frequency"), 8).alias("frequency"))


@query("d29_nested_profile", sql(
    """SELECT substitution, string_agg(context || '=' || CAST(mutation_count AS VARCHAR), ',' ORDER BY context) AS contexts
    FROM prof GROUP BY substitution""", ctes=_PROFILE,
))
def d29(spark, sf):
    counts = signature.profile(variants(spark, sf), ROLES).withColumn("frequency", F.col("mutation_count"))
    entries = F.array_sort(F.map_entries("contexts"))
    joined = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return signature.nested_profile(counts).select("substitution", joined.alias("contexts"))


_SLUGS = [s.replace(">", "_") for s in genomics.SUBSTITUTIONS]
_SIX = ", ".join(f"count(*) FILTER (sub = '{s.replace('_', '>')}') AS {s}" for s in _SLUGS)
_SIX_SHARES = ", ".join(f"round(coalesce({s} / nullif(total_substitutions, 0)::DOUBLE, 0), 8) AS {s}_freq" for s in _SLUGS)
_SPECTRUM = f"""sp AS (SELECT tumor_sample_barcode AS sample, count(*) AS total_mutations, count(sub) AS total_substitutions, {_SIX}
  FROM snp GROUP BY 1)"""


@query("d30_sample_spectrum", sql(f"SELECT *, {_SIX_SHARES} FROM sp", ctes=f"{_PROFILE}, {_SPECTRUM}"))
def d30(spark, sf):
    out = signature.sample_spectrum(variants(spark, sf), ROLES)
    for s in _SLUGS:
        out = out.withColumn(f"{s}_freq", stats.rounded(F.col(f"{s}_freq"), 8))
    return out


@query("d31_cosine", sql(
    """SELECT a.gene, round(sum(a.n * coalesce(r.n, 0))::DOUBLE / (sqrt(sum(a.n * a.n)::DOUBLE)
      * (SELECT sqrt(sum(n * n)::DOUBLE) FROM ref)), 8) AS cosine FROM ch a LEFT JOIN ref r USING (channel) GROUP BY a.gene""",
    ctes=f"""{_PROFILE}, ch AS (SELECT gene, sub || '_' || ctx AS channel, count(*) AS n FROM snp
      WHERE substr(trinucleotide_context, 2, 1) = ref_allele GROUP BY ALL),
    ref AS (SELECT channel, sum(n) AS n FROM ch GROUP BY channel)""",
))
def d31(spark, sf):
    v = variants(spark, sf)
    out = signature.cosine_to_reference(
        signature.channel_counts(v, ["gene"], ROLES), signature.profile(v, ROLES), "gene"
    )
    return out.withColumn("cosine", stats.rounded(F.col("cosine"), 8))


@query("d44_sample_titv", sql(
    """SELECT sample, C_T + T_C AS "Ti", total_substitutions - C_T - T_C AS "Tv",
    round((C_T + T_C)::DOUBLE / nullif(total_substitutions, 0), 8) AS "Ti_fraction",
    round((total_substitutions - C_T - T_C)::DOUBLE / nullif(total_substitutions, 0), 8) AS "Tv_fraction" FROM sp""",
    ctes=f"{_PROFILE}, {_SPECTRUM}",
))
def d44(spark, sf):
    out = signature.sample_titv(variants(spark, sf), ROLES).select("sample", "Ti", "Tv", "Ti_fraction", "Tv_fraction")
    for c in ("Ti_fraction", "Tv_fraction"):
        out = out.withColumn(c, stats.rounded(F.col(c), 8))
    return out


@query("d44_titv_long", sql(
    'SELECT tumor_sample_barcode, sub AS snv_class, count(*) AS "count" FROM snp GROUP BY 1, 2', ctes=_PROFILE
))
def d44_long(spark, sf):
    return signature.titv_long(variants(spark, sf), ROLES)


@query("k10_signature_analysis", sql(
    """SELECT substitution, sum(mutation_count)::BIGINT AS n FROM prof GROUP BY substitution""", ctes=_PROFILE
))
def k10(spark, sf):
    out = reports.signature_analysis(variants(spark, sf), "profile", ROLES)
    return out.groupBy("substitution").agg(F.sum("mutation_count").alias("n"))


# --- comparison ------------------------------------------------------------


@query("d37_dataset_summary", sql(
    """SELECT table_name AS dataset, count(*) AS total_mutations, count(DISTINCT tumor_sample_barcode) AS total_samples,
    count(DISTINCT gene) AS unique_genes, round(count(*)::DOUBLE / count(DISTINCT tumor_sample_barcode), 4) AS mutation_rate
    FROM variants GROUP BY table_name"""
))
def d37(spark, sf):
    return cmp.dataset_summary(cmp.cohorts(variants(spark, sf), roles=ROLES), ROLES)


_TWO = """c AS (SELECT gene, count(*) FILTER (table_name = 'cohort_0') AS x, count(*) FILTER (table_name = 'cohort_1') AS y,
    count(DISTINCT CASE WHEN table_name = 'cohort_0' THEN tumor_sample_barcode END) AS sx,
    count(DISTINCT CASE WHEN table_name = 'cohort_1' THEN tumor_sample_barcode END) AS sy
    FROM variants GROUP BY gene),
  t AS (SELECT count(DISTINCT CASE WHEN table_name = 'cohort_0' THEN tumor_sample_barcode END) AS tx,
    count(DISTINCT CASE WHEN table_name = 'cohort_1' THEN tumor_sample_barcode END) AS ty
    FROM variants),
  ct AS (SELECT * FROM c CROSS JOIN t WHERE x + y > 0)"""


def _two(spark, sf):
    v = variants(spark, sf)
    return cmp.cohorts(v, ["cohort_0", "cohort_1"], ROLES), ["cohort_0", "cohort_1"]


@query("d38_gene_frequency", sql(
    """SELECT gene, x AS cohort_0_count, round(x / tx::DOUBLE, 4) AS cohort_0_frequency, y AS cohort_1_count,
    round(y / ty::DOUBLE, 4) AS cohort_1_frequency FROM ct""", ctes=_TWO
))
def d38(spark, sf):
    return cmp.gene_frequencies(*_two(spark, sf), roles=ROLES)


_FISHER_TWO = """hh AS (SELECT gene, tx, ty, sx, sy, i, lgamma(tx + 1) - lgamma(i + 1) - lgamma(tx - i + 1) + lgamma(ty + 1)
    - lgamma(sx + sy - i + 1) - lgamma(ty - sx - sy + i + 1) - (lgamma(tx + ty + 1) - lgamma(sx + sy + 1) - lgamma(tx + ty - sx - sy + 1)) AS lp
    FROM ct, unnest(generate_series(greatest(0, sx + sy - ty), least(tx, sx + sy))) AS u(i)),
  oo AS (SELECT gene, max(CASE WHEN i = sx THEN lp END) AS lo FROM hh GROUP BY gene),
  pp AS (SELECT hh.gene, least(1.0::DOUBLE, sum(CASE WHEN lp <= lo + ln(1 + 1e-7) THEN exp(lp) ELSE 0 END)) AS p
    FROM hh JOIN oo ON hh.gene = oo.gene GROUP BY hh.gene)"""


@query("d52_two_dataset_fisher", sql(
    """SELECT ct.gene, x AS cohort_0_count, y AS cohort_1_count, round(abs(x / tx::DOUBLE - y / ty::DOUBLE), 4) AS
    frequency_difference, round(sx::DOUBLE * (ty - sy) / ((tx - sx)::DOUBLE * sy), 4) AS odds_ratio, round(p, 8) AS p_value
    FROM ct JOIN pp ON ct.gene = pp.gene WHERE p <= 0.5""", ctes=f"{_TWO}, {_FISHER_TWO}"
))
def d52(spark, sf):
    out = cmp.gene_frequencies(*_two(spark, sf), test="fisher_exact", p_value_threshold=0.5, roles=ROLES)
    return out.withColumn("p_value", stats.rounded(F.col("p_value"), 8)).drop("cohort_0_frequency", "cohort_1_frequency")


@query("d53_chi_square", sql(
    """SELECT gene, round(power(sx - e1, 2) / e1 + power(sy - e2, 2) / e2, 8) AS chi_square FROM (SELECT gene, sx, sy,
    (sx + sy) * tx::DOUBLE / (tx + ty) AS e1, (sx + sy) * ty::DOUBLE / (tx + ty) AS e2 FROM ct) x""", ctes=_TWO
))
def d53(spark, sf):
    out = cmp.gene_frequencies(*_two(spark, sf), test="chi_square", roles=ROLES)
    return out.select("gene", stats.rounded(F.col("chi_square"), 8).alias("chi_square"))


# p = erfc(sqrt(x / 2)): Simpson's rule over exp(-t * t) from there to 8 further on, in 2000 steps
@query("d53_chi_square_p", sql(
    """SELECT gene, round(2 / sqrt(pi()) * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * exp(-power(z + i * 0.004::DOUBLE, 2))) * 0.004::DOUBLE / 3, 8) AS p_value
    FROM (SELECT gene, sqrt((power(sx - e1, 2) / e1 + power(sy - e2, 2) / e2) / 2) AS z FROM (SELECT gene, sx, sy,
      (sx + sy) * tx::DOUBLE / (tx + ty) AS e1, (sx + sy) * ty::DOUBLE / (tx + ty) AS e2 FROM ct) x) y,
      unnest(generate_series(0, 2000)) AS u(i) GROUP BY gene""", ctes=_TWO
))
def d53_p(spark, sf):
    out = cmp.gene_frequencies(*_two(spark, sf), test="chi_square", roles=ROLES)
    return out.select("gene", stats.rounded(F.col("p_value"), 8).alias("p_value"))


@query("d39_variant_overlap", sql(
    """SELECT chrom || ':' || CAST(start_pos AS VARCHAR) || ':' || ref_allele || ':' || tumor_seq_allele2 AS variant_key,
    chrom AS chromosome, start_pos AS position, ref_allele AS reference_allele, tumor_seq_allele2 AS alternate_allele,
    string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS present_in_datasets, CAST(count(DISTINCT table_name) AS INTEGER)
    AS dataset_count, count(DISTINCT table_name) > 1 AS is_shared, count(DISTINCT table_name) = 1 AS is_unique
    FROM variants GROUP BY ALL HAVING count(DISTINCT table_name) >= 2"""
))
def d39(spark, sf):
    out = cmp.variant_overlap(cmp.cohorts(variants(spark, sf), roles=ROLES), 2, ROLES).drop("gene")
    return out.withColumn("present_in_datasets", F.array_join("present_in_datasets", ","))


@query("d40_sample_statistics", sql(
    """SELECT table_name AS dataset, count(*) AS total_samples, CAST(sum(n) AS BIGINT) AS total_mutations,
    count(*) AS samples_with_mutations, round(avg(n), 2) AS mean_mutations_per_sample, max(n) AS max_mutations_per_sample,
    min(n) AS min_mutations_per_sample, any_value(g) AS unique_genes FROM (SELECT table_name, tumor_sample_barcode, count(*) AS n
      FROM variants GROUP BY 1, 2) x JOIN (SELECT table_name AS tn, count(DISTINCT gene) AS g FROM variants GROUP BY 1) y
      ON x.table_name = y.tn GROUP BY table_name"""
))
def d40(spark, sf):
    return cmp.sample_statistics(cmp.cohorts(variants(spark, sf), roles=ROLES), ROLES)


@query("k11_compare_datasets", sql(
    """SELECT gene, x AS cohort_0_count, y AS cohort_1_count FROM ct WHERE gene IN ('G1', 'G2', 'G3')""", ctes=_TWO
))
def k11(spark, sf):
    data, labels = _two(spark, sf)
    picked = cmp.restricted(data, genes=["G1", "G2", "G3"], roles=ROLES)
    out = reports.compare_datasets(picked, "mutation_frequency", labels, ROLES)
    return out.select("gene", "cohort_0_count", "cohort_1_count")


# --- scalar functions ------------------------------------------------------


@query("h1_chromosome", sql("SELECT variant_id, replace(chrom, 'chr', '') AS chrom FROM variants"))
def h1(spark, sf):
    return variants(spark, sf).select("variant_id", text.chromosome("chrom").alias("chrom"))


@query("h2_concat", "SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN event_type END, '') || '|' || CAST(user_id AS VARCHAR) || '|' AS label FROM events")
def h2(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.when(F.col("event_id") % 3 > 0, F.col("event_type")))
    e = e.withColumn("nothing", F.lit(None).cast("string"))
    return e.select("event_id", text.joined(["t", "user_id", "nothing"], "|").alias("label"))


@query("h6_reverse_complement", sql(
    "SELECT variant_id, reverse(translate(trinucleotide_context, 'ACGT', 'TGCA')) AS rc FROM variants"
))
def h6(spark, sf):
    return variants(spark, sf).select("variant_id", genomics.reverse_complement("trinucleotide_context").alias("rc"))


@query("h7_channel", sql(
    f"""SELECT variant_id, {_SUB} AS substitution, CASE WHEN substr(trinucleotide_context, 2, 1) = ref_allele
    THEN {_SUB} || '_' || {_CTX} END AS channel FROM variants"""
))
def h7(spark, sf):
    return variants(spark, sf).select(
        "variant_id",
        genomics.pyrimidine_substitution("ref_allele", "tumor_seq_allele2").alias("substitution"),
        genomics.channel("ref_allele", "tumor_seq_allele2", "trinucleotide_context").alias("channel"),
    )


@query("h8_alteration_category", sql(
    """SELECT variant_id, CASE variant_class WHEN 'Missense_Mutation' THEN 'missense' WHEN 'Nonsense_Mutation' THEN 'truncating'
    WHEN 'Frame_Shift_Del' THEN 'truncating' WHEN 'In_Frame_Ins' THEN 'inframe' WHEN 'Splice_Region' THEN 'splice_site'
    ELSE 'mutation' END AS category FROM variants"""
))
def h8(spark, sf):
    return variants(spark, sf).select("variant_id", genomics.alteration_category("variant_class").alias("category"))


@query("h9_titv", sql(
    """SELECT gene, count(*) FILTER (pair IN ('AG', 'GA', 'CT', 'TC')) AS ti, count(*) FILTER (pair NOT IN ('AG', 'GA', 'CT', 'TC'))
    AS tv FROM (SELECT gene, ref_allele || tumor_seq_allele2 AS pair FROM variants) x GROUP BY gene"""
))
def h9(spark, sf):
    kind = genomics.titv_class("ref_allele", "tumor_seq_allele2")
    v = variants(spark, sf).select("gene", kind.alias("kind"))
    return v.groupBy("gene").agg(F.count_if(F.col("kind") == "Ti").alias("ti"), F.count_if(F.col("kind") == "Tv").alias("tv"))


@query("h10_amino_acid_position", sql(f"SELECT variant_id, {_RESIDUE} AS residue FROM variants"))
def h10(spark, sf):
    return variants(spark, sf).select("variant_id", genomics.amino_acid_position("protein_change").alias("residue"))


@query("h11_region_parse", sql(
    """SELECT variant_id, chrom, start_pos, CASE WHEN variant_type = 'SNP' THEN start_pos ELSE end_pos END AS end_pos,
    CASE WHEN variant_type = 'SNP' OR start_pos = end_pos THEN chrom || ':' || CAST(start_pos AS VARCHAR)
    ELSE chrom || ':' || CAST(start_pos AS VARCHAR) || '-' || CAST(end_pos AS VARCHAR) END AS label FROM variants"""
))
def h11(spark, sf):
    v = variants(spark, sf)
    grouped = F.format_number("start_pos", 0)
    point = F.concat(F.replace("chrom", F.lit("chr"), F.lit("")), F.lit(":"), grouped)
    raw = F.when(F.col("variant_type") == "SNP", point).otherwise(text.region_text("chrom", "start_pos", "end_pos"))
    v = v.select("variant_id", raw.alias("raw"))
    v = v.select(
        "variant_id", text.region_chrom("raw").alias("chrom"), text.region_start("raw").alias("start_pos"),
        text.region_end("raw").alias("end_pos"),
    )
    return v.withColumn("label", text.region_label("chrom", "start_pos", "end_pos"))


@query("h16_variant_key", sql(
    """SELECT variant_id, CASE WHEN variant_type = 'DEL' THEN chrom || ':' || CAST(start_pos AS VARCHAR) ELSE
    chrom || ':' || CAST(start_pos AS VARCHAR) || ':' || ref_allele || ':' || tumor_seq_allele2 END AS key FROM variants"""
))
def h16(spark, sf):
    v = variants(spark, sf).withColumn("alt", F.when(F.col("variant_type") != "DEL", F.col("tumor_seq_allele2")))
    return v.select("variant_id", genomics.variant_key("chrom", "start_pos", "ref_allele", "alt").alias("key"))


@query("h17_clean_items", "SELECT DISTINCT upper(trim(event_type)) || CAST(event_id % 4 AS VARCHAR) AS item FROM events")
def h17(spark, sf):
    from varloom.operators.suggest import distinct_items

    raw = F.concat(F.lit("  "), F.initcap("event_type"), F.col("event_id") % 4, F.lit(" "))
    return distinct_items(table(spark, sf, "events").select(raw.alias("item")))


@query("h19_first_non_empty", sql(
    """SELECT variant_id, coalesce(CASE WHEN variant_type <> 'SNP' THEN gene END, disease) AS label FROM variants"""
))
def h19(spark, sf):
    v = variants(spark, sf).withColumn("a", F.when(F.col("variant_type") != "SNP", F.col("gene")).otherwise(""))
    return v.select("variant_id", text.first_non_empty(["a", "disease"]).alias("label"))


@query("h20_indel_and_cpg", sql(
    """SELECT indel, cpg, count(*) AS n FROM (SELECT CASE variant_type WHEN 'INS' THEN 3 WHEN 'DEL' THEN -1 ELSE 0 END AS indel,
      contains(trinucleotide_context, 'CG') AS cpg FROM variants) x GROUP BY indel, cpg"""
))
def h20(spark, sf):
    v = variants(spark, sf)
    kind = F.col("variant_type")
    ref = F.when(kind == "INS", "-").otherwise(F.col("ref_allele"))
    alt = F.when(kind == "INS", "ACG").when(kind == "DEL", "-").otherwise(F.col("tumor_seq_allele2"))
    v = v.withColumn("r", ref).withColumn("a", alt)
    out = v.select(genomics.indel_length("r", "a").alias("indel"), genomics.is_cpg("trinucleotide_context").alias("cpg"))
    return out.groupBy("indel", "cpg").agg(F.count(F.lit(1)).alias("n"))
