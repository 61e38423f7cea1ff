"""Checked queries for joins, set operations, pathways and the gene graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import stats
from varloom.operators import cooccurrence as co
from varloom.operators import graph, matrix, metrics, ordering, pathway, position, regions, search, sets, suggest
from varloom.operators import aggregate as agg
from varloom.operators import compare as cmp
from varloom.plans import reports, steps
from varloom.registry.core import query
from varloom.registry.fixtures import ROLES, domains, edges, part_cells, part_edges, pathway_genes, pathways, sql, table, variants

# --- C: joins --------------------------------------------------------------

_IN_PATHWAYS = "SELECT variant_id, gene FROM variants WHERE gene IN (SELECT gene FROM pathway_genes pg {join} WHERE {where})"


@query(
    "c1_pathway_by_name",
    sql(
        _IN_PATHWAYS.format(join="JOIN pathways p ON p.id = pg.pathway_id", where="pathway_name IN ('Pathway P1', 'Pathway P8')"),
        "variants", "pathways",
    ),
)
def c1(spark, sf):
    v = variants(spark, sf)
    out = regions.in_pathways(v, pathway_genes(spark, sf), pathways(spark, sf), names=["Pathway P1", "Pathway P8"], roles=ROLES)
    return out.select("variant_id", "gene")


@query(
    "c1_pathway_by_name_part",
    sql(
        _IN_PATHWAYS.format(join="JOIN pathways p ON p.id = pg.pathway_id", where="pathway_name ILIKE '%way p1%'"),
        "variants", "pathways",
    ),
)
def c1_part(spark, sf):
    v = variants(spark, sf)
    out = regions.in_pathways(
        v, pathway_genes(spark, sf), pathways(spark, sf), names=["WAY p1"], match="contains", roles=ROLES
    )
    return out.select("variant_id", "gene")


@query(
    "c2_pathway_by_id",
    sql(_IN_PATHWAYS.format(join="", where="pathway_id IN ('P2', 'P9', 'P10')"), "variants", "pathway_genes"),
)
def c2(spark, sf):
    out = regions.in_pathways(variants(spark, sf), pathway_genes(spark, sf), ids=["P2", "P9", "P10"], roles=ROLES)
    return out.select("variant_id", "gene")


_GENOMIC = """(chrom = 'chr2' AND start_pos <= 1012000 AND end_pos >= 1010000 OR chrom = 'chr9' AND start_pos <= 1082900
  AND end_pos >= 1080000) AND gene IN (SELECT gene FROM pathway_genes WHERE pathway_id IN ('P1', 'P8', 'P9'))"""


def _genomic(spark, sf):
    return regions.GenomicFilter(
        positions=[
            {"chromosome": "2", "start": 1010000, "end": 1012000}, {"chromosome": "chr9", "start": 1080000, "end": 1082900},
        ],
        pathway_ids=["P1", "P8", "P9"],
        association=pathway_genes(spark, sf),
    )


@query(
    "k1_search_in_pathway",
    sql(
        f"""SELECT variant_id, gene, start_pos::DOUBLE AS start_pos, end_pos::DOUBLE AS end_pos FROM variants
        WHERE variant_class <> 'Silent' AND {_GENOMIC} ORDER BY start_pos DESC, variant_id LIMIT 40 OFFSET 40""",
        "variants", "pathway_genes",
    ),
)
def k1_pathway(spark, sf):
    out = search.search(
        variants(spark, sf), {"column": "variant_class", "operator": "neq", "value": "Silent"}, sort_by="start_pos",
        descending=True, page=2, page_size=40, genomic=_genomic(spark, sf), roles=ROLES,
    )
    return out.select("variant_id", "gene", "start_pos", "end_pos")


@query(
    "k2_aggregate_in_pathway",
    sql(
        f"""SELECT gene, variant_type, round(n * 100.0::DOUBLE / t, 2) AS aggregated_value, t AS group_total FROM (
        SELECT gene, variant_type, count(variant_id) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS t FROM variants
        WHERE {_GENOMIC} GROUP BY gene, variant_type) x""",
        "variants", "pathway_genes",
    ),
)
def k2_pathway(spark, sf):
    return agg.aggregate(
        variants(spark, sf), "variant_id", ["gene", "variant_type"], "percentage", genomic=_genomic(spark, sf), roles=ROLES
    )


@query(
    "d7_percentage_in_pathway",
    sql(
        f"""SELECT round((SELECT count(variant_id) FROM variants WHERE {_GENOMIC} AND variant_type = 'SNP')::DOUBLE
        / count(variant_id) * 100, 2) AS value FROM variants""",
        "variants", "pathway_genes",
    ),
)
def d7_pathway(spark, sf):
    return agg.aggregate(
        variants(spark, sf), "variant_id", None, "percentage", filters={"column": "variant_type", "value": "SNP"},
        genomic=_genomic(spark, sf), roles=ROLES,
    )


_PATHWAY_GENE_LISTS = """SELECT id, pathway_name, count(DISTINCT gene) AS gene_count,
  string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM pathways JOIN pathway_genes ON id = pathway_id"""


@query("c3_pathway_genes_grouped", sql(_PATHWAY_GENE_LISTS + " GROUP BY id, pathway_name", "pathways"))
def c3(spark, sf):
    out = pathway.gene_counts(pathway_genes(spark, sf), pathways(spark, sf))
    return out.withColumn("genes", F.array_join("genes", ","))


@query(
    "c4_pathways_of_genes",
    sql(
        """SELECT gene, pathway_id, pathway_name FROM pathway_genes JOIN pathways ON id = pathway_id
        WHERE gene IN ('G1', 'G8', 'G30') AND pathway_name ILIKE '%p1%'""",
        "pathways",
    ),
)
def c4(spark, sf):
    return pathway.pathways_of_genes(pathway_genes(spark, sf), pathways(spark, sf), ["G1", "G8", "G30"], "p1")


@query(
    "c5_pathway_suggestions",
    sql(
        """SELECT p.id, p.pathway_name, string_agg(gene, ',' ORDER BY gene) AS genes FROM
        (SELECT * FROM pathways WHERE pathway_name ILIKE 'pathway p1%' ORDER BY pathway_name, id LIMIT 4) p
        LEFT JOIN pathway_genes ON p.id = pathway_id GROUP BY p.id, p.pathway_name""",
        "pathways",
    ),
)
def c5(spark, sf):
    out = suggest.pathways(pathways(spark, sf), pathway_genes(spark, sf), "pathway p1", 4)
    return out.withColumn("genes", F.array_join("genes", ","))


@query(
    "c6_lookups",
    """SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def c6(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return steps.with_lookups(
        o, [(c, "o_custkey", "c_custkey"), (n, "c_nationkey", "n_nationkey")]
    ).select("o_orderkey", "c_name", "n_name")


@query(
    "c12_domain_of_variant",
    sql(
        """SELECT variant_id, gene, residue, CASE WHEN domain_id IS NULL THEN 'Intradomain/Unknown' ELSE
            COALESCE(domain_name, domain_id) END AS domain_name, domain_id FROM (
          SELECT v.variant_id, v.gene, CAST(regexp_extract(protein_change, '([0-9]+)', 1) AS BIGINT) AS residue, d.domain_name,
            d.domain_id
          FROM variants v LEFT JOIN domains d ON v.gene = d.gene
            AND CAST(regexp_extract(protein_change, '([0-9]+)', 1) AS BIGINT) BETWEEN domain_start AND domain_end) x""",
        "variants", "domains",
    ),
)
def c12(spark, sf):
    out = position.map_to_domains(variants(spark, sf), domains(spark, sf), ROLES)
    return out.select("variant_id", "gene", "residue", "domain_name", "domain_id")


@query(
    "c13_gene_extent",
    sql("SELECT gene, chrom, min(start_pos) AS gene_start, max(end_pos) AS gene_end FROM variants GROUP BY gene, chrom"),
)
def c13(spark, sf):
    return regions.gene_coordinates(variants(spark, sf), ROLES)


@query(
    "c13_variants_in_gene_extent",
    sql(
        """SELECT DISTINCT v.variant_id FROM variants v JOIN (SELECT chrom, min(start_pos) AS s, max(end_pos) AS e FROM variants
        WHERE gene IN ('G4', 'G26') AND variant_class = 'Silent' GROUP BY gene, chrom) g
        ON v.chrom = g.chrom AND v.start_pos <= g.e AND v.end_pos >= g.s"""
    ),
)
def c13_region(spark, sf):
    v = variants(spark, sf)
    picked = v.filter(F.col("gene").isin("G4", "G26") & (F.col("variant_class") == "Silent"))
    return regions.in_gene_extents(v, regions.gene_coordinates(picked, ROLES), ROLES).select("variant_id")


_CELLS = "n AS (SELECT DISTINCT gene, tumor_sample_barcode AS s FROM variants)"


@query(
    "c14_gene_pairs",
    sql("SELECT a.gene AS gene1, b.gene AS gene2 FROM (SELECT DISTINCT gene FROM n) a JOIN (SELECT DISTINCT gene FROM n) b ON a.gene < b.gene", ctes=_CELLS),
)
def c14(spark, sf):
    return co.all_pairs(co.gene_cells(variants(spark, sf), roles=ROLES).select("gene"), blocks=3)


@query(
    "c15_comutation_counts",
    sql(
        """SELECT a.gene AS gene1, b.gene AS gene2, count(*) AS "both" FROM n a JOIN n b ON a.s = b.s AND a.gene < b.gene
        GROUP BY a.gene, b.gene""",
        ctes=_CELLS,
    ),
)
def c15(spark, sf):
    return co.comutation_counts(co.gene_cells(variants(spark, sf), roles=ROLES))


_HEAT_GENES = ["G9", "G1", "G5", "G44", "G70"]


def _fisher_sql(select: str, tail: str = "") -> str:
    """All gene pairs with the 2x2 table and the exact two-sided p."""
    return sql(
        f"{select} {tail}",
        ctes=_CELLS
        + """, g AS (SELECT gene, count(*) AS m FROM n GROUP BY gene),
        t AS (SELECT count(DISTINCT s) AS total FROM n),
        k AS (SELECT a.gene AS gene1, b.gene AS gene2, count(*) AS shared FROM n a JOIN n b ON a.s = b.s AND a.gene < b.gene
          GROUP BY a.gene, b.gene),
        c AS (SELECT x.gene AS gene1, y.gene AS gene2, x.m AS n1, y.m AS n2, total, coalesce(shared, 0) AS a
          FROM g x JOIN g y ON x.gene < y.gene CROSS JOIN t LEFT JOIN k ON k.gene1 = x.gene AND k.gene2 = y.gene),
        h AS (SELECT gene1, gene2, n1, n2, total, a, i,
            lgamma(n1 + 1) - lgamma(i + 1) - lgamma(n1 - i + 1) + lgamma(total - n1 + 1) - lgamma(n2 - i + 1)
            - lgamma(total - n1 - n2 + i + 1) - (lgamma(total + 1) - lgamma(n2 + 1) - lgamma(total - n2 + 1)) AS lp
          FROM c, unnest(generate_series(greatest(0, n1 + n2 - total), least(n1, n2))) AS u(i)),
        o AS (SELECT gene1, gene2, max(CASE WHEN i = a THEN lp END) AS lo FROM h GROUP BY gene1, gene2),
        f AS (SELECT h.gene1, h.gene2, any_value(n1) AS n1, any_value(n2) AS n2, any_value(total) AS total, any_value(a) AS a,
            least(1.0::DOUBLE, sum(CASE WHEN lp <= lo + ln(1 + 1e-7) THEN exp(lp) ELSE 0 END)) AS p
          FROM h JOIN o ON h.gene1 = o.gene1 AND h.gene2 = o.gene2 GROUP BY h.gene1, h.gene2),
        pairs AS (SELECT gene1, gene2, a, n1 - a AS b, n2 - a AS c, total - n1 - n2 + a AS d, p,
            a::DOUBLE * (total - n1 - n2 + a) / nullif((n1 - a)::DOUBLE * (n2 - a), 0) AS odds FROM f)""",
    )


@query(
    "c16_pair_grid",
    _fisher_sql(
        """SELECT x.g AS gene1, y.g AS gene2, round(coalesce(-log10(p), 0), 6) AS score FROM
        (SELECT unnest(['G1', 'G44', 'G5', 'G70', 'G9']) AS g) x JOIN (SELECT unnest(['G1', 'G44', 'G5', 'G70', 'G9']) AS g) y
        ON x.g < y.g LEFT JOIN pairs ON pairs.gene1 = x.g AND pairs.gene2 = y.g"""
    ),
)
def c16(spark, sf):
    scores = co.pairwise_fisher(variants(spark, sf), unobserved=True, roles=ROLES)
    grid = co.gene_grid(scores, _HEAT_GENES).join(scores, ["gene1", "gene2"], "left")
    return grid.select(
        "gene1", "gene2", stats.rounded(F.coalesce("neg_log10_pval", F.lit(0.0)), 6).alias("score")
    )


@query(
    "c17_gene_outer_join",
    sql(
        """SELECT gene, count(*) FILTER (table_name = 'cohort_0') AS cohort_0_count,
        count(*) FILTER (table_name = 'cohort_1') AS cohort_1_count FROM variants
        WHERE table_name IN ('cohort_0', 'cohort_1') GROUP BY gene"""
    ),
)
def c17(spark, sf):
    data = cmp.cohorts(variants(spark, sf), roles=ROLES)
    out = cmp.gene_frequencies(data, ["cohort_0", "cohort_1"], roles=ROLES)
    return out.select("gene", "cohort_0_count", "cohort_1_count")


@query(
    "c18_variant_presence",
    sql(
        """SELECT chrom || ':' || CAST(start_pos AS VARCHAR) || ':' || ref_allele || ':' || tumor_seq_allele2 AS variant_key,
        string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS datasets FROM variants GROUP BY 1"""
    ),
)
def c18(spark, sf):
    out = cmp.variant_overlap(cmp.cohorts(variants(spark, sf), roles=ROLES), roles=ROLES)
    return out.select("variant_key", F.array_join("present_in_datasets", ",").alias("datasets"))


@query(
    "c19_clinical_annotation",
    sql(
        """SELECT s.sample, a.annotation FROM (SELECT DISTINCT tumor_sample_barcode AS sample FROM variants) s LEFT JOIN
        (SELECT tumor_sample_barcode AS sample, max_by(disease, variant_id) AS annotation FROM variants
         WHERE variant_type = 'DEL' GROUP BY 1) a ON s.sample = a.sample"""
    ),
)
def c19(spark, sf):
    v = variants(spark, sf).withColumn("stage", F.when(F.col("variant_type") == "DEL", F.col("disease")))
    samples = matrix.all_samples(v, ROLES)
    return samples.join(matrix.clinical_annotation(v, "stage", ROLES), "sample", "left").select("sample", "annotation")


@query(
    "c20_all_samples_kept",
    sql(
        """SELECT tumor_sample_barcode AS sample, count(*) FILTER (gene IN ('G1', 'G2') AND variant_class = 'Nonsense_Mutation')
        AS alteration_count FROM variants GROUP BY 1"""
    ),
)
def c20(spark, sf):
    v = variants(spark, sf)
    rows = matrix.altered(v.filter("variant_class = 'Nonsense_Mutation'"), ["G1", "G2"], roles=ROLES)
    return matrix.samples_with_counts(v, rows, ROLES)


@query(
    "c21_chained_step",
    sql(
        """SELECT gene, variant_class, count(*) AS aggregated_value FROM variants WHERE gene IN (SELECT gene FROM
        (SELECT gene, count(*) AS n FROM variants GROUP BY gene ORDER BY n DESC, gene LIMIT 5) x) GROUP BY gene, variant_class"""
    ),
)
def c21(spark, sf):
    v = variants(spark, sf)
    chosen = sets.restricted_to(v, sets.top_groups(v, "gene", 5), "gene")
    return agg.aggregate(chosen, "variant_id", ["gene", "variant_class"])


@query(
    "c22_samples_without_gene",
    sql(
        """SELECT DISTINCT tumor_sample_barcode AS sample FROM variants WHERE tumor_sample_barcode NOT IN
        (SELECT tumor_sample_barcode FROM variants WHERE gene = 'G7')"""
    ),
)
def c22(spark, sf):
    return co.samples_without_gene(variants(spark, sf), "G7", ROLES)


@query(
    "c22_exclusive_pairs",
    sql(
        """SELECT a.gene AS gene1, b.gene AS gene2 FROM (SELECT DISTINCT gene FROM n) a JOIN (SELECT DISTINCT gene FROM n) b
        ON a.gene < b.gene WHERE NOT EXISTS (SELECT 1 FROM n x JOIN n y ON x.s = y.s WHERE x.gene = a.gene AND y.gene = b.gene)""",
        ctes="""n AS (SELECT DISTINCT gene || ':' || variant_class || ':' || variant_type AS gene, tumor_sample_barcode AS s
          FROM variants)""",
    ),
)
def c22_pairs(spark, sf):
    """All variants, by kind of alteration of a gene; whole genes share samples with all others."""
    kind = F.concat_ws(":", "gene", "variant_class", "variant_type")
    return co.exclusive_pairs(variants(spark, sf).withColumn("gene", kind), roles=ROLES)


# --- G: set operations -----------------------------------------------------


@query(
    "g1_mirrored_union",
    sql("SELECT gene_a, gene_b, confidence_score FROM edges UNION ALL SELECT gene_b, gene_a, confidence_score FROM edges", "edges"),
)
def g1(spark, sf):
    e = edges(spark, sf).select(F.col("gene_a").alias("gene1"), F.col("gene_b").alias("gene2"), "confidence_score")
    return co.mirrored(e).select(F.col("gene1").alias("gene_a"), F.col("gene2").alias("gene_b"), "confidence_score")


@query(
    "g2_gene_union",
    sql("SELECT DISTINCT gene FROM variants WHERE table_name IN ('cohort_0', 'cohort_2')"),
)
def g2(spark, sf):
    v = variants(spark, sf)
    return cmp.gene_union(cmp.cohorts(v, ["cohort_0", "cohort_2"], ROLES), ROLES)


def _sample_lists(spark, sf):
    v = variants(spark, sf)
    return [v.filter(F.col("variant_type") == t).select("tumor_sample_barcode") for t in ("INS", "DEL")]


_LIST = "SELECT tumor_sample_barcode FROM variants WHERE variant_type = '{}'"


@query("g3_intersect", sql(f"{_LIST.format('INS')} INTERSECT {_LIST.format('DEL')}"))
def g3(spark, sf):
    return sets.combine(_sample_lists(spark, sf), "INTERSECT")


@query("g4_difference", sql(f"{_LIST.format('INS')} EXCEPT {_LIST.format('DEL')}"))
def g4(spark, sf):
    return sets.combine(_sample_lists(spark, sf), "DIFFERENCE")


@query("g5_union", sql(f"{_LIST.format('INS')} UNION {_LIST.format('DEL')}"))
def g5(spark, sf):
    return sets.combine(_sample_lists(spark, sf), "UNION")


@query("g6_distinct", sql("SELECT DISTINCT gene, variant_class, disease FROM variants"))
def g6(spark, sf):
    return variants(spark, sf).select("gene", "variant_class", "disease").distinct()


_LINKS = """l AS (SELECT gene_a AS gene, gene_b AS partner FROM edges UNION SELECT gene_b, gene_a FROM edges)"""


@query(
    "g7_shared_partners",
    sql(
        """SELECT partner AS common_partner, string_agg(gene, ',' ORDER BY gene) AS shared_by FROM l
        WHERE gene IN ('G1', 'G13') GROUP BY partner HAVING count(*) = 2""",
        "edges", ctes=_LINKS,
    ),
)
def g7(spark, sf):
    out = graph.common_partners(edges(spark, sf), ["G1", "G13"])
    return out.select("common_partner", F.array_join("shared_by", ",").alias("shared_by"))


@query(
    "g8_side_by_side",
    sql(
        """SELECT table_name AS dataset, gene, count(*) AS aggregated_value FROM variants GROUP BY table_name, gene"""
    ),
)
def g8(spark, sf):
    v = variants(spark, sf)
    data = sets.side_by_side({c: v.filter(F.col("table_name") == c) for c in ("cohort_0", "cohort_1", "cohort_2")})
    return agg.aggregate(data, "variant_id", ["dataset", "gene"])


# --- J: graph --------------------------------------------------------------


@query(
    "j1_pair_edges",
    sql(
        """SELECT least(gene_a, gene_b) AS gene1, greatest(gene_a, gene_b) AS gene2, count(*) AS edge_count,
        max(confidence_score) AS best_confidence, string_agg(DISTINCT interaction_type, ',' ORDER BY interaction_type) AS types
        FROM edges GROUP BY 1, 2""",
        "edges",
    ),
)
def j1(spark, sf):
    return graph.pair_summary(edges(spark, sf)).withColumn("types", F.array_join("types", ","))


@query("j1_adjacency", sql("SELECT gene, partner FROM l", "edges", ctes=_LINKS))
def j1_adjacency(spark, sf):
    return graph.adjacency(edges(spark, sf))


_PARTNERS = """d AS (SELECT CASE WHEN gene_a IN ('G1', 'G5', 'G16', 'G99') THEN gene_a ELSE gene_b END AS query_gene,
   CASE WHEN gene_a IN ('G1', 'G5', 'G16', 'G99') THEN gene_b ELSE gene_a END AS partner_gene, interaction_type, confidence_score
   FROM edges WHERE gene_a IN ('G1', 'G5', 'G16', 'G99') OR gene_b IN ('G1', 'G5', 'G16', 'G99'))"""
_ASKED = ["G1", "G5", "G16", "G99"]


@query(
    "j2_direct_partners",
    sql(
        """SELECT g AS query_gene, count(partner_gene) AS partner_count FROM (SELECT unnest(['G1', 'G5', 'G16', 'G99']) AS g) x
        LEFT JOIN d ON d.query_gene = g GROUP BY g""",
        "edges", ctes=_PARTNERS,
    ),
)
def j2(spark, sf):
    return graph.partner_counts(graph.direct_partners(edges(spark, sf), _ASKED), _ASKED)


@query(
    "f12_best_partners",
    sql(
        """SELECT query_gene, partner_gene, interaction_type, confidence_score, rank FROM (SELECT *, CAST(row_number() OVER
        (PARTITION BY query_gene ORDER BY confidence_score DESC, partner_gene, interaction_type) AS INTEGER) AS rank FROM d) x
        WHERE rank <= 2""",
        "edges", ctes=_PARTNERS,
    ),
)
def f12(spark, sf):
    return graph.best_partners(graph.direct_partners(edges(spark, sf), _ASKED), 2)


@query(
    "d54_network_statistics",
    sql(
        """SELECT CAST(4 AS BIGINT) AS total_query_genes, count(*) AS total_interactions, count(DISTINCT partner_gene) AS
        total_unique_partners, count(DISTINCT partner_gene) / 4.0::DOUBLE AS avg_partners_per_gene FROM d""",
        "edges", ctes=_PARTNERS,
    ),
)
def d54(spark, sf):
    return graph.partner_statistics(graph.direct_partners(edges(spark, sf), _ASKED), _ASKED)


_HOPS = (
    _LINKS.replace("FROM edges", "FROM edges WHERE confidence_score >= 0.2")
    + """, h0 AS (SELECT unnest(['G1', 'G7']) AS gene),
  h1 AS (SELECT DISTINCT partner AS gene FROM l WHERE gene IN (FROM h0) AND partner NOT IN (FROM h0)),
  h2 AS (SELECT DISTINCT partner AS gene FROM l WHERE gene IN (FROM h1) AND partner NOT IN (FROM h0) AND partner NOT IN (FROM h1)),
  h3 AS (SELECT DISTINCT partner AS gene FROM l WHERE gene IN (FROM h2) AND partner NOT IN (FROM h0) AND partner NOT IN (FROM h1)
    AND partner NOT IN (FROM h2)),
  hops AS (SELECT gene, 1 AS distance FROM h1 UNION ALL SELECT gene, 2 FROM h2 UNION ALL SELECT gene, 3 FROM h3)"""
)


@query("j3_neighbourhood", sql("SELECT gene, distance, false AS is_query_gene FROM hops", "edges", ctes=_HOPS))
def j3(spark, sf):
    return graph.neighbours(edges(spark, sf), ["G1", "G7"], 3, min_confidence=0.2)


@query(
    "d54_neighbours_by_distance",
    sql("SELECT distance, count(*) AS neighbours FROM hops GROUP BY distance", "edges", ctes=_HOPS),
)
def d54_distance(spark, sf):
    return graph.network_statistics(graph.neighbours(edges(spark, sf), ["G1", "G7"], 3, min_confidence=0.2))


@query(
    "j4_shortest_paths",
    sql(
        """SELECT source_gene, target_gene, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS path_length,
          array_to_string(path[2:len(path) - 1], '>') AS intermediate_genes FROM (
          SELECT source_gene, target_gene, path, row_number() OVER (PARTITION BY source_gene, target_gene ORDER BY len(path), path) AS rn
          FROM p WHERE target_gene IN ('G20', 'G33', 'G4') AND source_gene <> target_gene) x WHERE rn = 1""",
        "edges",
        ctes=_LINKS
        + """, p1 AS (SELECT gene AS source_gene, partner AS target_gene, [gene, partner] AS path FROM l WHERE gene IN ('G1', 'G7', 'G20')),
        p2 AS (SELECT source_gene, partner AS target_gene, list_append(path, partner) AS path FROM p1 JOIN l ON target_gene = gene
          WHERE NOT list_contains(path, partner)),
        p3 AS (SELECT source_gene, partner AS target_gene, list_append(path, partner) AS path FROM p2 JOIN l ON target_gene = gene
          WHERE NOT list_contains(path, partner)),
        p AS (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)""",
    ),
)
def j4(spark, sf):
    out = graph.shortest_paths(edges(spark, sf), ["G1", "G7", "G20"], ["G20", "G33", "G4"], 3)
    return out.withColumn("path", F.array_join("path", ">")).withColumn(
        "intermediate_genes", F.array_join("intermediate_genes", ">")
    )


# The same walks over a network whose nodes and edges grow with the tables.
_PART_LINKS = """l AS (SELECT gene_a AS gene, gene_b AS partner FROM part_edges WHERE confidence_score >= {0} AND gene_a <> gene_b
    UNION SELECT gene_b, gene_a FROM part_edges WHERE confidence_score >= {0} AND gene_a <> gene_b)"""


@query(
    "j3_neighbourhood_of_parts",
    sql(
        """SELECT gene, CAST(min(distance) AS INTEGER) AS distance FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) x
        WHERE gene NOT IN ('G1', 'G7') GROUP BY gene""",
        "part_edges",
        ctes=_PART_LINKS.format(0.9)
        + """, d1 AS (SELECT DISTINCT partner AS gene, 1 AS distance FROM l WHERE gene IN ('G1', 'G7')),
        d2 AS (SELECT DISTINCT partner AS gene, 2 AS distance FROM l WHERE gene IN (SELECT gene FROM d1))""",
    ),
)
def j3_parts(spark, sf):
    return graph.neighbours(part_edges(spark, sf), ["G1", "G7"], 2, min_confidence=0.9).select("gene", "distance")


@query(
    "j4_shortest_paths_of_parts",
    sql(
        """SELECT source_gene, target_gene, array_to_string(path, '>') AS path FROM (
          SELECT source_gene, target_gene, path, row_number() OVER (PARTITION BY source_gene, target_gene ORDER BY len(path), path) AS rn
          FROM p WHERE target_gene IN ('G20', 'G33', 'G4') AND source_gene <> target_gene) x WHERE rn = 1""",
        "part_edges",
        ctes=_PART_LINKS.format(0.0)
        + """, p1 AS (SELECT gene AS source_gene, partner AS target_gene, [gene, partner] AS path FROM l WHERE gene IN ('G1', 'G7', 'G20')),
        p2 AS (SELECT source_gene, partner AS target_gene, list_append(path, partner) AS path FROM p1 JOIN l ON target_gene = gene
          WHERE NOT list_contains(path, partner)),
        p AS (FROM p1 UNION ALL FROM p2)""",
    ),
)
def j4_parts(spark, sf):
    out = graph.shortest_paths(part_edges(spark, sf), ["G1", "G7", "G20"], ["G20", "G33", "G4"], 2)
    return out.select("source_gene", "target_gene", F.array_join("path", ">").alias("path"))


@query(
    "c15_comutation_of_parts",
    sql(
        """SELECT a.gene AS gene1, b.gene AS gene2, count(*) AS "both" FROM part_cells a JOIN part_cells b
        ON a.sample = b.sample AND a.gene < b.gene GROUP BY a.gene, b.gene""",
        "part_cells",
    ),
)
def c15_parts(spark, sf):
    return co.comutation_counts(part_cells(spark, sf))


@query(
    "j5_common_partners",
    sql(
        """SELECT partner AS common_partner, CAST(count(*) AS INTEGER) AS shared_count FROM l WHERE gene IN ('G1', 'G13', 'G30')
        GROUP BY partner HAVING count(*) = 3""",
        "edges", ctes=_LINKS,
    ),
)
def j5(spark, sf):
    return graph.common_partners(edges(spark, sf), ["G1", "G13", "G30"]).select("common_partner", "shared_count")


# --- pathways --------------------------------------------------------------


@query("d46_pathway_gene_counts", sql(_PATHWAY_GENE_LISTS + " WHERE pathway_name ILIKE '%p1%' GROUP BY id, pathway_name", "pathways"))
def d46(spark, sf):
    out = pathway.gene_counts(pathway_genes(spark, sf), pathways(spark, sf), "P1")
    return out.withColumn("genes", F.array_join("genes", ","))


@query(
    "d48_lookup_totals",
    sql(
        """SELECT count(DISTINCT gene) AS total_genes, count(DISTINCT pathway_id) AS total_pathways FROM pathway_genes
        WHERE gene IN ('G1', 'G8', 'G30')""",
        "pathways",
    ),
)
def d48(spark, sf):
    rows = pathway.pathways_of_genes(pathway_genes(spark, sf), pathways(spark, sf), ["G1", "G8", "G30"])
    return pathway.lookup_totals(rows)


_ENRICHMENT = """asked AS (SELECT gene FROM (SELECT gene, count(*) AS n FROM variants WHERE variant_class = 'Nonsense_Mutation'
    GROUP BY gene ORDER BY n DESC, gene LIMIT 12) x),
  s AS (SELECT (SELECT count(DISTINCT gene) FROM variants WHERE gene IS NOT NULL) AS total, (SELECT count(*) FROM asked) AS n),
  q AS (SELECT pathway_id, count(*) AS k, count(asked.gene) AS a, string_agg(asked.gene, ',' ORDER BY asked.gene) AS genes
    FROM pathway_genes LEFT JOIN asked ON pathway_genes.gene = asked.gene GROUP BY pathway_id),
  r AS (SELECT q.*, n, total, n - a AS b, k - a AS c, greatest(0, total - k - n + a) AS d FROM q CROSS JOIN s WHERE a >= 2),
  e AS (SELECT pathway_id, any_value(k) AS k, any_value(a) AS a, any_value(genes) AS genes, any_value(n) AS n, any_value(total) AS total,
    any_value(b) AS b, any_value(c) AS c, any_value(d) AS d,
    sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1)
      - lgamma(d - a + i + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1)))) AS p
    FROM r, unnest(generate_series(a, least(a + b, a + c))) AS u(i) GROUP BY pathway_id)"""


@query(
    "d47_pathway_enrichment",
    sql(
        """SELECT pathway_id, pathway_name, k AS total_genes_in_pathway, a AS genes_in_input, genes AS overlapping_genes,
        round(p, 8) AS p_value, round(a::DOUBLE / (n * k / total::DOUBLE), 3) AS fold_enrichment,
        round(a::DOUBLE * d / (b::DOUBLE * c), 3) AS odds_ratio FROM e JOIN pathways ON id = pathway_id WHERE p <= 0.9""",
        "variants", "pathways", ctes=_ENRICHMENT,
    ),
)
def d47(spark, sf):
    v = variants(spark, sf)
    asked = sets.top_groups(v.filter("variant_class = 'Nonsense_Mutation'"), "gene", 12)
    out = pathway.enrichment(
        pathway.mutated_genes(v, ROLES), pathway_genes(spark, sf), pathways(spark, sf), asked, min_genes=2, p_value_threshold=0.9
    )
    return out.withColumn("p_value", stats.rounded(F.col("p_value"), 8)).withColumn(
        "overlapping_genes", F.array_join("overlapping_genes", ",")
    )


@query(
    "f11_sorted_enrichment",
    sql(
        """SELECT pathway_id, a AS genes_in_input FROM e ORDER BY a DESC, pathway_id LIMIT 5""",
        "variants", "pathways", ctes=_ENRICHMENT,
    ),
)
def f11(spark, sf):
    v = variants(spark, sf)
    asked = sets.top_groups(v.filter("variant_class = 'Nonsense_Mutation'"), "gene", 12)
    out = pathway.enrichment(
        pathway.mutated_genes(v, ROLES), pathway_genes(spark, sf), pathways(spark, sf), asked, min_genes=2
    )
    return ordering.sort_nulls_as_zero(out, "genes_in_input", ["pathway_id"], True, 5).select("pathway_id", "genes_in_input")


@query(
    "k12_sorted_enrichment",
    sql(
        """SELECT pathway_id, a AS genes_in_input, round(p, 8) AS p_value FROM e ORDER BY a DESC, pathway_id LIMIT 4""",
        "variants", "pathways", ctes=_ENRICHMENT,
    ),
)
def k12_sorted(spark, sf):
    v = variants(spark, sf)
    asked = sets.top_groups(v.filter("variant_class = 'Nonsense_Mutation'"), "gene", 12)
    out = reports.pathway_analysis(
        "enrichment", pathway_genes(spark, sf), pathways(spark, sf), v, asked, roles=ROLES,
        order_by="genes_in_input", descending=True, limit=4, min_genes=2,
    )
    return out.select("pathway_id", "genes_in_input", stats.rounded(F.col("p_value"), 8).alias("p_value"))


# --- pairwise statistics ---------------------------------------------------


@query("d49_pair_tables", _fisher_sql("SELECT gene1, gene2, a, b, c, d FROM pairs"))
def d49(spark, sf):
    return co.pair_tables(co.gene_cells(variants(spark, sf), roles=ROLES), unobserved=True)


_FISHER_ROWS = """SELECT gene1, gene2, round(p, 8) AS p_value, round(odds, 6) AS odds_ratio, round(-log10(p), 6) AS neg_log10_pval FROM pairs"""


def _rounded_fisher(df):
    return df.select(
        "gene1", "gene2", stats.rounded(F.col("p_value"), 8).alias("p_value"),
        stats.rounded(F.col("odds_ratio"), 6).alias("odds_ratio"),
        stats.rounded(F.col("neg_log10_pval"), 6).alias("neg_log10_pval"),
    )


@query("d50_pairwise_fisher", _fisher_sql(_FISHER_ROWS))
def d50(spark, sf):
    return _rounded_fisher(co.pairwise_fisher(variants(spark, sf), unobserved=True, roles=ROLES))


@query("k17_pairwise_for_genes", _fisher_sql(_FISHER_ROWS, "WHERE a > 0"))
def k17(spark, sf):
    return _rounded_fisher(co.pairwise_fisher(variants(spark, sf), unobserved=False, roles=ROLES))


_HEAT = """SELECT x.g AS gene1, y.g AS gene2, round(coalesce(CASE WHEN odds < 1 THEN log10(p) ELSE -log10(p) END, 0), 6) AS value FROM
  (SELECT unnest(['G1', 'G44', 'G5', 'G70', 'G9']) AS g) x JOIN (SELECT unnest(['G1', 'G44', 'G5', 'G70', 'G9']) AS g) y
  ON x.g < y.g LEFT JOIN pairs ON pairs.gene1 = x.g AND pairs.gene2 = y.g"""


@query("d51_interaction_heatmap", _fisher_sql(_HEAT))
def d51(spark, sf):
    pairs = co.pairwise_fisher(variants(spark, sf), unobserved=True, roles=ROLES)
    return co.interaction_heatmap(pairs, _HEAT_GENES).withColumn("value", stats.rounded(F.col("value"), 6))


@query(
    "h18_signed_score",
    _fisher_sql(
        """SELECT gene1, gene2, round(CASE WHEN odds < 1 THEN log10(p) ELSE -log10(p) END, 6) AS signed,
        abs(b - c) AS difference, round(coalesce(a / nullif(a + b, 0)::DOUBLE, 0), 6) AS share FROM pairs"""
    ),
)
def h18(spark, sf):
    t = co.pair_tables(co.gene_cells(variants(spark, sf), roles=ROLES), unobserved=True)
    cells = [F.col(x) for x in "abcd"]
    t = t.withColumn("p", stats.fisher_two_sided(*cells)).withColumn("odds", stats.odds_ratio(*cells))
    score = stats.neg_log10(F.col("p"))
    return t.select(
        "gene1", "gene2",
        stats.rounded(F.when(F.col("odds") < 1, -score).otherwise(score), 6).alias("signed"),
        F.abs(F.col("b") - F.col("c")).alias("difference"),
        stats.rounded(stats.rate(F.col("a"), F.col("a") + F.col("b")), 6).alias("share"),
    )


@query(
    "h13_fisher_exact",
    """WITH t AS (SELECT p_brand, count(*) FILTER (p_size <= 25 AND p_retailprice > 880 + (p_partkey % 7) * 20) AS a,
        count(*) FILTER (p_size <= 25 AND NOT p_retailprice > 880 + (p_partkey % 7) * 20) AS b,
        count(*) FILTER (p_size > 25 AND p_retailprice > 880 + (p_partkey % 7) * 20) AS c,
        count(*) FILTER (p_size > 25 AND NOT p_retailprice > 880 + (p_partkey % 7) * 20) AS d FROM part GROUP BY p_brand),
      h AS (SELECT t.*, i, lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1)
        - lgamma(d - a + i + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1)) AS lp
        FROM t, unnest(generate_series(greatest(0, a - d), least(a + b, a + c))) AS u(i)),
      o AS (SELECT p_brand, max(CASE WHEN i = a THEN lp END) AS lo FROM h GROUP BY p_brand)
      SELECT h.p_brand, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d,
        round(sum(CASE WHEN lp <= lo + ln(1 + 1e-7) THEN exp(lp) ELSE 0 END), 8) AS two_sided,
        round(sum(CASE WHEN i >= a THEN exp(lp) ELSE 0 END), 8) AS greater,
        CASE WHEN any_value(b * c) <> 0 THEN round(any_value(a::DOUBLE * d / nullif(b::DOUBLE * c, 0)), 6)
          WHEN any_value(a * d) <> 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS odds
      FROM h JOIN o ON h.p_brand = o.p_brand GROUP BY h.p_brand""",
)
def h13(spark, sf):
    small, dear = F.col("p_size") <= 25, F.col("p_retailprice") > (F.col("p_partkey") % 7) * 20 + 880
    t = table(spark, sf, "part").groupBy("p_brand").agg(
        F.count_if(small & dear).alias("a"), F.count_if(small & ~dear).alias("b"),
        F.count_if(~small & dear).alias("c"), F.count_if(~small & ~dear).alias("d"),
    )
    cells = [F.col(x) for x in "abcd"]
    return t.select(
        "p_brand", *cells,
        stats.rounded(stats.fisher_two_sided(*cells), 8).alias("two_sided"),
        stats.rounded(stats.fisher_greater(*cells), 8).alias("greater"),
        stats.rounded(stats.odds_ratio(*cells), 6).alias("odds"),
    )


@query(
    "h14_neg_log10",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 999.0::DOUBLE ELSE round(-log10(1.0::DOUBLE / (event_id + 1)), 8) END AS score
       FROM events""",
)
def h14(spark, sf):
    from varloom.operators.filters import normalise_numbers

    e = table(spark, sf, "events")
    p = F.when(F.col("event_id") % 5 == 0, F.lit(0.0)).otherwise(F.lit(1.0) / (F.col("event_id") + 1))
    scored = e.select(F.col("event_id").cast("string").alias("event_id"), stats.rounded(stats.neg_log10(p), 8).alias("score"))
    return normalise_numbers(scored).withColumn("event_id", F.col("event_id").cast("bigint"))


@query(
    "h15_fold_with_guards",
    """SELECT l_suppkey, round(coalesce(hits::DOUBLE / nullif(n * expected, 0), 0), 3) AS fold FROM (
       SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS n,
         CASE WHEN l_suppkey % 10 = 0 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS expected FROM lineitem GROUP BY l_suppkey) x""",
)
def h15(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    expected = F.when(F.col("l_suppkey") % 10 == 0, 0.0).otherwise(0.25)
    return g.select("l_suppkey", stats.rounded(stats.rate(F.col("hits"), F.col("n") * expected), 3).alias("fold"))


@query(
    "d45_samples_with_all_genes",
    sql(
        """SELECT tumor_sample_barcode AS sample, count(DISTINCT gene) AS gene_count FROM variants
        WHERE gene IN ('G1', 'G2', 'G3') GROUP BY 1 HAVING count(DISTINCT gene) = 3"""
    ),
)
def d45(spark, sf):
    return co.samples_with_genes(variants(spark, sf), ["G1", "G2", "G3"], roles=ROLES)


@query(
    "d45_samples_with_some_genes",
    sql(
        """SELECT tumor_sample_barcode AS sample, count(DISTINCT gene) AS gene_count FROM variants
        WHERE gene IN ('G1', 'G2', 'G3', 'G4', 'G5') GROUP BY 1 HAVING count(DISTINCT gene) >= 4"""
    ),
)
def d45_some(spark, sf):
    return co.samples_with_genes(variants(spark, sf), [f"G{i}" for i in range(1, 6)], 4, ROLES)


@query(
    "d55_gene_share_of_samples",
    sql(
        """SELECT gene, samples, round(samples * 100.0::DOUBLE / total, 6) AS percent FROM (SELECT gene,
        count(DISTINCT tumor_sample_barcode) AS samples, (SELECT count(DISTINCT tumor_sample_barcode) FROM variants) AS total
        FROM variants GROUP BY gene) x WHERE samples * 100.0::DOUBLE / total > 55"""
    ),
)
def d55(spark, sf):
    out = metrics.sample_share(variants(spark, sf), "gene", 55, ROLES)
    return out.withColumn("percent", stats.rounded(F.col("percent"), 6))


@query(
    "e7_top_groups_then_metric",
    sql(
        """SELECT v.gene, count(DISTINCT tumor_sample_barcode) AS aggregated_value FROM variants v JOIN
        (SELECT gene, count(*) AS n FROM variants WHERE variant_type = 'INS' GROUP BY gene ORDER BY n DESC, gene LIMIT 7) t
        ON v.gene = t.gene WHERE variant_type = 'SNP' GROUP BY v.gene"""
    ),
)
def e7(spark, sf):
    v = variants(spark, sf)
    top = sets.top_groups(v.filter("variant_type = 'INS'"), "gene", 7)
    chosen = sets.restricted_to(v.filter("variant_type = 'SNP'"), top, "gene")
    return agg.aggregate(chosen, "tumor_sample_barcode", ["gene"], "distinct_count")


@query(
    "k18_query_plan",
    sql(
        """SELECT gene, table_name, aggregated_value, gene || '@' || table_name AS label FROM (
        SELECT gene, table_name, count(variant_id) AS aggregated_value FROM variants WHERE gene IN (SELECT gene FROM
          (SELECT gene, count(*) AS n FROM variants WHERE variant_class = 'Missense_Mutation' GROUP BY gene
           ORDER BY n DESC, gene LIMIT 3) x) GROUP BY gene, table_name) y"""
    ),
)
def k18(spark, sf):
    plan = [
        {
            "step_id": "top", "tool": "aggregate",
            "params": {
                "column": "variant_id", "group_by": ["gene"], "order_by": "aggregated_value", "limit": 3,
                "filters": {"column": "variant_class", "value": "Missense_Mutation"},
            },
        },
        {
            "step_id": "by_cohort", "tool": "combination_aggregate", "restrict": {"top": "gene"},
            "params": {
                "column": "variant_id", "combination": ["gene", "table_name"],
                "computed": [{"name": "label", "columns": ["gene", "table_name"], "separator": "@"}],
            },
        },
    ]
    return steps.run_plan(variants(spark, sf), plan, ROLES)["by_cohort"]
