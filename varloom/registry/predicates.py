"""Checked queries for predicates, searches and suggestions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from varloom.operators import filters as flt
from varloom.operators import dictionary, regions, search, suggest
from varloom.registry.core import query
from varloom.registry.fixtures import ROLES, pathway_genes, pathways, sql, table, variants
from varloom.sources import export


def _leaf(column, operator, value):
    return {"column": column, "operator": operator, "value": value}


def _all(*nodes):
    return {"logic": "AND", "conditions": list(nodes)}


def _any(*nodes):
    return {"logic": "OR", "conditions": list(nodes)}


@query("b1_eq", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def b1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return flt.apply(o, _leaf("o_orderpriority", "eq", "1-URGENT"))


@query("b2_neq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def b2(spark, sf):
    return flt.apply(table(spark, sf, "orders"), _leaf("o_orderstatus", "neq", "F")).select(
        "o_orderkey", "o_orderstatus"
    )


@query("b3_gt_lt", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_acctbal < 5000")
def b3(spark, sf):
    tree = _all(_leaf("c_acctbal", "gt", 1000), _leaf("c_acctbal", "lt", 5000))
    return flt.apply(table(spark, sf, "customer"), tree).select("c_custkey", "c_acctbal")


@query("b4_gte_lte", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20")
def b4(spark, sf):
    tree = _all(_leaf("p_size", "gte", 10), _leaf("p_size", "lte", 20))
    return flt.apply(table(spark, sf, "part"), tree).select("p_partkey", "p_size")


@query("b5_like", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%the%'")
def b5(spark, sf):
    return flt.apply(table(spark, sf, "documents"), _leaf("text", "like", "The")).select("doc_id", "lang")


@query("b6_in", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def b6(spark, sf):
    return flt.apply(table(spark, sf, "events"), _leaf("event_type", "in", ["click", "purchase"])).select(
        "event_id", "event_type"
    )


@query("b7_not_in", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def b7(spark, sf):
    return flt.apply(table(spark, sf, "events"), _leaf("event_type", "not_in", ["click", "view"])).select(
        "event_id", "event_type"
    )


@query(
    "b8_filter_tree",
    sql(
        """SELECT variant_id, gene, variant_class FROM variants
        WHERE (gene = 'G3' AND variant_class = 'Missense_Mutation')
           OR (gene IN ('G7', 'G9') AND (start_pos >= 1071000 OR NOT variant_type IN ('SNP')))"""
    ),
)
def b8(spark, sf):
    tree = _any(
        _all(_leaf("gene", "eq", "G3"), _leaf("variant_class", "eq", "Missense_Mutation")),
        _all(
            _leaf("gene", "in", ["G7", "G9"]),
            _any(_leaf("start_pos", "gte", 1071000), _leaf("variant_type", "not_in", "SNP")),
        ),
    )
    return flt.apply(variants(spark, sf), tree).select("variant_id", "gene", "variant_class")


@query(
    "b10_numeric_rows",
    """SELECT event_id::DOUBLE AS event_id, event_type,
      CASE WHEN event_id % 7 = 0 THEN 999.0::DOUBLE WHEN event_id % 7 = 1 THEN -999.0::DOUBLE
        WHEN event_id % 7 = 2 OR value IS NULL THEN 'nan'::DOUBLE ELSE value END AS value FROM events""",
)
def b10(spark, sf):
    value = (
        F.when(F.col("event_id") % 7 == 0, float("inf"))
        .when(F.col("event_id") % 7 == 1, float("-inf"))
        .when(F.col("event_id") % 7 != 2, F.col("value"))
    )
    e = table(spark, sf, "events").select("event_id", "event_type", value.alias("value"))
    return flt.normalise_numbers(e)


@query(
    "b11_free_text",
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE CAST(o_orderkey AS VARCHAR) ILIKE '%12%'
       OR o_orderstatus ILIKE '%12%' OR o_orderpriority ILIKE '%12%'""",
)
def b11(spark, sf):
    o = table(spark, sf, "orders")
    found = flt.free_text(o, " 12 ", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    return found.select("o_orderkey", "o_orderpriority")


@query(
    "b11_free_text_all_columns",
    sql(
        """SELECT variant_id FROM variants WHERE variant_id ILIKE '%g4%' OR table_name ILIKE '%g4%'
        OR tumor_sample_barcode ILIKE '%g4%' OR disease ILIKE '%g4%' OR gene ILIKE '%g4%' OR chrom ILIKE '%g4%'
        OR CAST(start_pos AS VARCHAR) ILIKE '%g4%' OR CAST(end_pos AS VARCHAR) ILIKE '%g4%'
        OR ref_allele ILIKE '%g4%' OR tumor_seq_allele2 ILIKE '%g4%' OR trinucleotide_context ILIKE '%g4%'
        OR variant_type ILIKE '%g4%' OR variant_class ILIKE '%g4%' OR protein_change ILIKE '%g4%'"""
    ),
)
def b11_all(spark, sf):
    return flt.free_text(variants(spark, sf), "g4").select("variant_id")


@query(
    "b12_terms_all_partial",
    """SELECT doc_id FROM documents WHERE (text ILIKE '%data%' OR source ILIKE '%data%' OR lang ILIKE '%data%')
       AND (text ILIKE '%en%' OR source ILIKE '%en%' OR lang ILIKE '%en%')""",
)
def b12(spark, sf):
    d = table(spark, sf, "documents")
    return flt.free_text_terms(d, ["data", " en "], ["text", "source", "lang"], mode="all").select("doc_id")


@query(
    "b12_terms_any_exact",
    "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_name IN ('BUILDING', 'MACHINERY')",
)
def b12_any(spark, sf):
    c = table(spark, sf, "customer")
    found = flt.free_text_terms(c, ["BUILDING", "MACHINERY"], ["c_mktsegment", "c_name"], mode="any", exact=True)
    return found.select("c_custkey")


@query("b14_position", sql("SELECT variant_id FROM variants WHERE chrom = 'chr4' AND start_pos = 1030044"))
def b14(spark, sf):
    found = regions.in_regions(variants(spark, sf), [{"chromosome": "4", "start": 1030044}], ROLES)
    return found.select("variant_id")


@query(
    "b15_region_overlap",
    sql("SELECT variant_id, start_pos, end_pos FROM variants WHERE chrom = 'chr4' AND start_pos <= 1030500 AND end_pos >= 1030100"),
)
def b15(spark, sf):
    r = [{"chromosome": "CHR4", "start": 1030100, "end": 1030500}]
    return regions.in_regions(variants(spark, sf), r, ROLES).select("variant_id", "start_pos", "end_pos")


@query(
    "b16_region_containment",
    sql("SELECT variant_id, start_pos FROM variants WHERE chrom = 'chr4' AND start_pos BETWEEN 1030100 AND 1030500"),
)
def b16(spark, sf):
    v = variants(spark, sf).drop("end_pos")
    r = [{"chromosome": "chr4", "start": 1030100, "end": 1030500}]
    return regions.in_regions(v, r, regions.detect_roles(v)).select("variant_id", "start_pos")


@query(
    "b17_region_list",
    sql(
        """SELECT variant_id FROM variants WHERE (chrom = 'chr4' AND start_pos <= 1030500 AND end_pos >= 1030100)
        OR (chrom = 'chr5' AND start_pos = 1040200) OR (chrom = 'chr9' AND start_pos <= 1082000 AND end_pos >= 1080000)"""
    ),
)
def b17(spark, sf):
    r = [
        {"chromosome": "chr4", "start": 1030100, "end": 1030500},
        {"chromosome": "5", "start": 1040200},
        {"chromosome": "CHR9", "start": 1080000, "end": 1082000},
    ]
    return regions.in_regions(variants(spark, sf), r, ROLES).select("variant_id")


def _part_regions(spark, sf):
    p = table(spark, sf, "part")
    start = F.col("p_partkey") * 500 + 1000000
    return p.select(
        F.concat(F.lit("CHR"), F.col("p_partkey") % 22 + 1).alias("chromosome"),
        start.alias("start"),
        (start + F.col("p_size") * 10).alias("end"),
    )


@query(
    "b17_region_table",
    sql(
        """SELECT variant_id FROM variants v WHERE EXISTS (SELECT 1 FROM part p WHERE
        v.chrom = 'chr' || CAST(p_partkey % 22 + 1 AS VARCHAR) AND v.start_pos <= 1000000 + p_partkey * 500 + p_size * 10
        AND v.end_pos >= 1000000 + p_partkey * 500)"""
    ),
)
def b17_table(spark, sf):
    return regions.in_region_table(variants(spark, sf), _part_regions(spark, sf), ROLES).select("variant_id")


@query(
    "b17_region_table_repeats",
    sql(
        """SELECT CASE WHEN start_pos % 3 > 0 THEN gene END AS variant_id, start_pos, stop_pos
        FROM (SELECT *, end_pos + (start_pos % 5) * 1500 AS stop_pos FROM variants) v WHERE EXISTS (SELECT 1 FROM part p WHERE
        v.chrom = 'chr' || CAST(p_partkey % 22 + 1 AS VARCHAR) AND v.start_pos <= 1000000 + p_partkey * 500 + p_size * 10
        AND v.stop_pos >= 1000000 + p_partkey * 500)"""
    ),
)
def b17_repeats(spark, sf):
    """Wide rows, whose id is the gene or missing: rows are kept as they are, however often an id occurs."""
    v = variants(spark, sf).withColumn("stop_pos", F.col("end_pos") + (F.col("start_pos") % 5) * 1500)
    v = v.withColumn("variant_id", F.when(F.col("start_pos") % 3 > 0, F.col("gene")))
    wide = replace(ROLES, end="stop_pos")
    return regions.in_region_table(v, _part_regions(spark, sf), wide).select("variant_id", "start_pos", "stop_pos")


@query("b18_chromosome_match", sql("SELECT variant_id, chrom FROM variants WHERE chrom = 'chr17'"))
def b18(spark, sf):
    v = variants(spark, sf)
    return v.filter(regions.same_chromosome("chrom", "ChR17")).select("variant_id", "chrom")


@query(
    "b19_detected_columns",
    "SELECT event_id FROM events WHERE event_type = 'view' AND event_id BETWEEN 100 AND 5000",
)
def b19(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("chr"), "event_type").alias("chromosome"), F.col("event_id").alias("position")
    )
    r = [{"chromosome": "view", "start": 100, "end": 5000}]
    return regions.in_regions(e, r, regions.detect_roles(e)).select("event_id")


@query("b20_first_column_contains", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%andar%'")
def b20(spark, sf):
    p = table(spark, sf, "part")
    return flt.contains_in_first(p, ["pathway", "pathways", "p_type", "p_name"], "ANDAR").select("p_partkey", "p_type")


@query("b21_open_bounds", sql("SELECT variant_id FROM variants WHERE chrom = 'chr2' AND start_pos >= 1012000"))
def b21(spark, sf):
    return regions.within_bounds(variants(spark, sf), "chr2", start=1012000, roles=ROLES).select("variant_id")


@query(
    "b22_type_and_class",
    sql(
        """SELECT variant_id FROM variants WHERE variant_type IN ('DEL', 'INS')
        AND variant_class IN ('Frame_Shift_Del', 'In_Frame_Ins')"""
    ),
)
def b22(spark, sf):
    v = variants(spark, sf)
    return flt.by_type_and_class(v, ["DEL", "INS"], ["Frame_Shift_Del", "In_Frame_Ins"], ROLES).select("variant_id")


@query("b23_sample_column", sql("SELECT variant_id FROM variants WHERE tumor_sample_barcode IN ('S1', 'S4', 'S10')"))
def b23(spark, sf):
    v = variants(spark, sf)
    return flt.in_first(v, ["sample_id", "tumor_sample_barcode"], ["S1", "S4", "S10"]).select("variant_id")


@query(
    "b24_metric_ranges",
    """SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_acctbal <= 4000 AND c_custkey >= 100""",
)
def b24(spark, sf):
    c = table(spark, sf, "customer")
    return flt.in_ranges(c, {"c_acctbal": (0, 4000), "c_custkey": (100, None)}).select("c_custkey")


@query(
    "b26_alteration_filter",
    sql(
        """SELECT variant_id, variant_class FROM variants WHERE variant_class = 'Missense_Mutation'
        OR variant_class IN ('Nonsense_Mutation', 'Frame_Shift_Del') OR variant_class = 'Splice_Region'"""
    ),
)
def b26(spark, sf):
    v = variants(spark, sf)
    kept = flt.by_alteration(v, ["missense", "truncating", "splice_site"], ROLES)
    return kept.select("variant_id", "variant_class")


@query("b27_projection", "SELECT l_orderkey, l_returnflag FROM lineitem")
def b27(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")


@query(
    "b28_gene_prefix",
    sql("SELECT DISTINCT gene FROM variants WHERE gene ILIKE 'g1%' ORDER BY gene LIMIT 5"),
)
def b28(spark, sf):
    genes = variants(spark, sf).select("gene").distinct()
    return suggest.genes(genes, "g1", 5)


_POSITIONS = """positions AS (SELECT chrom AS chromosome, start_pos AS "start", max(end_pos) AS "end", count(*) AS "count"
  FROM variants GROUP BY chrom, start_pos)"""


def _positions(spark, sf):
    v = variants(spark, sf)
    return v.groupBy(F.col("chrom").alias("chromosome"), F.col("start_pos").alias("start")).agg(
        F.max("end_pos").alias("end"), F.count(F.lit(1)).alias("count")
    )


def _position_sql(where, order='"start"'):
    return sql(
        f"""SELECT chromosome || ':' || CAST("start" AS VARCHAR) || '-' || CAST("end" AS VARCHAR) AS value, chromosome, "start",
        "end" FROM positions WHERE {where} ORDER BY {order}, chromosome, "start", "end" LIMIT 10""",
        ctes=_POSITIONS,
    )


@query(
    "b29_position_overlap",
    _position_sql("""chromosome ILIKE 'chr1%' AND "end" >= 1000100 AND "start" <= 1010400"""),
)
def b29(spark, sf):
    return suggest.positions(_positions(spark, sf), "chr1:1,010,400-1,000,100", 10)


@query("b30_position_contains", _position_sql("""chromosome ILIKE 'chr1%' AND "start" <= 1000500 AND "end" >= 1000500"""))
def b30(spark, sf):
    return suggest.positions(_positions(spark, sf), "chr1:1000500", 10)


@query(
    "b31_position_prefix",
    _position_sql("""chromosome ILIKE 'chr4%' AND CAST("start" AS VARCHAR) LIKE '1030%'"""),
)
def b31(spark, sf):
    return suggest.positions(_positions(spark, sf), "chr4:1030", 10, prefix=True)


@query("b32_position_by_count", _position_sql("chromosome ILIKE 'chr2%'", '"count"'))
def b32(spark, sf):
    return suggest.positions(_positions(spark, sf), "chr2", 10)


_ITEMS = """items AS (
  SELECT DISTINCT upper(trim(item)) AS item FROM (
    SELECT ' g' || CAST(l_partkey % 60 AS VARCHAR) || ' ' AS item FROM lineitem
    UNION ALL SELECT 'pathway p' || CAST(l_suppkey % 20 AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'chr' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) || '-' ||
      CAST(l_suppkey + 10 AS VARCHAR) FROM lineitem) x)"""


def _items(spark, sf):
    line = table(spark, sf, "lineitem")
    a = line.select(F.concat(F.lit(" g"), F.col("l_partkey") % 60, F.lit(" ")).alias("item"))
    b = line.select(F.concat(F.lit("pathway p"), F.col("l_suppkey") % 20).alias("item"))
    c = line.select(
        F.concat(F.lit("chr"), "l_linenumber", F.lit(":"), "l_suppkey", F.lit("-"), F.col("l_suppkey") + 10).alias("item")
    )
    return a.union(b).union(c)


@query(
    "b33_region_text",
    f"""WITH {_ITEMS} SELECT item, regexp_matches(item, '^CHR[0-9XYM]+:[0-9]+(-[0-9]+)?$') AS is_region FROM items""",
)
def b33(spark, sf):
    return suggest.distinct_items(_items(spark, sf)).select("item", suggest.text.is_region("item").alias("is_region"))


@query(
    "b34_validate_items",
    sql(
        """SELECT item, CASE WHEN regexp_matches(item, '^CHR[0-9XYM]+:[0-9]+(-[0-9]+)?$') THEN 'region'
          WHEN g.gene IS NOT NULL THEN 'gene' WHEN p.pathway_name IS NOT NULL THEN 'pathway' ELSE 'unknown' END AS kind,
          COALESCE(g.gene, p.pathway_name, CASE WHEN regexp_matches(item, '^CHR[0-9XYM]+:[0-9]+(-[0-9]+)?$') THEN item END)
          AS matched
        FROM items LEFT JOIN (SELECT DISTINCT gene FROM pathway_genes) g ON upper(g.gene) = item
        LEFT JOIN pathways p ON upper(p.pathway_name) = item""",
        "pathways",
        ctes=_ITEMS,
    ),
)
def b34(spark, sf):
    genes = pathway_genes(spark, sf).select("gene").distinct()
    return suggest.validate_items(_items(spark, sf), genes, pathways(spark, sf))


@query(
    "b35_edge_filter",
    sql(
        """SELECT gene_a, gene_b, confidence_score FROM edges WHERE (gene_a IN ('G1', 'G5', 'G7') OR gene_b IN ('G1', 'G5', 'G7'))
        AND interaction_type IN ('physical') AND confidence_score >= 0.2""",
        "edges",
    ),
)
def b35(spark, sf):
    from varloom.operators import graph
    from varloom.registry.fixtures import edges

    kept = graph.edges_touching(edges(spark, sf), ["G1", "G5", "G7"], types=["physical"], min_confidence=0.2)
    return kept.select("gene_a", "gene_b", "confidence_score")


@query("b36_distinct_genes", sql("SELECT DISTINCT gene FROM variants WHERE gene IS NOT NULL"))
def b36(spark, sf):
    from varloom.operators import pathway

    return pathway.mutated_genes(variants(spark, sf))


@query("b37_genes_subset", sql("SELECT * FROM variants WHERE gene IN ('G2', 'G3', 'G44')"))
def b37(spark, sf):
    return flt.genes_in(variants(spark, sf), ["G2", "G3", "G44"])


@query(
    "f2_page",
    """SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 60 OFFSET 120""",
)
def f2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return search.search(
        o, filters=_leaf("o_totalprice", "gt", 100000), sort_by="o_totalprice", descending=True, page=3, page_size=60,
        key=["o_orderkey"],
    )


@query("f2_total", sql("SELECT count(*) AS total_results FROM variants WHERE gene = 'G5' AND variant_class ILIKE '%missense%'"))
def f2_total(spark, sf):
    return search.total_results(
        variants(spark, sf), filters=_leaf("gene", "eq", "G5"), term="missense", columns=["variant_class"], roles=ROLES
    )


@query(
    "k1_search",
    sql(
        """SELECT variant_id, gene, chrom, start_pos::DOUBLE AS start_pos, end_pos::DOUBLE AS end_pos FROM variants
        WHERE (gene = 'G7' OR gene = 'G29') AND chrom = 'chr8' AND start_pos <= 1072500 AND end_pos >= 1070100
          AND variant_class ILIKE '%mut%'
        ORDER BY start_pos, variant_id LIMIT 25 OFFSET 25"""
    ),
)
def k1(spark, sf):
    v = variants(spark, sf).select("variant_id", "gene", "chrom", "start_pos", "end_pos", "variant_class")
    return search.search(
        v,
        filters=_any(_leaf("gene", "eq", "G7"), _leaf("gene", "eq", "G29")),
        positions=[{"chromosome": "8", "start": 1070100, "end": 1072500}],
        term="mut",
        columns=["variant_class"],
        sort_by="start_pos",
        page=2,
        page_size=25,
        roles=ROLES,
    ).drop("variant_class")


@query("b11_dictionary_search", sql(
    """SELECT variant_id FROM variants WHERE variant_class ILIKE '%rame_shift%' OR protein_change ILIKE '%rame_shift%'
    OR CAST(start_pos AS VARCHAR) ILIKE '%rame_shift%'"""
))
def b11_dictionary(spark, sf):
    v = variants(spark, sf).select("variant_id", "variant_class", "protein_change", "start_pos")
    columns = ["variant_class", "protein_change", "start_pos"]
    path = export.fresh_path(v, "dictionary")
    dictionary.write_dictionary(v, columns, path)
    return dictionary.free_text(v, path, "rame_shift", columns).select("variant_id")


@query("b12_dictionary_terms", sql(
    """SELECT variant_id FROM variants v WHERE (protein_change ILIKE '%p.A1%' OR CAST(start_pos AS VARCHAR) ILIKE '%p.A1%')
    AND (protein_change ILIKE '%12%' OR CAST(start_pos AS VARCHAR) ILIKE '%12%')"""
))
def b12_dictionary(spark, sf):
    v = variants(spark, sf).select("variant_id", "protein_change", "start_pos")
    columns = ["protein_change", "start_pos"]
    path = export.fresh_path(v, "dictionary")
    dictionary.write_dictionary(v, columns, path)
    return dictionary.free_text_terms(v, path, ["p.A1", "12"], columns, "all").select("variant_id")
