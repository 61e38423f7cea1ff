"""Variant tables derived from the given star-schema tables.

Each fixture exists twice: as a DataFrame and as the SQL the oracle embeds.
Only integer arithmetic and ``substr`` are used, so both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.roles import Roles

ROLES = Roles(start="start_pos", end="end_pos")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(index):
    return F.substring(F.lit("ACGT"), (F.lit(1) + index).cast("int"), F.lit(1))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, dressed up as a mutation seen in a sample."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(
        customer, orders["o_custkey"] == customer["c_custkey"]
    )
    okey, number, pkey, skey = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    offset = (okey * 7 + skey * 13 + number * 101) % 3000
    start = F.lit(1000000) + (pkey % 50) * 10000 + offset
    ref, alt = _base(okey % 4), _base((okey + 1 + skey % 3) % 4)
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    variant_class = (
        F.when((flag == "A") & (status == "F"), "Missense_Mutation")
        .when(flag == "A", "Silent")
        .when((flag == "N") & (status == "F"), "Nonsense_Mutation")
        .when(flag == "N", "Frame_Shift_Del")
        .when(status == "F", "In_Frame_Ins")
        .otherwise("Splice_Region")
    )
    return rows.select(
        F.concat_ws("-", okey, number, pkey, skey).alias("variant_id"),
        F.concat(F.lit("cohort_"), F.col("o_custkey") % 3).alias("table_name"),
        F.concat(F.lit("S"), F.col("o_custkey")).alias("tumor_sample_barcode"),
        F.col("c_mktsegment").alias("disease"),
        F.concat(F.lit("G"), pkey % 50).alias("gene"),
        F.concat(F.lit("chr"), (pkey % 50) % 22 + 1).alias("chrom"),
        start.alias("start_pos"),
        (start + F.col("l_quantity").cast("bigint") % 3).alias("end_pos"),
        ref.alias("ref_allele"),
        alt.alias("tumor_seq_allele2"),
        F.concat(_base(pkey % 4), ref, _base(skey % 4)).alias("trinucleotide_context"),
        F.when(number <= 5, "SNP").when(number == 6, "DEL").otherwise("INS").alias("variant_type"),
        variant_class.alias("variant_class"),
        F.concat(
            F.lit("p."), ref, (F.floor(offset / 3).cast("bigint") + 1).cast("string"), alt
        ).alias("protein_change"),
    )


VARIANTS = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)
   || '-' || CAST(l_suppkey AS VARCHAR) AS variant_id,
 'cohort_' || CAST(o_custkey % 3 AS VARCHAR) AS table_name,
 'S' || CAST(o_custkey AS VARCHAR) AS tumor_sample_barcode,
 c_mktsegment AS disease,
 'G' || CAST(l_partkey % 50 AS VARCHAR) AS gene,
 'chr' || CAST((l_partkey % 50) % 22 + 1 AS VARCHAR) AS chrom,
 1000000 + (l_partkey % 50) * 10000 + ((l_orderkey * 7 + l_suppkey * 13 + l_linenumber * 101) % 3000) AS start_pos,
 1000000 + (l_partkey % 50) * 10000 + ((l_orderkey * 7 + l_suppkey * 13 + l_linenumber * 101) % 3000)
   + CAST(l_quantity AS BIGINT) % 3 AS end_pos,
 substr('ACGT', CAST(1 + l_orderkey % 4 AS INT), 1) AS ref_allele,
 substr('ACGT', CAST(1 + (l_orderkey + 1 + l_suppkey % 3) % 4 AS INT), 1) AS tumor_seq_allele2,
 substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) || substr('ACGT', CAST(1 + l_orderkey % 4 AS INT), 1)
   || substr('ACGT', CAST(1 + l_suppkey % 4 AS INT), 1) AS trinucleotide_context,
 CASE WHEN l_linenumber <= 5 THEN 'SNP' WHEN l_linenumber = 6 THEN 'DEL' ELSE 'INS' END AS variant_type,
 CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Missense_Mutation' WHEN l_returnflag = 'A' THEN 'Silent'
   WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'Nonsense_Mutation' WHEN l_returnflag = 'N' THEN 'Frame_Shift_Del'
   WHEN l_linestatus = 'F' THEN 'In_Frame_Ins' ELSE 'Splice_Region' END AS variant_class,
 'p.' || substr('ACGT', CAST(1 + l_orderkey % 4 AS INT), 1)
   || CAST(((l_orderkey * 7 + l_suppkey * 13 + l_linenumber * 101) % 3000) // 3 + 1 AS VARCHAR)
   || substr('ACGT', CAST(1 + (l_orderkey + 1 + l_suppkey % 3) % 4 AS INT), 1) AS protein_change
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""


def gene_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gene per part; ``block`` is one of fifty genes each."""
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("n")).distinct()
    return parts.withColumn("block", F.floor(F.col("n") / 50))


GENE_NUMBERS = "SELECT DISTINCT l_partkey AS n, l_partkey // 50 AS block FROM lineitem"


def _gene(n):
    return F.concat(F.lit("G"), n)


def pathway_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pathways of each gene, and eighteen pathways per block of genes."""
    g, n, block = gene_numbers(spark, sf_dir), F.col("n"), F.col("block")
    first = g.select(_gene(n).alias("gene"), F.concat(F.lit("P"), block * 18 + n % 7).alias("pathway_id"))
    second = g.select(_gene(n).alias("gene"), F.concat(F.lit("P"), block * 18 + n % 11 + 7).alias("pathway_id"))
    return first.union(second).distinct()


PATHWAY_GENES = f"""
SELECT 'G' || CAST(n AS VARCHAR) AS gene, 'P' || CAST(block * 18 + n % 7 AS VARCHAR) AS pathway_id FROM ({GENE_NUMBERS}) g
UNION SELECT 'G' || CAST(n AS VARCHAR), 'P' || CAST(block * 18 + 7 + n % 11 AS VARCHAR) FROM ({GENE_NUMBERS}) g
"""


def pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pathway_genes(spark, sf_dir).select(F.col("pathway_id").alias("id")).distinct()
    return ids.select("id", F.concat(F.lit("Pathway "), "id").alias("pathway_name"))


PATHWAYS = "SELECT DISTINCT pathway_id AS id, 'Pathway ' || pathway_id AS pathway_name FROM pathway_genes"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical links inside a block of genes, genetic ones across blocks."""
    g, n = gene_numbers(spark, sf_dir), F.col("n")
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_partkey")).scalar()
    first = g.select(
        _gene(n).alias("gene_a"), _gene(F.col("block") * 50 + (n * 3 + 1) % 50).alias("gene_b"),
        F.lit("physical").alias("interaction_type"),
        ((n * 37) % 100).cast("double").alias("score"),
    )
    second = g.select(
        _gene(n).alias("gene_a"), _gene((n * 7 + 2) % last).alias("gene_b"),
        F.lit("genetic").alias("interaction_type"),
        ((n * 53) % 100).cast("double").alias("score"),
    )
    return first.union(second).select(
        "gene_a", "gene_b", "interaction_type", (F.col("score") / 100).alias("confidence_score")
    )


EDGES = f"""
SELECT 'G' || CAST(n AS VARCHAR) AS gene_a, 'G' || CAST(block * 50 + (n * 3 + 1) % 50 AS VARCHAR) AS gene_b,
  'physical' AS interaction_type, CAST((n * 37) % 100 AS DOUBLE) / 100 AS confidence_score FROM ({GENE_NUMBERS}) g
UNION ALL SELECT 'G' || CAST(n AS VARCHAR), 'G' || CAST((n * 7 + 2) % (SELECT max(l_partkey) FROM lineitem) AS VARCHAR), 'genetic',
  CAST((n * 53) % 100 AS DOUBLE) / 100 FROM ({GENE_NUMBERS}) g
"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of part-supplier pairs, with as many nodes as there are parts."""
    line = table(spark, sf_dir, "lineitem")
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    last = line.agg(F.max("l_partkey")).scalar()
    return line.select("l_partkey", "l_suppkey").distinct().select(
        _gene(part).alias("gene_a"), _gene((part * 7 + supplier * 13) % last + 1).alias("gene_b"),
        F.lit("physical").alias("interaction_type"),
        (((part * 37 + supplier) % 100).cast("double") / 100).alias("confidence_score"),
    )


PART_EDGES = """
SELECT 'G' || CAST(l_partkey AS VARCHAR) AS gene_a,
  'G' || CAST((l_partkey * 7 + l_suppkey * 13) % (SELECT max(l_partkey) FROM lineitem) + 1 AS VARCHAR) AS gene_b,
  'physical' AS interaction_type, CAST((l_partkey * 37 + l_suppkey) % 100 AS DOUBLE) / 100 AS confidence_score
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) g
"""


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, sample) with a gene per part and a sample per customer."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    return rows.select(_gene(F.col("l_partkey")).alias("gene"), F.concat(F.lit("S"), "o_custkey").alias("sample")).distinct()


PART_CELLS = """
SELECT DISTINCT 'G' || CAST(l_partkey AS VARCHAR) AS gene, 'S' || CAST(o_custkey AS VARCHAR) AS sample
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three domains per gene, which do not overlap."""
    g, n = gene_numbers(spark, sf_dir), F.col("n")
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("k")
    return g.select("n", k).select(
        _gene(n).alias("gene"),
        F.concat(F.lit("D"), F.col("k")).alias("domain_id"),
        F.when(F.col("k") > 0, F.concat(F.lit("Domain "), F.col("k"))).alias("domain_name"),
        (F.col("k") * 300 + 1).alias("domain_start"),
        (F.col("k") * 300 + 100 + n % 150).alias("domain_end"),
    )


DOMAINS = f"""
SELECT 'G' || CAST(n AS VARCHAR) AS gene, 'D' || CAST(k AS VARCHAR) AS domain_id,
  CASE WHEN k > 0 THEN 'Domain ' || CAST(k AS VARCHAR) END AS domain_name,
  1 + k * 300 AS domain_start, 1 + k * 300 + 99 + n % 150 AS domain_end
FROM ({GENE_NUMBERS}) g
CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS k FROM region WHERE r_regionkey < 3) d
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alteration cells: one code per (gene, sample) from non-silent variants."""
    v = variants(spark, sf_dir)
    code = (
        F.when(F.col("variant_class") == "Missense_Mutation", 1)
        .when(F.col("variant_class") == "Frame_Shift_Del", 4)
        .when(F.col("variant_class") == "Nonsense_Mutation", 5)
        .when(F.col("variant_class") == "In_Frame_Ins", 8)
        .otherwise(0)
    )
    from varloom.functions.genomics import code_annotation

    # by sample, so that tables of one row a sample need no further shuffle
    rows = v.select("gene", "tumor_sample_barcode", code.alias("code")).repartition("tumor_sample_barcode")
    return (
        rows.groupBy("gene", "tumor_sample_barcode")
        .agg(F.min("code").alias("code"))
        .withColumn("annotation", code_annotation("code"))
    )


CELLS = """
SELECT gene, tumor_sample_barcode, code,
  CASE code WHEN 1 THEN 'Missense_Mutation' WHEN 4 THEN 'Frame_Shift_Del' WHEN 5 THEN 'Nonsense_Mutation'
    WHEN 8 THEN 'In_Frame_Ins' ELSE '' END AS annotation
FROM (SELECT gene, tumor_sample_barcode, MIN(CASE variant_class WHEN 'Missense_Mutation' THEN 1
   WHEN 'Frame_Shift_Del' THEN 4 WHEN 'Nonsense_Mutation' THEN 5 WHEN 'In_Frame_Ins' THEN 8 ELSE 0 END) AS code
  FROM variants GROUP BY gene, tumor_sample_barcode) x
"""

_PARTS = {
    "variants": VARIANTS,
    "pathway_genes": PATHWAY_GENES,
    "pathways": PATHWAYS,
    "edges": EDGES,
    "part_edges": PART_EDGES,
    "part_cells": PART_CELLS,
    "domains": DOMAINS,
    "cells": CELLS,
}
_NEEDS = {"cells": ["variants"], "pathways": ["pathway_genes"]}


def sql(body: str, *parts: str, ctes: str = "") -> str:
    """``body`` with the named fixtures as common table expressions."""
    wanted: list[str] = []
    for part in parts or ("variants",):
        for name in [*_NEEDS.get(part, []), part]:
            if name not in wanted:
                wanted.append(name)
    with_list = [f"{name} AS ({_PARTS[name]})" for name in wanted]
    if ctes:
        with_list.append(ctes)
    return f"WITH {', '.join(with_list)} {body}"
