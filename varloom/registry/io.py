"""Checked queries for sources, sinks and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.operators import filters as flt
from varloom.plans import reports
from varloom.registry.core import query
from varloom.registry.fixtures import ROLES, cells, domains, edges, pathway_genes, pathways, sql, table, variants
from varloom.sources import catalog, delimited, export, nested
from varloom.streaming import ingest

_FILE_COLUMNS = ["variant_id", "table_name", "gene", "chrom", "start", "end", "variant_class"]
_FILE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in _FILE_COLUMNS])
_FILE_ROWS = """file AS (SELECT variant_id, table_name, gene, chrom, CASE WHEN variant_type = 'INS' THEN '?' ELSE
  CAST(start_pos AS VARCHAR) END AS "start", CAST(end_pos AS VARCHAR) AS "end", variant_class FROM variants)"""


def _file_rows(spark, sf):
    start = F.when(F.col("variant_type") == "INS", "?").otherwise(F.col("start_pos").cast("string"))
    return variants(spark, sf).select(
        "variant_id", "table_name", "gene", "chrom", start.alias("start"), F.col("end_pos").cast("string").alias("end"),
        "variant_class",
    )


@query("a1_delimited_scan", sql(
    """SELECT variant_id, gene, TRY_CAST("start" AS BIGINT) AS "start", "start" AS start_text FROM file""", ctes=_FILE_ROWS
))
def a1(spark, sf):
    rows = _file_rows(spark, sf)
    path = export.fresh_path(rows, "scan")
    export.write_delimited(rows, path)
    typed = delimited.typed_positions(delimited.read_delimited(spark, path, _FILE_SCHEMA))
    return typed.select("variant_id", "gene", "start", "start_text")


@query("a2_append_partitioned", sql("SELECT variant_id, gene FROM variants WHERE table_name = 'cohort_2'"))
def a2(spark, sf):
    v = variants(spark, sf).select("variant_id", "gene", "table_name", "variant_type")
    path = export.fresh_path(v, "append")
    catalog.append(v.filter("variant_type = 'SNP'"), path)
    catalog.append(v.filter("variant_type <> 'SNP'"), path)
    return flt.cohort(catalog.load_table(spark, path), "cohort_2").select("variant_id", "gene")


@query("a3_delimited_sink", sql("SELECT gene, disease, count(*) AS n FROM variants GROUP BY gene, disease"))
def a3(spark, sf):
    out = variants(spark, sf).groupBy("gene", "disease").agg(F.count(F.lit(1)).alias("n"))
    return export.written_and_read(out)


@query("a4_whole_table", "SELECT * FROM customer")
def a4(spark, sf):
    return catalog.load_table(spark, f"{sf}/customer.parquet")


@query("a5_table_by_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def a5(spark, sf):
    for name in ("nation", "region"):
        table(spark, sf, name).createOrReplaceTempView(f"varloom_{name}")
    n, r = catalog.table_by_name(spark, "varloom_nation"), catalog.table_by_name(spark, "varloom_region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name")


@query("a6_cohort", sql("SELECT variant_id, table_name FROM variants WHERE table_name = 'cohort_1'"))
def a6(spark, sf):
    return flt.cohort(variants(spark, sf), "cohort_1", ROLES).select("variant_id", "table_name")


def _records(spark, sf):
    """One transcript document per part, as JSON text."""
    p, key, size = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size").cast("bigint")

    def text_of(prefix, *parts):
        return F.concat(F.lit(prefix), *parts)

    def listed(n, make):
        steps = F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1)))
        return F.when(n > 0, F.transform(steps, make))

    exon = lambda i: F.struct(
        text_of("E", key, F.lit("."), i).alias("exonId"), (key * 100 + i * 10).alias("exonStart"),
        (key * 100 + i * 10 + 5).alias("exonEnd"), i.alias("rank"), F.lit(1).alias("strand"),
    )
    domain = lambda i: F.struct(
        F.when((key + i) % 5 != 0, text_of("PF", (key + i) % 9)).alias("pfamDomainId"),
        (i * 20).alias("pfamDomainStart"), (i * 20 + size).alias("pfamDomainEnd"),
    )
    doc = F.struct(
        text_of("T", key).alias("transcriptId"),
        F.when(key % 4 != 0, F.array(text_of("G", key % 50), F.lit("X"))).otherwise(F.array()).alias("hugoSymbols"),
        (size * 10).alias("proteinLength"),
        listed(size % 4, exon).alias("exons"),
        listed(size % 3, domain).alias("pfamDomains"),
    )
    return nested.parse_transcripts(p.select(F.to_json(doc).alias("doc")), "doc")


_KEY = "'T' || CAST(p_partkey AS VARCHAR) AS transcript_id"


@query("a7_transcripts", f"""SELECT {_KEY}, CASE WHEN p_partkey % 4 <> 0 THEN 'G' || CAST(p_partkey % 50 AS VARCHAR) END AS gene_symbol,
    p_size::BIGINT * 10 AS protein_length FROM part""")
def a7(spark, sf):
    return nested.transcript_table(_records(spark, sf)).select("transcript_id", "gene_symbol", "protein_length")


@query("a7_exons", f"""SELECT {_KEY}, 'E' || CAST(p_partkey AS VARCHAR) || '.' || CAST(i AS VARCHAR) AS exon_id, i AS rank,
    p_partkey * 100 + i * 10 AS "start", p_partkey * 100 + i * 10 + 5 AS "end" FROM part, unnest(generate_series(1, p_size % 4)) AS u(i)""")
def a7_exons(spark, sf):
    return nested.exon_table(_records(spark, sf)).select("transcript_id", "exon_id", "rank", "start", "end")


_DOMAIN_ROWS = f"""SELECT {_KEY}, 'PF' || CAST((p_partkey + i) % 9 AS VARCHAR) AS pfam_id, i * 20 AS "start", i * 20 + p_size AS "end"
    FROM part, unnest(generate_series(1, p_size % 3)) AS u(i) WHERE (p_partkey + i) % 5 <> 0"""


@query("a7_domains", _DOMAIN_ROWS)
def a7_domains(spark, sf):
    return nested.domain_table(_records(spark, sf))


@query("a11_domain_names", f"""SELECT d.*, coalesce(n_name, pfam_id) AS domain_name FROM ({_DOMAIN_ROWS}) d
    LEFT JOIN nation ON pfam_id = 'PF' || CAST(n_nationkey AS VARCHAR) AND n_nationkey < 6""")
def a11(spark, sf):
    names = table(spark, sf, "nation").filter("n_nationkey < 6").select(
        F.concat(F.lit("PF"), "n_nationkey").alias("pfam_id"), F.col("n_name").alias("name")
    )
    return nested.with_domain_names(nested.domain_table(_records(spark, sf)), names)


@query("a8_exchange_names", sql(
    """SELECT variant_id, gene AS "Hugo_Symbol", chrom AS "Chromosome", start_pos AS "Start_Position", end_pos AS "End_Position",
    variant_type AS "Variant_Type", ref_allele AS "Reference_Allele", variant_class AS "Variant_Classification",
    tumor_sample_barcode AS "Tumor_Sample_Barcode" FROM variants"""
))
def a8(spark, sf):
    v = variants(spark, sf).select(
        "variant_id", "gene", "chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "variant_type",
        "ref_allele", "variant_class", "tumor_sample_barcode",
    )
    return delimited.to_exchange_names(v)


@query("a9_text_list", sql("SELECT DISTINCT gene AS item FROM variants WHERE gene NOT IN ('G1', 'G2')"))
def a9(spark, sf):
    genes = variants(spark, sf).select("gene").distinct()
    line = F.when(F.col("gene").isin("G1", "G2"), F.concat(F.lit(" # "), "gene")).otherwise(F.concat(F.lit("  "), "gene", F.lit(" ")))
    lines = genes.select(line.alias("value")).union(genes.select(F.lit("   ")))
    path = export.fresh_path(genes, "list")
    lines.write.text(path)
    return delimited.read_list(spark, path)


_STRUCTURE = "gene string, size bigint, note string, checked boolean, parts array<bigint>"


def _structures(spark, sf):
    p = table(spark, sf, "part")
    gene = F.concat(F.lit("G"), F.col("p_partkey") % 300)
    note = F.when(F.col("p_partkey") % 3 == 0, F.lit("None")).otherwise(F.lit("'None is True here'"))
    checked = F.when(F.col("p_partkey") % 2 == 0, "True").otherwise("False")
    literal = F.concat(
        F.lit("{'gene': '"), gene, F.lit("', 'size': "), "p_size", F.lit(", 'note': "), note, F.lit(", 'checked': "), checked,
        F.lit(", 'parts': [1, "), "p_size", F.lit("]}"),
    )
    return p.select(
        F.col("p_partkey").alias("id"), gene.alias("gene"), F.concat(F.lit("A"), "p_partkey").alias("accession_id"),
        literal.alias("structure"),
    )


_STRUCTURE_SQL = """SELECT 'G' || CAST(p_partkey % 300 AS VARCHAR) AS gene, 'A' || CAST(p_partkey AS VARCHAR) AS accession_id,
  CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 3 <> 0 THEN 'None is True here' END AS note, p_partkey % 2 = 0 AS checked,
  CAST(p_size AS BIGINT) AS last_part FROM part
  QUALIFY row_number() OVER (PARTITION BY p_partkey % 300 ORDER BY p_partkey) = 1"""


def _flat(df):
    s = "structure."
    return df.select(
        "gene", "accession_id", F.col(s + "size"), F.col(s + "note"), F.col(s + "checked"),
        F.get(s + "parts", F.lit(1)).alias("last_part"),
    )


@query("a10_stored_structure", _STRUCTURE_SQL)
def a10(spark, sf):
    return _flat(nested.structures(_structures(spark, sf), _STRUCTURE))


@query("k8_structure_of_gene", f"SELECT * FROM ({_STRUCTURE_SQL}) s WHERE gene = 'G17'")
def k8(spark, sf):
    return _flat(nested.structure_of(_structures(spark, sf), "G17", _STRUCTURE))


@query("s1_stream_ingest", sql(
    """SELECT variant_id, table_name, gene, TRY_CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM file
    QUALIFY row_number() OVER (PARTITION BY table_name, variant_id ORDER BY gene, chrom, TRY_CAST("start" AS BIGINT) NULLS FIRST,
      CAST("end" AS BIGINT), variant_class) = 1""",
    ctes=_FILE_ROWS,
))
def s1(spark, sf):
    rows = _file_rows(spark, sf)
    folder, target, marks = (export.fresh_path(rows, n) for n in ("arrivals", "ingested", "progress"))
    export.write_delimited(rows, folder)
    stream = ingest.variant_stream(spark, folder, _FILE_SCHEMA)
    ingest.ingest_available(stream, target, marks, key=("table_name", "variant_id"))
    # files that arrive later repeat some rows; a second run takes only what is new
    export.write_delimited(rows.filter("gene in ('G1', 'G2')"), folder, mode="append")
    stream = ingest.variant_stream(spark, folder, _FILE_SCHEMA)
    ingest.ingest_available(stream, target, marks, key=("table_name", "variant_id"))
    return ingest.ingested(spark, target, stream.schema).select("variant_id", "table_name", "gene", "start", "end")


#: Packed files cannot be split, so a batch has one for each of its tasks.
_BATCH_FILES = 12


@query("s1_twenty_batches", sql(
    """SELECT variant_id, table_name, gene, TRY_CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM file
    QUALIFY row_number() OVER (PARTITION BY table_name, variant_id ORDER BY gene, chrom, TRY_CAST("start" AS BIGINT) NULLS FIRST,
      CAST("end" AS BIGINT), variant_class) = 1""",
    ctes=_FILE_ROWS,
))
def s1_batches(spark, sf):
    """All rows twice, over twenty batches of ``_BATCH_FILES`` files each."""
    rows = _file_rows(spark, sf)
    folder, target, marks = (export.fresh_path(rows, n) for n in ("arrivals", "ingested", "progress"))
    copies = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    files = 20 * _BATCH_FILES
    part = F.pmod(F.xxhash64("variant_id", "copy"), F.lit(files)).cast("int")
    placed = copies.withColumn("part", part).repartitionById(files, F.col("part")).drop("copy", "part")
    export.write_delimited(placed, folder, compression="gzip")
    stream = ingest.variant_stream(spark, folder, _FILE_SCHEMA, files_per_batch=_BATCH_FILES)
    ingest.ingest_available(stream, target, marks, key=("table_name", "variant_id"))
    return ingest.ingested(spark, target, stream.schema).select("variant_id", "table_name", "gene", "start", "end")


# --- composite entries over several sources --------------------------------


@query("k6_interaction_heatmap", sql(
    """SELECT x.g AS gene1, y.g AS gene2, coalesce(s, 0.0::DOUBLE) AS value FROM (SELECT unnest(['G1', 'G14', 'G4', 'G9']) AS g) x
    JOIN (SELECT unnest(['G1', 'G14', 'G4', 'G9']) AS g) y ON x.g < y.g LEFT JOIN (SELECT least(gene_a, gene_b) AS a, greatest(gene_a, gene_b)
      AS b, CASE WHEN min(1.5 - confidence_score) < 1 THEN -max(confidence_score) ELSE max(confidence_score) END AS s FROM edges GROUP BY 1, 2) e
    ON e.a = x.g AND e.b = y.g""", "edges",
))
def k6(spark, sf):
    pairs = edges(spark, sf).select(
        F.col("gene_a").alias("gene1"), F.col("gene_b").alias("gene2"), F.col("confidence_score").alias("neg_log10_pval"),
        (F.lit(1.5) - F.col("confidence_score")).alias("odds_ratio"),
    )
    return reports.interaction_heatmap(pairs, ["G14", "G1", "G9", "G4"])


@query("k7_autocomplete", sql(
    """SELECT 'gene' AS kind, gene AS value FROM (SELECT DISTINCT gene FROM pathway_genes WHERE gene ILIKE 'g2%' ORDER BY gene LIMIT 6) a
    UNION ALL SELECT 'pathway', pathway_name FROM (SELECT pathway_name FROM pathways WHERE pathway_name ILIKE 'g2%') b""", "pathways",
))
def k7(spark, sf):
    genes = pathway_genes(spark, sf).select("gene").distinct()
    parts = reports.autocomplete(genes, pathways(spark, sf), pathway_genes(spark, sf), "g2", 6)
    a = parts["genes"].select(F.lit("gene").alias("kind"), F.col("gene").alias("value"))
    return a.union(parts["pathways"].select(F.lit("pathway"), "pathway_name"))


@query("k12_pathway_lookup", sql("SELECT gene FROM pathway_genes WHERE pathway_id = 'P3'", "pathway_genes"))
def k12(spark, sf):
    return reports.pathway_analysis("pathway_genes", pathway_genes(spark, sf), pathways(spark, sf), pathway_id="P3")


@query("k13_gene_network", sql(
    """SELECT partner AS gene, 1 AS distance FROM (SELECT gene_a AS gene, gene_b AS partner FROM edges UNION SELECT gene_b, gene_a FROM edges) l
    WHERE gene = 'G8' AND partner <> 'G8'""", "edges",
))
def k13(spark, sf):
    return reports.gene_network(edges(spark, sf), "neighbors", ["G8"], hops=1).select("gene", "distance")
