"""Nested documents: transcript records and stored structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.operators.ordering import top_per_group
from varloom.roles import col

TRANSCRIPT_RECORD = (
    "transcriptId string, hugoSymbols array<string>, geneId string, proteinId string, proteinLength bigint, "
    "refseqMrnaId string, uniprotId string, "
    "exons array<struct<exonId:string,exonStart:bigint,exonEnd:bigint,rank:bigint,strand:bigint,version:bigint>>, "
    "pfamDomains array<struct<pfamDomainId:string,pfamDomainStart:bigint,pfamDomainEnd:bigint>>"
)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSCRIPT_RECORD).json(path)


def parse_transcripts(df: DataFrame, column: str) -> DataFrame:
    """The same records from a text column."""
    return df.select(F.from_json(col(column), TRANSCRIPT_RECORD).alias("r")).select("r.*")


def transcript_table(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("transcriptId").alias("transcript_id"),
        F.get("hugoSymbols", F.lit(0)).alias("gene_symbol"),
        F.col("geneId").alias("gene_id"),
        F.col("proteinId").alias("protein_id"),
        F.col("proteinLength").alias("protein_length"),
        F.col("refseqMrnaId").alias("refseq_id"),
        F.col("uniprotId").alias("uniprot_id"),
    )


def exon_table(records: DataFrame) -> DataFrame:
    rows = records.select(F.col("transcriptId").alias("transcript_id"), F.explode("exons").alias("e"))
    return rows.select(
        "transcript_id",
        F.col("e.exonId").alias("exon_id"),
        F.col("e.rank").alias("rank"),
        F.col("e.strand").alias("strand"),
        F.col("e.exonStart").alias("start"),
        F.col("e.exonEnd").alias("end"),
        F.col("e.version").alias("version"),
    )


def domain_table(records: DataFrame) -> DataFrame:
    """Domains with an id; entries without one are left out."""
    rows = records.select(F.col("transcriptId").alias("transcript_id"), F.explode("pfamDomains").alias("d"))
    return rows.filter(F.coalesce("d.pfamDomainId", F.lit("")) != "").select(
        "transcript_id",
        F.col("d.pfamDomainId").alias("pfam_id"),
        F.col("d.pfamDomainStart").alias("start"),
        F.col("d.pfamDomainEnd").alias("end"),
    )


def with_domain_names(domains: DataFrame, names: DataFrame) -> DataFrame:
    """Add the domain's name, or its id where no name is known."""
    known = names.groupBy("pfam_id").agg(F.min("name").alias("_name"))
    joined = domains.join(known, "pfam_id", "left")
    return joined.withColumn("domain_name", F.coalesce("_name", "pfam_id")).drop("_name")


# The rest of the text after a word outside of quotes: plain characters and
# complete quoted strings.
_OUTSIDE = r"""(?=(?:[^'"]++|'[^']*+'|"[^"]*+")*+$)"""
_WORDS = {"None": "null", "True": "true", "False": "false"}


def parse_literal(column: str, schema: str | T.DataType):
    """A stored Python-style literal as a nested value."""
    text = col(column)
    for word, json_word in _WORDS.items():
        text = F.regexp_replace(text, rf"\b{word}\b{_OUTSIDE}", json_word)
    return F.from_json(text, schema, {"allowSingleQuotes": "true"})


def structures(df: DataFrame, schema: str | T.DataType) -> DataFrame:
    """The first stored structure of every gene, parsed."""
    first = top_per_group(df, ["gene"], 1, [F.col("id").asc()])
    return first.select("gene", "accession_id", parse_literal("structure", schema).alias("structure"))


def structure_of(df: DataFrame, gene: str, schema: str | T.DataType) -> DataFrame:
    """The structure of one gene; the filter comes before anything is parsed."""
    return structures(df.filter(F.col("gene") == gene), schema)
