"""Delimited and plain text files in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.functions import text
from varloom.roles import VARIANT_FILE_SCHEMA, col

# Column names of the mutation exchange format.
EXCHANGE_NAMES = {
    "gene": "Hugo_Symbol",
    "chrom": "Chromosome",
    "end": "End_Position",
    "start": "Start_Position",
    "ncbi_build": "NCBI_Build",
    "variant_type": "Variant_Type",
    "protein_change": "HGVSp_Short",
    "ref_allele": "Reference_Allele",
    "entrez_gene_id": "Entrez_Gene_Id",
    "tumor_seq_allele2": "Tumor_Seq_Allele2",
    "variant_class": "Variant_Classification",
    "tumor_sample_barcode": "Tumor_Sample_Barcode",
}


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: T.StructType = VARIANT_FILE_SCHEMA, sep: str = "\t", header: bool = True
) -> DataFrame:
    """Scan with an explicit schema; splits are Spark's, not fixed-size chunks."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def typed_positions(df: DataFrame, names: Sequence[str] = ("start", "end")) -> DataFrame:
    """Position columns as bigint; the text as read stays in ``<name>_text``.

    Text that is no whole number becomes null in the typed column.
    """
    for name in names:
        if name in df.columns:
            df = df.withColumn(f"{name}_text", col(name).cast("string")).withColumn(name, text.to_int(f"{name}_text"))
    return df


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One item per line; blank lines and lines that start with # are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("item"))
    return lines.filter((F.col("item") != "") & ~F.col("item").startswith("#"))


def to_exchange_names(df: DataFrame) -> DataFrame:
    """Rename variant columns to the exchange format, others stay."""
    return df.withColumnsRenamed({k: v for k, v in EXCHANGE_NAMES.items() if k in df.columns})
