"""Column roles and table schemas.

Operators never hard-code a column: they ask a :class:`Roles` value which
column of the caller's table plays the part of gene, sample, position, ...
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    variant_id: str = "variant_id"
    cohort: str = "table_name"
    sample: str = "tumor_sample_barcode"
    disease: str = "disease"
    gene: str = "gene"
    chrom: str = "chrom"
    start: str = "start"
    end: str | None = "end"
    ref: str = "ref_allele"
    alt: str = "tumor_seq_allele2"
    context: str = "trinucleotide_context"
    variant_type: str = "variant_type"
    variant_class: str = "variant_class"
    protein_change: str = "protein_change"


class UnknownColumns(ValueError):
    """Raised when a request names columns the table does not have."""


class UnknownTable(LookupError):
    """Raised when a table name is not in the catalog."""


def col(name: str) -> Column:
    """Column reference that is safe for names holding dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Fail with the full list of names that ``df`` lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise UnknownColumns(f"invalid columns: {sorted(set(missing))}")


def first_existing(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first of ``candidates`` that is a column of ``df``."""
    for name in candidates:
        if name in df.columns:
            return name
    raise UnknownColumns(f"none of {list(candidates)} exists")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


_TEXT = T.StringType()


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _TEXT) for n in names]


# Positions arrive as text in raw files; `sources.delimited.typed_positions`
# turns them into bigint and keeps the raw text.
VARIANT_FILE_SCHEMA = T.StructType(
    [T.StructField("variant_id", T.LongType())]
    + _strings(
        "table_name", "gene", "tumor_sample_barcode", "disease", "chrom", "start", "end",
        "ncbi_build", "ref_allele", "tumor_seq_allele2", "trinucleotide_context",
        "variant_type", "variant_class", "protein_change", "codon_change", "cDNA_change",
        "genome_change", "dbsnp_rs",
    )
    + [T.StructField("entrez_gene_id", T.LongType())]
    + _strings(
        "transcript_exon", "transcript_strand", "transcript_position",
        "annotation_transcript", "reference", "reference_url", "remarks",
    )
)

GENELIST_SCHEMA = T.StructType(_strings("gene"))
PATHWAY_SCHEMA = T.StructType(_strings("id", "pathway_name"))
PATHWAY_GENE_SCHEMA = T.StructType(_strings("gene", "pathway_id"))
PATIENT_SCHEMA = T.StructType(_strings("id"))
STRUCTURE_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType())] + _strings("gene", "accession_id", "structure")
)
POSITION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("chromosome", _TEXT),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("count", T.LongType()),
    ]
)
TRANSCRIPT_SCHEMA = T.StructType(
    _strings("transcript_id", "gene", "gene_id", "refseq_id", "protein_id", "uniprot_id")
    + [T.StructField("protein_length", T.LongType())]
)
EXON_SCHEMA = T.StructType(
    _strings("transcript_id", "exon_id")
    + [T.StructField(n, T.LongType()) for n in ("rank", "start", "end", "strand", "version")]
)
DOMAIN_SCHEMA = T.StructType(
    _strings("transcript_id", "domain_name", "name", "description")
    + [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
ONCOPLOT_SCHEMA = T.StructType(
    _strings("gene", "tumor_sample_barcode")
    + [T.StructField("code", T.IntegerType()), T.StructField("annotation", _TEXT)]
)
GENE_PAIR_SCHEMA = T.StructType(
    _strings("gene1", "gene2")
    + [T.StructField(n, T.DoubleType()) for n in ("p_value", "odds_ratio", "neg_log10_pval")]
)
SAMPLE_TMB_SCHEMA = T.StructType(
    _strings("tumor_sample_barcode", "variant_class") + [T.StructField("count", T.LongType())]
)
SAMPLE_TITV_SCHEMA = T.StructType(
    _strings("tumor_sample_barcode", "snv_class") + [T.StructField("count", T.LongType())]
)
INTERACTION_EDGE_SCHEMA = T.StructType(
    _strings("gene_a", "gene_b", "interaction_type")
    + [T.StructField("confidence_score", T.DoubleType())]
    + _strings("source_database", "experimental_evidence")
)
PROTEIN_DOMAIN_SCHEMA = T.StructType(
    _strings("gene_symbol", "domain_name", "domain_id")
    + [T.StructField("domain_start", T.LongType()), T.StructField("domain_end", T.LongType())]
    + _strings("domain_database")
)
