"""Domain expressions over variant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom.functions.stats import rounded
from varloom.functions.text import _as_column

# Length of one distance unit in base pairs.
UNIT_BP = {"bp": 1, "kb": 1000, "mb": 1000000, "codon": 3}

# Mutation classes counted as truncating and as in-frame.
TRUNCATING_CLASSES = (
    "Nonsense_Mutation",
    "Frame_Shift_Del",
    "Frame_Shift_Ins",
    "Frameshift_Deletion",
    "Frameshift_Insertion",
    "Splice_Site",
)
INFRAME_CLASSES = ("In_Frame_Del", "In_Frame_Ins")

# Alteration codes of the cell matrix.
CODE_ANNOTATION = {
    0: "",
    1: "Missense_Mutation",
    2: "Frame_Shift_Ins",
    3: "In_Frame_Del",
    4: "Frame_Shift_Del",
    5: "Nonsense_Mutation",
    6: "Splice_Site",
    7: "Nonstop_Mutation",
    8: "In_Frame_Ins",
    9: "Multi_Hit",
}

# The six pyrimidine substitution classes.
SUBSTITUTIONS = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")

BASES = "ACGT"


def distance_bp(distance: int, unit: str = "bp") -> int:
    if unit not in UNIT_BP:
        raise ValueError(f"unknown distance unit {unit!r}")
    return distance * UNIT_BP[unit]


def distance_in(c: Column | str, unit: str = "bp") -> Column:
    """Base pairs shown in another unit; codons are whole, kb and mb rounded."""
    d = _as_column(c)
    if unit == "bp":
        return d
    if unit == "kb":
        return rounded(d / F.lit(1000.0), 3)
    if unit == "mb":
        return rounded(d / F.lit(1000000.0), 6)
    if unit == "codon":
        return F.floor(d / F.lit(3)).cast("bigint")
    raise ValueError(f"unknown distance unit {unit!r}")


def relative_direction(query: Column | str, reference: Column | str) -> Column:
    q, r = _as_column(query), _as_column(reference)
    return F.when(q < r, "upstream").when(q > r, "downstream").otherwise("same")


def complement(c: Column | str) -> Column:
    """Base-wise complement; letters outside ACGT become N."""
    upper = F.regexp_replace(F.upper(_as_column(c)), "[^ACGT]", "N")
    return F.translate(upper, "ACGT", "TGCA")


def _pair(c: Column) -> Column:
    """Complement of text that is known to hold plain bases only."""
    return F.translate(c, "ACGT", "TGCA")


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(complement(c))


def is_purine(c: Column | str) -> Column:
    return F.upper(_as_column(c)).isin("A", "G")


def pyrimidine_substitution(ref: Column | str, alt: Column | str) -> Column:
    """REF>ALT seen from the pyrimidine strand; null unless both are one base."""
    r, a = F.upper(_as_column(ref)), F.upper(_as_column(alt))
    single = r.isin(*BASES) & a.isin(*BASES) & (r != a)
    forward = F.concat(r, F.lit(">"), a)
    return F.when(single, F.when(r.isin("A", "G"), _pair(forward)).otherwise(forward))


def channel(ref: Column | str, alt: Column | str, context: Column | str) -> Column:
    """Trinucleotide channel such as C>T_ACG.

    Null when the context is not three plain bases or its centre is not ref.
    """
    r, ctx = F.upper(_as_column(ref)), F.upper(_as_column(context))
    plain = (F.length(ctx) == 3) & (F.translate(ctx, "ACGT", "") == "")
    strand = F.when(r.isin("A", "G"), F.reverse(_pair(ctx))).otherwise(ctx)
    name = F.concat(pyrimidine_substitution(ref, alt), F.lit("_"), strand)
    return F.when(plain & (F.substring(ctx, 2, 1) == r), name)


def all_channels() -> list[str]:
    """The 96 channel names, by substitution, then 5' and 3' base."""
    return [f"{s}_{five}{s[0]}{three}" for s in SUBSTITUTIONS for five in BASES for three in BASES]


def alteration_category(variant_class: Column | str) -> Column:
    c = _as_column(variant_class)
    return (
        F.when(c == "Missense_Mutation", "missense")
        .when(c.isin(*TRUNCATING_CLASSES), "truncating")
        .when(c.isin(*INFRAME_CLASSES), "inframe")
        .when(c.contains("Splice"), "splice_site")
        .otherwise("mutation")
    )


def titv_class(ref: Column | str, alt: Column | str) -> Column:
    """'Ti' or 'Tv' for a single-base change, null otherwise."""
    sub = pyrimidine_substitution(ref, alt)
    return F.when(sub.isin("C>T", "T>C"), "Ti").when(sub.isNotNull(), "Tv")


def amino_acid_position(protein_change: Column | str) -> Column:
    text = F.replace(_as_column(protein_change), F.lit("p."), F.lit(""))
    return F.regexp_extract(text, r"[A-Z*]?(\d+)[A-Z*]?", 1).try_cast("bigint")


def code_annotation(code: Column | str, empty: str = "") -> Column:
    """Decode an alteration code; ``empty`` stands for "no alteration"."""
    c = _as_column(code)
    out = None
    for number, name in CODE_ANNOTATION.items():
        value = name or empty
        out = F.when(c == number, value) if out is None else out.when(c == number, value)
    return out


def variant_key(chrom, start, ref, alt) -> Column:
    """chrom:pos:ref:alt, or chrom:pos when an allele is missing."""
    c, s, r, a = (_as_column(x) for x in (chrom, start, ref, alt))
    full = (F.coalesce(r, F.lit("")) != "") & (F.coalesce(a, F.lit("")) != "")
    pos = s.cast("string")
    return F.when(full, F.concat_ws(":", c, pos, r, a)).otherwise(F.concat_ws(":", c, pos))


def _allele_length(c: Column | str) -> Column:
    return F.length(F.replace(F.coalesce(_as_column(c), F.lit("")), F.lit("-"), F.lit("")))


def indel_length(ref: Column | str, alt: Column | str) -> Column:
    """Inserted minus deleted bases; a dash is an empty allele."""
    return _allele_length(alt) - _allele_length(ref)


def is_cpg(context: Column | str) -> Column:
    """Does the trinucleotide hold a CpG step on its middle base?"""
    ctx = F.upper(_as_column(context))
    return (F.substring(ctx, 2, 2) == "CG") | (F.substring(ctx, 1, 2) == "CG")
