"""Genomic position and region predicates, pathway membership."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import text
from varloom.operators.filters import BadRequest, _check_keys
from varloom.roles import Roles, col, first_existing

Region = Mapping[str, Any]

# A region table is cut into blocks of 2**12 bases for the equi-join, by way of
# blocks of 2**20 where a region covers these in full.
REGION_BLOCK_BITS = 12
WIDE_BLOCK_BITS = 20
# Blocks of blocks, up to 2**48 bases.
LEVELS = 36


#: Names with more letters than this have too many spellings to list.
MAX_LISTED_LETTERS = 4


def spellings(chromosome: str) -> list[str] | None:
    """All spellings that name the chromosome: any case, with and without chr."""
    plain = _plain_chromosome(chromosome)
    if sum(c.isalpha() for c in plain) > MAX_LISTED_LETTERS or not plain.isascii() or plain.startswith("CHR"):
        return None
    cases = ["".join(x) for x in product(*[sorted({c.upper(), c.lower()}) for c in plain])]
    prefixes = ["", *["".join(x) for x in product("Cc", "Hh", "Rr")]]
    return [p + c for p in prefixes for c in cases]


def same_chromosome(c: str, chromosome: str) -> Column:
    """Plain membership in the list of spellings, which reaches the scan and prunes there."""
    listed = spellings(chromosome)
    if listed is None:
        return text.chromosome(c) == _plain_chromosome(chromosome)
    return col(c).isin(listed)


def _plain_chromosome(chromosome: str) -> str:
    upper = str(chromosome).upper()
    return upper[3:] if upper.startswith("CHR") else upper


def region_predicate(region: Region, roles: Roles = Roles()) -> Column:
    """Exact position without an end; overlap with one; containment when the
    table has no end column."""
    _check_keys(region, {"chromosome", "start", "end"}, "region")
    start, end = region["start"], region.get("end")
    if start < 1 or (end is not None and end < start):
        raise BadRequest("a region needs 1 <= start <= end")
    on_chrom = same_chromosome(roles.chrom, region["chromosome"])
    if end is None:
        return on_chrom & (col(roles.start) == start)
    if roles.end is None:
        return on_chrom & col(roles.start).between(start, end)
    return on_chrom & (col(roles.start) <= end) & (col(roles.end) >= start)


def in_regions(df: DataFrame, regions: Sequence[Region] | None, roles: Roles = Roles()) -> DataFrame:
    """Rows that match any of a short list of positions and regions."""
    if not regions:
        return df
    # implied by the regions together; a conjunction that the scan can use by itself
    names = [spellings(r["chromosome"]) for r in regions if "chromosome" in r]
    if names and all(names):
        df = df.filter(col(roles.chrom).isin(sorted({n for listed in names for n in listed})))
    return df.filter(reduce(lambda a, b: a | b, [region_predicate(r, roles) for r in regions]))


def in_region_table(df: DataFrame, regions: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """As :func:`in_regions` for a table of regions (chromosome, start, end).

    A semi join on one key: every row looks into one block only, so no row is copied
    and rows need no id of their own (repeated and null ids are kept as they are).

    - A row inside one block of 2**12 bases looks into this block, for a piece of a
      region, cut at block borders, that begins before the row's end and ends after its
      start.  Pieces with the same start are merged, so a block has one per base at most.
    - A row that crosses block borders looks into the smallest aligned power-of-two block
      around it.  Its ends lie in different halves, so it meets a region exactly if the
      last piece of the left half reaches its start, or the first piece of the right half
      begins by its end; a block needs these two numbers only.

    A region that covers blocks of 2**20 bases in full is these wide blocks, once for all
    regions, before it is cut further; so there are never more pieces than 2**12 bases
    have places and chromosomes have blocks, however many regions overlap.

    A row without a start or end, or that ends before it starts, meets no region.
    """
    bits, wide = REGION_BLOCK_BITS, WIDE_BLOCK_BITS
    whole = regions.select(
        text.chromosome("chromosome").alias("r_chrom"),
        col("start").cast("bigint").alias("r_start"),
        F.coalesce(col("end"), col("start")).cast("bigint").alias("r_end"),
    ).filter("r_start <= r_end").distinct()
    # wide blocks [w_first, w_stop) are covered in full
    whole = whole.withColumn("w_first", F.shiftright(F.col("r_start") + ((1 << wide) - 1), wide)).withColumn(
        "w_stop", F.shiftright(F.col("r_end") + 1, wide)
    )
    covers = F.col("w_first") < F.col("w_stop")
    full = whole.filter(covers).select(
        "r_chrom", F.explode(F.sequence("w_first", F.col("w_stop") - 1)).alias("w_block")
    ).distinct()
    left_end, right_start = F.shiftleft("w_first", wide) - 1, F.shiftleft("w_stop", wide)

    def piece(low: Column, high: Column) -> Column:
        return F.struct(low.alias("r_start"), high.alias("r_end"))

    ends = F.array_compact(F.array(
        F.when(~covers, piece(F.col("r_start"), F.col("r_end"))),
        F.when(covers & (F.col("r_start") <= left_end), piece(F.col("r_start"), left_end)),
        F.when(covers & (right_start <= F.col("r_end")), piece(right_start, F.col("r_end"))),
    ))
    first, last = F.shiftleft("r_block", bits), F.shiftleft("r_block", bits) + ((1 << bits) - 1)
    narrow = (
        whole.select("r_chrom", F.explode(ends).alias("e")).select("r_chrom", "e.r_start", "e.r_end")
        .withColumn("r_block", F.explode(F.sequence(F.shiftright("r_start", bits), F.shiftright("r_end", bits))))
        .select("r_chrom", "r_block", F.greatest("r_start", first).alias("r_start"), F.least("r_end", last).alias("r_end"))
    )
    inner = F.shiftleft("w_block", wide - bits)
    broad = full.select("r_chrom", F.explode(F.sequence(inner, inner + ((1 << (wide - bits)) - 1))).alias("r_block"))
    merged = (
        narrow.unionByName(broad.select("r_chrom", "r_block", first.alias("r_start"), last.alias("r_end")))
        .groupBy("r_chrom", "r_block", "r_start").agg(F.max("r_end").alias("r_end"))
    )
    blocks = merged.groupBy("r_chrom", "r_block").agg(
        F.collect_list(F.struct("r_start", "r_end")).alias("r_pieces"),  # one per base of a block at most
        F.min("r_start").alias("r_first"), F.max("r_end").alias("r_last"),
    )
    # level: which bit of a position tells the halves of a block apart
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    halves = blocks.select(
        "r_chrom", "r_first", "r_last", F.explode(levels).alias("r_level"), "r_block"
    ).withColumn("upper", F.expr("shiftright(r_block, r_level)")).select(
        "r_chrom", (F.col("r_level") + 1).alias("r_level"), F.shiftright("upper", 1).alias("r_block"),
        F.when(F.col("upper") % 2 == 0, F.col("r_last")).alias("left"), F.when(F.col("upper") % 2 == 1, F.col("r_first")).alias("right"),
    )
    halves = halves.groupBy("r_chrom", "r_level", "r_block").agg(F.max("left").alias("r_left"), F.min("right").alias("r_right"))
    lookup = blocks.select("r_chrom", F.lit(0).alias("r_level"), "r_block", "r_pieces").unionByName(halves, allowMissingColumns=True)
    start, end = col(roles.start).cast("bigint"), col(roles.end or roles.start).cast("bigint")
    low, high = F.shiftright(start, bits), F.shiftright(end, bits)
    level = F.when(low == high, 0).otherwise(F.length(F.bin(low.bitwiseXOR(high))))  # the highest bit they differ in
    on = (
        (text.chromosome(roles.chrom) == F.col("r_chrom"))
        & (level == F.col("r_level"))
        & (F.call_function("shiftright", low, level) == F.col("r_block"))
        & (start <= end)
        & F.when(level == 0, F.exists("r_pieces", lambda p: (p["r_start"] <= end) & (p["r_end"] >= start)))
        .otherwise(F.coalesce(F.col("r_left") >= start, F.lit(False)) | F.coalesce(F.col("r_right") <= end, F.lit(False)))
    )
    return df.join(lookup, on, "left_semi")


def detect_roles(df: DataFrame, roles: Roles = Roles()) -> Roles:
    """Find the position columns by their usual names."""
    ends = [c for c in ("end", "end_pos", "end_position") if c in df.columns]
    return replace(
        roles,
        chrom=first_existing(df, ("chrom", "chromosome", "chr")),
        start=first_existing(df, ("start", "start_pos", "start_position", "position", "pos")),
        end=ends[0] if ends else None,
    )


def within_bounds(
    df: DataFrame,
    chromosome: str,
    start: int | None = None,
    end: int | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """Positions on a chromosome between bounds, each of which may be open."""
    df = df.filter(same_chromosome(roles.chrom, chromosome))
    if start is not None:
        df = df.filter(col(roles.start) >= start)
    if end is not None:
        df = df.filter(col(roles.start) <= end)
    return df


def gene_coordinates(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Extent of each gene over its variants or exons, per chromosome."""
    end = roles.end or roles.start
    return df.groupBy(col(roles.gene).alias("gene"), col(roles.chrom).alias("chrom")).agg(
        F.min(col(roles.start)).alias("gene_start"), F.max(col(end)).alias("gene_end")
    )


def in_gene_extents(df: DataFrame, extents: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Rows that overlap the extent of any of the given genes."""
    table = extents.select(
        F.col("chrom").alias("chromosome"), F.col("gene_start").alias("start"), F.col("gene_end").alias("end")
    )
    return in_region_table(df, table, roles)


@dataclass(frozen=True)
class GenomicFilter:
    """Positions and pathways a request may be limited to; all given parts must hold."""

    positions: Sequence[Region] | None = None
    pathway_ids: Sequence[str] | None = None
    pathway_names: Sequence[str] | None = None
    association: DataFrame | None = None
    pathways: DataFrame | None = None
    match: str = "exact"

    def apply(self, df: DataFrame, roles: Roles = Roles()) -> DataFrame:
        out = in_regions(df, self.positions, roles)
        if self.pathway_ids is None and self.pathway_names is None:
            return out
        if self.association is None:
            raise BadRequest("a pathway filter needs the pathway gene table")
        return in_pathways(
            out, self.association, self.pathways, self.pathway_names, self.pathway_ids, self.match, roles
        )


def genes_of_pathways(
    association: DataFrame,
    pathways: DataFrame | None = None,
    names: Sequence[str] | None = None,
    ids: Sequence[str] | None = None,
    match: str = "exact",
) -> DataFrame:
    """Distinct genes that belong to any of the chosen pathways."""
    chosen = association
    if ids:
        chosen = chosen.filter(F.col("pathway_id").isin(list(ids)))
    if names:
        if pathways is None:
            raise BadRequest("choosing pathways by name needs the pathway table")
        if match == "exact":
            wanted = F.col("pathway_name").isin(list(names))
        else:
            wanted = reduce(lambda a, b: a | b, [text.contains("pathway_name", n) for n in names])
        picked = pathways.filter(wanted).select(F.col("id").alias("pathway_id"))
        chosen = chosen.join(picked, "pathway_id", "left_semi")
    return chosen.select("gene").distinct()


def in_pathways(
    df: DataFrame,
    association: DataFrame,
    pathways: DataFrame | None = None,
    names: Sequence[str] | None = None,
    ids: Sequence[str] | None = None,
    match: str = "exact",
    roles: Roles = Roles(),
) -> DataFrame:
    """Variants in genes of the chosen pathways; names and ids both must hold.

    A semi join, so a gene in several chosen pathways is not counted twice.
    """
    out = df
    if names is not None and not names:
        raise BadRequest("the list of pathway names is empty")
    for picked in (
        genes_of_pathways(association, pathways, names=names, match=match) if names else None,
        genes_of_pathways(association, ids=ids) if ids else None,
    ):
        if picked is not None:
            out = out.join(picked, out[roles.gene] == picked["gene"], "left_semi")
    return out
