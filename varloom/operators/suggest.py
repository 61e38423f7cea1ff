"""Suggestions while typing, and checks of item lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import text
from varloom.operators.filters import BadRequest
from varloom.operators.ordering import top
from varloom.roles import col


def _check_term(term: str) -> str:
    if len(term.strip()) < 2:
        raise BadRequest("a search term needs at least 2 characters")
    return term


def genes(genelist: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Genes that start with the term, in name order."""
    hits = genelist.filter(text.starts_with("gene", _check_term(term)))
    return top(hits, limit, [F.col("gene").asc()]).select("gene")


def pathways(pathway: DataFrame, association: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Pathways that start with the term, each with its genes.

    The limit comes before the join, so only the chosen pathways fetch genes.
    """
    hits = pathway.filter(text.starts_with("pathway_name", _check_term(term)))
    chosen = top(hits, limit, [F.col("pathway_name").asc(), F.col("id").asc()])
    members = association.select(F.col("pathway_id").alias("id"), "gene").distinct()
    grouped = chosen.join(members, "id", "left").groupBy("id", "pathway_name")
    return grouped.agg(F.array_sort(F.collect_list("gene")).alias("genes"))


def positions(table: DataFrame, term: str, limit: int = 10, prefix: bool = False) -> DataFrame:
    """Position suggestions for ``chrom``, ``chrom:pos`` or ``chrom:start-end``.

    ``prefix`` reads the number as typed so far and matches starts that begin
    with it.  A reversed range is swapped; a malformed one finds nothing.
    """
    term = _check_term(term).strip()
    chrom, colon, rest = (p.strip() for p in term.partition(":"))
    hits = table.filter(text.starts_with("chromosome", chrom))
    start, end = col("start"), col("end")
    order = [start.asc()]
    digits = rest.replace(",", "")
    if not colon:
        order = [col("count").asc()]
    elif "-" in rest:
        bounds = re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", digits)
        if bounds is None:
            hits = hits.filter(F.lit(False))
        else:
            low, high = sorted(int(b) for b in bounds.groups())
            hits = hits.filter((end >= low) & (start <= high))
    elif digits.isdigit() and not prefix:
        hits = hits.filter((start <= int(digits)) & (end >= int(digits)))
    else:
        hits = hits.filter(start.cast("string").startswith(digits))
    order += [F.col("chromosome").asc(), start.asc(), end.asc()]
    return top(hits, limit, order).select(
        text.region_text("chromosome", "start", "end").alias("value"), "chromosome", "start", "end"
    )


def distinct_items(items: DataFrame) -> DataFrame:
    """Trimmed, upper-cased, de-duplicated, non-empty items."""
    return items.select(text.clean_item("item").alias("item")).filter(F.col("item") != "").distinct()


def validate_items(items: DataFrame, genelist: DataFrame, pathway: DataFrame) -> DataFrame:
    """Tell for every item whether it is a region, a gene, a pathway or unknown."""
    names = genelist.groupBy(F.upper("gene").alias("item")).agg(F.min("gene").alias("gene"))
    paths = pathway.groupBy(F.upper("pathway_name").alias("item")).agg(F.min("pathway_name").alias("pathway_name"))
    region = text.is_region("item")
    kind = (
        F.when(region, "region")
        .when(F.col("gene").isNotNull(), "gene")
        .when(F.col("pathway_name").isNotNull(), "pathway")
        .otherwise("unknown")
    )
    matched = F.coalesce("gene", "pathway_name", F.when(region, F.col("item")))
    joined = distinct_items(items).join(names, "item", "left").join(paths, "item", "left")
    return joined.select("item", kind.alias("kind"), matched.alias("matched"))
