"""Search: filters, regions, free text, sort and page in one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators import filters as flt
from varloom.operators import ordering, regions
from varloom.operators.regions import GenomicFilter
from varloom.roles import Roles


def matches(
    df: DataFrame,
    filters: Mapping[str, Any] | None = None,
    positions: Sequence[Mapping[str, Any]] | None = None,
    term: str | None = None,
    columns: Sequence[str] | None = None,
    genomic: GenomicFilter | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """All rows a search finds, before sorting and paging."""
    out = flt.apply(df, filters)
    out = regions.in_regions(out, positions, roles)
    if genomic is not None:
        out = genomic.apply(out, roles)
    return flt.free_text(out, term, columns)


def search(
    df: DataFrame,
    filters: Mapping[str, Any] | None = None,
    positions: Sequence[Mapping[str, Any]] | None = None,
    term: str | None = None,
    columns: Sequence[str] | None = None,
    sort_by: str | None = None,
    descending: bool = False,
    page: int = 1,
    page_size: int = 10,
    key: Sequence[str] | None = None,
    genomic: GenomicFilter | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """One page of results with numbers normalised."""
    found = matches(df, filters, positions, term, columns, genomic, roles)
    order_key = list(key) if key else [roles.variant_id]
    rows = ordering.page(found, page, page_size, sort_by, order_key, descending)
    return flt.normalise_numbers(rows)


def total_results(df: DataFrame, **request: Any) -> DataFrame:
    """How many rows a search finds, as one row."""
    return matches(df, **request).agg(F.count(F.lit(1)).alias("total_results"))
