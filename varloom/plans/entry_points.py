"""Composite requests: thin functions over the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators import filters as flt
from varloom.operators import ordering
from varloom.operators import proximity as prox
from varloom.operators.filters import BadRequest
from varloom.operators.proximity import Reach
from varloom.roles import Roles


def proximity(
    df: DataFrame,
    reference_filters: Mapping[str, Any],
    reach: Reach,
    query_filters: Mapping[str, Any] | None = None,
    chromosome: str | None = None,
    reference_sort_by: str | None = None,
    reference_descending: bool = False,
    max_reference_variants: int | None = None,
    nearby_sort_by: str | None = None,
    nearby_descending: bool = False,
    max_nearby_per_reference: int | None = None,
    aggregate_by_reference: bool = False,
    min_nearby: int | None = None,
    max_nearby: int | None = None,
    min_avg: float | None = None,
    max_avg: float | None = None,
    keep: Sequence[str] = (),
    sort_by: str | None = None,
    descending: bool = False,
    page: int | None = None,
    page_size: int = 100,
    roles: Roles = Roles(),
) -> DataFrame:
    """Variants near reference variants, by reference or by variant position.

    The nested list of neighbours is part of the result when
    ``max_nearby_per_reference`` bounds it.
    """
    if not aggregate_by_reference and any((min_nearby, max_nearby, min_avg, max_avg)):
        raise BadRequest("bounds on neighbours need aggregate_by_reference")
    refs = prox.references(
        flt.apply(df, reference_filters), chromosome, reference_sort_by, reference_descending,
        max_reference_variants, roles,
    )
    searched = flt.apply(df, query_filters)
    by = None if nearby_sort_by in (None, "distance") else nearby_sort_by
    k = max_nearby_per_reference
    hits = prox.nearby_per_reference(refs, searched, reach, k, by, nearby_descending, keep, roles) if k else None
    if aggregate_by_reference:
        stats = prox.neighbour_stats(refs, searched, reach, roles) if not k else _with_details(hits, refs, reach, roles)
        out = prox.rounded_average(prox.having(stats, min_nearby, max_nearby, min_avg, max_avg))
        key = ["reference_chromosome", "reference_position"]
        allowed = ("nearby_count", "avg_distance")
        sort_by = sort_by if sort_by in allowed else None
    else:
        out = prox.distinct_closest(hits, roles) if k else prox.closest_hits(refs, searched, reach, keep, roles)
        key = [roles.chrom, roles.start]
    if page is not None:
        if sort_by and sort_by in out.columns and dict(out.dtypes)[sort_by] != "string":
            out = out.withColumn("_sort", F.coalesce(F.col(sort_by), F.lit(0)))
            return ordering.page(out, page, page_size, "_sort", key, descending, 10000).drop("_sort")
        return ordering.page(out, page, page_size, sort_by, key, descending, 10000)
    return ordering.sort_nulls_as_zero(out, sort_by, key, descending) if sort_by else out


def _with_details(hits: DataFrame, refs: DataFrame, reach: Reach, roles: Roles) -> DataFrame:
    """Nested neighbours beside the details of their reference."""
    points = prox.reference_points(refs, reach, roles).drop(*reach.key).withColumnRenamed("pos", "reference_position")
    return points.join(prox.nested(hits, roles), ["reference_chromosome", "reference_position"])
