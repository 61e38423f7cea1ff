"""Grouped, scalar and combination aggregates with percentages and HAVING."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import text
from varloom.functions.stats import rounded
from varloom.operators import filters as flt
from varloom.operators.filters import BadRequest
from varloom.operators.regions import GenomicFilter
from varloom.roles import Roles, col, is_numeric, require_columns

VALUE = "aggregated_value"
TOTAL = "group_total"


def _numeric(df: DataFrame, name: str) -> Column:
    """Text under sum and avg is read as numbers, bad text as null."""
    c = col(name)
    return c if is_numeric(df.schema[name].dataType) else text.to_number(c)


def measure(df: DataFrame, kind: str, name: str) -> Column:
    makers = {
        "sum": lambda: F.sum(_numeric(df, name)),
        "avg": lambda: F.avg(_numeric(df, name)),
        "min": lambda: F.min(col(name)),
        "max": lambda: F.max(col(name)),
        "count": lambda: F.count(col(name)),
        "distinct_count": lambda: F.countDistinct(col(name)),
        "approx_distinct_count": lambda: F.approx_count_distinct(col(name)),
    }
    if kind not in makers:
        raise BadRequest(f"unknown aggregation {kind!r}")
    return makers[kind]()


def partition_total(groups: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the groups that share ``by``, beside each row.

    A second aggregate joined back instead of a window: partial sums keep a hot
    key from landing in one task, and both sides reuse the same exchange.
    """
    if not by:
        return groups.withColumn(name, groups.agg(F.sum(value)).scalar())
    keys = [f"_k{i}" for i in range(len(by))]
    totals = groups.groupBy(*[col(b).alias(k) for b, k in zip(by, keys)]).agg(F.sum(value).alias(name))
    on = reduce(lambda a, b: a & b, [groups[b].eqNullSafe(totals[k]) for b, k in zip(by, keys)])
    return groups.join(totals, on).drop(*keys)


def _percent_groups(
    df: DataFrame, counted: Column, group_by: Sequence[Column | str], names: Sequence[str],
    percentage_by: Sequence[str] | None,
) -> DataFrame:
    """Counts per group and the raw percentage, not yet rounded."""
    groups = df.groupBy(*group_by).agg(
        F.count(counted).alias("_count"), F.count(F.lit(1)).alias("_rows")
    )
    if percentage_by:
        groups = partition_total(groups, percentage_by, "_count", TOTAL)
    else:
        groups = partition_total(groups, [], "_rows", TOTAL)
    share = F.try_divide(F.col("_count").cast("double") * F.lit(100.0), F.col(TOTAL).cast("double"))
    return groups.select(*names, share.alias(VALUE), F.col(TOTAL).cast("bigint").alias(TOTAL))


def _rows(df: DataFrame, filters, genomic: GenomicFilter | None, roles: Roles) -> DataFrame:
    out = flt.apply(df, filters)
    return out if genomic is None else genomic.apply(out, roles)


def _check_grouping(group_by, percentage_by, having, order_by, limit) -> None:
    if having and not group_by:
        raise BadRequest("having needs group_by")
    if percentage_by and not set(percentage_by) <= set(group_by or []):
        raise BadRequest("percentage_by must be part of group_by")
    wanted = [order_by] if isinstance(order_by, str) else list(order_by or [])
    bad = [o for o in wanted if o != VALUE and o not in (group_by or [])]
    if bad:
        raise BadRequest(f"cannot order by {bad}")
    if limit is not None and limit < 1:
        raise BadRequest("limit must be greater than 0")


def _finish(
    groups: DataFrame, names: Sequence[str], percent: bool, having, order_by, descending: bool, limit
) -> DataFrame:
    """HAVING, order and limit use the unrounded value; rounding comes last."""
    if having:
        groups = groups.filter(flt.having(F.col(VALUE), having))
    wanted = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if wanted or limit:
        order = [col(o).desc() if descending else col(o).asc() for o in wanted]
        order += [col(n).asc() for n in names if n not in wanted]
        groups = groups.orderBy(*order)
    if limit:
        groups = groups.limit(limit)
    if percent:
        groups = groups.withColumn(VALUE, rounded(F.col(VALUE), 2))
    return groups


def aggregate(
    df: DataFrame,
    column: str,
    group_by: Sequence[str] | None = None,
    aggregation: str = "count",
    percentage_by: Sequence[str] | None = None,
    filters: Mapping[str, Any] | None = None,
    having: Mapping[str, Any] | None = None,
    order_by: str | Sequence[str] | None = None,
    descending: bool = True,
    limit: int | None = None,
    genomic: GenomicFilter | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """Grouped aggregate, or a one-row ``value`` without ``group_by``.

    Percentages come with their denominator in ``group_total``.
    """
    require_columns(df, [column, *(group_by or []), *(percentage_by or [])])
    _check_grouping(group_by, percentage_by, having, order_by, limit)
    if not group_by:
        return scalar(df, column, aggregation, filters, genomic, roles)
    rows = _rows(df, filters, genomic, roles)
    names = list(group_by)
    percent = aggregation == "percentage"
    if percent:
        groups = _percent_groups(rows, col(column), names, names, percentage_by)
    else:
        groups = rows.groupBy(*names).agg(measure(rows, aggregation, column).alias(VALUE))
    return _finish(groups, names, percent, having, order_by, descending, limit)


def scalar(
    df: DataFrame,
    column: str,
    aggregation: str,
    filters: Mapping[str, Any] | None = None,
    genomic: GenomicFilter | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """One row, one ``value``; no rows give 0.

    The percentage compares non-null counts inside and outside the filter, in
    one pass over the table unless a genomic filter needs a join.
    """
    c = col(column)
    if aggregation == "percentage":
        keep = flt.predicate(df, filters)
        if genomic is None:
            inside = F.count(c) if keep is None else F.count(F.when(keep, c))
            out = df.agg(inside.alias("i"), F.count(c).alias("n"))
        else:
            chosen = genomic.apply(flt.apply(df, filters), roles)
            out = df.agg(F.count(c).alias("n")).withColumn("i", chosen.agg(F.count(c)).scalar())
        share = F.try_divide(F.col("i").cast("double"), F.col("n").cast("double")) * F.lit(100.0)
        return out.select(F.coalesce(rounded(share, 2), F.lit(0.0)).alias("value"))
    rows = _rows(df, filters, genomic, roles)
    out = rows.agg(measure(rows, aggregation, column).alias("value"))
    if is_numeric(out.schema["value"].dataType):
        out = out.select(F.coalesce("value", F.lit(0)).alias("value"))
    return out


def summary(
    df: DataFrame,
    column: str,
    group_by: Sequence[str],
    aggregation: str = "count",
    filters: Mapping[str, Any] | None = None,
    having: Mapping[str, Any] | None = None,
    percentage_by: Sequence[str] | None = None,
    limit: int | None = None,
    genomic: GenomicFilter | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """total_records, groups_before_having, groups_after_having in one row."""
    rows = _rows(df, filters, genomic, roles)
    kept = aggregate(rows, column, group_by, aggregation, percentage_by, having=having)
    after = kept.agg(F.count(F.lit(1))).scalar()
    if limit:
        after = F.least(after, F.lit(limit).cast("bigint"))
    groups = rows.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_records"),
        F.count(F.lit(1)).alias("groups_before_having"),
    ).withColumn("groups_after_having", after)


def combination_aggregate(
    df: DataFrame,
    column: str,
    combination: Sequence[str],
    aggregation: str = "count",
    percentage_by: Sequence[str] | None = None,
    computed: Sequence[Mapping[str, Any]] | None = None,
    filters: Mapping[str, Any] | None = None,
    having: Mapping[str, Any] | None = None,
    order_by: str | Sequence[str] | None = None,
    descending: bool = True,
    limit: int | None = None,
    genomic: GenomicFilter | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """Aggregate over column combinations, with concatenated fields at the end.

    A computed field is ``{"name", "columns", "separator"}``; it may use any
    output column and is built after the limit.
    """
    if not combination:
        raise BadRequest("combination needs at least one column")
    out = aggregate(
        df, column, combination, aggregation, percentage_by, filters, having, order_by, descending, limit,
        genomic, roles,
    )
    for field in computed or []:
        flt._check_keys(field, {"name", "type", "columns", "separator"}, "computed field")
        if field.get("type", "concat") != "concat" or not field["name"].isidentifier():
            raise BadRequest("a computed field is a concat with an identifier as its name")
        parts = [col(c) if c in out.columns else F.lit(None).cast("string") for c in field["columns"]]
        out = out.withColumn(field["name"], text.joined(parts, field.get("separator", "")))
    return out


def concat_aggregate(
    df: DataFrame,
    columns: Sequence[str],
    separator: str = "",
    group_by: Sequence[str] | None = None,
    aggregation: str = "count",
    percentage_by: Sequence[str] | None = None,
    filters: Mapping[str, Any] | None = None,
    having: Mapping[str, Any] | None = None,
    order_by: str | Sequence[str] | None = None,
    descending: bool = True,
    limit: int | None = None,
    genomic: GenomicFilter | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """Older form: count, percentage or distinct count of a concatenated value.

    HAVING and order look at the count, also when percentages are shown.
    """
    groups_by = list(group_by or [])
    require_columns(df, [*columns, *groups_by])
    rows = _rows(df, filters, genomic, roles).select(*groups_by, text.joined(columns, separator).alias("concatenated_value"))
    if aggregation == "distinct_count":
        counted = F.countDistinct("concatenated_value")
        if not groups_by:
            return rows.agg(counted.alias("value"))
        out = rows.groupBy(*groups_by).agg(counted.alias(VALUE))
        return _finish(out, groups_by, False, having, order_by, descending, limit)
    if aggregation not in ("count", "percentage"):
        raise BadRequest(f"unknown aggregation {aggregation!r}")
    if percentage_by and not set(percentage_by) <= set(groups_by):
        raise BadRequest("percentage_by must be part of group_by")
    names = [*groups_by, "concatenated_value"]
    out = rows.groupBy(*names).agg(F.count(F.lit(1)).alias(VALUE))
    if aggregation == "count":
        return _finish(out, names, False, having, order_by, descending, limit)
    out = partition_total(out, list(percentage_by or []), VALUE, TOTAL)
    out = _finish(out, names, False, having, order_by, descending, limit)
    share = F.try_divide(F.col(VALUE).cast("double"), F.col(TOTAL).cast("double")) * F.lit(100.0)
    return out.withColumn(VALUE, F.coalesce(rounded(share, 2), F.lit(0.0)))
