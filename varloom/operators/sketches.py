"""Distinct counts that merge: sketches stored per cohort.

An exact distinct count over several cohorts reads all of them again.  A sketch of a
cohort's values has a fixed size, and the sketch of a union is made of the sketches; so
counts over any choice of cohorts read a row per cohort and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.filters import BadRequest
from varloom.roles import Roles, col, require_columns

#: Log2 of the number of registers: a relative standard error of 1.04 / sqrt(2 ** 14), 0.8 %.
LOG_REGISTERS = 14


def distinct_sketches(
    df: DataFrame, values: Sequence[str], group_by: Sequence[str] = (), roles: Roles = Roles(), log_registers: int = LOG_REGISTERS
) -> DataFrame:
    """A row per cohort and group: ``rows``, and for each of ``values`` its distinct values as a sketch of that name.

    Nulls are not values.  Partial sketches are merged before the shuffle, so a large
    cohort sends one per task.
    """
    if not 4 <= log_registers <= 21:
        raise BadRequest("a sketch has 2 ** 4 to 2 ** 21 registers")
    keys = list(dict.fromkeys([roles.cohort, *group_by]))
    require_columns(df, [*keys, *values])
    # numbers and text are sketched by different hashes; text it is, whatever the column
    sketches = [F.hll_sketch_agg(col(v).cast("string"), F.lit(log_registers)).alias(v) for v in values]
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"), *sketches)


def merged(sketches: DataFrame, values: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """Sketches of the union of the given rows, per group."""
    require_columns(sketches, [*group_by, *values, "rows"])
    return sketches.groupBy(*[col(g) for g in group_by]).agg(
        F.sum("rows").alias("rows"), *[F.hll_union_agg(col(v)).alias(v) for v in values]
    )


def estimates(sketches: DataFrame, values: Sequence[str]) -> DataFrame:
    """The sketches as approximate numbers of distinct values."""
    counted = {v: F.hll_sketch_estimate(col(v)) for v in values}
    return sketches.select(*[counted[c].alias(c) if c in counted else col(c) for c in sketches.columns])


def approximate_totals(sketches: DataFrame, values: Sequence[str], cohorts: Sequence[str] | None = None, group_by: Sequence[str] = (), roles: Roles = Roles()) -> DataFrame:
    """Approximate distinct counts over the chosen cohorts (all by default) together."""
    rows = sketches if cohorts is None else sketches.filter(col(roles.cohort).isin(list(cohorts)))
    return estimates(merged(rows, values, group_by), values)
