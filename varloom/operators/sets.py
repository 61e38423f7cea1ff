"""Set operations on entity lists, and chains of dependent steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.filters import BadRequest
from varloom.operators.ordering import top
from varloom.roles import col


def combine(lists: Sequence[DataFrame], operation: str) -> DataFrame:
    """UNION, INTERSECT or DIFFERENCE of lists; results are distinct."""
    ops = {"UNION": DataFrame.union, "INTERSECT": DataFrame.intersect, "DIFFERENCE": DataFrame.subtract}
    if operation not in ops or not lists:
        raise BadRequest(f"unknown set operation {operation!r}")
    out = lists[0]
    for other in lists[1:]:
        out = ops[operation](out, other)
    return out.distinct()


def side_by_side(tables: Mapping[str, DataFrame], label: str = "dataset") -> DataFrame:
    """Results of one question for several data sets, under a label."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise BadRequest("no tables given")
    return out


def restricted_to(df: DataFrame, upstream: DataFrame, on: Mapping[str, str] | str) -> DataFrame:
    """Rows whose key occurs in an earlier result; still one lazy plan."""
    pairs = {on: on} if isinstance(on, str) else dict(on)
    keys = upstream.select(*[col(u).alias(f"_u{i}") for i, u in enumerate(pairs.values())]).distinct()
    cond = None
    for i, name in enumerate(pairs):
        eq = df[name] == keys[f"_u{i}"]
        cond = eq if cond is None else cond & eq
    return df.join(keys, cond, "left_semi")


def top_groups(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k values with most rows; ties by value."""
    counts = df.groupBy(col(by).alias(by)).agg(F.count(F.lit(1)).alias("n"))
    return top(counts, k, [F.col("n").desc(), col(by).asc()])
