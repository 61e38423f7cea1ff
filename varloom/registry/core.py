"""Registry of checked queries: a Spark callable and, mostly, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _half_even(sql: str) -> str:
    """Spell ``round(x, d)`` as half-even rounding, which the operators use."""
    out, i = "", 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = sql[j + 6 : comma], int(sql[comma + 1 : k - 1])
        scale = f"{10**digits}::DOUBLE"
        out += sql[i:j] + f"(round_even(CAST({_half_even(inner)} AS DOUBLE) * {scale}, 0) / {scale})"
        i = k
    return out + sql[i:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)``; ``sql`` is the same query for the oracle."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _half_even(sql)
        return fn

    return register
