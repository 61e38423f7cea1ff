"""Plans of dependent steps, composed into lazy DataFrames.

There is no scheduler: a step that depends on another one is restricted by a
semi join with that step's result, and Spark plans the whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from varloom.operators import aggregate as agg
from varloom.operators import search as srch
from varloom.operators import sets
from varloom.operators.filters import BadRequest, _check_keys
from varloom.roles import Roles


def _tools(roles: Roles):
    return {
        "search": lambda df, **p: srch.search(df, roles=roles, **p),
        "aggregate": lambda df, **p: agg.aggregate(df, roles=roles, **p),
        "combination_aggregate": lambda df, **p: agg.combination_aggregate(df, roles=roles, **p),
    }


def run_plan(df: DataFrame, plan: Sequence[Mapping[str, Any]], roles: Roles = Roles()) -> dict[str, DataFrame]:
    """Results by step id.

    A step is ``{"step_id", "tool", "params", "restrict"}``; ``restrict`` maps
    an earlier step to the column whose values limit this step's rows.
    """
    done: dict[str, DataFrame] = {}
    tools = _tools(roles)
    for step in plan:
        _check_keys(step, {"step_id", "tool", "params", "restrict"}, "step")
        if step["tool"] not in tools:
            raise BadRequest(f"unknown tool {step['tool']!r}")
        rows = df
        for upstream, column in step.get("restrict", {}).items():
            if upstream not in done:
                raise BadRequest(f"step {step['step_id']!r} needs {upstream!r}, which has not run")
            rows = sets.restricted_to(rows, done[upstream], column)
        done[step["step_id"]] = tools[step["tool"]](rows, **step.get("params", {}))
    return done


def with_lookups(df: DataFrame, lookups: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left-join lookup tables, each as (table, own column, lookup column).

    A lookup row is expected once per key; Spark broadcasts a lookup when its
    measured size allows.
    """
    out = df
    for lookup, own, theirs in lookups:
        out = out.join(lookup, out[own] == lookup[theirs], "left")
    return out
