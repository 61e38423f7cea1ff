"""Filter trees, free text, simple row selections.

A filter tree is ``{"logic": "AND" | "OR", "conditions": [...]}`` whose leaves
are ``{"column": c, "operator": op, "value": v}``.  It folds into one boolean
Column, so Catalyst can push the parts it likes into the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import genomics, text
from varloom.roles import Roles, UnknownColumns, col, first_existing, is_numeric, require_columns

Tree = Mapping[str, Any]


class BadRequest(ValueError):
    """A request that cannot be carried out as written."""


def _values(value: Any) -> list[Any]:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _equal(c: Column, v: Any) -> Column:
    return c.isNull() if v is None else c == v


def _unequal(c: Column, v: Any) -> Column:
    return c.isNotNull() if v is None else c != v


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": _equal,
    "neq": _unequal,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "like": text.contains,
    "in": lambda c, v: c.isin(_values(v)),
    "not_in": lambda c, v: ~c.isin(_values(v)),
}


def _check_keys(node: Tree, allowed: set[str], what: str) -> None:
    extra = set(node) - allowed
    if extra:
        raise BadRequest(f"unknown {what} keys: {sorted(extra)}")


def condition(df: DataFrame, leaf: Tree, strict: bool = True) -> Column | None:
    """One comparison; with ``strict=False`` an unknown column is skipped and
    an unknown operator means equality."""
    _check_keys(leaf, {"column", "operator", "value"}, "condition")
    name, op = leaf["column"], leaf.get("operator", "eq")
    if name not in df.columns:
        if strict:
            raise UnknownColumns(f"invalid columns: ['{name}']")
        return None
    if op not in OPERATORS:
        if strict:
            raise BadRequest(f"unknown operator {op!r}")
        op = "eq"
    return OPERATORS[op](col(name), leaf.get("value"))


def predicate(df: DataFrame, tree: Tree | None, strict: bool = True) -> Column | None:
    """Fold a filter tree into one Column; None when nothing is asked."""
    if not tree:
        return None
    if "conditions" not in tree:
        return condition(df, tree, strict)
    _check_keys(tree, {"logic", "conditions"}, "filter")
    logic = tree.get("logic", "AND")
    if logic not in ("AND", "OR"):
        raise BadRequest(f"unknown logic {logic!r}")
    parts = [predicate(df, node, strict) for node in tree["conditions"]]
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return reduce(lambda a, b: a | b if logic == "OR" else a & b, parts)


def apply(df: DataFrame, tree: Tree | None, strict: bool = True) -> DataFrame:
    p = predicate(df, tree, strict)
    return df if p is None else df.filter(p)


def having(value: Column, tree: Tree) -> Column:
    """Fold a HAVING tree over one aggregate column."""
    ops = {k: OPERATORS[k] for k in ("eq", "neq", "gt", "gte", "lt", "lte")}
    if "conditions" not in tree:
        _check_keys(tree, {"operator", "value"}, "having")
        v = tree["value"]
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise BadRequest("a having value must be a number")
        op = tree.get("operator", "eq")
        if op not in ops:
            raise BadRequest(f"unknown having operator {op!r}")
        return ops[op](value, v)
    _check_keys(tree, {"logic", "conditions"}, "having")
    if not tree["conditions"]:
        raise BadRequest("a having clause needs at least one condition")
    parts = [having(value, node) for node in tree["conditions"]]
    if tree.get("logic", "AND") == "OR":
        return reduce(lambda a, b: a | b, parts)
    return reduce(lambda a, b: a & b, parts)


def clean_term(term: str | None) -> str | None:
    """A blank search term means no term."""
    stripped = (term or "").strip()
    return stripped or None


def free_text(df: DataFrame, term: str | None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where any of the columns (default: all) contains the term."""
    term = clean_term(term)
    if term is None:
        return df
    names = list(columns) if columns else df.columns
    require_columns(df, names)
    return df.filter(reduce(lambda a, b: a | b, [text.contains(n, term) for n in names]))


def free_text_terms(
    df: DataFrame,
    terms: Sequence[str],
    columns: Sequence[str] | None = None,
    mode: str = "any",
    exact: bool = False,
) -> DataFrame:
    """Several terms: ``any`` or ``all`` must hit some column."""
    if mode not in ("any", "all"):
        raise BadRequest(f"unknown mode {mode!r}")
    names = list(columns) if columns else df.columns
    require_columns(df, names)
    wanted = [t for t in map(clean_term, terms) if t]
    if not wanted:
        return df

    def hit(name: str, term: str) -> Column:
        if exact:
            return col(name).cast("string") == term
        return text.contains(name, term)

    per_term = [reduce(lambda a, b: a | b, [hit(n, t) for n in names]) for t in wanted]
    fold = (lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b)
    return df.filter(reduce(fold, per_term))


def contains_in_first(df: DataFrame, candidates: Sequence[str], value: str) -> DataFrame:
    """Substring filter on the first candidate column the table has."""
    return df.filter(text.contains(first_existing(df, candidates), value))


def in_first(df: DataFrame, candidates: Sequence[str], values: Sequence[Any]) -> DataFrame:
    """IN filter on the first candidate column the table has."""
    return df.filter(col(first_existing(df, candidates)).isin(list(values)))


def in_ranges(df: DataFrame, ranges: Mapping[str, tuple[Any, Any]]) -> DataFrame:
    """Closed ranges by column; a None bound is open."""
    require_columns(df, ranges)
    for name, (low, high) in ranges.items():
        if low is not None:
            df = df.filter(col(name) >= low)
        if high is not None:
            df = df.filter(col(name) <= high)
    return df


def by_type_and_class(
    df: DataFrame,
    types: Sequence[str] | None = None,
    classes: Sequence[str] | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    if types:
        df = df.filter(col(roles.variant_type).isin(list(types)))
    if classes:
        df = df.filter(col(roles.variant_class).isin(list(classes)))
    return df


def by_alteration(df: DataFrame, categories: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Keep rows whose alteration category is asked for; 'all' keeps every row."""
    if "all" in categories:
        return df
    return df.filter(genomics.alteration_category(roles.variant_class).isin(list(categories)))


def cohort(df: DataFrame, name: str, roles: Roles = Roles()) -> DataFrame:
    """One cohort; with the table partitioned by cohort this prunes files."""
    return df.filter(col(roles.cohort) == name)


def genes_in(df: DataFrame, genes: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    return df.filter(col(roles.gene).isin(list(genes)))


def normalise_numbers(df: DataFrame) -> DataFrame:
    """All numeric columns as double: +-inf become +-999, null becomes NaN."""
    out = []
    for field in df.schema.fields:
        c = col(field.name)
        if is_numeric(field.dataType):
            d = c.cast("double")
            c = (
                F.when(d.isNull(), F.lit(float("nan")))
                .when(d == float("inf"), F.lit(999.0))
                .when(d == float("-inf"), F.lit(-999.0))
                .otherwise(d)
                .alias(field.name)
            )
        out.append(c)
    return df.select(*out)
