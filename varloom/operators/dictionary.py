"""Contains search through a stored dictionary of distinct values.

A contains search has to look at every row of every searched column.  The columns it is
meant for have few distinct values beside the rows, so these are stored once, with the
trigrams of their lower-cased text.  A search finds the values that have all trigrams of
the term, checks them, and reads the table by these values only: as a list that reaches
the scan if there are few, by joins on the columns otherwise.  The rows are the same as
those of ``filters.free_text``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import text
from varloom.operators.filters import BadRequest, clean_term
from varloom.roles import col, require_columns

#: Matched values of a search that are listed in the plan; more are joined.
LISTED = 1000
#: Buckets of trigrams, each a folder of its own.
BUCKETS = 64


def _trigrams(value: Column) -> Column:
    """Distinct runs of three characters; a shorter text has none."""
    n = F.greatest(F.length(value) - 2, F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.substring(value, k, F.lit(3))))


def write_dictionary(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """The distinct values of ``columns`` and their trigrams, in ``path``/values and ``path``/trigrams.

    Values are text, as a contains search sees them; nulls are none.  One pass over the
    table for all columns; values are made distinct before they are shuffled.
    """
    require_columns(df, columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()
    values.write.mode("errorifexists").partitionBy("column").parquet(f"{path}/values")
    stored = df.sparkSession.read.schema("value string, column string").parquet(f"{path}/values")
    grams = stored.select("column", "value", F.explode(_trigrams(F.lower("value"))).alias("trigram"))
    bucket = F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int").alias("bucket")
    placed = grams.select("column", "value", "trigram", bucket).repartition("bucket", F.xxhash64("value") % 8)
    placed.sortWithinPartitions("bucket", "trigram").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/trigrams")


def matching_values(spark: SparkSession, path: str, term: str, columns: Sequence[str]) -> DataFrame:
    """(column, value): the stored values of the columns that contain the term, in any case.

    Wildcards of the term stay wildcards, as in ``filters.free_text``; trigrams are taken
    from the letters between them.  A term without three letters in a row is looked up in
    the list of values.
    """
    values = spark.read.schema("value string, column string").parquet(f"{path}/values")
    values = values.filter(F.col("column").isin(list(columns)))
    literal = term.lower().replace("_", "%").split("%")
    wanted = sorted({part[k : k + 3] for part in literal for k in range(len(part) - 2)})
    # lower case may differ in length from what LIKE folds; such letters are no part of a trigram that is looked up
    wanted = [g for g in wanted if g.isascii()]
    if wanted:
        grams = spark.read.schema("column string, value string, trigram string, bucket int").parquet(f"{path}/trigrams")
        buckets = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in wanted])).alias("g"))
        near = buckets.select(F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()  # at most BUCKETS
        hits = grams.filter(F.col("bucket").isin([r["b"] for r in near]) & F.col("trigram").isin(wanted) & F.col("column").isin(list(columns)))
        values = hits.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).drop("n")
    return values.select("column", "value").filter(text.contains("value", term))


def free_text(df: DataFrame, path: str, term: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows where any of the columns contains the term, found through the dictionary in ``path``."""
    term = clean_term(term)
    if term is None:
        return df
    return _rows_with(df, path, [term], columns, "any")


def free_text_terms(df: DataFrame, path: str, terms: Sequence[str], columns: Sequence[str], mode: str = "any") -> DataFrame:
    """As ``filters.free_text_terms`` with partial terms: ``any`` or ``all`` must hit some column."""
    if mode not in ("any", "all"):
        raise BadRequest(f"unknown mode {mode!r}")
    wanted = [t for t in map(clean_term, terms) if t]
    return _rows_with(df, path, wanted, columns, mode) if wanted else df


def _rows_with(df: DataFrame, path: str, terms: Sequence[str], columns: Sequence[str], mode: str) -> DataFrame:
    require_columns(df, columns)
    marks, drop = [], []
    for k, term in enumerate(terms):
        found = matching_values(df.sparkSession, path, term, columns)
        few = found.limit(LISTED + 1).collect()  # at most LISTED + 1 values
        hits = []
        for i, c in enumerate(columns):
            if len(few) <= LISTED:
                own = [r["value"] for r in few if r["column"] == c]
                hits.append(_listed(df, c, own))
            else:
                name, flag = f"_value_{k}_{i}", f"_hit_{k}_{i}"
                own = found.filter(F.col("column") == c).select(F.col("value").alias(name), F.lit(True).alias(flag))
                df = df.join(own, col(c).cast("string") == F.col(name), "left")  # values are distinct
                hits.append(F.col(flag).isNotNull())
                drop += [name, flag]
        marks.append(reduce(lambda a, b: a | b, hits))
    return df.filter(reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), marks)).drop(*drop)


def _listed(df: DataFrame, name: str, values: list[str]) -> Column:
    """Membership in a list, in the column's own type so that the scan can use it."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return col(name).isin(values)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return col(name).isin([int(v) for v in values])
    return col(name).cast("string").isin(values)
