"""Tables by name and by location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from varloom.roles import Roles, UnknownTable


def table_by_name(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise UnknownTable(f"table {name!r} not found")
    return spark.table(name)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table; with a numeric column and bounds it is read in parallel."""
    props = properties or {}
    if partition_column is None or bounds is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
        numPartitions=partitions, properties=props,
    )


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ("table_name",)) -> None:
    """Append rows to a table that is partitioned by cohort."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_variant_table(
    df: DataFrame, path: str, files: int | None = None, roles: Roles = Roles(), rows_per_file: int = 5_000_000
) -> None:
    """Variant table laid out for region reads.

    Partitioned by cohort and range-partitioned by position, so a cohort filter
    prunes folders and a region filter prunes files and row groups by their
    min/max.  A large cohort is spread over many files by its positions.  The
    number of files follows the number of rows unless it is given.
    """
    if files is None:
        files = max(1, -(-df.count() // rows_per_file))
    placed = df.repartitionByRange(files, roles.cohort, roles.chrom, roles.start)
    placed.sortWithinPartitions(roles.cohort, roles.chrom, roles.start).write.mode("errorifexists").partitionBy(
        roles.cohort
    ).parquet(path)
