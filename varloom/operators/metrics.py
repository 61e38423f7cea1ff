"""Per-sample summary tables and questions to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import stats
from varloom.operators import filters as flt
from varloom.operators import ordering
from varloom.roles import Roles, col, first_existing

SAMPLE_COLUMNS = ("tumor_sample_barcode", "sample_id", "sample")
COUNT_COLUMNS = ("mutation_count", "total_mutations")
METRIC_SUFFIX = {"tmb": "sample_tmb", "mutation_count": "sample_mutation_count", "sample_summary": "sample_summary"}


def metric_table(dataset: str, metric: str) -> str:
    """Name of the stored summary table of a data set."""
    if metric not in METRIC_SUFFIX:
        raise flt.BadRequest(f"unknown metric {metric!r}")
    return f"{dataset}_{METRIC_SUFFIX[metric]}"


def burden(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """sample, mutation class, count."""
    return df.groupBy(
        col(roles.sample).alias("tumor_sample_barcode"), col(roles.variant_class).alias("variant_class")
    ).agg(F.count(F.lit(1)).alias("count"))


def tmb(burden_table: DataFrame, genome_size_mb: float) -> DataFrame:
    """Mutations per megabase of every sample."""
    out = burden_table.groupBy("tumor_sample_barcode").agg(F.sum("count").alias("mutation_count"))
    return out.select(
        "tumor_sample_barcode",
        (F.col("mutation_count") / F.lit(float(genome_size_mb))).alias("tmb"),
        "mutation_count",
        F.lit(float(genome_size_mb)).alias("genome_size_mb"),
    )


def select_samples(
    metrics: DataFrame,
    samples: Sequence[str] | None = None,
    tmb_range: tuple[float | None, float | None] = (None, None),
    count_range: tuple[int | None, int | None] = (None, None),
) -> DataFrame:
    out = metrics if not samples else flt.in_first(metrics, SAMPLE_COLUMNS, samples)
    if tmb_range != (None, None):
        out = flt.in_ranges(out, {"tmb": tmb_range})
    if count_range != (None, None):
        out = flt.in_ranges(out, {first_existing(out, COUNT_COLUMNS): count_range})
    return out


def tmb_statistics(metrics: DataFrame) -> DataFrame:
    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    return metrics.agg(
        zero(F.min("tmb")).alias("min_tmb"),
        zero(F.max("tmb")).alias("max_tmb"),
        zero(F.avg("tmb")).alias("mean_tmb"),
        F.count("tmb").alias("sample_count"),
    )


def high_tmb(metrics: DataFrame, threshold: float, limit: int = 100) -> DataFrame:
    """Samples at or above a burden, highest first."""
    chosen = select_samples(metrics, tmb_range=(threshold, None))
    order = [F.col("tmb").desc(), col(first_existing(metrics, SAMPLE_COLUMNS)).asc()]
    return ordering.top(chosen, limit, order)


def sample_share(df: DataFrame, by: str, percent: float = 0.0, roles: Roles = Roles()) -> DataFrame:
    """Values of a column that occur in more than ``percent`` of the samples."""
    hits = df.groupBy(col(by).alias(by)).agg(F.countDistinct(col(roles.sample)).alias("samples"))
    total = df.agg(F.countDistinct(col(roles.sample))).scalar()
    out = hits.withColumn("percent", stats.rate(F.col("samples"), total, 100.0))
    return out.filter(F.col("percent") > percent)
