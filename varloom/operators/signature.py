"""Mutation spectra: 96 channels, six classes, transitions, similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.functions import genomics, stats
from varloom.roles import Roles, col


def _slug(substitution: str) -> str:
    return substitution.replace(">", "_")


def _named_channels(df: DataFrame, by: Sequence[str], roles: Roles) -> DataFrame:
    """Counts by raw letters with their channel, null where there is none.

    Single-base changes are counted by their letters first, so the channel is
    worked out for a few hundred combinations instead of for every variant.
    """
    letters = [roles.ref, roles.alt, roles.context]
    single = (F.length(col(roles.ref)) == 1) & (F.length(col(roles.alt)) == 1) & (F.length(col(roles.context)) == 3)
    raw = df.filter(single).groupBy(*[col(c) for c in (*by, *letters)]).agg(F.count(F.lit(1)).alias("n"))
    return raw.select(*[col(b) for b in by], genomics.channel(*letters).alias("channel"), "n")


def channel_counts(df: DataFrame, by: Sequence[str] = (), roles: Roles = Roles()) -> DataFrame:
    """Variants per channel (and label columns), observed channels only."""
    # a filter on the channel would be pushed below the first count; one on the
    # sum stays above it
    counted = F.sum(F.when(F.col("channel").isNotNull(), F.col("n")))
    out = _named_channels(df, by, roles).groupBy(*by, "channel").agg(counted.alias("mutation_count"))
    return out.filter(F.col("mutation_count") > 0)


def profile(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """The 96 channels with their counts, zeros included, and their shares.

    The fixed channels come in by a union with zero counts: a join would push
    its null check on the channel down to every variant.
    """
    axis = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in genomics.all_channels()])).alias("channel"),
        F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("known"),
    )
    counts = _named_channels(df, (), roles).withColumn("known", F.lit(0))
    full = counts.unionByName(axis).groupBy("channel").agg(
        F.sum("n").alias("mutation_count"), F.sum("known").alias("known")
    )
    full = full.filter(F.col("known") > 0)
    # 96 rows, so one window over all of them is small
    total = F.sum("mutation_count").over(Window.partitionBy())
    return full.select(
        "channel",
        F.substring("channel", 1, 3).alias("substitution"),
        F.substring("channel", 5, 3).alias("context"),
        "mutation_count",
        stats.rate(F.col("mutation_count"), total).alias("frequency"),
    )


def nested_profile(profile_table: DataFrame) -> DataFrame:
    """Per substitution a map from context to frequency (16 entries each)."""
    entry = F.struct("context", "frequency")
    return profile_table.groupBy("substitution").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("contexts")
    )


def _letter_counts(df: DataFrame, sample: str, roles: Roles) -> DataFrame:
    """Variants per sample and pair of single bases, with the substitution class.

    Longer alleles share one null pair, so a sample has 17 rows at most.
    """
    single = (F.length(col(roles.ref)) == 1) & (F.length(col(roles.alt)) == 1)
    pair = [F.when(single, F.upper(col(c))).alias(name) for c, name in ((roles.ref, "r"), (roles.alt, "a"))]
    raw = df.groupBy(col(roles.sample).alias(sample), *pair).agg(F.count(F.lit(1)).alias("n"))
    return raw.withColumn("sub", genomics.pyrimidine_substitution("r", "a")).drop("r", "a")


def sample_spectrum(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Per sample the six substitution classes, as counts and as shares."""
    raw = _letter_counts(df, "sample", roles)
    counts = [
        F.coalesce(F.sum(F.when(F.col("sub") == s, F.col("n"))), F.lit(0)).alias(_slug(s)) for s in genomics.SUBSTITUTIONS
    ]
    substitutions = F.coalesce(F.sum(F.when(F.col("sub").isNotNull(), F.col("n"))), F.lit(0))
    out = raw.groupBy("sample").agg(
        F.sum("n").alias("total_mutations"), substitutions.alias("total_substitutions"), *counts
    )
    shares = [
        stats.rate(F.col(_slug(s)), F.col("total_substitutions")).alias(f"{_slug(s)}_freq")
        for s in genomics.SUBSTITUTIONS
    ]
    return out.select("*", *shares)


def cosine_to_reference(profiles: DataFrame, reference: DataFrame, label: str) -> DataFrame:
    """Cosine similarity of each labelled profile to one reference profile.

    ``reference`` has one row per channel, so the join keeps one row per
    (label, channel); the norms come from the two tables alone.
    """
    right = reference.select("channel", F.col("mutation_count").alias("r"))
    joined = profiles.join(right, "channel", "left")
    a, b = F.col("mutation_count").cast("double"), F.coalesce("r", F.lit(0)).cast("double")
    norm = right.agg(F.sqrt(F.sum(F.col("r").cast("double") * F.col("r").cast("double")))).scalar()
    sums = joined.groupBy(label).agg(F.sum(a * b).alias("dot"), F.sqrt(F.sum(a * a)).alias("own"))
    return sums.select(label, stats.rate(F.col("dot"), F.col("own") * norm).alias("cosine"))


def sample_titv(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Per sample the six class counts and shares, and the Ti and Tv shares."""
    spectrum = sample_spectrum(df, roles)
    total = F.col("total_substitutions")
    transitions = F.col("C_T") + F.col("T_C")
    return spectrum.select(
        "*",
        transitions.alias("Ti"),
        (total - transitions).alias("Tv"),
        stats.rate(transitions, total).alias("Ti_fraction"),
        stats.rate(total - transitions, total).alias("Tv_fraction"),
    )


def titv_long(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """sample, substitution class, count."""
    raw = _letter_counts(df, "tumor_sample_barcode", roles).withColumnRenamed("sub", "snv_class")
    counted = F.sum(F.when(F.col("snv_class").isNotNull(), F.col("n")))
    out = raw.groupBy("tumor_sample_barcode", "snv_class").agg(counted.alias("count"))
    return out.filter(F.col("count") > 0)
