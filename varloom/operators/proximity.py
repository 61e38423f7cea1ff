"""Variants near reference variants.

Distances are measured between start positions.  Four modes (within, beyond,
exact, range), three directions, and switches for gene and chromosome are all
turned into closed ranges of positions; see ``intervals`` for the lookup.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.functions import genomics
from varloom.functions.stats import rounded
from varloom.operators import intervals, regions
from varloom.operators.filters import BadRequest
from varloom.operators.ordering import top_per_group
from varloom.roles import Roles, col

UP, SAME, DOWN = -1, 0, 1
#: So many neighbours travel with their blocks; of more the positions are chosen first.
FEW = 32


@dataclass(frozen=True)
class Reach:
    """Which distances count, in base pairs, and on which side."""

    distance: int
    mode: str = "within"
    max_distance: int | None = None
    unit: str = "bp"
    direction: str = "both"
    exclude_reference: bool = True
    same_gene: bool = False
    same_chromosome: bool = True

    def __post_init__(self) -> None:
        if self.mode not in ("within", "beyond", "exact", "range"):
            raise BadRequest(f"unknown distance mode {self.mode!r}")
        if self.direction not in ("upstream", "downstream", "both"):
            raise BadRequest(f"unknown direction {self.direction!r}")
        if self.distance < 1:
            raise BadRequest("the distance must be at least 1")
        if self.mode == "range" and (self.max_distance is None or self.max_distance < self.distance):
            raise BadRequest("range mode needs max_distance >= distance")

    @property
    def bounds(self) -> tuple[int, int | None]:
        """Smallest and largest distance of a neighbour at another position."""
        d = genomics.distance_bp(self.distance, self.unit)
        if self.mode == "within":
            return 1, d
        if self.mode == "beyond":
            return d, None
        if self.mode == "exact":
            return max(d - 1, 1), d + 1
        return d, genomics.distance_bp(self.max_distance, self.unit)

    @property
    def zero_counts(self) -> bool:
        """Do variants at the very position of the reference count?"""
        if self.exclude_reference or self.direction != "both":
            return False
        d = genomics.distance_bp(self.distance, self.unit)
        return self.mode == "within" or (self.mode == "exact" and d <= 1)

    @property
    def key(self) -> list[str]:
        return (["k_chrom"] if self.same_chromosome else []) + (["k_gene"] if self.same_gene else [])

    def flipped(self) -> Reach:
        """The same relation seen from the neighbour."""
        from dataclasses import replace

        other = {"upstream": "downstream", "downstream": "upstream", "both": "both"}
        return replace(self, direction=other[self.direction])


def _keyed(df: DataFrame, reach: Reach, roles: Roles) -> DataFrame:
    """Add the join key and the numeric position; rows without one are left out."""
    pos = col(roles.start)
    if dict(df.dtypes)[roles.start] == "string":
        pos = pos.try_cast("bigint")
    out = df.withColumn("pos", pos.cast("bigint")).filter(F.col("pos").isNotNull())
    if reach.same_chromosome:
        out = out.withColumn("k_chrom", col(roles.chrom))
    if reach.same_gene:
        out = out.withColumn("k_gene", col(roles.gene))
    return out


def references(
    df: DataFrame,
    chromosome: str | None = None,
    sort_by: str | None = None,
    descending: bool = False,
    limit: int | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """Restrict and cut the reference variants before anything is joined."""
    out = df if chromosome is None else df.filter(regions.same_chromosome(roles.chrom, chromosome))
    if limit:
        lead = [] if sort_by is None else [col(sort_by).desc() if descending else col(sort_by).asc()]
        out = out.orderBy(*lead, col(roles.variant_id).asc()).limit(limit)
    return out


def _in_reach(rows: DataFrame, points: DataFrame, reach: Reach) -> DataFrame:
    """Drop rows whose surroundings hold no point at all.

    A coarse check by blocks at least as wide as the reach: every point marks
    the two or three blocks its range touches.  Few points leave few rows for
    the exact lookup.  Without an upper bound every row may be in reach.
    """
    high = reach.bounds[1]
    if high is None:
        return rows
    bits = high.bit_length()
    touched = F.sequence(F.shiftright(F.col("pos") - high, bits), F.shiftright(F.col("pos") + high, bits))
    marked = points.select(*reach.key, F.explode(touched).alias("coarse")).distinct()
    placed = rows.withColumn("coarse", F.shiftright("pos", bits))
    return placed.join(marked, [*reach.key, "coarse"], "left_semi").drop("coarse")


@dataclass(frozen=True)
class Span:
    """How far a lookup can go: by the reach alone, or to the ends of the searched positions."""

    levels: int
    first: int | None = None
    last: int | None = None


def _span(searched: DataFrame, reach: Reach) -> Span:
    """Without an upper bound on the distance, the ends of the table are looked up: one small aggregate."""
    low, high = reach.bounds
    if high is not None:
        return Span(intervals.levels_for(high - low + 1))
    ends = searched.agg(F.min("pos").alias("first"), F.max("pos").alias("last")).first()
    if ends["first"] is None:
        return Span(1, 0, -1)
    return Span(intervals.levels_for(ends["last"] - ends["first"] + 1), ends["first"], ends["last"])


def _probes(points: DataFrame, reach: Reach, span: Span) -> DataFrame:
    """Cut the range on each side of every point into blocks."""
    low, high = reach.bounds
    p = F.col("pos")
    far_left = F.lit(span.first).cast("bigint") if high is None else p - high
    far_right = F.lit(span.last).cast("bigint") if high is None else p + high
    sides = []
    if reach.direction in ("both", "upstream"):
        sides.append((UP, far_left, p - low if high is not None else F.least(p - low, F.lit(span.last).cast("bigint"))))
    if reach.direction in ("both", "downstream"):
        sides.append((DOWN, p + low if high is not None else F.greatest(p + low, F.lit(span.first).cast("bigint")), far_right))
    if reach.zero_counts:
        sides.append((SAME, p, p))
    ranges = F.array(
        *[F.struct(F.lit(side).alias("side"), start.alias("low"), end.alias("high")) for side, start, end in sides]
    )
    return intervals.cut_into_blocks(points.select("*", F.inline(ranges)), span.levels)


def neighbour_stats(
    refs: DataFrame, variants: DataFrame, reach: Reach, roles: Roles = Roles()
) -> DataFrame:
    """Count, mean, least and greatest distance of the neighbours of each reference.

    One row per reference position (chrom:pos); where several references share
    it, the first by gene and variant id stands for them.  With ``same_gene`` each
    gene at the position looks up its own neighbours, which are then added up.
    Positions without a neighbour are left out.
    """
    picked = reference_points(refs, reach, roles)
    searched = _keyed(variants, reach, roles).groupBy(*reach.key, "pos").agg(F.count(F.lit(1)).alias("n"))
    searched = _in_reach(searched, picked, reach)
    span = _span(searched, reach)
    index = intervals.block_stats(searched, reach.key, span.levels)
    probes = _probes(picked.select(*reach.key, "reference_chromosome", "pos"), reach, span)
    base = intervals.block_start()
    p, side = F.col("pos"), F.col("side")
    total = F.when(side == UP, F.col("b_n") * (p - base) - F.col("b_offsets")).otherwise(
        F.col("b_n") * (base - p) + F.col("b_offsets")
    )
    near = F.when(side == UP, p - F.col("b_last")).otherwise(F.col("b_first") - p)
    far = F.when(side == UP, p - F.col("b_first")).otherwise(F.col("b_last") - p)
    stats = (
        probes.join(index, [*reach.key, "level", "block"])
        .groupBy("reference_chromosome", "pos")
        .agg(
            F.sum("b_n").alias("nearby_count"),
            F.sum(total).alias("_total"),
            F.min(near).alias("min_distance"),
            F.max(far).alias("max_distance"),
        )
        .withColumn("avg_distance", F.col("_total").cast("double") / F.col("nearby_count"))
        .drop("_total")
    )
    shown = _collapsed(picked) if reach.same_gene else picked.drop(*reach.key)
    return shown.join(stats, ["reference_chromosome", "pos"]).withColumnRenamed("pos", "reference_position")


def _collapsed(points: DataFrame) -> DataFrame:
    """One row per position of points by gene: details of the first gene, references of all."""
    details = [c for c in points.columns if c.startswith("reference_") and c not in ("reference_chromosome", "reference_variants")]
    first = F.min_by(F.struct(*details), F.struct("reference_gene", "k_first"))
    return points.groupBy("reference_chromosome", "pos").agg(
        first.alias("d"), F.sum("reference_variants").alias("reference_variants")
    ).select("reference_chromosome", "pos", "reference_variants", "d.*")


def reference_points(refs: DataFrame, reach: Reach, roles: Roles = Roles()) -> DataFrame:
    """One row per reference position, with ``same_gene`` per gene there, with the details of its first reference."""
    details = ["gene", "variant_type", "variant_class", "protein_change", "genome_change"]
    named = {d: getattr(roles, d, d) for d in details}
    present = {d: c for d, c in named.items() if c in refs.columns}
    rows = _keyed(refs, reach, roles)
    # a struct compares by its first fields, so min takes the first by gene, id
    order = F.struct(col(roles.gene), col(roles.variant_id))
    detail = F.struct(*[col(c).alias(f"reference_{d}") for d, c in present.items()])
    place = [col(roles.chrom).alias("reference_chromosome"), "pos", *(["k_gene"] if reach.same_gene else [])]
    points = rows.groupBy(*place).agg(
        F.min_by(detail, order).alias("d"), F.count(F.lit(1)).alias("reference_variants"),
        F.min(col(roles.variant_id)).alias("k_first"),
    )
    kept = ["k_gene", "k_first"] if reach.same_gene else []
    points = points.select("reference_chromosome", "pos", "reference_variants", *kept, "d.*")
    if reach.same_chromosome:
        points = points.withColumn("k_chrom", F.col("reference_chromosome"))
    return points


def having(
    stats: DataFrame,
    min_nearby: int | None = None,
    max_nearby: int | None = None,
    min_avg: float | None = None,
    max_avg: float | None = None,
) -> DataFrame:
    """Keep references by their statistics; None or 0 switches a bound off."""
    for name, low, high in (("nearby_count", min_nearby, max_nearby), ("avg_distance", min_avg, max_avg)):
        if low:
            stats = stats.filter(F.col(name) >= low)
        if high:
            stats = stats.filter(F.col(name) <= high)
    return stats


def nearest(
    points: DataFrame,
    searched: DataFrame,
    reach: Reach,
    k: int,
    by: str | None = None,
    descending: bool = False,
    tie: Sequence[str] = ("id",),
    sparse_points: bool = True,
) -> DataFrame:
    """For every point the k first of the searched rows within reach.

    ``points`` and ``searched`` carry the key columns and ``pos``; the searched
    columns come back with their position as ``near_pos``.  Order is by
    distance, or by another searched column, then by ``tie``.  Each block only
    keeps the k rows that can win, so a hot position stays small; a large k by
    distance is served by :func:`_many_nearest`.  With
    ``sparse_points`` the searched rows are first reduced to those around some
    point.
    """
    if k < 1:
        raise BadRequest("the number of neighbours must be at least 1")
    ties = [F.col(t).asc() for t in tie]
    key = reach.key

    def directed(c: Column, down: bool) -> Column:
        return c.desc() if down else c.asc()

    if by is None:
        # nearest first is by falling position upstream, by rising downstream
        orders = {UP: [directed(F.col("pos"), not descending)], DOWN: [directed(F.col("pos"), descending)]}
        within = ties
    else:
        orders = {UP: [directed(col(by), descending)]}
        orders[DOWN] = orders[UP]
        within = [directed(col(by), descending), *ties]

    if sparse_points:
        searched = _in_reach(searched, points, reach)
    span = _span(searched, reach)
    if by is None and k > FEW:
        return _many_nearest(points, searched, reach, span, k, descending, tie)
    kept = top_per_group(searched, [*key, "pos"], k, within)
    index = None
    for order_of, sides in ((UP, [UP]), (DOWN, [SAME, DOWN])) if by is None else ((UP, [UP, SAME, DOWN]),):
        top = intervals.block_top(kept, key, span.levels, k, [*orders[order_of], *ties])
        served = top.withColumn("side", F.explode(F.array(*[F.lit(x) for x in sides])))
        index = served if index is None else index.unionByName(served)
    index = index.withColumnRenamed("pos", "near_pos")
    hits = _probes(points, reach, span).join(index, [*key, "side", "level", "block"])
    hits = hits.withColumn("distance_bp", F.abs(F.col("near_pos") - F.col("pos"))).drop("level", "block", "side")
    lead = F.col("distance_bp") if by is None else col(by)
    group = [c for c in points.columns]
    return top_per_group(hits, group, k, [directed(lead, descending), *ties])


def _many_nearest(
    points: DataFrame, searched: DataFrame, reach: Reach, span: Span, k: int, descending: bool, tie: Sequence[str]
) -> DataFrame:
    """The k first rows by distance, then ``tie``, of every point: first positions by their counts, then rows.

    Blocks hold positions and how many rows these have, up to the k-th row; summed up by
    distance they tell each point which positions it takes and how many rows of the last
    distance.  So a row is neither copied to every block size nor met in every block.
    """
    key, ties = reach.key, [F.col(t).asc() for t in tie]
    ranked = top_per_group(searched, [*key, "pos"], k, ties, rank="_place").withColumnRenamed("pos", "near_pos")
    counts = searched.groupBy(*key, "pos").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_n"))
    index = None
    for falling, sides in ((not descending, [UP]), (descending, [SAME, DOWN])):
        order = F.col("pos").desc() if falling else F.col("pos").asc()
        before = Window.partitionBy(*key, "level", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        blocks = intervals.block_top(counts, key, span.levels, k, [order])
        blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < k)
        served = blocks.drop("_before").withColumn("side", F.explode(F.array(*[F.lit(x) for x in sides])))
        index = served if index is None else index.unionByName(served)
    index = index.withColumnRenamed("pos", "near_pos")
    group = list(points.columns)
    met = _probes(points, reach, span).join(index, [*key, "side", "level", "block"])
    met = met.select(*group, "near_pos", "_n", F.abs(F.col("near_pos") - F.col("pos")).alias("distance_bp"))
    lead = F.col("distance_bp").desc() if descending else F.col("distance_bp").asc()
    # both windows need the same order of rows; the first one counts what stands at the same distance, too
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(lead))
    same = F.sum("_n").over(Window.partitionBy(*group, "distance_bp"))
    taken = met.withColumn("_left", F.lit(k) - (upto - same)).filter(F.col("_left") > 0)
    rows = taken.drop("_n").join(ranked, [*key, "near_pos"]).filter(F.col("_place") <= F.col("_left"))
    place = F.row_number().over(Window.partitionBy(*group, "distance_bp").orderBy(*ties))
    return rows.withColumn("_place", place).filter(F.col("_place") <= F.col("_left")).drop("_place", "_left")


def nearby_per_reference(
    refs: DataFrame,
    variants: DataFrame,
    reach: Reach,
    k: int,
    by: str | None = None,
    descending: bool = False,
    keep: Sequence[str] = (),
    roles: Roles = Roles(),
) -> DataFrame:
    """Up to k neighbours of each reference position, one row per pair.

    With ``same_gene`` each gene at the position looks up its own neighbours, and
    the k first of them all are kept.
    """
    points = reference_points(refs, reach, roles)
    extra = [c for c in dict.fromkeys([roles.chrom, roles.gene, *keep, *([by] if by else [])]) if c != roles.variant_id]
    searched = _keyed(variants, reach, roles).select(
        *reach.key, "pos", col(roles.variant_id).alias("id"), *[col(c) for c in extra]
    )
    slim = points.select(*reach.key, "reference_chromosome", "pos", "reference_gene")
    hits = nearest(slim, searched, reach, k, by, descending)
    if reach.same_gene:
        lead = F.col("distance_bp") if by is None else col(by)
        order = [lead.desc() if descending else lead.asc(), F.col("id").asc()]
        hits = top_per_group(hits, ["reference_chromosome", "pos"], k, order)
    return _presented(hits, "pos", "near_pos", reach, roles)


def _presented(hits: DataFrame, ref: str, query: str, reach: Reach, roles: Roles) -> DataFrame:
    """Add labels and units, and give the columns the caller's names."""
    return (
        hits.withColumn("relative_direction", genomics.relative_direction(query, ref))
        .withColumn("distance", genomics.distance_in("distance_bp", reach.unit))
        .withColumn("distance_unit", F.lit(reach.unit))
        .withColumnRenamed(ref, "reference_position")
        .withColumnRenamed(query, roles.start)
        .withColumnRenamed("id", roles.variant_id)
        .drop("k_chrom", "k_gene")
    )


def closest_hits(
    refs: DataFrame,
    variants: DataFrame,
    reach: Reach,
    keep: Sequence[str] = (),
    roles: Roles = Roles(),
) -> DataFrame:
    """Every variant position near some reference, with its closest reference.

    One row per (chrom, start): the first variant there by id, and the nearest
    reference; ties go to the lower reference position, then to the gene.
    """
    seen = reach.flipped()
    extra = [c for c in dict.fromkeys([roles.gene, *keep]) if c not in (roles.variant_id, roles.chrom, roles.start)]
    rows = _keyed(variants, seen, roles)
    place = list(dict.fromkeys([*seen.key, roles.chrom, "pos"]))
    ref_rows = _keyed(refs, seen, roles).groupBy(*seen.key, "pos").agg(
        F.min(F.struct(col(roles.gene).alias("g"), col(roles.chrom).alias("c"))).alias("r")
    )
    searched = ref_rows.select(
        *seen.key, "pos", F.col("pos").alias("ref_pos"), F.col("r.g").alias("reference_gene"),
        F.col("r.c").alias("reference_chromosome"),
    )
    points = _in_reach(rows.select(*place).distinct(), searched.select(*seen.key, "pos"), seen)
    best = nearest(
        points, searched, seen, 1, tie=("ref_pos", "reference_gene"), sparse_points=False
    ).drop("near_pos")
    if reach.same_gene:
        order = [F.col(c).asc() for c in ("distance_bp", "ref_pos", "reference_gene")]
        best = top_per_group(best, [roles.chrom, "pos"], 1, order)
    # only now the variants themselves: the first by id at every position found
    first = F.min_by(F.struct(col(roles.variant_id).alias("id"), *[col(c) for c in extra]), col(roles.variant_id))
    found = rows.select(*place, col(roles.variant_id), *[col(c) for c in extra if c not in place]).join(best, place)
    out = found.groupBy(*best.columns).agg(first.alias("q"))
    out = out.select(*[c for c in best.columns if c not in extra], "q.*")
    return _presented(out, "ref_pos", "pos", reach, roles)


def distinct_closest(hits: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """From neighbour rows keep, per (chrom, start), the closest one."""
    order = ["distance_bp", "reference_chromosome", "reference_position", "reference_gene", roles.variant_id]
    return top_per_group(hits, [roles.chrom, roles.start], 1, [col(c).asc() for c in order])


def rounded_average(stats: DataFrame) -> DataFrame:
    return stats.withColumn("avg_distance", rounded(F.col("avg_distance"), 2))


def nested(hits: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Statistics over limited neighbour rows, with the rows as a nested list.

    The list is as long as the per-reference limit at most, nearest first.
    """
    key = ["reference_chromosome", "reference_position"]
    lead = ["distance_bp", roles.variant_id]
    rest = [c for c in hits.columns if c not in (*key, *lead, "reference_gene")]
    return hits.groupBy(*key).agg(
        F.count(F.lit(1)).alias("nearby_count"),
        F.avg("distance_bp").alias("avg_distance"),
        F.min("distance_bp").alias("min_distance"),
        F.max("distance_bp").alias("max_distance"),
        F.array_sort(F.collect_list(F.struct(*[col(c) for c in (*lead, *rest)]))).alias("nearby_variants"),
    )
