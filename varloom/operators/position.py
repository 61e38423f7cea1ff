"""Where mutations fall: bins, density, codons, hotspots, protein domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.functions import genomics, stats, text
from varloom.operators.filters import BadRequest
from varloom.roles import Roles, col

NO_DOMAIN = "Intradomain/Unknown"


def _set_of(c: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(c != "", c)))


def _check_width(width: int) -> None:
    if width < 1:
        raise BadRequest("the width must be at least 1")


def fixed_windows(df: DataFrame, width: int, min_mutations: int = 1, roles: Roles = Roles()) -> DataFrame:
    """Windows of equal width that hold at least ``min_mutations`` variants."""
    _check_width(width)
    pos = col(roles.start)
    start = (F.floor(pos / F.lit(width)) * width).cast("bigint")
    out = df.groupBy(col(roles.chrom).alias("chromosome"), start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("mutation_count"),
        F.min(pos).alias("min_position"),
        F.max(pos).alias("max_position"),
        _set_of(col(roles.gene)).alias("genes"),
    )
    out = out.filter(F.col("mutation_count") >= min_mutations)
    return out.withColumn("window_end", F.col("window_start") + width)


def gene_windows(df: DataFrame, min_mutations: int = 1, roles: Roles = Roles()) -> DataFrame:
    """One window per gene and chromosome."""
    pos = col(roles.start)
    out = df.groupBy(col(roles.gene).alias("gene"), col(roles.chrom).alias("chromosome")).agg(
        F.count(F.lit(1)).alias("mutation_count"), F.min(pos).alias("window_start"), F.max(pos).alias("window_end")
    )
    return out.filter(F.col("mutation_count") >= min_mutations)


def density(df: DataFrame, bin_size: int, roles: Roles = Roles()) -> DataFrame:
    """Variants per bin and per thousand bases."""
    _check_width(bin_size)
    start = (F.floor(col(roles.start) / F.lit(bin_size)) * bin_size).cast("bigint")
    out = df.groupBy(col(roles.chrom).alias("chromosome"), start.alias("bin_start")).agg(
        F.count(F.lit(1)).alias("mutation_count")
    )
    per_kb = stats.rounded(F.col("mutation_count") / F.lit(float(bin_size)) * F.lit(1000.0), 3)
    return out.select(
        "chromosome", "bin_start", (F.col("bin_start") + bin_size).alias("bin_end"), "mutation_count", per_kb.alias("density")
    )


def by_position(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Each position with its count, genes and mutation classes."""
    return df.groupBy(col(roles.chrom).alias("chromosome"), col(roles.start).alias("position")).agg(
        F.count(F.lit(1)).alias("mutation_count"),
        _set_of(col(roles.gene)).alias("genes"),
        _set_of(col(roles.variant_class)).alias("variant_classes"),
    )


def with_protein_position(df: DataFrame, candidates: Sequence[str] | None = None, roles: Roles = Roles()) -> DataFrame:
    """Variants whose protein change names a residue, as ``residue``."""
    names = [c for c in (candidates or (roles.protein_change,)) if c in df.columns]
    if not names:
        raise BadRequest("no protein change column")
    out = df.withColumn("change", text.first_non_empty(names))
    out = out.withColumn("residue", genomics.amino_acid_position("change"))
    return out.filter(F.coalesce("residue", F.lit(0)) != 0).filter(
        col(roles.gene).isNotNull() & (col(roles.gene) != "")
    )


def _residue_points(df: DataFrame, roles: Roles) -> DataFrame:
    """(gene, pos, n): mutations per residue.

    Rows are counted by their protein change as written, so each distinct text
    is parsed once; the check stands on the sum to stay above that count.
    """
    gene = F.nullif(col(roles.gene), F.lit(""))
    raw = df.groupBy(gene.alias("gene"), col(roles.protein_change).alias("change")).agg(F.count(F.lit(1)).alias("m"))
    named = raw.withColumn("pos", genomics.amino_acid_position("change"))
    known = F.col("gene").isNotNull() & (F.coalesce("pos", F.lit(0)) != 0)
    return named.groupBy("gene", "pos").agg(F.sum(F.when(known, F.col("m"))).alias("n")).filter(F.col("n") > 0)


def by_codon(df: DataFrame, gene: str | None = None, roles: Roles = Roles()) -> DataFrame:
    """Per gene and residue: count and the set of protein changes."""
    rows = df if gene is None else df.filter(col(roles.gene) == gene)
    rows = with_protein_position(rows, roles=roles)
    return rows.groupBy(col(roles.gene).alias("gene"), F.col("residue").alias("protein_position")).agg(
        F.count(F.lit(1)).alias("mutation_count"), _set_of(F.col("change")).alias("protein_changes")
    )


def _counted(df: DataFrame, key: Sequence[Column], pos: Column) -> DataFrame:
    return df.groupBy(*key, pos.alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def sliding_windows(
    df: DataFrame, width: int, min_mutations: int = 1, chunk: int = 1 << 16, roles: Roles = Roles()
) -> DataFrame:
    """For every mutated position p, the variants in [p, p + width - 1].

    Positions are counted first.  Each chunk of a chromosome is a window
    partition that also gets the positions just past its end, so no chromosome
    has to fit in one task; running totals replace the moving frame.
    """
    _check_width(width)
    chunk = max(chunk, width)
    points = _counted(df, [col(roles.chrom).alias("chromosome")], col(roles.start).cast("bigint"))
    home = F.floor(F.col("pos") / F.lit(chunk)).cast("bigint")
    # a position also serves the windows that start in the chunk before it
    first = F.floor(F.greatest(F.col("pos") - (width - 1), F.lit(0)) / F.lit(chunk)).cast("bigint")
    spread = points.withColumn("home", home).withColumn("chunk", F.explode(F.sequence(first, home)))
    order = Window.partitionBy("chromosome", "chunk").orderBy("pos")
    upto = F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, width - 1))
    before = F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, -1))
    out = spread.withColumn("mutation_count", (upto - F.coalesce(before, F.lit(0))).cast("bigint"))
    out = out.filter((F.col("home") == F.col("chunk")) & (F.col("mutation_count") >= min_mutations))
    return out.select(
        "chromosome", F.col("pos").alias("window_start"), (F.col("pos") + width).alias("window_end"), "mutation_count"
    )


def greedy_hotspots(df: DataFrame, width: int, min_mutations: int, roles: Roles = Roles()) -> DataFrame:
    """Hotspots found by walking along the residues of each gene.

    From a residue, count the mutations in the window that starts there.  With
    enough of them the window is a hotspot and the walk goes on behind it, else
    it goes on at the next residue.

    Mutations are counted per residue first, so one gene is at most as long as
    its protein.  Stretches separated by a gap of a window or more cannot
    influence each other and are walked apart.
    """
    _check_width(width)
    points = _residue_points(df, roles)
    along = Window.partitionBy("gene").orderBy("pos")
    upto = F.sum("n").over(along.rangeBetween(Window.unboundedPreceding, width - 1))
    before = F.sum("n").over(along.rangeBetween(Window.unboundedPreceding, -1))
    gap = F.col("pos") - F.lag("pos").over(along) >= width
    marked = points.select(
        "*", (upto - F.coalesce(before, F.lit(0))).alias("ahead"), F.when(gap, 1).otherwise(0).alias("cut")
    )
    run = F.sum("cut").over(along.rowsBetween(Window.unboundedPreceding, 0))
    stretches = marked.withColumn("run", run).groupBy("gene", "run").agg(
        F.array_sort(F.collect_list(F.struct("pos", "ahead"))).alias("points"), F.max("ahead").alias("best")
    )
    stretches = stretches.filter(F.col("best") >= min_mutations)

    def walk(acc: Column, point: Column) -> Column:
        """acc: the next free residue and the starts found so far."""
        hot = (point["pos"] >= acc["free"]) & (point["ahead"] >= min_mutations)
        grown = F.struct(
            (point["pos"] + width).alias("free"), F.concat(acc["starts"], F.array(point["pos"])).alias("starts")
        )
        return F.when(hot, grown).otherwise(acc)

    begin = F.struct(F.lit(0).cast("bigint").alias("free"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate("points", begin, walk, lambda acc: acc["starts"])
    found = stretches.select("gene", F.explode(starts).alias("hotspot_start"))

    # a window touches at most two buckets of its own width
    def bucket(c: Column) -> Column:
        return F.floor(c / F.lit(width)).cast("bigint")

    first, last = F.col("hotspot_start"), F.col("hotspot_start") + (width - 1)
    placed = found.withColumn("bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    inside = placed.join(points.withColumn("bucket", bucket(F.col("pos"))), ["gene", "bucket"])
    inside = inside.filter(F.col("pos").between(first, last))
    out = inside.groupBy("gene", "hotspot_start").agg(
        F.sum("n").alias("mutation_count"),
        F.sum(F.col("n") * F.col("pos")).alias("weighted"),
        F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("points"),
    )
    count = F.col("mutation_count")
    return out.select(
        "gene",
        "hotspot_start",
        last.alias("hotspot_end"),
        F.floor(F.col("weighted") / count).cast("bigint").alias("hotspot_center"),
        "mutation_count",
        stats.rounded(count / F.lit(float(width)), 3).alias("mutations_per_residue"),
        F.col("points.pos").alias("positions"),
        F.col("points.n").alias("position_counts"),
    )


def domain_lists(domains: DataFrame) -> DataFrame:
    """The domains of each gene as one sorted list; a protein has few."""
    entry = F.struct("domain_start", "domain_end", "domain_id", "domain_name")
    return domains.groupBy("gene").agg(F.array_sort(F.collect_set(entry)).alias("domains"))


def map_to_domains(df: DataFrame, domains: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Each variant with the first domain that covers its residue.

    The domains of a gene are joined as one list, so variants are neither
    multiplied nor ranked afterwards.
    """
    rows = with_protein_position(df, roles=roles)
    lists = domain_lists(domains).withColumnRenamed("gene", "d_gene")
    joined = rows.join(lists, rows[roles.gene] == lists["d_gene"], "left")
    covering = F.filter(
        "domains", lambda d: (d["domain_start"] <= F.col("residue")) & (d["domain_end"] >= F.col("residue"))
    )
    hit = F.get(covering, F.lit(0))
    return joined.withColumn("hit", hit).select(
        *[col(c) for c in df.columns],
        F.col("residue"),
        F.coalesce("hit.domain_name", F.when(F.col("hit").isNotNull(), F.col("hit.domain_id")), F.lit(NO_DOMAIN)).alias(
            "domain_name"
        ),
        F.col("hit.domain_id").alias("domain_id"),
        F.col("hit.domain_start").alias("domain_start"),
        F.col("hit.domain_end").alias("domain_end"),
    )


def domain_enrichment(
    df: DataFrame, domains: DataFrame, min_mutations: int = 1, roles: Roles = Roles()
) -> DataFrame:
    """Variants and genes per domain, as a share of all variants of the table.

    Variants are counted per residue before they meet the domains.
    """
    points = _residue_points(df, roles)
    lists = domain_lists(domains)
    covering = F.filter(
        "domains", lambda d: (d["domain_start"] <= F.col("pos")) & (d["domain_end"] >= F.col("pos"))
    )
    mapped = points.join(lists, "gene").withColumn("hit", F.get(covering, F.lit(0))).filter(F.col("hit").isNotNull())
    out = mapped.groupBy(
        F.coalesce("hit.domain_name", "hit.domain_id").alias("domain_name"), F.col("hit.domain_id").alias("domain_id")
    ).agg(
        F.sum("n").alias("mutation_count"),
        F.countDistinct("gene").alias("gene_count"),
        F.array_sort(F.collect_set("gene")).alias("genes"),
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    share = stats.rounded(stats.rate(F.col("mutation_count"), total), 4)
    return out.filter(F.col("mutation_count") >= min_mutations).withColumn("frequency", share)
