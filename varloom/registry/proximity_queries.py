"""Checked queries for proximity."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import genomics
from varloom.operators import proximity as prox
from varloom.plans import entry_points as plans
from varloom.operators.ordering import sort_nulls_as_zero
from varloom.operators.proximity import Reach
from varloom.registry.core import query
from varloom.registry.fixtures import ROLES, sql, variants

_REF = "gene IN ('G3', 'G25', 'G11') AND variant_class = 'Nonsense_Mutation' AND table_name = 'cohort_1'"

_HIT_COLUMNS = ["variant_id", "chrom", "start_pos", "reference_gene", "reference_position", "distance_bp", "relative_direction"]


def _refs(v):
    return v.filter(
        F.col("gene").isin("G3", "G25", "G11")
        & (F.col("variant_class") == "Nonsense_Mutation")
        & (F.col("table_name") == "cohort_1")
    )


def _closest_sql(on: str, same_chrom: bool = True, exclude: bool = True) -> str:
    """Brute force over reference positions and variant positions."""
    chrom = "q.chrom = r.chrom AND" if same_chrom else ""
    skip = "AND q.start_pos <> r.start_pos" if exclude else ""
    return sql(
        f"""SELECT variant_id, chrom, start_pos, reference_gene, reference_position, distance_bp,
          CASE WHEN start_pos < reference_position THEN 'upstream' WHEN start_pos > reference_position THEN 'downstream'
            ELSE 'same' END AS relative_direction FROM (
          SELECT q.chrom, q.start_pos, q.variant_id, r.gene AS reference_gene, r.start_pos AS reference_position,
            abs(q.start_pos - r.start_pos) AS distance_bp,
            row_number() OVER (PARTITION BY q.chrom, q.start_pos ORDER BY abs(q.start_pos - r.start_pos), r.start_pos, r.gene) AS rn
          FROM q JOIN r ON {chrom} {on} {skip}) x WHERE rn = 1""",
        ctes=f"""r AS (SELECT chrom, gene, start_pos FROM variants WHERE {_REF} GROUP BY ALL),
          q AS (SELECT chrom, gene, start_pos, min(variant_id) AS variant_id FROM variants GROUP BY ALL)""".replace(
            "chrom, gene, start_pos, min", "chrom, start_pos, min"
        ),
    )


def _closest(spark, sf, reach):
    v = variants(spark, sf)
    return prox.closest_hits(_refs(v), v, reach, roles=ROLES).select(*_HIT_COLUMNS)


@query("c7_proximity_within", _closest_sql("abs(q.start_pos - r.start_pos) <= 6"))
def c7(spark, sf):
    return _closest(spark, sf, Reach(6))


@query("c7_proximity_within_codon", _closest_sql("abs(q.start_pos - r.start_pos) <= 9", exclude=False))
def c7_codon(spark, sf):
    return _closest(spark, sf, Reach(3, unit="codon", exclude_reference=False))


@query("c8_proximity_beyond", _closest_sql("abs(q.start_pos - r.start_pos) >= 2500"))
def c8(spark, sf):
    return _closest(spark, sf, Reach(2500, "beyond"))


@query("c9_proximity_exact", _closest_sql("abs(abs(q.start_pos - r.start_pos) - 40) <= 1"))
def c9(spark, sf):
    return _closest(spark, sf, Reach(40, "exact"))


@query("c10_proximity_range", _closest_sql("abs(q.start_pos - r.start_pos) BETWEEN 30 AND 37"))
def c10(spark, sf):
    return _closest(spark, sf, Reach(30, "range", 37))


@query("c11_upstream", _closest_sql("r.start_pos - q.start_pos BETWEEN 1 AND 12"))
def c11_up(spark, sf):
    return _closest(spark, sf, Reach(12, direction="upstream"))


@query("c11_downstream", _closest_sql("q.start_pos - r.start_pos BETWEEN 1 AND 12"))
def c11_down(spark, sf):
    return _closest(spark, sf, Reach(12, direction="downstream"))


@query("c11_any_chromosome", _closest_sql("abs(q.start_pos - r.start_pos) <= 3", same_chrom=False))
def c11_any(spark, sf):
    return _closest(spark, sf, Reach(3, same_chromosome=False))


@query(
    "c11_same_gene",
    sql(
        f"""SELECT variant_id, chrom, start_pos, reference_gene, reference_position, distance_bp FROM (
          SELECT q.chrom, q.start_pos, q.variant_id, r.gene AS reference_gene, r.start_pos AS reference_position,
            abs(q.start_pos - r.start_pos) AS distance_bp,
            row_number() OVER (PARTITION BY q.chrom, q.start_pos ORDER BY abs(q.start_pos - r.start_pos), r.start_pos, r.gene) AS rn
          FROM q JOIN r ON q.chrom = r.chrom AND q.gene = r.gene AND abs(q.start_pos - r.start_pos) BETWEEN 1 AND 8) x
        WHERE rn = 1""",
        ctes=f"""r AS (SELECT DISTINCT chrom, gene, start_pos FROM variants WHERE {_REF}),
          q AS (SELECT chrom, gene, start_pos, min(variant_id) AS variant_id FROM variants GROUP BY ALL)""",
    ),
)
def c11_gene(spark, sf):
    return _closest(spark, sf, Reach(8, same_gene=True)).drop("relative_direction")


def _stats_sql(on: str, where: str = "", tail: str = "") -> str:
    return sql(
        f"""SELECT * FROM (SELECT r.chrom AS reference_chromosome, r.start_pos AS reference_position, r.gene AS reference_gene,
          r.n AS reference_variants, CAST(sum(q.n) AS BIGINT) AS nearby_count,
          round(sum(q.n * abs(q.start_pos - r.start_pos))::DOUBLE / sum(q.n), 2) AS avg_distance,
          min(abs(q.start_pos - r.start_pos)) AS min_distance, max(abs(q.start_pos - r.start_pos)) AS max_distance
        FROM r JOIN q ON q.chrom = r.chrom AND {on} GROUP BY ALL) s {where} {tail}""",
        ctes=f"""r AS (SELECT chrom, start_pos, min(gene) AS gene, count(*) AS n FROM variants WHERE {_REF} GROUP BY ALL),
          q AS (SELECT chrom, start_pos, count(*) AS n FROM variants GROUP BY ALL)""",
    )


_STATS_COLUMNS = [
    "reference_chromosome", "reference_position", "reference_gene", "reference_variants", "nearby_count",
    "avg_distance", "min_distance", "max_distance",
]


def _stats(spark, sf, reach):
    v = variants(spark, sf)
    return prox.neighbour_stats(_refs(v), v, reach, ROLES)


@query("d35_neighbour_stats", _stats_sql("abs(q.start_pos - r.start_pos) BETWEEN 1 AND 300"))
def d35(spark, sf):
    return prox.rounded_average(_stats(spark, sf, Reach(300))).select(*_STATS_COLUMNS)


@query("d35_neighbour_stats_beyond", _stats_sql("r.start_pos - q.start_pos >= 700"))
def d35_beyond(spark, sf):
    reach = Reach(700, "beyond", direction="upstream")
    return prox.rounded_average(_stats(spark, sf, reach)).select(*_STATS_COLUMNS)


@query(
    "d36_neighbour_having",
    _stats_sql("abs(q.start_pos - r.start_pos) <= 20", "WHERE nearby_count BETWEEN 5 AND 30 AND avg_distance <= 11"),
)
def d36(spark, sf):
    stats = prox.having(_stats(spark, sf, Reach(20, exclude_reference=False)), 5, 30, None, 11)
    return prox.rounded_average(stats).select(*_STATS_COLUMNS)


# Two genes at every position: the second copy of a variant belongs to gene 'H' + number.
_SHARED = f"""two AS (SELECT * FROM variants UNION ALL BY NAME SELECT * REPLACE (variant_id || '-h' AS variant_id,
    replace(gene, 'G', 'H') AS gene, start_pos + CAST(substr(gene, 2) AS BIGINT) % 3 AS start_pos) FROM variants),
  r2 AS (SELECT DISTINCT chrom, gene, start_pos FROM two WHERE replace(gene, 'H', 'G') IN ('G3', 'G25', 'G11')
    AND variant_class = 'Nonsense_Mutation' AND table_name = 'cohort_1')"""


def _shared(spark, sf):
    v = variants(spark, sf)
    moved = v.withColumn("start_pos", F.col("start_pos") + F.substring("gene", 2, 9).cast("bigint") % 3)
    moved = moved.withColumn("variant_id", F.concat("variant_id", F.lit("-h")))
    two = v.unionByName(moved.withColumn("gene", F.regexp_replace("gene", "G", "H")))
    g = F.regexp_replace("gene", "H", "G")
    refs = two.filter(
        g.isin("G3", "G25", "G11") & (F.col("variant_class") == "Nonsense_Mutation") & (F.col("table_name") == "cohort_1")
    )
    return refs, two


@query(
    "c11_same_gene_limited",
    sql(
        """SELECT reference_chromosome, reference_position, variant_id, gene, start_pos, distance_bp FROM (
          SELECT r.chrom AS reference_chromosome, r.start_pos AS reference_position, q.variant_id, q.gene, q.start_pos,
            abs(q.start_pos - r.start_pos) AS distance_bp,
            row_number() OVER (PARTITION BY r.chrom, r.start_pos ORDER BY abs(q.start_pos - r.start_pos), q.variant_id) AS rn
          FROM r2 r JOIN two q ON q.chrom = r.chrom AND q.gene = r.gene AND abs(q.start_pos - r.start_pos) BETWEEN 1 AND 20) x
        WHERE rn <= 3""",
        ctes=_SHARED,
    ),
)
def c11_gene_limited(spark, sf):
    refs, two = _shared(spark, sf)
    hits = prox.nearby_per_reference(refs, two, Reach(20, same_gene=True), 3, roles=ROLES)
    return hits.select("reference_chromosome", "reference_position", "variant_id", "gene", "start_pos", "distance_bp")


@query(
    "d35_same_gene",
    sql(
        """SELECT r.chrom AS reference_chromosome, r.start_pos AS reference_position, count(*) AS nearby_count,
          round(avg(abs(q.start_pos - r.start_pos)), 2) AS avg_distance, min(abs(q.start_pos - r.start_pos)) AS min_distance,
          max(abs(q.start_pos - r.start_pos)) AS max_distance
        FROM r2 r JOIN two q ON q.chrom = r.chrom AND q.gene = r.gene AND abs(q.start_pos - r.start_pos) BETWEEN 1 AND 40
        GROUP BY ALL""",
        ctes=_SHARED,
    ),
)
def d35_gene(spark, sf):
    refs, two = _shared(spark, sf)
    found = prox.rounded_average(prox.neighbour_stats(refs, two, Reach(40, same_gene=True), ROLES))
    return found.select(
        "reference_chromosome", "reference_position", "nearby_count", "avg_distance", "min_distance", "max_distance"
    )


@query(
    "c7_far_positions",
    sql(
        """SELECT variant_id, start_pos + 8000000000 AS start_pos, reference_position + 8000000000 AS reference_position,
          distance_bp FROM (
          SELECT q.chrom, q.start_pos, q.variant_id, r.start_pos AS reference_position, abs(q.start_pos - r.start_pos) AS distance_bp,
            row_number() OVER (PARTITION BY q.chrom, q.start_pos ORDER BY abs(q.start_pos - r.start_pos), r.start_pos) AS rn
          FROM q JOIN r ON q.chrom = r.chrom AND abs(q.start_pos - r.start_pos) BETWEEN 1 AND 6) x WHERE rn = 1""",
        ctes=f"""r AS (SELECT DISTINCT chrom, start_pos FROM variants WHERE {_REF}),
          q AS (SELECT chrom, start_pos, min(variant_id) AS variant_id FROM variants GROUP BY ALL)""",
    ),
)
def c7_far(spark, sf):
    v = variants(spark, sf).withColumn("start_pos", F.col("start_pos") + 8_000_000_000)
    hits = prox.closest_hits(_refs(v), v, Reach(6), roles=ROLES)
    return hits.select("variant_id", "start_pos", "reference_position", "distance_bp")


def _nearest_sql(on: str, order: str, k: int) -> str:
    return sql(
        f"""SELECT reference_chromosome, reference_position, reference_gene, variant_id, gene, start_pos, distance_bp FROM (
          SELECT r.chrom AS reference_chromosome, r.start_pos AS reference_position, r.gene AS reference_gene,
            q.variant_id, q.gene, q.start_pos, abs(q.start_pos - r.start_pos) AS distance_bp,
            row_number() OVER (PARTITION BY r.chrom, r.start_pos ORDER BY {order}, q.variant_id) AS rn
          FROM r JOIN variants q ON q.chrom = r.chrom AND {on}) x WHERE rn <= {k}""",
        ctes=f"r AS (SELECT chrom, start_pos, min(gene) AS gene FROM variants WHERE {_REF} GROUP BY ALL)",
    )


_NEAREST_COLUMNS = [
    "reference_chromosome", "reference_position", "reference_gene", "variant_id", "gene", "start_pos", "distance_bp",
]


@query(
    "e2_nearest_k",
    _nearest_sql("abs(q.start_pos - r.start_pos) BETWEEN 1 AND 60", "abs(q.start_pos - r.start_pos)", 4),
)
def e2(spark, sf):
    v = variants(spark, sf)
    return prox.nearby_per_reference(_refs(v), v, Reach(60), 4, roles=ROLES).select(*_NEAREST_COLUMNS)


@query(
    "e2_nearest_k_large",
    _nearest_sql("abs(q.start_pos - r.start_pos) BETWEEN 1 AND 900", "abs(q.start_pos - r.start_pos)", 1500),
)
def e2_large(spark, sf):
    v = variants(spark, sf)
    return prox.nearby_per_reference(_refs(v), v, Reach(900), 1500, roles=ROLES).select(*_NEAREST_COLUMNS)


@query(
    "e2_first_k_by_column",
    _nearest_sql("abs(q.start_pos - r.start_pos) BETWEEN 1 AND 60", "q.variant_class DESC", 3),
)
def e2_column(spark, sf):
    v = variants(spark, sf)
    hits = prox.nearby_per_reference(_refs(v), v, Reach(60), 3, by="variant_class", descending=True, roles=ROLES)
    return hits.select(*_NEAREST_COLUMNS)


@query(
    "e2_farthest_k",
    _nearest_sql("q.start_pos - r.start_pos BETWEEN 1 AND 60", "abs(q.start_pos - r.start_pos) DESC", 2),
)
def e2_far(spark, sf):
    v = variants(spark, sf)
    reach = Reach(60, direction="downstream")
    return prox.nearby_per_reference(_refs(v), v, reach, 2, descending=True, roles=ROLES).select(*_NEAREST_COLUMNS)


@query(
    "e3_closest_of_limited",
    sql(
        """SELECT variant_id, chrom, start_pos, reference_gene, reference_position, distance_bp FROM (
          SELECT *, row_number() OVER (PARTITION BY chrom, start_pos ORDER BY distance_bp, reference_position, reference_gene,
            variant_id) AS rn2 FROM (
          SELECT q.variant_id, q.chrom, q.start_pos, r.gene AS reference_gene, r.start_pos AS reference_position,
            abs(q.start_pos - r.start_pos) AS distance_bp,
            row_number() OVER (PARTITION BY r.chrom, r.start_pos ORDER BY abs(q.start_pos - r.start_pos), q.variant_id) AS rn
          FROM r JOIN variants q ON q.chrom = r.chrom AND abs(q.start_pos - r.start_pos) BETWEEN 1 AND 60) x WHERE rn <= 5) y
        WHERE rn2 = 1""",
        ctes=f"r AS (SELECT chrom, start_pos, min(gene) AS gene FROM variants WHERE {_REF} GROUP BY ALL)",
    ),
)
def e3(spark, sf):
    v = variants(spark, sf)
    hits = prox.nearby_per_reference(_refs(v), v, Reach(60), 5, roles=ROLES)
    return prox.distinct_closest(hits, ROLES).select(
        "variant_id", "chrom", "start_pos", "reference_gene", "reference_position", "distance_bp"
    )


@query(
    "f5_limited_references",
    sql(
        """SELECT r.chrom AS reference_chromosome, r.start_pos AS reference_position, CAST(sum(q.n) AS BIGINT) AS nearby_count
        FROM r JOIN q ON q.chrom = r.chrom AND abs(q.start_pos - r.start_pos) BETWEEN 1 AND 50 GROUP BY ALL""",
        ctes=f"""r AS (SELECT DISTINCT chrom, start_pos FROM (SELECT chrom, start_pos FROM variants WHERE {_REF}
            ORDER BY start_pos DESC, variant_id LIMIT 25) x),
          q AS (SELECT chrom, start_pos, count(*) AS n FROM variants GROUP BY ALL)""",
    ),
)
def f5(spark, sf):
    v = variants(spark, sf)
    refs = prox.references(_refs(v), sort_by="start_pos", descending=True, limit=25, roles=ROLES)
    return prox.neighbour_stats(refs, v, Reach(50), ROLES).select(
        "reference_chromosome", "reference_position", "nearby_count"
    )


@query(
    "f6_sorted_results",
    _stats_sql(
        "abs(q.start_pos - r.start_pos) BETWEEN 1 AND 100", "",
        "ORDER BY nearby_count DESC, reference_chromosome, reference_position LIMIT 30",
    ),
)
def f6(spark, sf):
    stats = prox.rounded_average(_stats(spark, sf, Reach(100))).select(*_STATS_COLUMNS)
    return sort_nulls_as_zero(stats, "nearby_count", ["reference_chromosome", "reference_position"], True, 30)


@query(
    "k4_proximity",
    sql(
        f"""SELECT reference_chromosome, reference_position, count(*) AS nearby_count, round(avg(distance_bp), 2) AS avg_distance,
          string_agg(variant_id, ',' ORDER BY distance_bp, variant_id) AS nearby FROM (
          SELECT r.chrom AS reference_chromosome, r.start_pos AS reference_position, q.variant_id,
            abs(q.start_pos - r.start_pos) AS distance_bp,
            row_number() OVER (PARTITION BY r.chrom, r.start_pos ORDER BY abs(q.start_pos - r.start_pos), q.variant_id) AS rn
          FROM r JOIN variants q ON q.chrom = r.chrom AND q.variant_class = 'Missense_Mutation'
            AND abs(q.start_pos - r.start_pos) BETWEEN 1 AND 100) x WHERE rn <= 6
        GROUP BY ALL HAVING count(*) >= 4""",
        ctes=f"r AS (SELECT DISTINCT chrom, start_pos FROM variants WHERE {_REF} AND chrom = 'chr4')",
    ),
)
def k4(spark, sf):
    v = variants(spark, sf)
    tree = {
        "conditions": [
            {"column": "gene", "operator": "in", "value": ["G3", "G25", "G11"]},
            {"column": "variant_class", "value": "Nonsense_Mutation"},
            {"column": "table_name", "value": "cohort_1"},
        ]
    }
    out = plans.proximity(
        v, tree, Reach(100), query_filters={"column": "variant_class", "value": "Missense_Mutation"},
        chromosome="4", aggregate_by_reference=True, max_nearby_per_reference=6, min_nearby=4, roles=ROLES,
    )
    ids = F.array_join(F.transform("nearby_variants", lambda r: r["variant_id"]), ",")
    return out.select("reference_chromosome", "reference_position", "nearby_count", "avg_distance", ids.alias("nearby"))


@query(
    "h3_distance_units",
    sql(
        """SELECT variant_id, start_pos - 999999 AS bp, round((start_pos - 999999) / 1000.0::DOUBLE, 3) AS kb,
        round((start_pos - 999999) / 1000000.0::DOUBLE, 6) AS mb, (start_pos - 999999) // 3 AS codon FROM variants"""
    ),
)
def h3(spark, sf):
    d = variants(spark, sf).select("variant_id", (F.col("start_pos") - 999999).alias("bp"))
    return d.select("variant_id", *[genomics.distance_in("bp", u).alias(u) for u in ("bp", "kb", "mb", "codon")])


@query(
    "h4_relative_direction",
    sql(
        """SELECT variant_id, CASE WHEN start_pos < 1240000 THEN 'upstream' WHEN start_pos > 1240000 THEN 'downstream'
        ELSE 'same' END AS side FROM variants"""
    ),
)
def h4(spark, sf):
    v = variants(spark, sf)
    return v.select("variant_id", genomics.relative_direction("start_pos", F.lit(1240000)).alias("side"))


@query("h5_text_to_int", "SELECT event_id, TRY_CAST(replace(props, '\"k\":', '') AS BIGINT) AS k FROM events WHERE TRY_CAST(replace(props, '\"k\":', '') AS BIGINT) IS NOT NULL UNION ALL SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) FROM events WHERE event_id % 2 = 0")
def h5(spark, sf):
    from varloom.functions.text import to_int
    from varloom.registry.fixtures import table

    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.regexp_extract("props", "([0-9]+)", 1)).otherwise(F.col("props"))
    out = e.select("event_id", to_int(raw).alias("k"))
    return out.filter(F.col("k").isNotNull())
