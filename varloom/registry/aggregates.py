"""Checked queries for aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions.stats import rounded
from varloom.operators import aggregate as agg
from varloom.operators import sketches
from varloom.registry.core import query
from varloom.registry.fixtures import ROLES, sql, table, variants


def _leaf(column, operator, value):
    return {"column": column, "operator": operator, "value": value}


@query("d1_sum", "SELECT l_returnflag, sum(l_quantity) AS aggregated_value FROM lineitem GROUP BY l_returnflag")
def d1(spark, sf):
    return agg.aggregate(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"], "sum")


@query("d1_sum_scalar", "SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS value FROM part WHERE p_size > 1000000")
def d1_scalar(spark, sf):
    return agg.aggregate(table(spark, sf, "part"), "p_size", None, "sum", filters=_leaf("p_size", "gt", 1000000))


@query(
    "d1_sum_of_text",
    "SELECT sum(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) AS aggregated_value, o_orderstatus FROM orders GROUP BY o_orderstatus",
)
def d1_text(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("level"))
    return agg.aggregate(o, "level", ["o_orderstatus"], "sum")


@query("d2_avg", "SELECT event_type, round(avg(value), 6) AS aggregated_value FROM events GROUP BY event_type")
def d2(spark, sf):
    out = agg.aggregate(table(spark, sf, "events"), "value", ["event_type"], "avg")
    return out.withColumn("aggregated_value", rounded(F.col("aggregated_value"), 6))


@query("d3_min", "SELECT o_orderpriority, min(o_totalprice) AS aggregated_value FROM orders GROUP BY o_orderpriority")
def d3(spark, sf):
    return agg.aggregate(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"], "min")


@query("d4_max", "SELECT p_brand, max(p_name) AS aggregated_value FROM part GROUP BY p_brand")
def d4(spark, sf):
    return agg.aggregate(table(spark, sf, "part"), "p_name", ["p_brand"], "max")


@query(
    "d5_count",
    "SELECT event_type, count(CASE WHEN event_id % 3 > 0 THEN value END) AS aggregated_value FROM events GROUP BY event_type",
)
def d5(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"))
    return agg.aggregate(e, "v", ["event_type"], "count")


@query(
    "d6_distinct_count",
    sql("SELECT gene, count(DISTINCT tumor_sample_barcode) AS aggregated_value FROM variants GROUP BY gene"),
)
def d6(spark, sf):
    return agg.aggregate(variants(spark, sf), "tumor_sample_barcode", ["gene"], "distinct_count")


@query(
    "d7_percentage_scalar",
    """SELECT round(count(CASE WHEN event_id % 3 > 0 AND event_type = 'click' THEN value END)::DOUBLE
       / count(CASE WHEN event_id % 3 > 0 THEN value END) * 100, 2) AS value FROM events""",
)
def d7(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"))
    return agg.aggregate(e, "v", None, "percentage", filters=_leaf("event_type", "eq", "click"))


@query(
    "d8_percentage_global",
    """SELECT o_orderpriority, round(count(o_orderkey) * 100.0::DOUBLE / (SELECT count(*) FROM orders WHERE o_orderstatus = 'O'), 2)
       AS aggregated_value, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS group_total
       FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority""",
)
def d8(spark, sf):
    return agg.aggregate(
        table(spark, sf, "orders"), "o_orderkey", ["o_orderpriority"], "percentage",
        filters=_leaf("o_orderstatus", "eq", "O"),
    )


@query(
    "d9_percentage_within",
    sql(
        """SELECT table_name, variant_class, round(n * 100.0::DOUBLE / t, 2) AS aggregated_value, t AS group_total FROM (
        SELECT table_name, variant_class, count(gene) AS n,
          CAST(sum(count(gene)) OVER (PARTITION BY table_name) AS BIGINT) AS t
        FROM variants GROUP BY table_name, variant_class) x"""
    ),
)
def d9(spark, sf):
    return agg.aggregate(
        variants(spark, sf), "gene", ["table_name", "variant_class"], "percentage", percentage_by=["table_name"]
    )


@query(
    "d10_group_totals",
    """SELECT DISTINCT l_shipyear, CAST(sum(count(*)) OVER (PARTITION BY l_shipyear) AS BIGINT) AS group_total FROM (
       SELECT year(l_shipdate) AS l_shipyear, l_returnflag FROM lineitem) x GROUP BY l_shipyear, l_returnflag""",
)
def d10(spark, sf):
    line = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("l_shipyear"), "l_returnflag")
    out = agg.aggregate(
        line, "l_shipyear", ["l_shipyear", "l_returnflag"], "percentage", percentage_by=["l_shipyear"]
    )
    return out.select("l_shipyear", "group_total").distinct()


@query(
    "d11_summary",
    sql(
        """SELECT (SELECT count(*) FROM variants WHERE variant_type = 'SNP') AS total_records,
        count(*) AS groups_before_having, count(*) FILTER (n > 90) AS groups_after_having FROM (
        SELECT gene, disease, count(variant_id) AS n FROM variants WHERE variant_type = 'SNP' GROUP BY gene, disease) x"""
    ),
)
def d11(spark, sf):
    return agg.summary(
        variants(spark, sf), "variant_id", ["gene", "disease"], "count", filters=_leaf("variant_type", "eq", "SNP"),
        having={"operator": "gt", "value": 90},
    )


@query(
    "d12_having_tree",
    sql(
        """SELECT gene, variant_class, count(variant_id) AS aggregated_value FROM variants GROUP BY gene, variant_class
        HAVING (count(variant_id) >= 100 AND count(variant_id) <= 250) OR (count(variant_id) > 300 AND count(variant_id) <> 305)"""
    ),
)
def d12(spark, sf):
    tree = {
        "logic": "OR",
        "conditions": [
            {"logic": "AND", "conditions": [{"operator": "gte", "value": 100}, {"operator": "lte", "value": 250}]},
            {"logic": "AND", "conditions": [{"operator": "gt", "value": 300}, {"operator": "neq", "value": 305}]},
        ],
    }
    return agg.aggregate(variants(spark, sf), "variant_id", ["gene", "variant_class"], "count", having=tree)


@query(
    "d14_many_columns",
    """SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, count(l_partkey) AS aggregated_value FROM lineitem
       GROUP BY l_returnflag, l_linestatus, l_linenumber, l_suppkey""",
)
def d14(spark, sf):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]
    return agg.aggregate(table(spark, sf, "lineitem"), "l_partkey", keys, "count")


@query(
    "d15_combination",
    sql(
        """SELECT gene, chrom, variant_class, aggregated_value, group_total, gene || '|' || variant_class AS label,
        chrom || gene AS place FROM (
          SELECT gene, chrom, variant_class, round(n * 100.0::DOUBLE / t, 2) AS aggregated_value, t AS group_total, n * 100.0::DOUBLE / t AS raw
          FROM (SELECT gene, chrom, variant_class, count(variant_id) AS n,
            CAST(sum(count(variant_id)) OVER (PARTITION BY gene, chrom) AS BIGINT) AS t
            FROM variants GROUP BY gene, chrom, variant_class) a) b
        WHERE raw > 5 ORDER BY raw DESC, gene, chrom, variant_class LIMIT 40"""
    ),
)
def d15(spark, sf):
    return agg.combination_aggregate(
        variants(spark, sf), "variant_id", ["gene", "chrom", "variant_class"], "percentage",
        percentage_by=["gene", "chrom"],
        computed=[
            {"name": "label", "columns": ["gene", "variant_class"], "separator": "|"},
            {"name": "place", "columns": ["chrom", "gene"]},
        ],
        having={"operator": "gt", "value": 5}, order_by="aggregated_value", limit=40,
    )


@query(
    "d16_concat_grouped_percent",
    sql(
        """SELECT disease, concatenated_value, round(n * 1.0::DOUBLE / t * 100, 2) AS aggregated_value, t AS group_total FROM (
        SELECT disease, gene || '_' || variant_type AS concatenated_value, count(*) AS n,
          CAST(sum(count(*)) OVER (PARTITION BY disease) AS BIGINT) AS t
        FROM variants GROUP BY disease, gene || '_' || variant_type) x WHERE n > 20"""
    ),
)
def d16(spark, sf):
    return agg.concat_aggregate(
        variants(spark, sf), ["gene", "variant_type"], "_", ["disease"], "percentage", percentage_by=["disease"],
        having={"operator": "gt", "value": 20},
    )


@query(
    "d16_concat_grouped_count",
    """SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) || '/' || l_linestatus AS concatenated_value, count(*) AS aggregated_value
       FROM lineitem GROUP BY ALL""",
)
def d16_count(spark, sf):
    return agg.concat_aggregate(table(spark, sf, "lineitem"), ["l_linenumber", "l_linestatus"], "/", ["l_returnflag"])


@query(
    "d17_concat_distinct_grouped",
    sql("SELECT gene, count(DISTINCT chrom || ':' || protein_change) AS aggregated_value FROM variants GROUP BY gene"),
)
def d17(spark, sf):
    return agg.concat_aggregate(variants(spark, sf), ["chrom", "protein_change"], ":", ["gene"], "distinct_count")


@query(
    "d17_concat_distinct_overall",
    sql("SELECT count(DISTINCT tumor_sample_barcode || ':' || gene) AS value FROM variants"),
)
def d17_overall(spark, sf):
    return agg.concat_aggregate(variants(spark, sf), ["tumor_sample_barcode", "gene"], ":", None, "distinct_count")


@query(
    "d18_concat_distribution",
    sql(
        """SELECT concatenated_value, round(n * 1.0::DOUBLE / t * 100, 2) AS aggregated_value, t AS group_total FROM (
        SELECT variant_type || '-' || variant_class AS concatenated_value, count(*) AS n, (SELECT count(*) FROM variants) AS t
        FROM variants GROUP BY variant_type || '-' || variant_class) x"""
    ),
)
def d18(spark, sf):
    return agg.concat_aggregate(variants(spark, sf), ["variant_type", "variant_class"], "-", None, "percentage")


@query(
    "e1_sum_of_counts",
    """SELECT event_type, user_id, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY event_type) AS BIGINT) AS total
       FROM events GROUP BY event_type, user_id""",
)
def e1(spark, sf):
    groups = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return agg.partition_total(groups, ["event_type"], "n", "total")


@query(
    "f3_order_groups",
    """SELECT p_brand, p_type, aggregated_value FROM (SELECT p_brand, p_type, count(p_partkey) AS aggregated_value FROM part
       GROUP BY p_brand, p_type) x ORDER BY aggregated_value DESC, p_brand DESC, p_type LIMIT 1000000""",
)
def f3(spark, sf):
    return agg.aggregate(
        table(spark, sf, "part"), "p_partkey", ["p_brand", "p_type"], "count", order_by=["aggregated_value", "p_brand"]
    )


@query(
    "f4_top_groups",
    """SELECT l_suppkey, sum(l_quantity) AS aggregated_value FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 100
       ORDER BY sum(l_quantity) DESC, l_suppkey LIMIT 10""",
)
def f4(spark, sf):
    return agg.aggregate(
        table(spark, sf, "lineitem"), "l_quantity", ["l_suppkey"], "sum", having={"operator": "gt", "value": 100},
        order_by="aggregated_value", limit=10,
    )


@query(
    "k2_aggregate",
    sql(
        """SELECT gene, avg_start AS aggregated_value FROM (SELECT gene, round(avg(start_pos), 3) AS avg_start, avg(start_pos) AS raw
        FROM variants WHERE variant_class <> 'Silent' AND disease ILIKE '%build%' GROUP BY gene) x
        WHERE raw BETWEEN 1100000 AND 1300000"""
    ),
)
def k2(spark, sf):
    out = agg.aggregate(
        variants(spark, sf), "start_pos", ["gene"], "avg",
        filters={"conditions": [_leaf("variant_class", "neq", "Silent"), _leaf("disease", "like", "build")]},
        having={"conditions": [{"operator": "gte", "value": 1100000}, {"operator": "lte", "value": 1300000}]},
        order_by="aggregated_value",
    )
    return out.withColumn("aggregated_value", rounded(F.col("aggregated_value"), 3))


@query(
    "k3_combination_count",
    sql(
        """SELECT disease, variant_type, count(DISTINCT gene) AS aggregated_value, disease || ' ' || variant_type AS label
        FROM variants WHERE table_name = 'cohort_1' GROUP BY disease, variant_type"""
    ),
)
def k3(spark, sf):
    return agg.combination_aggregate(
        variants(spark, sf), "gene", ["disease", "variant_type"], "distinct_count",
        computed=[{"name": "label", "columns": ["disease", "variant_type"], "separator": " "}],
        filters=_leaf("table_name", "eq", "cohort_1"),
    )


@query("d6_merged_sketches", sql(
    """SELECT gene, count(*) AS "rows", count(DISTINCT tumor_sample_barcode) AS tumor_sample_barcode FROM variants
    WHERE table_name IN ('cohort_0', 'cohort_2') GROUP BY gene"""
))
def d6_sketches(spark, sf):
    """Counts of two cohorts together, from the sketches of all; exact at this number of values."""
    stored = sketches.distinct_sketches(variants(spark, sf), ["tumor_sample_barcode"], ["gene"], ROLES)
    return sketches.approximate_totals(stored, ["tumor_sample_barcode"], ["cohort_0", "cohort_2"], ["gene"], ROLES)
