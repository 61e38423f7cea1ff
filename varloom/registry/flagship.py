"""The flagship query: filter, group, percentage in a partition, HAVING, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.operators.aggregate import aggregate
from varloom.registry.core import query
from varloom.registry.fixtures import table


@query(
    "flagship_status_share",
    """
    SELECT l_returnflag, l_linestatus, round(100.0::DOUBLE * n / total, 2) AS aggregated_value,
      CAST(total AS BIGINT) AS group_total
    FROM (SELECT l_returnflag, l_linestatus, count(l_orderkey) AS n,
        sum(count(l_orderkey)) OVER (PARTITION BY l_returnflag) AS total
      FROM lineitem WHERE l_quantity >= 5 AND (l_discount < 0.05 OR l_tax > 0.02)
      GROUP BY l_returnflag, l_linestatus) g
    WHERE 100.0::DOUBLE * n / total > 10
    """,
)
def shares_over_ten_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(
        table(spark, sf_dir, "lineitem"),
        "l_orderkey",
        group_by=["l_returnflag", "l_linestatus"],
        aggregation="percentage",
        percentage_by=["l_returnflag"],
        filters={
            "logic": "AND",
            "conditions": [
                {"column": "l_quantity", "operator": "gte", "value": 5},
                {
                    "logic": "OR",
                    "conditions": [
                        {"column": "l_discount", "operator": "lt", "value": 0.05},
                        {"column": "l_tax", "operator": "gt", "value": 0.02},
                    ],
                },
            ],
        },
        having={"operator": "gt", "value": 10},
        order_by="aggregated_value",
    )
