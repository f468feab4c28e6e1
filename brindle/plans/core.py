"""The queries of the driver's smoke slice: plain DataFrame plans over the star schema.

Sums of money are taken over decimals, so that their order doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities, discounted prices and counts of the lines shipped up to a day, by flag and status."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        F.round(F.sum(price).cast("double"), 2).alias("sum_disc_price"),
        F.round(F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double") / F.count("*"), 6).alias("avg_disc"),
        F.count("*").alias("n_lines"),
    )


PRICING_SUMMARY = """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
  round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE), 2) AS sum_disc_price,
  round(CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS avg_disc, count(*) AS n_lines
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pricing_summary": pricing_summary}


def oracle_sql() -> dict[str, str]:
    return {"pricing_summary": PRICING_SUMMARY}
