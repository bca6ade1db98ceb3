"""Throughput statistics and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.catalog import standins as S
from assayframe.catalog.registry import query
from assayframe.operators import timing

_STATS = """
placed AS (
  SELECT o_orderpriority AS label, o_orderstatus, o_totalprice AS t,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn,
         count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
stats AS (
  SELECT label, count(*) AS n_sampled, count(*) FILTER (o_orderstatus <> 'F') AS n_ok, count(*) FILTER (o_orderstatus = 'F') AS n_failed,
         CAST(sum(CAST(t AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS mean_s, max(t) AS max_s,
         (max(CASE WHEN rn = (n + 1) // 2 THEN t END) + max(CASE WHEN rn = n // 2 + 1 THEN t END)) / 2 AS median_s
  FROM placed GROUP BY label),
rated AS (SELECT *, CASE WHEN median_s = 0 THEN 1 ELSE mean_s / median_s END AS tail_ratio FROM stats),
projected AS (SELECT *, mean_s * 47451 / 12 / 3600 AS projected_hours FROM rated)
"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("label"),
        F.col("o_totalprice").alias("elapsed_s"),
        F.col("o_orderstatus"),
    )
    ok: Column = F.col("o_orderstatus") != "F"
    return timing.timing_stats(orders, ["label"], status=ok)


@query(f"""
WITH {_STATS}
SELECT label, n_sampled, n_ok, n_failed, mean_s, max_s, median_s, tail_ratio FROM rated
""")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, exact median, maximum and tail ratio per configuration."""
    return _stats(spark, sf_dir)


@query(f"""
WITH {_STATS}
SELECT label, projected_hours,
       CASE WHEN projected_hours < 48 THEN printf('%.1f h', projected_hours) ELSE printf('%.1f d', projected_hours / 24) END AS projected
FROM projected
""")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours a whole library would take."""
    return timing.compare_configurations(_stats(spark, sf_dir), 47451, 12).select(
        "label", "projected_hours", "projected"
    )


@query(f"""
WITH {_STATS}
SELECT label, median_s, mean_s, max_s, projected_hours, tail_ratio > CAST(1.3 AS DOUBLE) AS heavy_tail FROM projected
""")
def config_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations side by side, cheapest mean first."""
    return timing.compare_configurations(_stats(spark, sf_dir), 47451, 12).select(
        "label", "median_s", "mean_s", "max_s", "projected_hours", "heavy_tail"
    )


@query("""
WITH placed AS (
  SELECT l_returnflag, l_shipdate, l_extendedprice * l_discount AS t FROM lineitem),
ranked AS (
  SELECT l_returnflag, t, row_number() OVER (PARTITION BY l_returnflag ORDER BY t) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM placed),
medians AS (
  SELECT l_returnflag, (max(CASE WHEN rn = (n + 1) // 2 THEN t END) + max(CASE WHEN rn = n // 2 + 1 THEN t END)) / 2 AS median_s, max(t) AS top,
         CAST(sum(CAST(t AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS mean_s FROM ranked GROUP BY l_returnflag)
SELECT count(*) FILTER (mean_s / median_s > CAST(1.3 AS DOUBLE)) AS n_heavy,
       max(CASE WHEN mean_s / median_s > CAST(1.3 AS DOUBLE) THEN mean_s / median_s END) AS worst_ratio
FROM medians
""")
def heavy_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a minority of slow rows drives the mean."""
    lines = S.table(spark, sf_dir, "lineitem").select(
        "l_returnflag", (F.col("l_extendedprice") * F.col("l_discount")).alias("elapsed_s")
    )
    stats = timing.timing_stats(lines, ["l_returnflag"], status=F.lit(True))
    return timing.heavy_tail_note(stats)
