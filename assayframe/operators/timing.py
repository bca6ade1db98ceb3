"""Throughput samples, projections and comparisons of configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.numeric import round_half_even
from assayframe.functions.seeds import spread_key
from assayframe.operators.ordering import exact_median

DEFAULT_SAMPLE = 50
HEAVY_TAIL = 1.3


def hash_sample(rows: DataFrame, n: int = DEFAULT_SAMPLE, seed: int = 0, key: str = "ligand_id") -> DataFrame:
    """``n`` rows spread over the table, the same ones every time, in id order."""
    hashed = rows.withColumn("_h", spread_key(seed, F.col(key).cast("string")))
    return hashed.orderBy("_h", key).limit(n).drop("_h").orderBy(key)


def timing_stats(
    outcomes: DataFrame,
    keys: Sequence[str],
    elapsed: str = "elapsed_s",
    status: Column | None = None,
) -> DataFrame:
    """Counts, mean, exact median, maximum and tail ratio per configuration.

    Times are summed as decimals, so the mean does not depend on the order in
    which partitions arrive.
    """
    ok = (F.col("status") == "ok") if status is None else status
    total = F.sum(F.col(elapsed).cast("decimal(28,6)")).cast("double")
    basic = outcomes.groupBy(*keys).agg(
        F.count("*").alias("n_sampled"),
        F.count_if(ok).alias("n_ok"),
        (F.count("*") - F.count_if(ok)).alias("n_failed"),
        (total / F.count(elapsed)).alias("mean_s"),
        F.max(elapsed).alias("max_s"),
    )
    medians = exact_median(outcomes, keys, elapsed).select(
        *keys, F.col("median").alias("median_s")
    )
    zero = F.lit(0.0)
    return (
        basic.join(medians, list(keys), "left")
        .withColumn("mean_s", F.coalesce("mean_s", zero))
        .withColumn("max_s", F.coalesce("max_s", zero))
        .withColumn("median_s", F.coalesce("median_s", zero))
        .withColumn("tail_ratio", tail_ratio(F.col("mean_s"), F.col("median_s")))
    )


def tail_ratio(mean_s: Column, median_s: Column) -> Column:
    """Mean over median; 1 where there is no median."""
    return F.when(median_s == 0, F.lit(1.0)).otherwise(mean_s / median_s)


def projected_hours(mean_s: Column, n_ligands: int | Column, n_workers: int | Column) -> Column:
    """Hours for a whole library, scaled from the mean; 0 without workers."""
    n, w = F.lit(n_ligands), F.lit(n_workers)
    return F.when(w < 1, F.lit(0.0)).otherwise((mean_s * n) / w / 3600)


def projection_text(hours: Column) -> Column:
    """Hours below two days, days above."""
    return F.when(
        hours < 48, F.format_string("%.1f h", round_half_even(hours, 1))
    ).otherwise(F.format_string("%.1f d", round_half_even(hours / 24, 1)))


def compare_configurations(stats: DataFrame, n_ligands: int, n_workers: int) -> DataFrame:
    """Configurations with their projection, cheapest mean first."""
    hours = projected_hours(F.col("mean_s"), n_ligands, n_workers)
    return (
        stats.withColumn("projected_hours", hours)
        .withColumn("projected", projection_text(F.col("projected_hours")))
        .withColumn("heavy_tail", F.col("tail_ratio") > HEAVY_TAIL)
        .orderBy("mean_s")
    )


def heavy_tail_note(stats: DataFrame) -> DataFrame:
    """One row: how many configurations have a heavy tail, and the worst ratio."""
    heavy = F.col("tail_ratio") > HEAVY_TAIL
    return stats.agg(
        F.count_if(heavy).alias("n_heavy"),
        F.max(F.when(heavy, F.col("tail_ratio"))).alias("worst_ratio"),
    )
