"""Synthetic runs: seeded, independent of partitioning.

Every number is a hash of the seed, the row and a draw name, so any number of
executors writes the same run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.numeric import round_half_even
from assayframe.functions.seeds import uniform
from assayframe.functions.text import bind
from assayframe.schemas import JOURNAL_SCHEMA

# Shape of a plausible run.
AFFINITY_MEAN, AFFINITY_SD = -6.5, 1.4
FAILURE_RATE = 0.02
INCOMPLETE_SHARE = 0.6


def _normal(seed: int, key: Column, draw: str) -> Column:
    """Standard normal draw (Box-Muller on two hashed uniforms)."""
    u, v = uniform(seed, key, draw + "/u"), uniform(seed, key, draw + "/v")
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)


def _modes(seed: int, key: Column, n_modes: int) -> Column:
    """Modes that worsen step by step, with deviations drifting up."""
    best = F.lit(AFFINITY_MEAN) + F.lit(AFFINITY_SD) * _normal(seed, key, "best")

    def draws(i: Column) -> Column:
        cell = F.struct(key, i)
        later = (i > 1).cast("double")
        lower = F.round(later * F.abs(2.0 + _normal(seed, cell, "lb")), 3)
        return F.struct(
            i.alias("mode"),
            (later * F.abs(0.15 + 0.12 * _normal(seed, cell, "step"))).alias("step"),
            lower.alias("lb"),
            (later * F.abs(1.5 + _normal(seed, cell, "ub"))).alias("gap"),
        )

    drawn = F.transform(F.sequence(F.lit(1), F.lit(n_modes)), draws)
    rows = F.struct(best.alias("best"), drawn.alias("drawn"))

    def mode(all_rows: Column, d: Column) -> Column:
        walked = F.aggregate(
            F.slice(all_rows["drawn"], F.lit(1), d["mode"]), F.lit(0.0), lambda acc, e: acc + e["step"]
        )
        return F.struct(
            d["mode"].alias("mode"),
            F.round(all_rows["best"] + walked, 1).alias("affinity"),
            d["lb"].alias("rmsd_lb"),
            F.round(d["lb"] + d["gap"], 3).alias("rmsd_ub"),
        )

    return bind(rows, lambda r: F.transform(r["drawn"], lambda d: mode(r, d)))


def synthetic_journal(
    spark: SparkSession,
    n_ligands: int,
    seed: int = 0,
    failure_rate: float = FAILURE_RATE,
    n_modes: int = 9,
    run_id: str = "synthetic",
    id_prefix: str = "LIG",
    complete: bool = True,
) -> DataFrame:
    """Journal rows of a made-up run; an incomplete one stops at 60 %."""
    written = n_ligands if complete else max(1, int(n_ligands * INCOMPLETE_SHARE))
    key = F.col("id")
    failed = uniform(seed, key, "failed") < failure_rate
    none = F.array().cast(JOURNAL_SCHEMA["modes"].dataType)
    short = 0.1 + 0.4 * uniform(seed, key, "elapsed")
    long = 1.5 + 23.5 * uniform(seed, key, "elapsed")
    return spark.range(written).select(
        F.lit(run_id).alias("run_id"),
        F.concat(F.lit(id_prefix), (key + 1).cast("string")).alias("ligand_id"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.floor(uniform(seed, key, "seed") * 2147483648).alias("seed"),
        round_half_even(F.when(failed, short).otherwise(long), 3).alias("elapsed_s"),
        key.cast("double").alias("timestamp"),
        F.when(failed, none).otherwise(_modes(seed, key, n_modes)).alias("modes"),
        F.when(failed, "synthetic failure: no poses returned").alias("error"),
        F.lit(None).cast("string").alias("error_kind"),
        key.alias("ordinal"),
    )
