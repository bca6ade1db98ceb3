"""Expressions over journal records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayframe.functions.numeric import round_half_even


def best_affinity(modes: Column) -> Column:
    """Lowest affinity over all modes, null without modes."""
    return F.array_min(F.transform(modes, lambda m: m["affinity"]))


def mode_count(modes: Column) -> Column:
    return F.when(modes.isNull(), F.lit(0)).otherwise(F.size(modes))


def modes_sorted(modes: Column) -> Column:
    """Whether the modes are listed best first."""
    affinities = F.transform(modes, lambda m: m["affinity"])
    return affinities == F.array_sort(affinities)


def ligand_efficiency(affinity: Column, heavy_atoms: Column) -> Column:
    """Affinity per heavy atom to four decimals, null if either is missing."""
    per_atom = affinity / F.when(heavy_atoms != 0, heavy_atoms).cast("double")
    return round_half_even(per_atom, 4)


def is_retryable(error_kind: Column) -> Column:
    """True for failures of the set-up; a null kind counts as done."""
    return error_kind.eqNullSafe(F.lit("setup"))


def with_record_defaults(modes: Column) -> Column:
    """Fill absent RMSD values of a mode array with zero."""
    return F.transform(
        modes,
        lambda m: F.struct(
            m["mode"].alias("mode"),
            m["affinity"].alias("affinity"),
            F.coalesce(m["rmsd_lb"], F.lit(0.0)).alias("rmsd_lb"),
            F.coalesce(m["rmsd_ub"], F.lit(0.0)).alias("rmsd_ub"),
        ),
    )


def remaining(total: Column, done: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), total - done)


def fraction_done(total: Column, done: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(done / total)


def rate_per_s(done: Column, started_at: Column, updated_at: Column) -> Column:
    """Rows per second; null before progress or without elapsed time."""
    elapsed = updated_at - started_at
    started = started_at.isNotNull() & (started_at != 0)
    return F.when(started & (done != 0) & (elapsed > 0), done / elapsed)


def eta_s(total: Column, done: Column, rate: Column) -> Column:
    left = remaining(total, done)
    return F.when((rate > 0) & (left > 0), left / rate)
