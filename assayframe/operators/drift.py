"""Comparison with recorded values, and checks over a finished run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import scoring

TOLERANCE = 0.5


def compare_to_reference(
    reference: DataFrame, measured: DataFrame, key: str = "ligand_id", tolerance: float = TOLERANCE
) -> DataFrame:
    """Reference ids with expected and measured value, deviation and verdict.

    Verdicts: ``missing`` (not measured), ``drifted`` (off by more than the
    tolerance, either way), ``ok``.
    """
    joined = reference.select(key, "expected").join(measured.select(key, "affinity"), key, "left")
    deviation = F.abs(F.col("affinity") - F.col("expected"))
    verdict = (
        F.when(F.col("affinity").isNull(), "missing")
        .when(deviation > tolerance, "drifted")
        .otherwise("ok")
    )
    return joined.withColumn("deviation", deviation).withColumn("verdict", verdict)


def drift_summary(compared: DataFrame) -> DataFrame:
    """One row: counts by verdict, largest deviation, overall pass."""
    verdict = F.col("verdict")
    return compared.agg(
        F.count("*").alias("n_reference"),
        F.count_if(verdict == "missing").alias("n_missing"),
        F.count_if(verdict == "drifted").alias("n_drifted"),
        F.max("deviation").alias("largest_deviation"),
        ((F.count("*") > 0) & (F.count_if(verdict != "ok") == 0)).alias("passed"),
    )


def drifted_rows(compared: DataFrame) -> DataFrame:
    """Rows that drifted, as text with both values signed to two decimals."""
    def signed(c: Column) -> Column:
        return F.format_string("%+.2f", c)

    message = F.concat(
        F.lit("expected "), signed(F.col("expected")), F.lit(", got "), signed(F.col("affinity"))
    )
    return compared.where(F.col("verdict") == "drifted").withColumn("detail", message)


def _check(row: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    return row.select(
        F.lit(name).alias("name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        detail.alias("detail"),
    )


def run_checks(journal: DataFrame, n_expected: int, ranked: DataFrame) -> DataFrame:
    """Checks over a run as rows ``(name, passed, detail)``."""
    best = scoring.best_affinity(F.col("modes"))
    facts = journal.agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_distinct(F.when(best.isNotNull(), F.col("ligand_id"))).alias("scored"),
        F.count_if((F.size("modes") > 0) & ~scoring.modes_sorted(F.col("modes"))).alias("unsorted"),
    )
    rows = ranked.agg(F.count("*").alias("n"))

    def text(*parts: object) -> Column:
        return F.concat(
            *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
        )

    ok, failed, scored, unsorted = (F.col(c) for c in ("ok", "failed", "scored", "unsorted"))
    return (
        _check(facts, "nothing failed", (failed == 0) & (ok > 0),
               text(ok, " scored, ", failed, " failed"))
        .unionByName(_check(facts, "every ligand scored", scored == n_expected,
                            text(scored, f"/{n_expected}")))
        .unionByName(_check(facts, "best mode comes first", unsorted == 0,
                            text(unsorted, " out of order")))
        .unionByName(_check(rows, "results written", F.col("n") > 0,
                            text(F.col("n"), " ranked rows")))
    )


def reference_checks(compared: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The comparison as check rows; an empty reference fails."""
    summary = drift_summary(compared)
    n, missing = F.col("n_reference"), F.col("n_missing")
    return _check(
        summary, "all reference ligands scored", (n > 0) & (missing == 0),
        F.concat(missing.cast("string"), F.lit(" missing of "), n.cast("string")),
    ).unionByName(
        _check(
            summary, f"affinities within {tolerance} of reference", F.col("passed"),
            F.concat(F.lit("largest deviation "),
                     F.coalesce(F.format_string("%.2f", F.col("largest_deviation")), F.lit("-"))),
        )
    )
