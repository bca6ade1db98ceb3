"""The regression check: a finished run against recorded values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions import scoring
from assayframe.functions.numeric import round_half_even
from assayframe.operators import drift
from assayframe.sources.runs import write_reference


def measured_values(journal: DataFrame) -> DataFrame:
    """Best affinity per scored ligand to two decimals; the last record counts."""
    best = round_half_even(scoring.best_affinity(F.col("modes")), 2)
    scored = journal.withColumn("affinity", best).where("affinity is not null")
    return scored.groupBy("ligand_id").agg(F.max_by("affinity", "ordinal").alias("affinity"))


def affinity_listing(journal: DataFrame) -> DataFrame:
    """Scored ligands, best first: ``ligand_id``, ``affinity`` and the ``line`` to show."""
    values = measured_values(journal)
    line = F.format_string("%-28s %+.2f kcal/mol", "ligand_id", "affinity")
    return values.select("ligand_id", "affinity", line.alias("line")).orderBy("affinity", "ligand_id")


def regression_check(
    journal: DataFrame, ranked: DataFrame, reference: DataFrame, n_expected: int
) -> DataFrame:
    """Checks over the run, then the comparison, as ``(name, passed, detail)``."""
    compared = drift.compare_to_reference(reference, measured_values(journal))
    return drift.run_checks(journal, n_expected, ranked).unionByName(
        drift.reference_checks(compared)
    )


def record_reference(journal: DataFrame, path: str, settings: dict[str, Any]) -> None:
    """Record the run's values; a separate call, never done by the check."""
    write_reference(measured_values(journal), path, settings)
