"""The receptor check over many files, and pseudo-atom placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators import composition, metalsites, spatial
from assayframe.sources import structures


def check_receptors(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One report row per file, also for files without a single atom."""
    atoms = structures.read_receptors(spark, path)
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return composition.receptor_report(atoms, files.select(F.col("_metadata.file_path").alias("receptor_id")))


def site_boxes(
    atoms: DataFrame, sites: DataFrame, padding: float = 5.0, cubic: bool = False,
    sidechains_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Boxes around requested residues, and the residues that are missing.

    Receptors with a missing residue get no box: a mistyped number would shrink
    it unnoticed.
    """
    missing = composition.missing_residues(sites, atoms)
    chosen = composition.select_sites(atoms, sites, sidechains_only)
    whole = chosen.join(missing.select("receptor_id").distinct(), "receptor_id", "left_anti")
    return spatial.boxes_from_points(whole, ["receptor_id"], padding, cubic), missing


def add_zinc_pseudo_atoms(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms with pseudo-atoms, and a summary naming receptors without a site."""
    placed = metalsites.with_zinc_pseudo_atoms(atoms)
    return placed, metalsites.zinc_summary(atoms, placed)
