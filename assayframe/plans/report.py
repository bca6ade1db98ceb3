"""The report job: journal and manifest in, ranked exports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators import hits
from assayframe.schemas import MANIFEST_SCHEMA
from assayframe.sources import manifest as M
from assayframe.sources.journal import read_journal


def empty_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST_SCHEMA)


def report(
    spark: SparkSession,
    journal_path: str,
    out_dir: str,
    manifest: DataFrame | None = None,
    group_variants: bool = True,
    latest_only: bool = False,
    ligand_dir: str | None = None,
) -> DataFrame:
    """Write ``results`` and ``all_modes`` and return the ranked rows.

    Without a manifest, the one in or above ``ligand_dir`` is looked up.

    Safe on a run in progress: it reports on the files committed so far.
    """
    journal = read_journal(spark, journal_path)
    if manifest is None and (found := M.find_manifest(spark, ligand_dir)):
        manifest = M.read_manifest(spark, found)
    described = empty_manifest(spark) if manifest is None else manifest
    ranked = hits.ranked_hits(journal, described, group_variants, latest_only)
    M.write_results(ranked, f"{out_dir}/results")
    M.write_all_modes(hits.all_modes(journal), f"{out_dir}/all_modes")
    return ranked


def head(ranked: DataFrame, top: int = 20) -> DataFrame:
    """The rows a report prints."""
    return ranked.where(F.col("rank") <= top).select(
        "rank", "compound_id", "best_affinity", "ligand_efficiency", "mw", "formula"
    ).orderBy("rank")
