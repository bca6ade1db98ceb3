"""The prepare job: library in, prepared ligands with descriptors out."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from assayframe.operators import batchmap, digests, progress
from assayframe.schemas import DESCRIPTOR_SCHEMA, MANIFEST_COLUMNS, PrepConfig
from assayframe.session import materialize, path_exists
from assayframe.sources import runs
from assayframe.sources.manifest import last_wins
from assayframe.streaming.journal_stream import scratch_folder

_DESCRIPTORS = tuple(DESCRIPTOR_SCHEMA.fieldNames())


def prepared_table(spark: SparkSession, out_dir: str, name: str) -> DataFrame | None:
    """A table of the output folder, or None before the first run.

    Of the manifest rows that resumed runs added for one id, the last counts.
    """
    path = f"{out_dir}/{name}"
    if not path_exists(spark, path):
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if name == "manifest" and "committed_at" in rows.columns:
        return last_wins(rows, "ligand_id", "committed_at").drop("committed_at")
    return rows


def done_ids(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """Prepared ids whose every file is there."""
    manifest = prepared_table(spark, out_dir, "manifest")
    ligands = prepared_table(spark, out_dir, "ligands")
    if manifest is None or ligands is None:
        return None
    return digests.fully_present(manifest, ligands)


def given_up_ids(spark: SparkSession, out_dir: str, retry: str) -> DataFrame | None:
    """Ids whose earlier failure stands under a retry policy, as ``progress.finished_ids`` has it."""
    if retry not in progress.RETRY_POLICIES:
        raise ValueError(f"unknown retry policy {retry!r}; expected one of {progress.RETRY_POLICIES}")
    failures = prepared_table(spark, out_dir, "failures")
    if failures is None or retry == "all":
        return None
    if "error_kind" not in failures.columns:
        failures = failures.withColumn("error_kind", F.lit(None).cast("string"))
    return progress.finished_ids(failures.withColumn("status", F.lit("failed")), retry)


def prepare(
    spark: SparkSession,
    library: DataFrame,
    out_dir: str,
    describe: Sequence[batchmap.Stage],
    build: Sequence[batchmap.Stage],
    config: PrepConfig | None = None,
    fallbacks: dict[str, Callable[..., Any]] | None = None,
    limit: int | None = None,
    resume: bool = True,
    retry: str = "all",
) -> DataFrame:
    """Prepare a library and return the summary row.

    ``describe`` stages run first and must yield the descriptors; the torsion
    limit then rejects rows before the expensive ``build`` stages, whose last
    one yields ``texts``, ``torsions`` and ``prepared_charge``. Each phase is
    written once and read back, so no user function runs twice. Outcomes are
    appended to ``manifest``, ``failures`` and ``ligands`` below ``out_dir``.

    A resumed run tries failures again by ``retry``: ``all`` of them, ``setup_only``
    those that blamed the run, or ``never``. Failures left alone count as skipped.
    Rows prepared and failed are counted by the tasks that write them, not again.
    """
    config = config or PrepConfig()
    settings = config.to_dict()
    started = time.time()
    work_dir = scratch_folder(spark, "prepare")
    considered = progress.scan_limited(library, limit, "ordinal")
    finished = None
    if resume:
        for ids in (done_ids(spark, out_dir), given_up_ids(spark, out_dir, retry)):
            if ids is not None:
                finished = ids if finished is None else finished.union(ids).distinct()
        if finished is not None:
            # What this run appends must not change what it skipped.
            finished = materialize(finished)
    work = considered if finished is None else progress.todo(considered, finished)

    described_path = f"{work_dir}/described"
    keep = ("block", "fmt")
    batchmap.run_stages(work, describe, settings, fallbacks, keep).write.parquet(described_path)
    described = spark.read.parquet(described_path)
    usable, rejected = batchmap.reject_over_limit(
        described.where("outcome = 'ok'"), "rot_bonds", config.max_torsions
    )
    built_path = f"{work_dir}/built"
    batchmap.run_stages(
        usable.drop("outcome", "stage", "error", "error_kind", "texts"), build, settings, fallbacks
    ).write.parquet(built_path)
    built = spark.read.parquet(built_path)

    n_conformers = max(1, config.n_conformers)
    suffix = (lambda i: F.lit("")) if n_conformers == 1 else (
        lambda i: F.concat(F.lit("_c"), (i + 1).cast("string"))
    )
    files = F.transform("texts", lambda t, i: F.concat("ligand_id", suffix(i), F.lit(".pdbqt")))
    good = built.where("outcome = 'ok'").withColumn("pdbqt", files)
    ligands = good.select(
        "ligand_id", "compound_id", F.posexplode(F.arrays_zip("pdbqt", "texts")).alias("_i", "_f")
    ).select(
        "ligand_id", "compound_id", (F.col("_i") + 1).alias("conformer"),
        F.col("_f.pdbqt").alias("file_name"), F.col("_f.texts").alias("text"),
    )
    manifest = good.withColumn("n_conformers", F.size("texts")).select(*MANIFEST_COLUMNS)
    failure_columns = ("ligand_id", "compound_id", "stage", "error", "error_kind")
    failures = (
        described.where("outcome = 'failed'").select(*failure_columns)
        .unionByName(rejected.withColumn("error_kind", F.lit("ligand")).select(*failure_columns))
        .unionByName(built.where("outcome = 'failed'").select(*failure_columns))
    )
    # Files before the manifest: a row counts as done only if its files exist.
    ligands.write.mode("append").parquet(f"{out_dir}/ligands")
    n_prepared = _append_counted(
        manifest.withColumn("committed_at", F.lit(time.time_ns())), f"{out_dir}/manifest"
    )
    n_failed = _append_counted(failures, f"{out_dir}/failures")

    summary = prep_summary(library, finished, n_prepared, n_failed, limit, time.time() - started)
    runs.write_metadata(spark, f"{out_dir}/prep", {"config": settings, "limit": limit})
    return summary


def _append_counted(rows: DataFrame, path: str) -> int:
    """Append rows and say how many there were.

    ``rows`` must come from a scan without a shuffle: only the tasks that write are
    counted once each whatever is lost and repeated.
    """
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def prep_summary(
    library: DataFrame,
    finished: DataFrame | None,
    prepared: int,
    failed: int,
    limit: int | None,
    elapsed_s: float,
) -> DataFrame:
    """One row: total, prepared, failed, skipped, seconds and rate."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    skipped = count(finished, "skipped") if finished is not None else count(
        library.limit(0), "skipped"
    )
    records = F.col("records")
    bound = records if limit is None else F.least(F.lit(limit) + F.col("skipped"), records)
    row = count(library, "records").select(
        "records",
        F.lit(prepared).cast("bigint").alias("prepared"),
        F.lit(failed).cast("bigint").alias("failed"),
        skipped.scalar().alias("skipped"),
    )
    done = F.col("prepared") + F.col("failed")
    rate = done / F.lit(elapsed_s) if elapsed_s > 0 else F.lit(0.0)
    return row.select(
        bound.alias("total"), "prepared", "failed", "skipped",
        F.lit(float(elapsed_s)).alias("elapsed_s"), rate.alias("rate_per_s"),
    )


def prep_progress(spark: SparkSession, out_dir: str) -> tuple[int, int]:
    """Rows committed so far as (prepared, failed)."""
    counts = []
    for name in ("manifest", "failures"):
        table = prepared_table(spark, out_dir, name)
        counts.append(0 if table is None else table.count())
    return counts[0], counts[1]
