"""The screen job: prepared ligands in, journalled outcomes out."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.seeds import stable_seed
from assayframe.operators import batchmap, progress
from assayframe.operators.ordering import with_global_rank
from assayframe.schemas import ScreenConfig
from assayframe.session import path_exists
from assayframe.sources import runs
from assayframe.sources.journal import append_journal, read_journal
from assayframe.streaming.journal_stream import scratch_folder


class SetupFailure(RuntimeError):
    """The run cannot be set up; going on would fail every row alike."""


def screen(
    spark: SparkSession,
    ligands: DataFrame,
    run_dir: str,
    config: ScreenConfig,
    scorer: batchmap.OpenScorer | str,
    run_id: str = "run",
    waves: int = 12,
    limit: int | None = None,
    resume: bool = True,
    retry: str = "setup_only",
    pose_cutoff: int = progress.LEADING_SLICE,
    provenance: dict[str, Any] | None = None,
) -> DataFrame:
    """Score ``(ligand_id, text)`` rows and return the status row.

    The work is cut by id into ``waves``, each about as large as all before it
    together; each commits before the next starts. So a broken set-up shows in a
    small share of the rows, and a kill loses at most the wave in flight. After
    each wave the records of the whole run are looked at in the order they were
    finished; enough failed set-ups in a row, across waves too, stop it.
    """
    problems = batchmap.check_config(config)
    if problems:
        raise ValueError("; ".join(problems))
    opener = batchmap.scorer_named(scorer) if isinstance(scorer, str) else scorer
    settings = config.to_dict()
    journal_path = f"{run_dir}/journal"
    runs.write_metadata(
        spark, f"{run_dir}/provenance", {"run_id": run_id, "config": settings, **(provenance or {})}
    )
    considered = ligands.select("ligand_id", "text")
    if limit is not None:
        leading = considered.select("ligand_id").orderBy("ligand_id").limit(limit)
        considered = considered.join(leading, "ligand_id", "left_semi")
    flagged = progress.with_leading_flag(considered, size=pose_cutoff)
    total = considered.count()
    if total == 0:
        raise ValueError("no prepared ligands")
    work = flagged
    batches_before = 0
    if resume and path_exists(spark, journal_path):
        earlier = read_journal(spark, journal_path)
        work = progress.todo(flagged, progress.finished_ids(earlier, retry))
        batches_before = _next_batch(spark, journal_path)
    work = work.withColumn(
        "row_seed", stable_seed(config.seed, F.col("ligand_id"))
    ).withColumn("_wave", wave_of(F.col("ligand_id"), waves))

    started = time.time()

    def record(state: str, message: str | None = None) -> DataFrame:
        now = time.time()
        finished = now if state == "finished" else None
        return runs.run_record(
            spark, run_id, engine=config.engine, state=state, total=total, started_at=started,
            updated_at=now, finished_at=finished, message=message, config=settings,
        )

    runs.append_run(record("running"), f"{run_dir}/runs")
    folder = scratch_folder(spark, "screen")
    for wave in range(waves):
        staged = f"{folder}/{wave}"
        scored = batchmap.safe_map(work.where(F.col("_wave") == wave), opener, settings)
        scored.withColumn("run_id", F.lit(run_id)).write.parquet(staged)
        outcomes = spark.read.parquet(staged)
        batch = batches_before + wave
        append_journal(outcomes, journal_path, batch)
        poses = outcomes.where("poses is not null").select("run_id", "ligand_id", "poses")
        poses.write.mode("append").parquet(f"{run_dir}/poses")
        stop = first_stop(
            spark, [f"{journal_path}/batch_id={b:010d}" for b in range(batches_before, batch + 1)]
        )
        if stop is not None:
            runs.append_run(record("failed", stop), f"{run_dir}/runs")
            raise SetupFailure(stop)
    runs.append_run(record("finished"), f"{run_dir}/runs")
    return run_state(spark, run_dir)


def wave_of(ligand_id: Column, waves: int) -> Column:
    """Wave of an id: shares double from wave to wave, the last takes half of all."""
    share = F.pmod(F.xxhash64(F.lit("wave"), ligand_id), F.lit(1 << (waves - 1)))
    # The bit length of a number below 2**k is j with chance 2**(j-1-k).
    return F.when(share == 0, 0).otherwise(F.length(F.bin(share))).cast("int")


def first_stop(spark: SparkSession, batch_paths: Sequence[str]) -> str | None:
    """Message of the record at which the run should have stopped, by completion time."""
    records = read_journal(spark, batch_paths).drop("ordinal")
    placed = with_global_rank(records, [F.col("timestamp"), F.col("ligand_id")], "ordinal")
    stops = progress.stop_points(placed, ["run_id"])
    row = stops.orderBy("ordinal").select("error").limit(1).collect()
    return (row[0]["error"] or "run could not be set up") if row else None


def _next_batch(spark: SparkSession, journal_path: str) -> int:
    """Number after the last committed batch."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(journal_path)
    listing = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [entry.getPath().getName() for entry in listing]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("batch_id=")]
    return max(numbers, default=-1) + 1


def run_state(spark: SparkSession, run_dir: str) -> DataFrame:
    """Status of the runs in a folder: latest record of each ligand, counted."""
    journal = read_journal(spark, f"{run_dir}/journal")
    return progress.run_status(journal, runs.read_runs(spark, f"{run_dir}/runs"), latest_only=True)
