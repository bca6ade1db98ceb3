"""What a run has done, what is left, and when it should stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import scoring
from assayframe.operators.ordering import with_streak

SETUP_FAILURE_LIMIT = 5
LEADING_SLICE = 500

RETRY_POLICIES = ("never", "setup_only", "all")


def completed_ids(journal: DataFrame, keys: Sequence[str] = ("ligand_id",)) -> DataFrame:
    """Ids with any outcome that is not a failed set-up."""
    done = journal.where(~scoring.is_retryable(F.col("error_kind")))
    return done.select(*keys).distinct()


def retryable_ids(
    journal: DataFrame, keys: Sequence[str] = ("ligand_id",), ordinal: str = "ordinal"
) -> DataFrame:
    """Ids whose last record is a failed set-up."""
    last = F.max_by(scoring.is_retryable(F.col("error_kind")), F.col(ordinal))
    return journal.groupBy(*keys).agg(last.alias("_retry")).where("_retry").select(*keys)


def latest_records(
    journal: DataFrame, keys: Sequence[str] = ("ligand_id",), ordinal: str = "ordinal"
) -> DataFrame:
    """The last record of each id; reduced before the shuffle."""
    rest = [c for c in journal.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col(ordinal))
    return journal.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def finished_ids(journal: DataFrame, retry: str = "setup_only") -> DataFrame:
    """Ids a resumed job leaves alone, by retry policy.

    ``never`` leaves every recorded id, ``setup_only`` takes failed set-ups
    again, ``all`` takes every id without a success again.
    """
    if retry == "never":
        return journal.select("ligand_id").distinct()
    if retry == "setup_only":
        return completed_ids(journal)
    if retry == "all":
        return journal.where(F.col("status") == "ok").select("ligand_id").distinct()
    raise ValueError(f"unknown retry policy {retry!r}; expected one of {RETRY_POLICIES}")


def todo(work: DataFrame, done: DataFrame, on: Sequence[str] = ("ligand_id",)) -> DataFrame:
    """Work rows whose id is not among the done ids."""
    return work.join(done, list(on), "left_anti")


def scan_limited(
    rows: DataFrame, limit: int | Column | None, index: str = "index"
) -> DataFrame:
    """Bound how far the input is read, not how many rows come out.

    Applied before the resume anti-join, so repeating a command finishes the
    same leading part of the input instead of moving on.
    """
    return rows if limit is None else rows.where(F.col(index) < limit)


def with_leading_flag(
    rows: DataFrame, key: str = "ligand_id", size: int = LEADING_SLICE, flag: str = "want_poses"
) -> DataFrame:
    """Flag the first ``size`` ids in sorted order of all rows; ids are unique.

    The slice is a bounded top-k of at most ``size`` ids, small enough to
    broadcast whatever the size of the table.
    """
    head = rows.select(key).orderBy(key).limit(size).withColumn("_leads", F.lit(True))
    return (
        rows.join(F.broadcast(head), key, "left")
        .withColumn(flag, F.coalesce("_leads", F.lit(False)))
        .drop("_leads")
    )


def setup_streaks(
    journal: DataFrame,
    keys: Sequence[str],
    ordinal: str = "ordinal",
    partitions: int | None = None,
    failed: Column | None = None,
) -> DataFrame:
    """Length of the run of failed set-ups ending at each record."""
    hit = scoring.is_retryable(F.col("error_kind")) if failed is None else failed
    return with_streak(journal, keys, ordinal, hit, "streak", partitions)


def stop_points(
    journal: DataFrame,
    keys: Sequence[str],
    ordinal: str = "ordinal",
    limit: int = SETUP_FAILURE_LIMIT,
    partitions: int | None = None,
) -> DataFrame:
    """Records at which a run of failed set-ups reaches ``limit``."""
    return setup_streaks(journal, keys, ordinal, partitions).where(F.col("streak") == limit)


def status_counts(journal: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Completed, failed and otherwise skipped records per run."""
    status = F.col("status")
    return journal.groupBy(*keys).agg(
        F.count_if(status == "ok").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(~status.isin("ok", "failed")).alias("skipped"),
    )


def with_progress(status: DataFrame) -> DataFrame:
    """Append done, remaining, fraction, rate and expected seconds left."""
    total, done = F.col("total"), F.col("done")
    return (
        status.withColumn("done", F.col("completed") + F.col("failed") + F.col("skipped"))
        .withColumn("remaining", scoring.remaining(total, done))
        .withColumn("fraction", scoring.fraction_done(total, done))
        .withColumn(
            "rate_per_s", scoring.rate_per_s(done, F.col("started_at"), F.col("updated_at"))
        )
        .withColumn("eta_s", scoring.eta_s(total, done, F.col("rate_per_s")))
    )


def run_status(journal: DataFrame, runs: DataFrame, latest_only: bool = False) -> DataFrame:
    """Status of every run, counted from the journal and never stored as truth.

    ``latest_only`` counts each ligand once, by its last record; otherwise a
    failed set-up and its later success both count.
    """
    rows = latest_records(journal, ("run_id", "ligand_id")) if latest_only else journal
    counts = status_counts(rows)
    zero = F.lit(0).cast("bigint")
    joined = runs.drop("completed", "failed", "skipped").join(counts, "run_id", "left")
    for name in ("completed", "failed", "skipped"):
        joined = joined.withColumn(name, F.coalesce(name, zero))
    return with_progress(joined.withColumn("total", F.coalesce("total", zero)))
