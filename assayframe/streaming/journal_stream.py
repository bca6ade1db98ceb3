"""Following a journal while it grows.

The journal is a folder of immutable files. Offsets live in the query's
checkpoint, so every file is read once, and a writer publishes whole files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayframe.functions import scoring
from assayframe.operators.ordering import with_previous, with_streak
from assayframe.operators.progress import SETUP_FAILURE_LIMIT, status_counts, with_progress
from assayframe.session import ensure_checkpoint_dir
from assayframe.sources.journal import parse_records
from assayframe.sources.manifest import last_wins

TERMINAL_STATES = ("finished", "failed", "cancelled")


def stream_journal(
    spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None
) -> DataFrame:
    """New complete records of a journal folder, a bounded number of files at a time."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    lines = reader.text(path).select(F.col("value").alias("line"))
    return parse_records(lines)


def without_redelivery(records: DataFrame) -> DataFrame:
    """Drop records delivered twice; a first delivery always passes, however late.

    The state holds every key seen, so long streams want the RocksDB state store
    (``session.DEFAULT_CONF`` sets it), which keeps it on disk.
    """
    return records.dropDuplicates(["run_id", "ligand_id", "timestamp"])


def stream_status(records: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Running counts per run; partial counts are formed before the shuffle."""
    return status_counts(records, keys)


def progress_of(counts: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts joined to run records, with rate and seconds left."""
    return with_progress(counts.join(runs, "run_id"))


class _Watch:
    """A batch operator over all records of a stream, whatever order they came in.

    Each micro-batch adds its few needed columns to a log, under its own number,
    so replaying a batch is harmless and nothing written before is touched.
    ``results`` applies the operator to the log: the answer depends on the set of
    records alone, not on how files, batches and ordinals were mixed.
    """

    log_columns = ""

    def __init__(
        self, spark: SparkSession, folder: str, key: str = "run_id", ordinal: str = "ordinal",
        partitions: int | None = None,
    ) -> None:
        self.spark, self.folder = spark, folder
        self.key, self.ordinal, self.partitions = key, ordinal, partitions

    def narrow(self, batch: DataFrame) -> Column:
        """The one further column the operator needs."""
        raise NotImplementedError

    def answer(self, log: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.col(self.key).cast("string").alias(self.key),
            F.col(self.ordinal).cast("bigint").alias(self.ordinal),
            self.narrow(batch),
        )
        rows.write.mode("overwrite").parquet(f"{self.folder}/log/{batch_id:010d}")

    def log(self) -> DataFrame:
        schema = f"{self.key} string, {self.ordinal} bigint, {self.log_columns}"
        reader = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        return reader.parquet(f"{self.folder}/log")

    def results(self) -> DataFrame:
        return self.answer(self.log())


class StreakWatch(_Watch):
    """Online circuit breaker: records at which failed set-ups reach the limit.

    Scored by the segmented batch operator, so a run holding most of the records
    does not end up in one task.
    """

    log_columns = "hit boolean"
    limit = SETUP_FAILURE_LIMIT

    def narrow(self, batch: DataFrame) -> Column:
        return scoring.is_retryable(F.col("error_kind")).alias("hit")

    def answer(self, log: DataFrame) -> DataFrame:
        streaks = with_streak(
            log, [self.key], self.ordinal, F.col("hit"), "streak", self.partitions
        )
        return streaks.where(F.col("streak") == self.limit).select(self.key, self.ordinal, "streak")


class TransitionWatch(_Watch):
    """A row each time a run enters a terminal state; repeats are silent.

    Following goes on after the report, since journal records may still arrive.
    """

    log_columns = "state string"

    def narrow(self, batch: DataFrame) -> Column:
        return F.col("state")

    def answer(self, log: DataFrame) -> DataFrame:
        moved = with_previous(
            log, [self.key], self.ordinal, "state", "_previous", self.partitions
        )
        entered = F.col("state").isin(*TERMINAL_STATES) & ~F.col("state").eqNullSafe(
            F.col("_previous")
        )
        return moved.where(entered).select(self.key, self.ordinal, "state")


def catch_up(
    records: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Process everything that is there, then return."""
    query = (
        records.writeStream.outputMode(mode)
        .foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def follow(
    records: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str = "1 second",
    mode: str = "append",
) -> StreamingQuery:
    """Catch up first, then keep following from the same checkpoint."""
    catch_up(records, each_batch, checkpoint, mode)
    return (
        records.writeStream.outputMode(mode)
        .foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, reachable by every executor."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain_to_table(records: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream to its current end and return all its output as a table.

    Every batch is written under its number; in update mode a row carries that
    number, so :func:`newest` can keep the last version of each key.
    """
    spark = records.sparkSession
    folder = scratch_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{folder}/out/{batch_id:010d}"
        )

    schema = records.schema.add("batch", "long")
    catch_up(records, write, f"{folder}/checkpoint", mode)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def newest(table: DataFrame, key: str) -> DataFrame:
    """The last version of each key of an update-mode table."""
    return last_wins(table, key, "batch").drop("batch")
