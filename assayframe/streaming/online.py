"""Watches that answer in the micro-batch in which something happens.

State is one small value per run, so a batch costs what it holds, however long the
stream has been. Both watches need the records of a run in order from batch to batch
(within a batch any order will do), as :mod:`assayframe.sources.journal_tail` delivers
them. A record that comes behind one already judged cannot be judged by one value; it is
reported as ``late``, never dropped in silence. Journals whose files arrive in any order
belong to the watches of :mod:`assayframe.streaming.journal_stream`, which read a log.

Where records carry the ``portion`` of a tailing source, every report carries that of its
record, so a reader far behind may take many portions in one micro-batch and tells the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assayframe.functions import scoring
from assayframe.operators.progress import SETUP_FAILURE_LIMIT
from assayframe.streaming.journal_stream import TERMINAL_STATES

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Ordered(StatefulProcessor):
    """Rows of a key in order of ``ordinal`` against one value of state."""

    state_schema = ""
    # Whether records name their portion.
    portions = False

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", f"ordinal bigint, {self.state_schema}", self.ttl_ms)

    def step(self, value: Any, row: Any) -> tuple[Any, tuple[str, Any] | None]:
        """The next value, and what to report: ``(event, detail)``."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, value = self.state.get() if self.state.exists() else (None, None)
        batch = pd.concat(list(rows)).sort_values("ordinal", kind="stable")
        told, places = [], []
        for place, (ordinal, item) in enumerate(zip(batch["ordinal"].tolist(), batch["item"].tolist(), strict=True)):
            if last is not None and ordinal <= last:
                told.append((key[0], ordinal, "late", None))
                places.append(place)
                continue
            last = ordinal
            value, report = self.step(value, item)
            if report:
                told.append((key[0], ordinal, *report))
                places.append(place)
        self.state.update((last, value))
        if told:
            out = pd.DataFrame(told, columns=["run_id", "ordinal", "event", "detail"])
            yield out.assign(portion=batch["portion"].to_numpy()[places]) if self.portions else out

    def close(self) -> None:
        pass


class _Breaker(_Ordered):
    """Counts set-ups that fail one after the other; any other record starts again."""

    state_schema = "streak bigint"

    def __init__(self, limit: int, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.limit = limit

    def step(self, value: Any, row: Any) -> tuple[Any, tuple[str, Any] | None]:
        streak = (value or 0) + 1 if row == "hit" else 0
        return streak, ("stop", str(streak)) if streak == self.limit else None


class _Terminal(_Ordered):
    """Remembers the last state; tells each entry into a terminal one."""

    state_schema = "state string"

    def step(self, value: Any, row: Any) -> tuple[Any, tuple[str, Any] | None]:
        return row, ("entered", row) if row in TERMINAL_STATES and row != value else None


def _watched(records: DataFrame, item: Column, processor: StatefulProcessor) -> DataFrame:
    use_state_store(records.sparkSession)
    processor.portions = "portion" in records.columns
    rows = records.select(
        F.coalesce(F.col("run_id").cast("string"), F.lit("")).alias("run_id"), F.col("ordinal").cast("bigint").alias("ordinal"), item.alias("item"),
        *["portion"] * processor.portions,
    )
    return rows.groupBy("run_id").transformWithStateInPandas(
        processor, "run_id string, ordinal bigint, event string, detail string" + ", portion bigint" * processor.portions, "Append",
        "ProcessingTime" if processor.ttl_ms else "None",
    )


def use_state_store(spark: SparkSession) -> None:
    """Named state needs the RocksDB store; a session that names another one is switched."""
    if spark.conf.get(_PROVIDER, "") != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)


def stops(records: DataFrame, limit: int = SETUP_FAILURE_LIMIT, ttl_ms: int | None = None) -> DataFrame:
    """A ``stop`` row, in its own batch, when ``limit`` set-ups of a run failed in a row.

    ``records`` are a stream with ``run_id``, ``ordinal`` and ``error_kind``. ``ttl_ms``
    forgets runs that have been silent so long; such a stream has a batch at every trigger,
    so follow it instead of draining it.
    """
    hit = F.when(scoring.is_retryable(F.col("error_kind")), "hit").otherwise("other")
    return _watched(records, hit, _Breaker(limit, ttl_ms))


def entries(states: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """An ``entered`` row, once and in its own batch, when a run enters a terminal state.

    ``states`` are a stream with ``run_id``, ``ordinal`` and ``state``.
    """
    return _watched(states, F.coalesce(F.col("state"), F.lit("")), _Terminal(ttl_ms))


def drain(records: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process batch after batch until the source has nothing more, then return.

    For sources that bound their batches themselves, where one batch is not all there is.
    """
    query = (
        records.writeStream.outputMode(mode)
        .foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def drain_table(records: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """The output of a drained stream as a table, with the number of the ``batch`` that gave each row.

    Rows that name their ``portion`` have it as their batch, whatever micro-batch it came in.
    """
    told = "portion" in records.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        number = F.col("portion") if told else F.lit(batch_id).cast("bigint")
        batch.withColumn("batch", number).drop("portion").write.mode("overwrite").parquet(f"{folder}/out/{batch_id:010d}")

    schema = records.drop("portion").schema.add("batch", "long")
    drain(records, write, f"{folder}/checkpoint", mode)
    return records.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
