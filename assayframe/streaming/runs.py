"""What a followed stream has gathered, kept on disk in runs of doubling size.

After n batches the live runs cover the ones of n's binary form: 13 batches are the
runs 0-8, 8-12 and 12-13. A batch adds its own rows and merges the runs that its
carry closes, so every row is written about log2(n) times however long the stream
is, and a reader unites at most log2(n) + 1 tables.

A run is named by its batches. A batch that is replayed writes the same run from the
same inputs, so a lost driver or executor changes nothing. The folder belongs to one
stream checkpoint, whose batches count from 0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Run = tuple[int, int]


def covering(batches: int) -> list[Run]:
    """The live runs after so many batches, oldest (and largest) first."""
    runs, start = [], 0
    for bit in reversed(range(batches.bit_length())):
        if batches >> bit & 1:
            runs.append((start, start + (1 << bit)))
            start += 1 << bit
    return runs


class Runs:
    """A folder of runs; all have the columns of a batch and are united by ``merge``.

    A writer may lay a run out by further columns, which merging leaves out. ``schema``
    is needed only where a run may have no file, as an empty partitioned one.
    What an operator derives from a run it may keep at ``beside(run)``; it goes with the run.
    """

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.folder, self.merge = spark, folder, merge
        self.schema: StructType | None = None

    def path(self, run: Run) -> str:
        return f"{self.folder}/{run[0]:010d}-{run[1]:010d}"

    def beside(self, run: Run) -> str:
        return f"{self.folder}-beside/{run[0]:010d}-{run[1]:010d}"

    def _hadoop(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def written(self) -> list[Run]:
        """Every run that was committed and is still there."""
        place, files = self._hadoop(f"{self.folder}/*/_SUCCESS")
        names = [s.getPath().getParent().getName() for s in files.globStatus(place) or []]
        return sorted((int(lo), int(hi)) for lo, hi in (n.split("-") for n in names))

    def batches(self) -> int:
        """Batches folded in so far."""
        return max((hi for _, hi in self.written()), default=0)

    def table(self, run: Run) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(self.path(run))

    def read(self, runs: list[Run]) -> DataFrame | None:
        """The rows of some runs, not yet merged with each other; None for no run."""
        tables = [self.table(r) for r in runs]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def current(self) -> DataFrame | None:
        """Everything gathered so far, merged; None before the first batch.

        The table reads files that the second batch after it may delete.
        """
        rows = self.read(covering(self.batches()))
        return None if rows is None else self.merge(rows)

    def add(self, batch_id: int, rows: DataFrame, write: Callable[[DataFrame, str], None] | None = None) -> Run:
        """Fold in the rows of a batch and return the run they went to.

        Runs that no replay of this batch or the one before needs are deleted first.
        """
        there, before = set(self.written()), covering(batch_id)
        if missing := [r for r in before if r not in there]:
            raise ValueError(f"batch {batch_id} needs the runs {missing} in {self.folder}; one folder serves one checkpoint")
        run = covering(batch_id + 1)[-1]
        for old in there - {*before, *covering(max(batch_id - 1, 0)), run}:
            for path in (self.beside(old), self.path(old)):
                place, files = self._hadoop(path)
                files.delete(place, True)
        closed = self.read([r for r in before if r[0] >= run[0]])
        merged = self.merge(rows if closed is None else rows.unionByName(closed.select(*rows.columns)))
        if write is None:
            merged.write.mode("overwrite").parquet(self.path(run))
        else:
            write(merged, self.path(run))
        return run
