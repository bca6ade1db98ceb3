"""Positions of text pieces in their file and in the whole input, without a shuffle.

Two scans of the same splits: one counts the kept pieces of every split, the
other adds the split's offset to the position inside it. Only the small table of
splits is joined back; the text itself stays where it was read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.operators.ordering import with_running_total
from assayframe.session import materialize

# Splits whose offsets may be broadcast: about 100 bytes each.
MAX_BROADCAST_SPLITS = 500_000

_PART_BITS = 33


def normalized(value: Column) -> Column:
    """UTF-8 with replacement, one kind of line end."""
    return F.regexp_replace(F.make_valid_utf8(value), r"\r\n?", "\n")


def scan_pieces(
    spark: SparkSession, path: str | Sequence[str], separator: str | None = None
) -> DataFrame:
    """Text cut at ``separator`` (line ends by default), with its split."""
    paths = [path] if isinstance(path, str) else list(path)
    options = {"lineSep": separator} if separator else {}
    return (
        spark.read.text(paths, **options)
        .select(
            normalized(F.col("value")).alias("piece"),
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("split_start"),
        )
        .withColumn("_at", F.monotonically_increasing_id())
    )


def opening_verdicts(keep: Column, keep_first: Column) -> Column:
    """Position of a piece with its two verdicts in the low bits.

    The first piece of a file follows other rules (header line, byte-order
    mark). The minimum of this number carries its position and verdicts, and
    the aggregate buffer stays a plain number.
    """
    return F.col("_at") * 4 + keep_first.cast("bigint") * 2 + keep.cast("bigint")


def dropped_opening(first: str) -> Column:
    """1 where the file's first piece is kept by the general rule only."""
    keep_bit = F.pmod(first, F.lit(2))
    first_bit = F.pmod(F.floor(F.col(first) / 2), F.lit(2))
    return keep_bit - first_bit


def _splits(pieces: DataFrame, keep: Column, keep_first: Column) -> DataFrame:
    """One row per split: first position, pieces kept before it in file and input."""
    raw = pieces.groupBy("source_file", "split_start").agg(
        F.min(opening_verdicts(keep, keep_first)).alias("_first"), F.count_if(keep).alias("_kept")
    )
    opens_file = F.col("split_start") == 0
    # One narrow row per split, kept so that the text is scanned once for all sums.
    sized = materialize(
        raw.select(
            "source_file",
            "split_start",
            F.shiftright("_first", 2).alias("_first_at"),
            "_kept",
            F.when(opens_file, dropped_opening("_first")).otherwise(0).alias("_dropped"),
        )
    )
    # Rows of one scan task are numbered in the order of its splits.
    in_task = (
        Window.partitionBy("_task").orderBy("_first_at").rowsBetween(Window.unboundedPreceding, -1)
    )
    in_file = (
        Window.partitionBy("source_file")
        .orderBy("split_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    n = F.col("_kept") - F.col("_dropped")
    with_sums = (
        sized.withColumn("_task", F.shiftright("_first_at", _PART_BITS))
        .withColumn("_task_before", F.coalesce(F.sum("_kept").over(in_task), F.lit(0)))
        .withColumn("_file_before", F.coalesce(F.sum(n).over(in_file), F.lit(0)))
    )
    files = sized.groupBy("source_file").agg(F.sum(n).alias("_in_file"))
    starts = with_running_total(files, [F.col("source_file")], "_in_file", "_base").drop("_in_file")
    return with_sums.join(starts, "source_file").select(
        "source_file", "split_start", "_first_at", "_dropped", "_task", "_task_before",
        "_file_before", "_base",
    )


def with_positions(
    pieces: DataFrame, keep: Column, keep_first: Column | None = None
) -> DataFrame:
    """Kept pieces with ``index`` (in the file) and ``ordinal`` (in the input).

    Files count in path order. ``keep_first`` replaces ``keep`` for the first
    piece of a file and may only be narrower.
    """
    keep_first = keep if keep_first is None else keep_first
    splits = _splits(pieces, keep, keep_first)
    if splits.count() <= MAX_BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    kept = pieces.where(keep).withColumn("_kept_at", F.monotonically_increasing_id())
    joined = kept.join(splits, ["source_file", "split_start"], "left")
    known = F.coalesce(
        F.col("_first_at"), F.raise_error("input splits changed between scans").cast("bigint")
    )
    is_first = (F.col("split_start") == 0) & (F.col("_at") == known)
    in_split = (
        F.col("_kept_at")
        - F.shiftleft(F.col("_task"), _PART_BITS)
        - F.col("_task_before")
        - F.col("_dropped")
    )
    index = F.col("_file_before") + in_split
    return (
        joined.withColumn("is_first", is_first)
        .where(~(F.col("is_first") & (F.col("_dropped") == 1)))
        .select(
            "piece",
            "source_file",
            "is_first",
            index.cast("bigint").alias("index"),
            (F.col("_base") + index).cast("bigint").alias("ordinal"),
        )
    )
