"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.session import materialize

__all__ = [
    "WORD_BREAK", "clean_text", "join_unique", "materialize", "once_per_worker", "packed_rows",
    "rank_in_groups", "spread", "table", "words_of",
]

# What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_rows(df: DataFrame, keep: Sequence[str] | None = None, **columns: Column) -> DataFrame:
    """The input row as one struct ``row``, beside the columns an operator needs.

    A caller's own columns can then never clash with names an operator uses.
    ``keep`` names the columns worth carrying; all by default.
    """
    row = F.struct("*") if keep is None else F.struct(*[df[c] for c in keep])
    return df.select(row.alias("row"), *[c.alias(n) for n, c in columns.items()])


def clean_text(text: Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(clean_text(text), WORD_BREAK), "")


def rank_in_groups(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    rank_col: str,
    rows_per_slice: int = 20_000,
) -> DataFrame:
    """Append a gapless rank from 0 within each group; no task sees a whole group.

    Rows of a group are dealt over hashed slices, counted per slice, and each
    slice starts where the ones before it end. The order within a group is fixed
    by ``order`` but is not a sorted one. ``df`` must be cheap to read twice
    (materialized). Rows equal in all of ``order`` are interchangeable.
    """
    slices = max(1, -(-df.count() // rows_per_slice))
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    sizes = sliced.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(
        F.col(group).alias("_g"),
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
    )
    local = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*order))
    return (
        sliced.withColumn("_local", local)
        .join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
        .withColumn(rank_col, (F.col("_start") + F.col("_local") - 1).cast("bigint"))
        .drop("_slice", "_local", "_g", "_s", "_start")
    )


# A key with more than one in so many of all rows is hot; there are never more such keys than this.
HOT_SHARE = 1000


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Inner join with a ``right`` that is unique by ``keys`` and says how many rows of ``left`` each key has.

    Hot keys are at most ``HOT_SHARE`` rows, a proven bound, and are broadcast; only the
    other rows of ``left`` are shuffled. ``right`` must be cheap to read again
    (materialized); its column ``weight`` is dropped.
    """
    whole = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > F.lit(whole)
    hot = F.broadcast(right.where(is_hot).drop(weight))
    many = left.join(hot, list(keys))
    few = left.join(F.broadcast(right.where(is_hot).select(*keys)), list(keys), "left_anti")
    return many.unionByName(few.join(right.where(~is_hot).drop(weight), list(keys)))


def spread(df: DataFrame, rows_per_task: int, rows: int) -> DataFrame:
    """Deal narrow rows over tasks of about ``rows_per_task``."""
    return df.repartition(max(1, -(-rows // rows_per_task)))


def once_per_worker(key: object, make: Callable[[], object]) -> object:
    """Build something costly once in each Python worker process and keep it.

    Functions of this package travel by value, so their module globals are new
    in every task; a module of our own in ``sys.modules`` outlives the task.
    Workers go from stage to stage, so what a task builds takes the place of what
    earlier tasks built and it does not use.
    """
    kept = sys.modules.setdefault("assayframe_worker_state", types.ModuleType("assayframe_worker_state"))
    made, used = kept.__dict__.setdefault("made", {}), kept.__dict__.setdefault("used", {})
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if key not in made:
        for other in [k for k in made if used.get(k) != task]:
            del made[other]
        made[key] = make()
    used[key] = task
    return made[key]
