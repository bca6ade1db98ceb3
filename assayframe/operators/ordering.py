"""Ranks and running counts that never put a whole table or key in one task.

A plain ``row_number() over (order by ...)`` is one task, and a window
partitioned by a key is one task per key, however large. The operators here cut
the order into range partitions, count inside each, and carry one small total per
partition forward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.session import materialize

_POSITION_BITS = 33
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def with_global_rank(
    df: DataFrame, order: Sequence[Column], rank_col: str = "rank"
) -> DataFrame:
    """Append ``1..n`` in the given total order.

    Range-partitioned sort, rows per partition, offsets joined back. The sorted
    rows are materialized in the checkpoint folder, since both passes must see
    one layout. The offsets table has one row per partition, a bound that does
    not depend on the rows, so it may be broadcast.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _POSITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    within = F.col("_at").bitwiseAND(F.lit(_POSITION_MASK))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank_col, (F.col("_offset") + within + 1).cast("bigint"))
        .drop("_at", "_part", "_offset")
    )


def with_running_total(
    df: DataFrame, order: Sequence[Column], value: str, total_col: str
) -> DataFrame:
    """Append the sum of ``value`` over all rows before each row, in the given total order.

    Built like :func:`with_global_rank`: running sums inside range partitions, and
    one offset per partition.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", _POSITION_BITS))
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.sum(value).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before.orderBy("_part")), F.lit(0)).alias("_offset"))
    )
    inside = F.coalesce(F.sum(value).over(before.partitionBy("_part").orderBy("_at")), F.lit(0))
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_part")
        .withColumn(total_col, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_at", "_part", "_offset", "_inside")
    )


def _segments(df: DataFrame, keys: Sequence[str], ordinal: str, partitions: int | None) -> DataFrame:
    """Rows cut into range partitions of (keys, ordinal), with ``_part`` and ``_at`` (their place).

    The rows of a key in one partition are a segment. Only a key that fills whole
    partitions has more than two, and a partition shares at most its first and its
    last key with others. Materialized, since segments and carries must see one layout.
    """
    order = [*keys, ordinal]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return materialize(
        ranged.sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", _POSITION_BITS))
    )


def _in_segment(keys: Sequence[str]) -> Window:
    return Window.partitionBy("_part", *keys).orderBy("_at")


def _border_totals(placed: DataFrame, keys: Sequence[str], *totals: Column) -> DataFrame:
    """Totals of the segments that may go on in another partition: at most two a partition."""
    key = F.struct(*keys)
    ends = placed.groupBy("_part").agg(
        F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_last")
    )
    border = placed.join(F.broadcast(ends), "_part").where((key == F.col("_first")) | (key == F.col("_last")))
    return border.groupBy("_part", *keys).agg(*totals)


def _with_carried(placed: DataFrame, keys: Sequence[str], carried: DataFrame) -> DataFrame:
    """Give every segment what the segments of its key before it left; one row per partition at most."""
    return placed.join(F.broadcast(carried), ["_part", *keys], "left")


def _earlier(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_key_rank(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    rank_col: str,
    partitions: int | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by ordinal)``, safe for hot keys.

    ``ordinal`` is a unique integer, dense or sparse. Keys must not be null.
    ``partitions`` is the number of range partitions (Spark's own by default).
    """
    placed = _segments(df, keys, ordinal, partitions)
    totals = _border_totals(placed, keys, F.count("*").alias("_n"))
    carried = totals.select("_part", *keys, F.sum("_n").over(_earlier(keys)).alias("_before")).where(
        "_before is not null"
    )
    local = placed.withColumn("_local", F.row_number().over(_in_segment(keys)))
    return (
        _with_carried(local, keys, carried)
        .withColumn(rank_col, (F.coalesce("_before", F.lit(0)) + F.col("_local")).cast("bigint"))
        .select(*df.columns, rank_col)
    )


def with_streak(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    hit: Column,
    streak_col: str = "streak",
    partitions: int | None = None,
) -> DataFrame:
    """Length of the unbroken run of ``hit`` rows ending at each row, per key.

    Zero on rows that break the run. A segment is given how many trailing hits the
    segments of its key before it ended with.
    """
    placed = _segments(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), keys, ordinal, partitions)
    # Places are dense inside a segment, so differences of places count rows.
    totals = _border_totals(
        placed, keys, F.count("*").alias("_n"), F.max("_at").alias("_end"), F.max(F.when(~F.col("_hit"), F.col("_at"))).alias("_miss")
    )
    earlier = _earlier(keys)
    counted = totals.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    reset = F.max(F.col("_start") + F.col("_n") - (F.col("_end") - F.col("_miss"))).over(earlier)
    carried = counted.select(
        "_part", *keys, (F.col("_start") - F.coalesce(reset, F.lit(0))).alias("_carry")
    ).where("_carry > 0")
    ordered = _in_segment(keys)
    local = placed.withColumn("_pos", F.row_number().over(ordered)).withColumn(
        "_reset", F.max(F.when(~F.col("_hit"), F.col("_pos"))).over(ordered)
    )
    since = F.when(F.col("_reset").isNotNull(), F.col("_pos") - F.col("_reset")).otherwise(
        F.col("_pos") + F.coalesce("_carry", F.lit(0))
    )
    return (
        _with_carried(local, keys, carried)
        .withColumn(streak_col, F.when(F.col("_hit"), since).otherwise(F.lit(0)).cast("bigint"))
        .select(*df.columns, streak_col)
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    value: str,
    previous_col: str = "previous",
    partitions: int | None = None,
) -> DataFrame:
    """Value of the row before each row, per key; null on a key's first row.

    The first row of a segment takes the last value of the segment before it.
    """
    placed = _segments(df, keys, ordinal, partitions)
    totals = _border_totals(placed, keys, F.max_by(F.struct(value), "_at").alias("_end"))
    carried = totals.select(
        "_part", *keys, F.lag("_end").over(Window.partitionBy(*keys).orderBy("_part")).alias("_carried")
    ).where("_carried is not null")
    ordered = _in_segment(keys)
    local = placed.withColumn("_before", F.lag(value).over(ordered)).withColumn("_pos", F.row_number().over(ordered))
    return (
        _with_carried(local, keys, carried)
        .withColumn(previous_col, F.when(F.col("_pos") == 1, F.col(f"_carried.{value}")).otherwise(F.col("_before")))
        .select(*df.columns, previous_col)
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, salts: int = 32
) -> DataFrame:
    """Exact median per key (mean of the middle two), safe for hot keys.

    A mergeable quantile sketch brackets the middle ranks; one more pass counts
    the values below the bracket and keeps distinct values inside it with their
    multiplicity. The bracket is a fixed small share of a key's rows, and the
    exact rank is found inside it. Values meet their key's bracket on a salted
    key, so a hot key is spread over ``salts`` tasks. Rows: keys, ``n``, ``median``.
    """
    accuracy = 10000
    margin = 3.0 / accuracy
    known = df.where(F.col(value).isNotNull())
    marks = F.percentile_approx(
        value, F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), accuracy
    )
    sketch = known.groupBy(*keys).agg(marks.alias("_marks"))
    bracket = sketch.select(
        *keys,
        F.col("_marks")[0].alias("_lo"),
        F.col("_marks")[1].alias("_hi"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    salt = F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")
    counted = (
        known.groupBy(*keys, value)
        .agg(F.count("*").alias("_n"))
        .withColumn("_salt", salt)
        .join(bracket, [*keys, "_salt"])
    )
    summary = counted.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(F.col(value) < F.col("_lo"), F.col("_n")).otherwise(0)).alias("_below"),
    )
    inside = counted.where(F.col(value).between(F.col("_lo"), F.col("_hi"))).select(
        *keys, value, "_n"
    )
    running = Window.partitionBy(*keys).orderBy(value)
    placed = (
        inside.join(summary, list(keys))
        .withColumn("_to", F.col("_below") + F.sum("_n").over(running))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )

    def holds(rank: Column) -> Column:
        return (F.col("_from") < rank) & (rank <= F.col("_to"))

    low_rank = F.floor((F.col("n") + 1) / 2)
    high_rank = F.floor(F.col("n") / 2) + 1
    return (
        placed.groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.max(F.when(holds(low_rank), F.col(value))).alias("_a"),
            F.max(F.when(holds(high_rank), F.col(value))).alias("_b"),
        )
        .select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"))
    )
