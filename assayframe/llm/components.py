"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import materialize


def _min_near(links: DataFrame) -> DataFrame:
    """Per node ``u`` the least node among itself and its neighbours ``v``."""
    return links.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_min_near(both), "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _min_near(down)
    moved = down.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionAll(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has a link; ``root`` is its component's least node.

    Links may repeat and point either way. Each round shuffles links twice and is
    cut off with a checkpoint; the rounds needed grow with the logarithm of the
    number of nodes. Only a count and a checksum reach the driver. No rows in, no
    rows out.
    """
    now = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    seen = _state(now)
    while seen[0]:
        now = materialize(_small_star(_large_star(now)))
        then, seen = seen, _state(now)
        if seen == then:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
