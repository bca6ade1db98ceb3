from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assayframe.functions.numeric import parse_float, parse_int, round_half_even
from assayframe.operators import ordering as O


def rows(spark, n=3000, seed=1, partitions=4):
    rng = random.Random(seed)
    # One key holds a third of all rows.
    data = [
        ("hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}", i, rng.random() < 0.6,
         rng.choice("abc"), round(rng.gauss(0, 3), 1))
        for i in range(n)
    ]
    rng.shuffle(data)
    schema = "key string, ordinal bigint, hit boolean, state string, value double"
    return spark.createDataFrame(data, schema).repartition(partitions)


@pytest.mark.parametrize("parts", [1, 9, 60])
def test_key_rank_equals_a_plain_window(spark, parts):
    df = rows(spark)
    plain = F.row_number().over(Window.partitionBy("key").orderBy("ordinal"))
    got = O.with_key_rank(df, ["key"], "ordinal", "n", parts).withColumn("w", plain)
    assert got.count() == 3000
    assert got.where("n <> w or n is null").count() == 0


@pytest.mark.parametrize("parts", [1, 9, 60])
def test_streaks_equal_a_loop(spark, parts):
    df = rows(spark)
    want, run = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["ordinal"]):
        run[r["key"]] = run.get(r["key"], 0) + 1 if r["hit"] else 0
        want[r["ordinal"]] = run[r["key"]]
    got = O.with_streak(df, ["key"], "ordinal", F.col("hit"), partitions=parts)
    assert {r["ordinal"]: r["streak"] for r in got.collect()} == want


@pytest.mark.parametrize("parts", [1, 9, 60])
def test_previous_equals_lag(spark, parts):
    df = rows(spark)
    lag = F.lag("state").over(Window.partitionBy("key").orderBy("ordinal"))
    got = O.with_previous(df, ["key"], "ordinal", "state", partitions=parts).withColumn("w", lag)
    assert got.where("not (previous <=> w)").count() == 0
    assert got.count() == 3000


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_global_rank_does_not_depend_on_partitions(spark, partitions):
    df = rows(spark, partitions=partitions).withColumn(
        "value", F.when(F.col("value") > -3, F.col("value"))
    )
    order = [F.col("value").asc_nulls_last(), F.col("ordinal").asc()]
    ranked = O.with_global_rank(df, order).select("rank", "ordinal", "value").collect()
    want = sorted(
        df.collect(), key=lambda r: (r["value"] is None, r["value"] or 0.0, r["ordinal"])
    )
    assert [r["ordinal"] for r in sorted(ranked)] == [r["ordinal"] for r in want]
    assert sorted(r["rank"] for r in ranked) == list(range(1, 3001))


def test_exact_median_per_key(spark):
    for n in (1, 2, 3, 3000, 30000):
        df = rows(spark, n=n, seed=n)
        want = {}
        for r in df.collect():
            want.setdefault(r["key"], []).append(r["value"])
        got = {r["key"]: (r["n"], r["median"]) for r in O.exact_median(df, ["key"], "value").collect()}
        assert got == {k: (len(v), statistics.median(v)) for k, v in want.items()}


def test_median_of_many_distinct_values(spark):
    df = spark.range(50001).select(
        F.lit("k").alias("key"), F.xxhash64("id").cast("double").alias("value")
    )
    want = statistics.median(r["value"] for r in df.collect())
    assert O.exact_median(df, ["key"], "value").first()["median"] == want


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4])
def test_rounding_equals_python(spark, digits):
    rng = random.Random(digits)
    values = [-rng.randrange(1, 200) / 10 / rng.randrange(1, 60) for _ in range(20000)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(5000)]
    values += [k / 2 / 10**digits for k in range(-500, 500)]
    values += [0.5, 1.5, 2.5, -0.5, 2.675, 1.005, 0.125, -2.9 / 16, -0.0625, 1e300, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", round_half_even(F.col("v"), digits).alias("r")).collect()
    wrong = [(r["v"], r["r"], round(r["v"], digits)) for r in got if r["r"] != round(r["v"], digits)]
    assert wrong == []


def test_number_text(spark):
    cases = {"1": (1, 1.0), " 1.5 ": (None, 1.5), "x": (None, None), "": (None, None),
             "1.0f": (None, None), "-3": (-3, -3.0), "1e3": (None, 1000.0), ".5": (None, 0.5),
             "5.": (None, 5.0), "99999999999": (None, 99999999999.0), "--1": (None, None)}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("t", parse_int(F.col("t")), parse_float(F.col("t"))).collect()}
    assert got == cases


def test_sparse_ordinals_of_a_hot_key_are_spread(spark):
    # Every row of the hot key is 2^33 from the next; nine tenths of all rows are its own.
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("key"),
        (F.col("id") * (1 << 33)).alias("ordinal"),
        (F.col("id") % 6007 > 0).alias("hit"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("state"),
    )
    parts = 16
    placed = O._segments(df, ["key"], "ordinal", parts)
    totals = O._border_totals(placed, ["key"], F.count("*").alias("n"))
    assert totals.count() <= 2 * parts
    segments = placed.groupBy("_part", "key").count()
    assert segments.agg(F.max("count")).first()[0] < 3 * 20000 / parts
    assert segments.where("key = 'hot'").count() > parts / 2

    per_key = Window.partitionBy("key").orderBy("ordinal")
    rank = O.with_key_rank(df, ["key"], "ordinal", "n", parts)
    assert rank.withColumn("w", F.row_number().over(per_key)).where("n <> w").isEmpty()
    before = O.with_previous(df, ["key"], "ordinal", "state", partitions=parts)
    assert before.withColumn("w", F.lag("state").over(per_key)).where("not (previous <=> w)").isEmpty()
    streak = O.with_streak(df, ["key"], "ordinal", F.col("hit"), partitions=parts)
    missed = F.coalesce(F.max(F.when(~F.col("hit"), F.col("_r"))).over(per_key), F.lit(0))
    want = streak.withColumn("_r", F.row_number().over(per_key)).withColumn("w", F.col("_r") - missed)
    assert want.where("streak <> w").isEmpty() and want.count() == 20000
