"""Streams folded into runs on disk: the report that follows, and first deliveries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assayframe.operators import hits
from assayframe.streaming import redelivery
from assayframe.streaming.journal_stream import catch_up
from assayframe.streaming.redelivery import RedeliveryGuard
from assayframe.streaming.report import ReportFold
from assayframe.streaming.runs import Runs, covering

JOURNAL = (
    "ligand_id string, status string, seed bigint, ordinal bigint, "
    "modes array<struct<mode:int,affinity:double,rmsd_lb:double,rmsd_ub:double>>"
)
MANIFEST = "ligand_id string, compound_id string, heavy_atoms string"


def journal_rows(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of all records is of one ligand; scores tie and are missing.
        ligand = "hot" if rng.random() < 0.34 else f"L{rng.randrange(25)}"
        scored = rng.random() < 0.7
        modes = [(1, -float(rng.randrange(4)), 0.0, 0.0)] if scored else []
        rows.append((ligand, "ok" if scored else "failed", i if i % 5 else None, i, modes))
    rng.shuffle(rows)
    return rows


def test_runs_cover_every_batch_once():
    for n in range(200):
        runs = covering(n)
        assert [b for lo, hi in runs for b in range(lo, hi)] == list(range(n))
        assert len(runs) == bin(n).count("1")
        assert all(lo % (hi - lo) == 0 for lo, hi in runs)


def test_report_equals_the_whole_one_after_every_batch(spark, tmp_path):
    rows = journal_rows(90)
    manifest = spark.createDataFrame(
        [(f"L{i}", f"C{i % 8}", str(i % 6)) for i in range(20)] + [("hot", "C1", "7")], MANIFEST
    )
    fold, step = ReportFold(spark, str(tmp_path)), 23
    for batch_id in range(4):
        batch = spark.createDataFrame(rows[batch_id * step : (batch_id + 1) * step], JOURNAL)
        fold(batch, batch_id)
        if batch_id % 2:
            fold(batch, batch_id)  # a replay changes nothing
        so_far = spark.createDataFrame(rows[: (batch_id + 1) * step], JOURNAL)
        for latest in (False, True)[: 1 + batch_id % 2]:
            want = hits.ranked_hits(so_far, manifest, latest_only=latest).orderBy("rank").collect()
            assert fold.results(manifest, latest).orderBy("rank").collect() == want


def test_a_batch_costs_a_share_of_the_merges_not_the_history(spark, tmp_path):
    written = []

    def write(rows, path):
        rows.write.mode("overwrite").parquet(path)
        written.append(spark.read.parquet(path).count())

    runs, batches, size = Runs(spark, str(tmp_path), lambda rows: rows), 16, 10
    for b in range(batches):
        runs.add(b, spark.range(b * size, (b + 1) * size), write)
    assert [r["id"] for r in runs.current().orderBy("id").collect()] == list(range(batches * size))
    # Batch n writes the run that n's lowest 1 stands for: 480 rows, where rewriting all each time is 1360.
    assert written == [(n & -n) * size for n in range(1, batches + 1)]
    assert sum(written) == 480
    assert len(runs.written()) <= 2 * batches.bit_length()


def test_a_folder_of_another_checkpoint_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="one folder serves one checkpoint"):
        Runs(spark, str(tmp_path), lambda rows: rows).add(3, spark.range(1))


DELIVERY = "run_id string, ligand_id string, timestamp double, payload string"


@pytest.mark.parametrize(("bits", "part_keys"), [(16, 1_000_000), (16, 7), (0.5, 7)])
def test_each_record_passes_once_however_late_it_comes_again(spark, tmp_path, bits, part_keys):
    """With half a bit a key nearly every look-up is a false hit, and answers stay right."""
    rng = random.Random(11)
    guard = RedeliveryGuard(spark, str(tmp_path), recent=2, bits=bits, part_keys=part_keys)
    seen, sent = set(), []
    for batch_id in range(6):
        new = [(rng.choice(["a", "b", None]), f"L{batch_id}-{i}", rng.choice([None, 1.0, 2.0])) for i in range(12)]
        again = rng.sample(sent, min(len(sent), 10)) + new[:3] + sent[:1] * 5
        rows = [(*k, f"{batch_id}") for k in new + again]
        rng.shuffle(rows)
        batch = spark.createDataFrame(rows, DELIVERY)
        guard(batch, batch_id)
        if batch_id in (3, 4):
            guard(batch, batch_id)
        fresh = {k for k in new if k not in seen}
        told = spark.read.parquet(guard._out(batch_id)).collect()
        assert sorted(map(repr, ((r["run_id"], r["ligand_id"], r["timestamp"]) for r in told))) == sorted(map(repr, fresh))
        seen |= fresh
        sent += new
    assert guard.results().count() == len(seen)
    assert guard.results().columns == ["run_id", "ligand_id", "timestamp", "payload"]
    assert len(covering(guard.runs.batches())) == 2


def test_filter_lets_most_new_keys_pass_without_reading_old_ones(spark, tmp_path):
    guard = RedeliveryGuard(spark, str(tmp_path), key=["id"], recent=1)
    guard(spark.range(20_000), 0)
    new = spark.range(20_000, 20_020).withColumn("_hash", F.xxhash64("id"))
    old = spark.range(19_990, 20_000).withColumn("_hash", F.xxhash64("id"))
    assert guard._suspected(new, (0, 1)) is None
    assert guard._suspected(old, (0, 1)).join(old, "id", "left_semi").count() == 10


@pytest.mark.parametrize("few", [500_000, 0])
def test_old_keys_are_compared_only_where_their_hash_is_suspected(spark, tmp_path, monkeypatch, few):
    """One late key of a run does not bring the rest of its part into the comparison."""
    monkeypatch.setattr(redelivery, "BROADCAST_HASHES", few, raising=False)
    guard = RedeliveryGuard(spark, str(tmp_path), key=["id"], recent=1)
    size, compared = 5_000, []
    whole = guard._seen

    def seen(rows, runs):
        tables = whole(rows, runs)
        compared.append(sum(t.count() for t in tables))
        return tables

    guard._seen = seen
    for b in range(4):
        # The last 50 keys of the batch before come again.
        guard(spark.range(b * size - 50 if b else 0, (b + 1) * size), b)
        assert spark.read.parquet(guard._out(b)).count() == size
    assert compared[0] == 0 and all(50 <= n < 250 for n in compared[1:])
    assert guard.results().distinct().count() == 4 * size


def test_a_batch_lies_in_few_tasks_whatever_the_shuffle_partitions(spark, tmp_path):
    spark.range(200).repartition(2, "id").write.parquet(str(tmp_path / "stream"))
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stream"))
    guard = RedeliveryGuard(spark, str(tmp_path / "guard"), key=["id"], recent=1)
    whole, tasks = guard._seen, []
    guard._seen = lambda rows, runs: tasks.append(rows.rdd.getNumPartitions()) or whole(rows, runs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        catch_up(stream, guard, str(tmp_path / "checkpoint"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(tasks) == 2 and max(tasks) <= 16
    assert guard.results().count() == 200


def test_a_filter_of_another_layout_is_not_asked(spark, tmp_path):
    guard = RedeliveryGuard(spark, str(tmp_path), key=["id"], recent=1)
    guard(spark.range(100), 0)
    old = spark.createDataFrame([(0, bytearray(4096), 1)], "piece bigint, bits binary, pieces int")
    old.write.mode("overwrite").parquet(guard.runs.beside((0, 1)))
    guard(spark.range(90, 110), 1)
    assert guard.results().count() == 110


def test_an_empty_batch_is_a_batch(spark, tmp_path):
    guard = RedeliveryGuard(spark, str(tmp_path), recent=1)
    empty = spark.createDataFrame([], DELIVERY)
    guard(empty, 0)
    guard(spark.createDataFrame([("a", "L", 1.0, "x")], DELIVERY), 1)
    guard(empty, 2)
    assert guard.results().count() == 1
