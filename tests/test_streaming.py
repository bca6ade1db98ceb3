from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from assayframe.operators import hits, progress
from assayframe.plans.report import empty_manifest
from assayframe.sources import journal as J
from assayframe.streaming import journal_stream as S


def publish(folder, number, rows, tail=""):
    """One whole journal file, made visible by a rename."""
    folder.mkdir(exist_ok=True)
    hidden = folder / f".{number}.tmp"
    hidden.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)
    hidden.rename(folder / f"part-{number:03d}.json")


def records(n, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["ok", "ok", "setup", "setup", "setup", "ligand"])
        row = {"run_id": "hot" if rng.random() < 0.5 else f"r{rng.randrange(4)}", "ligand_id": f"L{i}",
               "status": "ok" if kind == "ok" else "failed", "timestamp": float(i)}
        if kind == "ok":
            row["modes"] = [{"mode": 1, "affinity": -rng.random()}]
        else:
            row["error_kind"] = kind
        out.append(row)
    return out


def test_stream_equals_batch_on_the_same_files(spark, tmp_path):
    folder, rows = tmp_path / "journal", records(240)
    for f in range(4):
        publish(folder, f, rows[f * 60:(f + 1) * 60], tail='{"ligand_id": "half' if f == 1 else "")
    stream = S.stream_journal(spark, str(folder), max_files=1)
    counts = S.newest(S.drain_to_table(S.stream_status(stream), "update"), "run_id")
    batch = progress.status_counts(J.read_journal(spark, str(folder)))
    columns = ["run_id", "completed", "failed", "skipped"]
    assert sorted(map(tuple, counts.select(columns).collect())) == sorted(
        map(tuple, batch.select(columns).collect())
    )


def test_streaks_carry_over_micro_batches(spark, tmp_path):
    folder, rows = tmp_path / "journal", records(240, 7)
    for f in range(6):
        publish(folder, f, rows[f * 40:(f + 1) * 40])
    stream = S.stream_journal(spark, str(folder), max_files=1).withColumn(
        "ordinal", F.col("timestamp").cast("bigint")
    )
    watch = S.StreakWatch(spark, str(tmp_path / "watch"), partitions=16)
    watch.limit = 3
    S.catch_up(stream, watch, str(tmp_path / "ckpt"))
    want, run = set(), {}
    for i, r in enumerate(rows):
        run[r["run_id"]] = run.get(r["run_id"], 0) + 1 if r.get("error_kind") == "setup" else 0
        if run[r["run_id"]] == 3:
            want.add((r["run_id"], i))
    assert {(r["run_id"], r["ordinal"]) for r in watch.results().collect()} == want
    assert len(want) > 3


def test_terminal_states_are_reported_once(spark, tmp_path):
    steps = ["running", "running", "failed", "failed", "running", "finished", "finished"]
    for f, state in enumerate(steps):
        publish(tmp_path / "runs", f, [{"run_id": "a", "state": state, "ordinal": f}, {"run_id": "b", "state": "running", "ordinal": f}])
    stream = (
        spark.readStream.schema("run_id string, state string, ordinal bigint")
        .option("maxFilesPerTrigger", 2).json(str(tmp_path / "runs"))
    )
    watch = S.TransitionWatch(spark, str(tmp_path / "watch"))
    S.catch_up(stream, watch, str(tmp_path / "ckpt"))
    got = sorted((r["ordinal"], r["run_id"], r["state"]) for r in watch.results().collect())
    assert got == [(2, "a", "failed"), (5, "a", "finished")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_watches_do_not_depend_on_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = [rng.choice(["setup", "setup", None]) for _ in range(60)]
    states = [rng.choice(["running", "failed", "finished"]) for _ in range(60)]
    rows = [{"run_id": f"r{i % 2}", "ordinal": i * i, "error_kind": k, "state": s} for i, (k, s) in enumerate(zip(kinds, states, strict=True))]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, 60), 5))
    for f, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60], strict=True)):
        publish(tmp_path / "in", f, rows[a:b])
    stream = (
        spark.readStream.schema("run_id string, ordinal bigint, error_kind string, state string")
        .option("maxFilesPerTrigger", 1 + seed % 2).json(str(tmp_path / "in"))
    )
    stops, moves = S.StreakWatch(spark, str(tmp_path / "a"), partitions=8), S.TransitionWatch(spark, str(tmp_path / "b"), partitions=8)
    stops.limit = 2
    S.catch_up(stream, stops, str(tmp_path / "ca"))
    S.catch_up(stream, moves, str(tmp_path / "cb"))
    want_stops, want_moves, run, last = set(), set(), {}, {}
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        key = r["run_id"]
        run[key] = run.get(key, 0) + 1 if r["error_kind"] else 0
        if run[key] == 2:
            want_stops.add((key, r["ordinal"]))
        if r["state"] != "running" and r["state"] != last.get(key):
            want_moves.add((key, r["ordinal"], r["state"]))
        last[key] = r["state"]
    assert {(r["run_id"], r["ordinal"]) for r in stops.results().collect()} == want_stops
    assert {(r["run_id"], r["ordinal"], r["state"]) for r in moves.results().collect()} == want_moves


def test_late_first_deliveries_pass(spark, tmp_path):
    times = [2e6, 1.5e6, 1e6, 2.000001e6, 1.6e6, 1e6]
    for f, t in enumerate(times):
        publish(tmp_path / "in", f, [{"run_id": "r", "ligand_id": "A", "timestamp": t}])
    stream = S.stream_journal(spark, str(tmp_path / "in"), max_files=1).select("run_id", "ligand_id", "timestamp")
    got = S.drain_to_table(S.without_redelivery(stream)).collect()
    assert sorted(r["timestamp"] for r in got) == sorted(set(times))


def test_catch_up_then_follow_reads_each_file_once(spark, tmp_path):
    folder, seen = tmp_path / "journal", []

    def collect(batch, batch_id):
        seen.extend(r["ligand_id"] for r in batch.select("ligand_id").collect())

    publish(folder, 0, [{"ligand_id": "A"}])
    query = S.follow(S.stream_journal(spark, str(folder)), collect, str(tmp_path / "ckpt"), "200 milliseconds")
    try:
        assert seen == ["A"]
        publish(folder, 1, [{"ligand_id": "B"}])
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == ["A", "B"]


def test_incremental_report_equals_a_report_at_the_end(spark, tmp_path):
    folder, rows = tmp_path / "journal", records(80, 2)
    nothing = empty_manifest(spark)
    publish(folder, 0, rows[:40])
    part = hits.ranked_hits(J.read_journal(spark, str(folder)), nothing)
    assert part.count() == 40
    publish(folder, 1, rows[40:])
    whole = hits.ranked_hits(J.read_journal(spark, str(folder)), nothing)
    assert [r["rank"] for r in whole.orderBy("rank").collect()] == list(range(1, 81))
