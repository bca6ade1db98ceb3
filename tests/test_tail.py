"""Growing journals: whole lines only, shrunk files, bounded batches, and watches that answer at once."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from assayframe.operators import progress
from assayframe.sources import journal as J
from assayframe.sources import journal_tail as T
from assayframe.streaming import online as O


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def collector(seen):
    def collect(batch, batch_id):
        rows = batch.collect()
        if rows:
            seen.append(sorted(rows, key=lambda r: r["ordinal"]))

    return collect


def follow(stream, seen, checkpoint):
    return stream.writeStream.foreachBatch(collector(seen)).option("checkpointLocation", checkpoint).start()


def test_a_half_written_line_waits_and_a_shrunk_file_starts_again(spark, tmp_path):
    file, seen = tmp_path / "journal.jsonl", []
    file.write_text('{"ligand_id": "A"}\n{"ligand_id": "B')
    query = follow(T.tail_journal(spark, str(file), str(tmp_path / "pos")), seen, str(tmp_path / "c"))
    try:
        query.processAllAvailable()
        assert [r["ligand_id"] for b in seen for r in b] == ["A"]
        with file.open("a") as f:
            f.write('2"}\n\nnot json\n{"ligand_id": "C"}\n{"lig')
        query.processAllAvailable()
        assert [r["ligand_id"] for b in seen for r in b] == ["A", "B2", "C"]
        file.write_text('{"ligand_id": "Z"}\n')
        query.processAllAvailable()
        assert [r["ligand_id"] for b in seen for r in b] == ["A", "B2", "C", "Z"]
        with file.open("a") as f:
            f.write('{"ligand_id": "Y"}\n')
        query.processAllAvailable()
    finally:
        query.stop()
    got = [r for b in seen for r in b]
    assert [r["ligand_id"] for r in got] == ["A", "B2", "C", "Z", "Y"]
    assert [r["ordinal"] for r in got] == sorted({r["ordinal"] for r in got})


def test_nothing_there_yet_is_an_empty_journal(spark, tmp_path):
    seen, folder = [], tmp_path / "run"
    query = follow(T.tail_journal(spark, str(folder), str(tmp_path / "pos")), seen, str(tmp_path / "c"))
    try:
        query.processAllAvailable()
        assert not seen
        folder.mkdir()
        (folder / "_hidden").write_text('{"ligand_id": "no"}\n')
        (folder / "b.jsonl").write_text('{"ligand_id": "B"}\n')
        (folder / "a.jsonl").write_text('{"ligand_id": "A"}\n')
        query.processAllAvailable()
    finally:
        query.stop()
    assert [[r["ligand_id"] for r in b] for b in seen] == [["A", "B"]]


def test_batches_hold_no_more_records_than_asked(spark, tmp_path):
    file, seen = tmp_path / "journal.jsonl", []
    file.write_text(lines({"ligand_id": f"L{i}"} for i in range(100)) + "\n\n")
    O.drain(T.tail_journal(spark, str(file), str(tmp_path / "pos"), max_records=7), collector(seen), str(tmp_path / "c"))
    assert [len(b) for b in seen] == [7] * 14 + [2]
    assert [r["ligand_id"] for b in seen for r in b] == [f"L{i}" for i in range(100)]


def test_a_restart_goes_on_within_the_bound(spark, tmp_path):
    file, seen = tmp_path / "journal.jsonl", []
    options = {"max_records": 5, "position": str(tmp_path / "deep" / "tail.json")}
    rows = [{"ligand_id": f"L{i}"} for i in range(40)]
    file.write_text(lines(rows[:12]))
    O.drain(T.tail_journal(spark, str(file), **options), collector(seen), str(tmp_path / "c"))
    with file.open("a") as f:
        f.write(lines(rows[12:]))
    O.drain(T.tail_journal(spark, str(file), **options), collector(seen), str(tmp_path / "c"))
    assert [r["ligand_id"] for b in seen for r in b] == [r["ligand_id"] for r in rows]
    assert max(map(len, seen)) == 5
    # A lost or foreign position neither repeats nor skips lines unseen.
    (tmp_path / "deep" / "tail.json").unlink()
    with pytest.raises(Exception, match="lies behind this query"):
        O.drain(T.tail_journal(spark, str(file), **options), collector(seen), str(tmp_path / "c"))


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_ranges_give_every_line_once(tmp_path, size):
    rng = random.Random(size)
    text = "".join("é" * rng.randint(0, 30) + "\n" for _ in range(60)) + "half"
    file = tmp_path / "x"
    file.write_bytes(text.encode())
    reader = T.TailReader({"path": str(file), "range_bytes": str(size), "position": str(tmp_path / "pos")})
    start = reader.initialOffset()
    end = reader.latestOffset()
    got = [(o, x) for p in reader.partitions(start, end) for b in reader.read(p) for x, o in zip(b["line"].to_pylist(), b["ordinal"].to_pylist())]
    want, at = [], 0
    for line in text.encode().split(b"\n")[:-1]:
        if line:
            want.append((at, line.decode()))
        at += len(line) + 1
    assert got == want


def test_tail_equals_reading_the_journal_at_the_end(spark, tmp_path):
    folder, seen, rng = tmp_path / "journal", [], random.Random(3)
    folder.mkdir()
    query = follow(T.tail_journal(spark, str(folder), str(tmp_path / "pos"), max_records=50), seen, str(tmp_path / "c"))
    try:
        for k in range(4):
            for name in ("a.jsonl", "b.jsonl"):
                with (folder / name).open("a") as f:
                    f.write(lines({"run_id": name, "ligand_id": f"{k}-{i}", "status": rng.choice(["ok", "failed"])} for i in range(rng.randint(0, 60))))
            query.processAllAvailable()
    finally:
        query.stop()
    want = {(r["run_id"], r["ligand_id"], r["status"]) for r in J.read_journal(spark, str(folder)).collect()}
    got = [(r["run_id"], r["ligand_id"], r["status"]) for b in seen for r in b]
    assert set(got) == want and len(got) == len(want) and max(map(len, seen)) <= 50


def kinds(n, seed):
    rng = random.Random(seed)
    return [
        {"run_id": rng.choice(["hot", "hot", "r1", "r2"]), "ligand_id": f"L{i}", "error_kind": rng.choice(["setup", "setup", "setup", "ligand", None])}
        for i in range(n)
    ]


def test_the_breaker_stops_in_the_batch_that_reaches_the_limit(spark, tmp_path):
    file, rows = tmp_path / "journal.jsonl", kinds(90, 5)
    file.write_text(lines(rows))
    stream = O.stops(T.tail_journal(spark, str(file), str(tmp_path / "pos"), max_records=10), limit=3)
    got = {(r["batch"], r["run_id"], r["event"], r["detail"]) for r in O.drain_table(stream, str(tmp_path / "w")).collect()}
    want, run = set(), {}
    for i, r in enumerate(rows):
        run[r["run_id"]] = run.get(r["run_id"], 0) + 1 if r["error_kind"] == "setup" else 0
        if run[r["run_id"]] == 3:
            want.add((i // 10, r["run_id"], "stop", "3"))
    assert got == want and len(want) > 3


def test_terminal_states_are_told_once_and_at_once(spark, tmp_path):
    file = tmp_path / "states.jsonl"
    steps = ["running", "failed", "failed", "running", "finished", "finished", "cancelled"]
    file.write_text(lines({"run_id": r, "state": s} for s in steps for r in ("a", "b")))
    state = F.from_json("line", "run_id string, state string")
    states = T.tail_lines(spark, str(file), str(tmp_path / "pos"), max_records=2).select("ordinal", state.alias("j")).select("ordinal", "j.*")
    got = sorted((r["batch"], r["run_id"], r["detail"]) for r in O.drain_table(O.entries(states), str(tmp_path / "w")).collect())
    assert got == [(k, r, s) for k, s in ((1, "failed"), (4, "finished"), (6, "cancelled")) for r in ("a", "b")]


def test_records_behind_a_judged_one_are_reported(spark, tmp_path):
    for k, at in enumerate([5, 3, 9]):
        file = tmp_path / f"{k}.json"
        file.write_text(json.dumps({"run_id": "a", "ordinal": at, "error_kind": "setup"}) + "\n")
        os.utime(file, (1000 + k, 1000 + k))
    stream = spark.readStream.schema("run_id string, ordinal bigint, error_kind string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = sorted((r["ordinal"], r["event"]) for r in O.drain_table(O.stops(stream, limit=2), str(tmp_path / "w")).collect())
    assert got == [(3, "late"), (9, "stop")]


def test_status_of_a_tailed_journal(spark, tmp_path):
    rows = kinds(60, 8)
    for r in rows:
        r["status"] = "failed" if r["error_kind"] else "ok"
    (tmp_path / "j.jsonl").write_text(lines(rows))
    latest = {}

    def keep(batch, _):
        latest.update({r["run_id"]: (r["completed"], r["failed"]) for r in batch.collect()})

    counts = progress.status_counts(T.tail_journal(spark, str(tmp_path / "j.jsonl"), str(tmp_path / "pos"), max_records=25), ["run_id"])
    O.drain(counts, keep, str(tmp_path / "c"), "update")
    assert latest == {k: (sum(r["run_id"] == k and not r["error_kind"] for r in rows), sum(r["run_id"] == k and bool(r["error_kind"]) for r in rows)) for k in {r["run_id"] for r in rows}}


def test_portions_are_the_same_however_many_a_batch_takes(spark, tmp_path):
    folder, rng = tmp_path / "journal", random.Random(11)
    folder.mkdir()
    for name in "abcde":
        text = "".join(rng.choice(["", " \t\n", "\n\n"]) + "x" * rng.randint(1, 40) + "\n" for _ in range(rng.choice([0, 3, 40, 57])))
        (folder / name).write_text(text + rng.choice(["", "\n \n", "half"]))
    got = {}
    for portions in (1, 3, 1000):
        seen, at = [], tmp_path / f"at{portions}"
        stream = T.tail_lines(spark, str(folder), str(at), max_records=7, range_bytes=100, portions=portions)
        O.drain(stream, collector(seen), str(tmp_path / f"c{portions}"))
        got[portions] = [(r["ordinal"], r["line"], r["portion"]) for b in seen for r in b]
        assert max(map(len, seen)) <= 7 * portions
        if portions == 1000:
            assert len(seen) == 1
    assert got[1] == got[3] == got[1000]
    assert [p for _, _, p in got[1]] == [i // 7 for i in range(len(got[1]))]


def test_portions_go_on_after_an_answer_without_a_batch(tmp_path):
    file = tmp_path / "x"
    file.write_text("".join(f"{i}\n" for i in range(40)))
    options = {"path": str(file), "position": str(tmp_path / "pos"), "max_records": "3", "portions": "4"}
    first = T.TailReader(options)
    start = first.initialOffset()
    lost = first.latestOffset()
    end = T.TailReader(options).latestOffset()
    assert T.TailReader(options).latestOffset()["portion"] == 12
    for since, to, rows in ((start, lost, range(12)), (start, end, range(24)), (lost, end, range(12, 24))):
        reader = T.TailReader(options)
        out = [b for p in reader.partitions(since, to) for b in reader.read(p)]
        lines = [int(x) for b in out for x in b["line"].to_pylist()]
        assert lines == list(rows)
        assert [x for b in out for x in b["portion"].to_pylist()] == [i // 3 for i in rows]


def test_a_tail_at_its_end_answers_the_same_again(tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a").write_text("1\n2\n3\n")
    options = {"path": str(tmp_path / "j"), "position": str(tmp_path / "pos"), "max_records": "3", "portions": "4"}
    reader = T.TailReader(options)
    end = reader.latestOffset()
    (tmp_path / "j" / "a").open("a").write("half")
    assert json.dumps(reader.latestOffset()) == json.dumps(end) == json.dumps(T.TailReader(options).latestOffset())


def test_watches_tell_the_portion_when_far_behind(spark, tmp_path):
    file, rows = tmp_path / "journal.jsonl", kinds(90, 5)
    file.write_text(lines(rows))
    told = []
    for portions in (1, 4, 50):
        stream = O.stops(T.tail_journal(spark, str(file), str(tmp_path / f"p{portions}"), max_records=10, portions=portions), limit=3)
        told.append(sorted(tuple(r) for r in O.drain_table(stream, str(tmp_path / f"w{portions}")).collect()))
        batches = [f for f in os.listdir(tmp_path / f"w{portions}" / "checkpoint" / "commits") if f.isdigit()]
        assert len(batches) <= -(-9 // portions) + 1
    assert told[0] == told[1] == told[2] and len(told[0]) > 3
