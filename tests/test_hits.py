from __future__ import annotations

import json

from pyspark.sql import functions as F

from assayframe.operators import hits, progress
from assayframe.plans.report import report
from assayframe.schemas import ALL_MODES_COLUMNS, MANIFEST_SCHEMA, RESULT_COLUMNS
from assayframe.sources import journal as J
from assayframe.sources import manifest as M
from assayframe.sources.synthetic import synthetic_journal


def write_journal(path, *records, tail=""):
    path.mkdir(exist_ok=True)
    (path / "part-0.json").write_text("".join(json.dumps(r) + "\n" for r in records) + tail)
    return str(path)


def ok(ligand, *affinities, **more):
    modes = [{"mode": i, "affinity": a} for i, a in enumerate(affinities, 1)]
    return {"ligand_id": ligand, "status": "ok", "seed": 1, "modes": modes, **more}


def failed(ligand, kind=None, **more):
    row = {"ligand_id": ligand, "status": "failed", "seed": 1, "error": "broke", **more}
    return {**row, "error_kind": kind} if kind else row


def manifest(spark, *rows):
    full = [{f: None for f in MANIFEST_SCHEMA.fieldNames()} | r for r in rows]
    names = MANIFEST_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], MANIFEST_SCHEMA)


def test_broken_lines_are_left_out(spark, tmp_path):
    path = write_journal(
        tmp_path / "j", ok("A", -7.0), failed("B"), tail='garbage\n{"status":"ok"}\n\n[1]\n{"ligand_id":"C","sta'
    )
    rows = J.read_journal(spark, path).orderBy("ordinal").collect()
    assert [r["ligand_id"] for r in rows] == ["A", "B"]
    assert rows[1]["modes"] == [] and rows[1]["error_kind"] is None


def test_round_trip_and_defaults(spark, tmp_path):
    run = synthetic_journal(spark, 40, seed=3)
    J.append_journal(run, str(tmp_path / "j"))
    back = J.read_journal(spark, str(tmp_path / "j"))
    want = {r["ligand_id"]: r for r in J.to_wire(run).collect()}
    for r in back.collect():
        w = want[r["ligand_id"]]
        assert (r["status"], r["seed"], r["elapsed_s"], r["error"]) == (
            w["status"], w["seed"], w["elapsed_s"], w["error"])
        assert r["modes"] == (w["modes"] or [])
    path = write_journal(tmp_path / "old", {"ligand_id": "A", "modes": [{"mode": 1, "affinity": -1}]})
    row = J.read_journal(spark, path).first()
    assert (row["status"], row["elapsed_s"], row["timestamp"]) == ("ok", 0.0, 0.0)
    assert tuple(row["modes"][0]) == (1, -1.0, 0.0, 0.0)


def test_ranking_and_efficiency(spark, tmp_path):
    path = write_journal(tmp_path / "j", ok("A", -7.0), ok("B", -3.0, -9.5), failed("D"), ok("C", -5.0))
    known = manifest(spark, {"ligand_id": "B", "compound_id": "B", "heavy_atoms": 25})
    rows = hits.ranked_hits(J.read_journal(spark, path), known).orderBy("rank").collect()
    assert [(r["rank"], r["ligand_id"], r["best_affinity"]) for r in rows] == [
        (1, "B", -9.5), (2, "A", -7.0), (3, "C", -5.0), (4, "D", None)]
    assert rows[0]["ligand_efficiency"] == -0.38 and rows[1]["ligand_efficiency"] is None
    assert tuple(rows[0].asDict()) == RESULT_COLUMNS
    coverage = hits.join_coverage(J.read_journal(spark, path), known).first()
    assert (coverage["matched"], coverage["total"]) == (1, 4)


def test_variants_collapse_to_the_best(spark, tmp_path):
    path = write_journal(
        tmp_path / "j", ok("CPD", -7.0), ok("CPD_2", -9.5), ok("CPD_3", -6.0), failed("CPD_4"), failed("X"),
        ok("T1", -6.0), ok("T2", -6.0),
    )
    rows = [{"ligand_id": i, "compound_id": "CPD"} for i in ("CPD", "CPD_2", "CPD_3", "CPD_4")]
    rows += [{"ligand_id": i, "compound_id": "T"} for i in ("T1", "T2")]
    got = hits.ranked_hits(J.read_journal(spark, path), manifest(spark, *rows)).orderBy("rank")
    assert [(r["compound_id"], r["ligand_id"], r["n_variants"]) for r in got.collect()] == [
        ("CPD", "CPD_2", 4), ("T", "T1", 2), ("X", "X", 1)]


def test_ties_rank_by_first_sight_of_the_compound(spark, tmp_path):
    # P is seen first, but its winning variant comes after Q's.
    path = write_journal(tmp_path / "j", ok("P1", -1.0), ok("Q1", -5.0), ok("P2", -5.0))
    rows = [{"ligand_id": i, "compound_id": i[0]} for i in ("P1", "P2", "Q1")]
    got = hits.ranked_hits(J.read_journal(spark, path), manifest(spark, *rows)).orderBy("rank")
    assert [r["compound_id"] for r in got.collect()] == ["P", "Q"]


def test_sixty_four_variants(spark, tmp_path):
    records = [ok(f"BIG_{i}", -9.0 - i / 100) for i in range(64)] + [ok("OTHER", -8.9)]
    path = write_journal(tmp_path / "j", *records)
    known = manifest(spark, *[{"ligand_id": f"BIG_{i}", "compound_id": "BIG"} for i in range(64)])
    journal = J.read_journal(spark, path)
    grouped = hits.ranked_hits(journal, known).orderBy("rank").collect()
    assert [(r["compound_id"], r["best_affinity"], r["n_variants"]) for r in grouped] == [
        ("BIG", -9.63, 64), ("OTHER", -8.9, 1)]
    assert hits.ranked_hits(journal, known, group_variants=False).count() == 65


def test_setup_failure_then_success(spark, tmp_path):
    path = write_journal(
        tmp_path / "j", failed("A", "setup"), failed("B", "setup"), ok("A", -5.0), failed("C", "ligand"), failed("D")
    )
    journal = J.read_journal(spark, path)
    assert {r[0] for r in progress.completed_ids(journal).collect()} == {"A", "C", "D"}
    assert {r[0] for r in progress.retryable_ids(journal).collect()} == {"B"}
    known = manifest(spark)
    both = hits.ranked_hits(journal, known).where("ligand_id = 'A'").first()
    once = hits.ranked_hits(journal, known, latest_only=True).where("ligand_id = 'A'").first()
    assert (both["n_variants"], once["n_variants"]) == (2, 1)
    retries = {p: progress.finished_ids(journal, p).count() for p in progress.RETRY_POLICIES}
    assert retries == {"never": 4, "setup_only": 3, "all": 1}


def test_report_files(spark, tmp_path):
    path = write_journal(tmp_path / "j", ok("A", -7.25, -6.0, seed=None), failed("B"))
    report(spark, path, str(tmp_path / "out"))
    results = spark.read.csv(str(tmp_path / "out/results"), header=True)
    modes = spark.read.csv(str(tmp_path / "out/all_modes"), header=True)
    assert tuple(results.columns) == RESULT_COLUMNS and results.count() == 2
    assert tuple(modes.columns) == ALL_MODES_COLUMNS
    assert [tuple(r) for r in modes.orderBy("Mode").collect()] == [
        ("A", "1", "-7.25", "0.000", "0.000", None), ("A", "2", "-6.0", "0.000", "0.000", None)]


def test_report_of_an_empty_journal_has_headers(spark, tmp_path):
    path = write_journal(tmp_path / "j")
    report(spark, path, str(tmp_path / "out"))
    for name, columns in (("results", RESULT_COLUMNS), ("all_modes", ALL_MODES_COLUMNS)):
        text = "".join(p.read_text() for p in (tmp_path / "out" / name).glob("*.csv"))
        assert text.strip() == ",".join(columns)


def test_manifest_round_trip_last_wins(spark, tmp_path):
    rows = manifest(
        spark,
        {"ligand_id": "A", "compound_id": "X", "pdbqt": ["a", "c"], "mw": 1.5, "warnings": ["w1", "w2"]},
        {"ligand_id": "B", "compound_id": 'say "hi", you', "heavy_atoms": 3},
    )
    M.write_manifest(rows.coalesce(1), str(tmp_path / "m"))
    again = next((tmp_path / "m").glob("*.csv"))
    for checksum in (tmp_path / "m").glob(".*.crc"):
        checksum.unlink()
    with open(again, "a") as fh:
        fh.write("A,Y" + "," * 18 + "\n,ghost" + "," * 18 + "\n")
    got = {r["ligand_id"]: r for r in M.read_manifest(spark, str(tmp_path / "m")).collect()}
    assert set(got) == {"A", "B"}
    assert got["A"]["compound_id"] == "Y" and got["A"]["mw"] is None
    assert got["B"]["compound_id"] == 'say "hi", you' and got["B"]["heavy_atoms"] == 3


def test_find_manifest(spark, tmp_path):
    (tmp_path / "lib/pdbqt").mkdir(parents=True)
    assert M.find_manifest(spark, str(tmp_path / "lib/pdbqt")) is None
    (tmp_path / "lib/manifest.csv").write_text("ligand_id\n")
    for place in ("lib", "lib/pdbqt"):
        assert M.find_manifest(spark, str(tmp_path / place)).endswith("lib/manifest.csv")
    assert M.find_manifest(spark, None, str(tmp_path / "lib")).endswith("lib/manifest.csv")


def test_sorting_keeps_missing_together(spark):
    rows = spark.createDataFrame([("a", 1.0, 0), ("b", None, 1), ("c", -10.2, 2), ("d", -9.1, 3)],
                                 "ligand_id string, best_affinity double, ordinal int")
    up = [r[0] for r in hits.sort_rows(rows, "rank").select("ligand_id").collect()]
    down = [r[0] for r in hits.sort_rows(rows, "best_affinity", True).select("ligand_id").collect()]
    assert (up, down) == (["c", "d", "a", "b"], ["b", "a", "d", "c"])


def test_hit_list_does_not_depend_on_partitions(spark):
    known = spark.range(2000).select(
        F.concat(F.lit("LIG"), (F.col("id") + 1).cast("string")).alias("ligand_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("compound_id"),
    )
    seen = []
    for partitions in (1, 5, 40):
        journal = synthetic_journal(spark, 2000, seed=9).repartition(partitions)
        rows = hits.ranked_hits(journal, known).orderBy("rank").collect()
        assert len(rows) == 51 and sum(r["n_variants"] for r in rows) == 2000
        seen.append([tuple(r) for r in rows])
    assert seen[0] == seen[1] == seen[2]


def test_synthetic_run_shape(spark):
    run = synthetic_journal(spark, 3000, seed=1)
    rows = run.collect()
    assert rows == synthetic_journal(spark, 3000, seed=1).repartition(13).orderBy("ordinal").collect()
    bad = [r for r in rows if r["status"] == "failed"]
    assert 30 < len(bad) < 95 and all(r["modes"] == [] for r in bad)
    best = [r["modes"][0]["affinity"] for r in rows if r["modes"]]
    assert abs(sum(best) / len(best) + 6.5) < 0.1
    for r in rows:
        values = [m["affinity"] for m in r["modes"]]
        assert values == sorted(values)
    assert synthetic_journal(spark, 100, complete=False).count() == 60
