from __future__ import annotations

import hashlib
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from assayframe.operators import batchmap, digests, drift, timing
from assayframe.plans import benchmark, prepare, provenance, regression, screen
from assayframe.plans.report import report
from assayframe.schemas import PrepConfig, ScreenConfig
from assayframe.sources import journal as J
from assayframe.sources import runs, structures
from assayframe.sources.library import read_library

# User functions of this file travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMILES = "CCO ethanol\nc1ccccc1 benzene\nCC(=O)O acid\nXX bad\nCCCCCCCCCC floppy\nN1 lost\n"
CONFIG = ScreenConfig(receptor="r.pdbqt", center=(0.0, 0.0, 0.0), size=(20.0, 20.0, 20.0), seed=42)


def parse(record, config):
    if record["block"].startswith("XX"):
        raise ValueError("cannot parse")
    size = len(record["block"])
    return {
        "smiles": record["block"], "formula": f"C{size}", "mw": size * 12.0, "heavy_atoms": size,
        "rot_bonds": size - 1, "clogp": 0.5, "tpsa": 1.0, "hbd": 0, "hba": 0, "formal_charge": 0,
        "rings": 0, "aromatic_rings": 0, "fraction_csp3": 0.0,
    }


def embed(record, config):
    if record["block"].startswith("N1"):
        raise ValueError("no geometry")
    return {"geometry": record["smiles"]}


def write_text(record, config):
    n = max(1, config["n_conformers"])
    return {
        "texts": [f"{record['smiles']} conf {i}\nTORSDOF 3" for i in range(n)],
        "torsions": 33 if record["ligand_id"] == "acid" else 3, "prepared_charge": 0,
    }


DESCRIBE = [("parse", parse)]
BUILD = [("embed", embed), ("pdbqt", write_text)]


class LengthScorer:
    def __init__(self, config):
        self.n = config["n_modes"]

    def score(self, ligand_id, text, seed, want_poses):
        if ligand_id.startswith("bad"):
            raise batchmap.ScoringError("could not load ligand")
        if ligand_id.startswith("odd"):
            raise KeyError("x" * 500)
        best = -float(len(text))
        return [(best + i, float(i), float(i)) for i in range(self.n)], f"POSE {seed}" if want_poses else None


def broken(config):
    raise batchmap.ScoringError("cannot find affinity maps", setup=True)


def ligands(spark, *names):
    return spark.createDataFrame([(n, "x" * (i + 1)) for i, n in enumerate(names)], "ligand_id string, text string")


def test_prepare_then_screen_then_report(spark, tmp_path):
    (tmp_path / "lib.smi").write_text(SMILES)
    library = read_library(spark, str(tmp_path / "lib.smi"))
    out = str(tmp_path / "prep")
    config = PrepConfig(seed=42, max_torsions=8, n_conformers=2)
    first = prepare.prepare(spark, library, out, DESCRIBE, BUILD, config, limit=3).first()
    assert (first["total"], first["prepared"], first["failed"], first["skipped"]) == (3, 3, 0, 0)
    again = prepare.prepare(spark, library, out, DESCRIBE, BUILD, config, limit=3).first()
    assert (again["prepared"], again["skipped"]) == (0, 3)
    rest = prepare.prepare(spark, library, out, DESCRIBE, BUILD, config).first()
    assert (rest["total"], rest["prepared"], rest["failed"], rest["skipped"]) == (6, 0, 3, 3)
    failures = {r["ligand_id"]: r for r in spark.read.parquet(f"{out}/failures").collect()}
    assert failures["bad"]["stage"] == "parse" and failures["bad"]["error"] == "cannot parse"
    assert failures["lost"]["stage"] == "embed"
    assert prepare.prep_progress(spark, out) == (3, 3)
    manifest = prepare.prepared_table(spark, out, "manifest")
    rows = {r["ligand_id"]: r for r in manifest.collect()}
    assert rows["ethanol"]["pdbqt"] == ["ethanol_c1.pdbqt", "ethanol_c2.pdbqt"]
    assert "33 active torsions" in rows["acid"]["warnings"][0]
    prepared = prepare.prepared_table(spark, out, "ligands").where("conformer = 1")
    status = screen.screen(spark, prepared, str(tmp_path / "run"), CONFIG, LengthScorer, waves=2).first()
    assert (status["state"], status["completed"], status["failed"], status["total"]) == ("finished", 3, 0, 3)
    ranked = report(spark, str(tmp_path / "run/journal"), str(tmp_path / "out"), manifest).orderBy("rank").collect()
    assert [r["ligand_id"] for r in ranked] == ["benzene", "acid", "ethanol"]
    assert ranked[0]["n_modes"] == 9 and ranked[0]["mw"] == 96.0
    poses = spark.read.parquet(str(tmp_path / "run/poses")).collect()
    assert len(poses) == 3 and all(p["poses"].startswith("POSE ") for p in poses)


@pytest.mark.parametrize(
    ("retry", "tried"), [("never", set()), ("setup_only", {"lost"}), ("all", {"bad", "floppy", "lost"})]
)
def test_resumed_preparation_tries_failures_by_policy(spark, tmp_path, retry, tried):
    (tmp_path / "lib.smi").write_text(SMILES)
    library = read_library(spark, str(tmp_path / "lib.smi"))
    out = str(tmp_path / "prep")

    def place(record, config):
        if record["block"].startswith("N1"):
            raise batchmap.ScoringError("no force field", setup=True)
        return {"geometry": record["smiles"]}

    build = [("embed", place), ("pdbqt", write_text)]
    config = PrepConfig(max_torsions=8)
    first = prepare.prepare(spark, library, out, DESCRIBE, build, config).first()
    assert (first["prepared"], first["failed"], first["skipped"]) == (3, 3, 0)
    kinds = {r["ligand_id"]: r["error_kind"] for r in spark.read.parquet(f"{out}/failures").collect()}
    assert kinds == {"bad": "ligand", "floppy": "ligand", "lost": "setup"}
    again = prepare.prepare(spark, library, out, DESCRIBE, BUILD, config, retry=retry).first()
    assert (again["total"], again["prepared"], again["failed"]) == (6, 0, len(tried))
    assert again["skipped"] == 6 - len(tried)
    assert spark.read.parquet(f"{out}/failures").count() == 3 + len(tried)
    with pytest.raises(ValueError, match="unknown retry policy"):
        prepare.prepare(spark, library, out, DESCRIBE, BUILD, config, retry="sometimes")


def test_torsion_limit_rejects_before_building(spark, tmp_path):
    (tmp_path / "lib.smi").write_text(SMILES)
    library = read_library(spark, str(tmp_path / "lib.smi"))
    out = str(tmp_path / "prep")
    prepare.prepare(spark, library, out, DESCRIBE, BUILD, PrepConfig(max_torsions=8))
    stages = {r["ligand_id"]: r["stage"] for r in spark.read.parquet(f"{out}/failures").collect()}
    assert stages == {"bad": "parse", "floppy": "filter", "lost": "embed"}


def test_failures_are_rows_and_resume_skips_them(spark, tmp_path):
    run = str(tmp_path / "run")
    names = ("a", "bad1", "odd1", "b")
    screen.screen(spark, ligands(spark, *names), run, CONFIG, LengthScorer, limit=3)
    rows = {r["ligand_id"]: r for r in J.read_journal(spark, f"{run}/journal").collect()}
    assert set(rows) == {"a", "b", "bad1"}
    status = screen.screen(spark, ligands(spark, *names), run, CONFIG, LengthScorer).first()
    assert (status["completed"], status["failed"], status["done"]) == (2, 2, 4)
    rows = J.read_journal(spark, f"{run}/journal").orderBy("ordinal").collect()
    assert len(rows) == 4
    odd = next(r for r in rows if r["ligand_id"] == "odd1")
    assert odd["error"].startswith("KeyError: ") and len(odd["error"]) == 260
    assert odd["error_kind"] == "ligand" and odd["seed"] == 42
    assert [r["run_id"] for r in rows] == ["run"] * 4


def test_failed_setup_stops_the_run_and_is_retried(spark, tmp_path):
    run = str(tmp_path / "run")
    rows = ligands(spark, *[f"l{i}" for i in range(12)])
    with pytest.raises(screen.SetupFailure, match="affinity maps"):
        screen.screen(spark, rows, run, CONFIG, broken)
    assert runs.read_runs(spark, f"{run}/runs").first()["state"] == "failed"
    status = screen.screen(spark, rows, run, CONFIG, LengthScorer).first()
    assert (status["state"], status["completed"], status["failed"], status["eta_s"]) == ("finished", 12, 0, None)


def test_configurations_are_checked_first(spark, tmp_path):
    for wrong in ({"engine": "autodock4"}, {"engine": "x"}, {"n_modes": 0}, {"parameter_file": "p"}, {"size": (0, 1, 1)}):
        bad = ScreenConfig(**{**CONFIG.to_dict(), **wrong})
        with pytest.raises(ValueError):
            screen.screen(spark, ligands(spark, "a"), str(tmp_path / "x"), bad, LengthScorer)


def test_newer_layout_is_refused(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"run_id":"r","schema_version":2}\n')
    with pytest.raises(Exception, match="newer layout"):
        runs.read_runs(spark, str(tmp_path / "r")).collect()


def test_digests(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, body in (("b.pdbqt", "hello"), ("a.pdbqt", "xx"), ("skip.txt", "x")):
        (tmp_path / "d" / name).write_text(body)

    def digest():
        listing = structures.read_listing(spark, str(tmp_path / "d"), "*.pdbqt")
        return digests.listing_digest(listing).first()

    row = digest()
    leaves = sorted(
        (hashlib.sha256(n.encode()).hexdigest()[:4], hashlib.sha256(f"{n}:{k}\n".encode()).hexdigest())
        for n, k in (("a.pdbqt", 2), ("b.pdbqt", 5))
    )
    want = hashlib.sha256("".join(f"{a}:{d}\n" for a, d in leaves).encode()).hexdigest()
    assert (row["n_files"], row["total_bytes"], row["listing_sha256"]) == (2, 7, want)
    (tmp_path / "d/a.pdbqt").write_text("xxx")
    assert digest()["listing_sha256"] != want
    hashes = {r["path"][-7:]: r["sha256"] for r in structures.read_digests(spark, str(tmp_path / "d")).collect()}
    assert hashes["b.pdbqt"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    row = provenance.provenance(
        spark, "r", str(tmp_path / "d/b.pdbqt"), str(tmp_path / "d"), CONFIG.to_dict(), str(tmp_path / "d/skip.txt")
    ).first()
    assert row["receptor"]["sha256"] == hashes["b.pdbqt"] and row["ligands"]["n_files"] == 2
    assert json.loads(row["config"])["seed"] == 42 and row["global_seed"] == 42
    gone = provenance.provenance(spark, "r", str(tmp_path / "d/b.pdbqt"), str(tmp_path / "gone"), CONFIG.to_dict()).first()
    assert gone["ligands"]["exists"] is False and row["ligands"]["exists"] is True
    assert row["environment"]["spark"] == spark.version and row["environment"]["java"]
    assert row["packages"]["pyspark"] == spark.version and row["engines"] == {}
    assert [r["file_name"] for r in structures.read_prepared(spark, str(tmp_path / "d")).collect()] == ["a.pdbqt", "b.pdbqt"]


def test_versions_of_packages_and_programs(tmp_path, monkeypatch):
    for name, body in (("tells", "echo 'tells 1.2'; echo more"), ("errs", "echo 'errs 3' >&2; exit 1"), ("quiet", "true"), ("slow", "exec sleep 9")):
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / name).chmod(0o755)
    monkeypatch.setenv("PATH", str(tmp_path), prepend=":")
    told = provenance.engine_versions(["tells", "errs", "quiet", "slow", "no-such-program"], wait_s=1)
    missing = "not available"
    assert told == {"tells": "tells 1.2", "errs": "errs 3", "quiet": "unknown", "slow": missing, "no-such-program": missing}
    assert provenance.package_versions(["no-such-package"]) == {"no-such-package": "not installed"}


def test_affinity_listing(spark):
    modes = "array(named_struct('mode', 1, 'affinity', cast({} as double)))"
    rows = [("B", 1, "-7.126"), ("A", 2, "-7.13"), ("C", 3, "0.5"), ("C", 4, "-1"), ("D", 5, "null")]
    journal = spark.sql(" union all ".join(
        f"select '{k}' as ligand_id, {n} as ordinal, {modes.format(a)} as modes" for k, n, a in rows
    ))
    got = [(r["ligand_id"], r["affinity"]) for r in regression.affinity_listing(journal).collect()]
    assert got == [("A", -7.13), ("B", -7.13), ("C", -1.0)]
    line = regression.affinity_listing(journal).collect()[2]["line"]
    assert line == "C".ljust(28) + " -1.00 kcal/mol"


def test_digest_depends_on_the_listing_alone(spark):
    listing = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("dir"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_name"), (F.col("id") % 11).alias("bytes"),
    )
    rows = digests.listing_digest(listing)
    shuffled = digests.listing_digest(listing.repartition(13))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, shuffled.collect()))
    moved = listing.withColumn("bytes", F.when(F.col("file_name") == "f3", 99).otherwise(F.col("bytes")))
    changed = {r["dir"]: r["listing_sha256"] for r in digests.listing_digest(moved).collect()}
    before = {r["dir"]: r["listing_sha256"] for r in rows.collect()}
    assert [k for k in before if before[k] != changed[k]] == ["hot"]
    missing = digests.folder_digests(spark.createDataFrame([("hot",), ("gone",)], "dir string"), listing)
    assert {r["dir"]: r["exists"] for r in missing.collect()} == {"hot": True, "gone": False}


def test_map_sets(spark):
    rows = [("good", "receptor.maps.fld"), ("good", "receptor.C.map"), ("raw", "x.pdbqt"), ("half", "receptor.C.map"),
            ("none", "notes.txt"), *[("raw", f"{c}.pdbqt") for c in "dcba"]]
    df = spark.createDataFrame(rows, "dir string, file_name string")
    got = {r["dir"]: (r["ok"], r["message"]) for r in digests.map_set_status(df).collect()}
    assert got == {"good": (True, "1 maps"), "raw": (False, "receptors but no maps"),
                   "half": (False, "1 maps but no receptor.maps.fld"), "none": (False, "no maps")}
    assert digests.example_receptors(df).first()["receptors"] == ["a.pdbqt", "b.pdbqt", "c.pdbqt"]


def test_drift(spark):
    reference = spark.createDataFrame([("a", -5.0), ("b", -6.0), ("c", -7.0), ("d", -8.0)], "ligand_id string, expected double")

    def verdicts(*pairs):
        measured = spark.createDataFrame(list(pairs), "ligand_id string, affinity double")
        compared = drift.compare_to_reference(reference, measured)
        return {r["ligand_id"]: r["verdict"] for r in compared.collect()}, drift.drift_summary(compared).first()

    rows, summary = verdicts(("a", -5.45), ("b", -5.55), ("c", -7.0), ("d", -8.0), ("extra", 0.0))
    assert set(rows.values()) == {"ok"} and summary["passed"]
    rows, summary = verdicts(("a", -6.0), ("b", -5.0), ("c", -7.0))
    assert rows == {"a": "drifted", "b": "drifted", "c": "ok", "d": "missing"} and not summary["passed"]
    nothing = drift.compare_to_reference(reference.limit(0), reference.toDF("ligand_id", "affinity"))
    assert not drift.drift_summary(nothing).first()["passed"]


def test_regression_check_and_recording(spark, tmp_path):
    run = str(tmp_path / "run")
    screen.screen(spark, ligands(spark, "a", "b", "c"), run, CONFIG, LengthScorer)
    journal = J.read_journal(spark, f"{run}/journal")
    regression.record_reference(journal, str(tmp_path / "ref"), {"seed": 42})
    reference = runs.read_recorded(spark, str(tmp_path / "ref"))
    ranked = report(spark, f"{run}/journal", str(tmp_path / "out"))
    checks = regression.regression_check(journal, ranked, reference, 3).collect()
    assert len(checks) == 6 and all(c["passed"] for c in checks)
    with pytest.raises(ValueError, match="refusing"):
        regression.record_reference(journal.limit(0), str(tmp_path / "no"), {})
    (tmp_path / "map.json").write_text('{"settings": {},\n "affinities": {"a": -1.5, "b": -2}}')
    loaded = {r["ligand_id"]: r["expected"] for r in runs.read_reference(spark, str(tmp_path / "map.json")).collect()}
    assert loaded == {"a": -1.5, "b": -2.0}


def test_benchmark(spark, tmp_path):
    rows = ligands(spark, *[f"l{i:03d}" for i in range(100)])
    assert timing.hash_sample(rows, 200).count() == 100
    sample = [r["ligand_id"] for r in timing.hash_sample(rows, 10, 1).collect()]
    assert sample == sorted(sample) and len(sample) == 10
    assert sample == [r["ligand_id"] for r in timing.hash_sample(rows.repartition(9), 10, 1).collect()]
    outcomes = benchmark.benchmark(rows, {"small": CONFIG, "large": CONFIG}, LengthScorer, 10, 1)
    outcomes.write.parquet(str(tmp_path / "b"))
    table = benchmark.compare(spark.read.parquet(str(tmp_path / "b")), 1000, 8).collect()
    assert {r["label"] for r in table} == {"small", "large"}
    assert all(r["n_sampled"] == 10 and r["n_failed"] == 0 and r["box_volume"] == 8000.0 for r in table)


def test_projection_numbers(spark):
    times = spark.createDataFrame([("c", t, "ok") for t in (1.0, 2.0, 10.0, 20.0)], "label string, elapsed_s double, status string")
    row = timing.compare_configurations(timing.timing_stats(times, ["label"]), 3600, 10).first()
    assert (row["median_s"], row["mean_s"], row["max_s"]) == (6.0, 8.25, 20.0)
    assert row["tail_ratio"] == 1.375 and row["heavy_tail"]
    assert row["projected_hours"] == pytest.approx(0.825) and row["projected"] == "0.8 h"
