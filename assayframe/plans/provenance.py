"""What produced a run: digests of its inputs, its settings and the software."""

from __future__ import annotations

import json
import platform
import shutil
import subprocess
import sys
import time
from collections.abc import Sequence
from importlib import metadata
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators.digests import folder_digests
from assayframe.schemas import SCHEMA_VERSION
from assayframe.session import path_exists
from assayframe.sources.structures import read_digests, read_listing

REPRODUCIBILITY_NOTE = (
    "seeds derive from the run seed and the ligand id; rows are scored one per task thread"
)

# Python packages whose version can change a result.
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def environment(spark: SparkSession) -> dict[str, str]:
    """The driver's machine and interpreter, Spark and its virtual machine."""
    return {
        "python": platform.python_version(),
        "executable": sys.executable,
        "platform": platform.platform(),
        "machine": platform.machine(),
        "hostname": platform.node(),
        "spark": spark.version,
        "java": spark.sparkContext._jvm.java.lang.System.getProperty("java.version"),
    }


def package_versions(names: Sequence[str] = PACKAGES) -> dict[str, str]:
    """Installed version by package; ``not installed`` where there is none."""
    installed = {name: list(metadata.distributions(name=name)) for name in names}
    return {name: found[0].version if found else "not installed" for name, found in installed.items()}


def engine_versions(programs: Sequence[str], wait_s: float = 10) -> dict[str, str]:
    """First line that each program prints for ``--version``, cut to 80 characters.

    ``unknown`` for one that prints nothing, ``not available`` for one that is missing,
    cannot be run or does not answer in time.
    """
    told = {}
    for program in programs:
        told[program] = "not available"
        found = shutil.which(program)
        if not found:
            continue
        try:
            answer = subprocess.run(
                [found, "--version"], stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.STDOUT,
                timeout=wait_s, text=True, errors="replace",
            )
        except (OSError, subprocess.TimeoutExpired):
            continue
        told[program] = (answer.stdout.strip().partition("\n")[0] or "unknown")[:80]
    return told


def provenance(
    spark: SparkSession,
    run_id: str,
    receptor: str,
    ligand_dir: str,
    config: dict[str, Any],
    manifest: str | None = None,
    engines: Sequence[str] = (),
    packages: Sequence[str] = PACKAGES,
) -> DataFrame:
    """One row per run: input digests, configuration, software versions, reproducibility.

    ``engines`` are programs asked for their version on the driver.
    """
    asked = spark.range(1).select(F.lit(ligand_dir).alias("dir"))
    if path_exists(spark, ligand_dir):
        listing = read_listing(spark, ligand_dir, "*.pdbqt").withColumn("dir", F.lit(ligand_dir))
    else:
        listing = spark.createDataFrame([], "dir string, file_name string, path string, bytes bigint")
    ligands = folder_digests(asked, listing).select(
        F.struct("dir", "exists", "n_files", "total_bytes", "listing_sha256").alias("ligands")
    )

    def digest(path: str, name: str) -> DataFrame:
        return read_digests(spark, path).agg(
            F.first(F.struct("path", "bytes", "sha256")).alias(name)
        )

    row = ligands.select("ligands", digest(receptor, "receptor").scalar().alias("receptor"))
    if manifest:
        row = row.withColumn("manifest", digest(manifest, "manifest").scalar())
    facts = {
        "run_id": run_id,
        "schema_version": SCHEMA_VERSION,
        "created_at": time.time(),
        "config": json.dumps(config, sort_keys=True),
        "global_seed": config.get("seed"),
        "note": REPRODUCIBILITY_NOTE,
    }
    software = {
        "environment": environment(spark),
        "packages": package_versions(packages),
        "engines": engine_versions(engines),
    }
    maps = [F.from_json(F.lit(json.dumps(v)), "map<string, string>").alias(k) for k, v in software.items()]
    return row.select("*", *[F.lit(v).alias(k) for k, v in facts.items()], *maps)
