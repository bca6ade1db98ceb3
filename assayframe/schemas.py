"""Column layouts of every table the engine reads or writes."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import types as T

MODE_TYPE = T.StructType(
    [
        T.StructField("mode", T.IntegerType()),
        T.StructField("affinity", T.DoubleType()),
        T.StructField("rmsd_lb", T.DoubleType()),
        T.StructField("rmsd_ub", T.DoubleType()),
    ]
)

LIBRARY_SCHEMA = T.StructType(
    [
        T.StructField("ligand_id", T.StringType()),
        T.StructField("compound_id", T.StringType()),
        T.StructField("raw_id", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("fmt", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("source_file", T.StringType()),
    ]
)

JOURNAL_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("ligand_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("elapsed_s", T.DoubleType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("modes", T.ArrayType(MODE_TYPE)),
        T.StructField("error", T.StringType()),
        T.StructField("error_kind", T.StringType()),
        T.StructField("ordinal", T.LongType()),
    ]
)

DESCRIPTOR_SCHEMA = T.StructType(
    [
        T.StructField("smiles", T.StringType()),
        T.StructField("formula", T.StringType()),
        T.StructField("mw", T.DoubleType()),
        T.StructField("heavy_atoms", T.IntegerType()),
        T.StructField("rot_bonds", T.IntegerType()),
        T.StructField("clogp", T.DoubleType()),
        T.StructField("tpsa", T.DoubleType()),
        T.StructField("hbd", T.IntegerType()),
        T.StructField("hba", T.IntegerType()),
        T.StructField("formal_charge", T.IntegerType()),
        T.StructField("rings", T.IntegerType()),
        T.StructField("aromatic_rings", T.IntegerType()),
        T.StructField("fraction_csp3", T.DoubleType()),
    ]
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("ligand_id", T.StringType()),
        T.StructField("compound_id", T.StringType()),
        T.StructField("n_conformers", T.IntegerType()),
        T.StructField("pdbqt", T.ArrayType(T.StringType())),
        T.StructField("torsions", T.IntegerType()),
        T.StructField("prepared_charge", T.IntegerType()),
        *DESCRIPTOR_SCHEMA.fields,
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)

MANIFEST_COLUMNS: tuple[str, ...] = tuple(MANIFEST_SCHEMA.fieldNames())
FAILURE_COLUMNS: tuple[str, ...] = ("ligand_id", "compound_id", "stage", "error")

# Column order of the ranked and the all-modes exports.
RESULT_COLUMNS: tuple[str, ...] = (
    "rank", "compound_id", "ligand_id", "best_affinity", "ligand_efficiency",
    "mw", "clogp", "tpsa", "heavy_atoms", "rot_bonds", "hbd", "hba",
    "formal_charge", "torsions", "n_variants", "n_modes", "formula", "smiles",
    "status", "seed",
)
ALL_MODES_COLUMNS: tuple[str, ...] = (
    "Ligand", "Mode", "Affinity", "RMSD_LB", "RMSD_UB", "RandomSeed",
)

ATOM_SCHEMA = T.StructType(
    [
        T.StructField("receptor_id", T.StringType()),
        T.StructField("serial", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("residue", T.StringType()),
        T.StructField("chain", T.StringType()),
        T.StructField("residue_seq", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("charge", T.DoubleType()),
        T.StructField("atom_type", T.StringType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("engine", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("total", T.LongType()),
        T.StructField("started_at", T.DoubleType()),
        T.StructField("updated_at", T.DoubleType()),
        T.StructField("finished_at", T.DoubleType()),
        T.StructField("message", T.StringType()),
        T.StructField("config_json", T.StringType()),
    ]
)

# Layout version written into run and provenance records. Readers refuse newer.
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class PrepConfig:
    """Settings that decide what a preparation job does; its metadata repeats them."""

    ph: float = 7.4
    optimize: bool = True
    n_conformers: int = 1
    skip_tautomers: bool = True
    macrocycles: bool = True
    seed: int = 0
    max_torsions: int | None = None

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class ScreenConfig:
    """Parameters of a screening job; validated before any row is scored."""

    receptor: str
    center: tuple[float, float, float]
    size: tuple[float, float, float]
    engine: str = "vina"
    exhaustiveness: int = 8
    n_modes: int = 9
    energy_range: float = 3.0
    seed: int = 0
    cpu: int = 1
    maps_dir: str | None = None
    parameter_file: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)
