"""Tetrahedral pseudo-points beside zinc atoms with three binding partners."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions import atoms as A
from assayframe.operators.ordering import with_key_rank
from assayframe.operators.spatial import neighbours_within

# Bonding diameter by atom type, binding types, distances (A).
DIAMETERS: dict[str, float] = {
    "H": 2.0, "HD": 2.0, "HS": 2.0,
    "C": 4.0, "A": 4.0, "G": 4.0, "J": 4.0, "Z": 4.0, "GA": 4.0, "Q": 4.0,
    "N": 3.5, "NA": 3.5, "NS": 3.5, "OA": 3.2, "OS": 3.2, "F": 3.1,
    "MG": 1.3, "P": 4.2, "S": 4.0, "SA": 4.0, "CL": 4.1, "CA": 2.0,
    "MN": 1.3, "FE": 1.3, "ZN": 1.5, "BR": 4.3, "I": 4.7,
}
BINDERS = frozenset({"O", "OA", "NA", "N", "S", "SA", "MG", "MN", "ZN", "CA", "FE", "CU"})
TERMINAL_OXYGENS = frozenset({"O", "OA"})
CARBONS = frozenset({"C", "A"})
BINDING_CUTOFF = 2.5
PSEUDO_DISTANCE = 2.0
CARBOXYL_EXPONENT = 0.5

SITE_SCHEMA = (
    "receptor_id string, center_serial int, n_binders int, x double, y double, z double"
)


def _bonded(xyz: np.ndarray, diameters: np.ndarray) -> np.ndarray:
    """Symmetric matrix of bonds; an unknown type (NaN) never bonds."""
    gaps = np.linalg.norm(xyz[:, None, :] - xyz[None, :, :], axis=2)
    with np.errstate(invalid="ignore"):
        bonds = gaps < 0.25 * (diameters[:, None] + diameters[None, :])
    np.fill_diagonal(bonds, False)
    return bonds


def _carboxyls(types: list[str], bonds: np.ndarray) -> list[tuple[int, int, int]]:
    """(carbon, nearer oxygen, farther oxygen) of every carboxylate."""
    degree = bonds.sum(axis=1)
    found = []
    for carbon in (i for i, t in enumerate(types) if t in CARBONS):
        ends = [
            int(j) for j in np.flatnonzero(bonds[carbon])
            if types[j] in TERMINAL_OXYGENS and degree[j] == 1
        ]
        found += [(carbon, near, far) for near, far in combinations(ends, 2)]
    return found


def _carboxyl_point(near: np.ndarray, far: np.ndarray, metal: np.ndarray) -> np.ndarray:
    """One point for a pair of oxygens: midway if equally far, else the nearer."""
    lead = np.linalg.norm(far - metal) - np.linalg.norm(near - metal)
    asymmetry = (max(lead, 0.0) / np.linalg.norm(far - near)) ** CARBOXYL_EXPONENT
    return near + (far - near) * (1.0 - asymmetry) / 2.0


def binding_points(metal: np.ndarray, xyz: np.ndarray, types: list[str]) -> np.ndarray:
    """Points that bind the metal; inputs are its neighbours, nearest first.

    Taking atoms from the nearest outward, each binder rules out whatever is one
    or two bonds away from it. Carboxylates count once, by their averaged point.
    """
    diameters = np.array([DIAMETERS.get(t, np.nan) for t in types], dtype=float)
    groups = _carboxyls(types, _bonded(xyz, diameters))
    in_group = {i for group in groups for i in group}
    rest = [i for i in range(len(types)) if i not in in_group]
    bonds = _bonded(xyz[rest], diameters[rest])
    reach = bonds | ((bonds.astype(int) @ bonds.astype(int)) > 0)
    reach_distance = np.linalg.norm(xyz[rest] - metal, axis=1)
    ruled_out = np.zeros(len(rest), dtype=bool)
    chosen = []
    for i, original in enumerate(rest):
        binds = types[original] in BINDERS and reach_distance[i] <= BINDING_CUTOFF
        if binds and not ruled_out[i]:
            chosen.append(xyz[original])
            ruled_out |= reach[i]
            ruled_out[i] = False
    for _, near, far in groups:
        point = _carboxyl_point(xyz[near], xyz[far], metal)
        if np.linalg.norm(point - metal) <= BINDING_CUTOFF:
            chosen.append(point)
    return np.array(chosen).reshape(-1, 3)


def pseudo_point(metal: np.ndarray, binders: np.ndarray) -> np.ndarray | None:
    """Vacant tetrahedral position, only for exactly three binding points.

    It lies on the normal of the plane through the three points, on the side
    that the dihedral angle to the metal (in whole degrees) points to.
    """
    if len(binders) != 3:
        return None
    first, second, third = binders
    u, v, w = second - first, third - second, metal - third
    normal = np.cross(u, v)
    turn = np.degrees(
        np.arctan2(np.linalg.norm(v) * np.dot(u, np.cross(v, w)), np.dot(normal, np.cross(v, w)))
    )
    side = 1.0 if turn >= 1.0 else -1.0
    return metal + side * PSEUDO_DISTANCE * normal / np.linalg.norm(normal)


def _solve_sites(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for site in batch.itertuples(index=False):
            near = sorted(site.near, key=lambda a: (a["dist"], a["at"]))
            metal = np.array([site.center_x, site.center_y, site.center_z])
            xyz = np.array([[a["x"], a["y"], a["z"]] for a in near], dtype=float).reshape(-1, 3)
            binders = binding_points(metal, xyz, [a["atom_type"].upper() for a in near])
            point = pseudo_point(metal, binders)
            coordinates = (None, None, None) if point is None else tuple(map(float, point))
            rows.append((site.receptor_id, site.center_serial, len(binders), *coordinates))
        yield pd.DataFrame(
            rows, columns=["receptor_id", "center_serial", "n_binders", "x", "y", "z"]
        )


def zinc_sites(atoms: DataFrame, ordinal: str = "line_no") -> DataFrame:
    """One row per zinc: number of binding points and, for three, the pseudo-point.

    Neighbours come from the grid join; what one site gathers is what fits in a
    sphere of 4.5 A.
    """
    real = atoms.where(F.upper("atom_type") != A.ZINC_PSEUDO)
    zinc = real.where(F.upper("atom_type") == "ZN")
    near = neighbours_within(zinc, real, ["receptor_id"]).where(
        F.col("serial") != F.col("center_serial")
    )
    packed = F.collect_list(
        F.struct("x", "y", "z", "atom_type", "dist", F.col(ordinal).alias("at"))
    )
    gathered = near.groupBy("receptor_id", "center_serial").agg(packed.alias("near"))
    centers = zinc.select(
        "receptor_id",
        F.col("serial").alias("center_serial"),
        *[F.col(a).alias(f"center_{a}") for a in ("x", "y", "z")],
    )
    none = F.array().cast(gathered.schema["near"].dataType)
    sites = centers.join(gathered, ["receptor_id", "center_serial"], "left").withColumn(
        "near", F.coalesce("near", none)
    )
    return sites.mapInPandas(_solve_sites, SITE_SCHEMA)


def with_zinc_pseudo_atoms(atoms: DataFrame, ordinal: str = "line_no") -> DataFrame:
    """Atoms with fresh pseudo-atoms: old ones dropped, zinc charges set to zero."""
    real = atoms.where(F.upper("atom_type") != A.ZINC_PSEUDO)
    charge = F.when(F.upper("atom_type") == "ZN", F.lit(0.0)).otherwise(F.col("charge"))
    kept = real.withColumn("charge", charge).withColumn(
        "atom_type", F.coalesce(A.canonical_type(F.col("atom_type")), F.col("atom_type"))
    )
    points = zinc_sites(atoms, ordinal).where("x is not null").select(
        "receptor_id", F.col("center_serial").alias("serial"),
        *[F.col(a).alias(f"new_{a}") for a in ("x", "y", "z")],
    )
    beside = real.where(F.upper("atom_type") == "ZN").join(points, ["receptor_id", "serial"])
    numbered = with_key_rank(beside, ["receptor_id"], ordinal, "_nth")
    last = real.groupBy("receptor_id").agg(
        F.max("serial").alias("_last"), F.max(ordinal).alias("_last_at")
    )
    added = (
        numbered.join(last, "receptor_id")
        .withColumn("serial", (F.col("_last") + F.col("_nth")).cast("int"))
        .withColumn(ordinal, F.col("_last_at") + F.col("_nth"))
        .withColumn("name", F.lit(A.ZINC_PSEUDO))
        .withColumn("atom_type", F.lit(A.ZINC_PSEUDO))
        .withColumn("charge", F.lit(0.0))
    )
    for axis in ("x", "y", "z"):
        added = added.withColumn(axis, F.col(f"new_{axis}"))
    return kept.unionByName(added.select(*atoms.columns))


def zinc_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per receptor: zinc atoms, old and new pseudo-atoms, and what went wrong."""
    upper = F.upper("atom_type")
    old = before.groupBy("receptor_id").agg(
        F.count_if(upper == "ZN").alias("n_zinc"),
        F.count_if(upper == A.ZINC_PSEUDO).alias("n_old_pseudo"),
    )
    new = after.groupBy("receptor_id").agg(F.count_if(upper == A.ZINC_PSEUDO).alias("n_pseudo"))
    return (
        old.join(new, "receptor_id", "left")
        .withColumn("n_pseudo", F.coalesce("n_pseudo", F.lit(0).cast("bigint")))
        .withColumn(
            "problem",
            F.when(F.col("n_zinc") == 0, "no zinc atoms").when(
                F.col("n_pseudo") == 0, "no zinc has a free place"
            ),
        )
    )
