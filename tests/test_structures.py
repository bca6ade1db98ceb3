from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.functions import atoms as A
from assayframe.functions import geometry as G
from assayframe.operators import composition, metalsites, spatial
from assayframe.plans import receptors
from assayframe.schemas import ATOM_SCHEMA
from assayframe.sources import structures


def line(serial, name, res, chain, seq, x, y, z, charge="0.100", kind="C", record="ATOM"):
    return (
        f"{record:<6}{serial:>5} {name:<4} {res:<3} {chain:1}{seq:>4}    "
        f"{x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00    {charge:>6} {kind:<2}"
    )


SMALL = [
    "REMARK made by hand",
    line(1, "N", "HIS", "B", 110, 1, 2, 3, kind="N"),
    line(2, "CA", "HIS", "B", 110, -100.125, -200.25, 3, kind="C"),
    line(3, "HD1", "HIS", "B", 110, 0, 0, 0, kind="HD"),
    line(4, "CB", "GLU", "N", 111, 4, 4, 4, kind="C"),
    line(5, "CG", "GLU", "N", 111, 6, 8, 4, kind="C"),
    line(6, "ZN", "ZN", "", 444, 5, 5, 5, kind="Zn", record="HETATM"),
    "ATOM  broken line",
    "ATOM      x  N   HIS B 110",
    "TER",
]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "small.pdbqt").write_text("\n".join(SMALL) + "\n")
    (tmp_path / "empty.pdbqt").write_text("REMARK nothing\n")
    bare = [line(i, "CA", "ALA", "A", i, i, 0, 0, kind="") for i in range(1, 4)]
    (tmp_path / "bare.pdbqt").write_text("\n".join(bare))
    return tmp_path


def test_fixed_columns(spark, folder):
    rows = structures.read_receptors(spark, str(folder / "small.pdbqt")).orderBy("serial").collect()
    assert [r["serial"] for r in rows] == [1, 2, 3, 4, 5, 6]
    wide = rows[1]
    assert (wide["x"], wide["y"], wide["z"], wide["charge"]) == (-100.125, -200.25, 3.0, 0.1)
    zinc = rows[5]
    assert (zinc["chain"], zinc["residue_seq"], zinc["atom_type"], zinc["line_no"]) == ("", 444, "Zn", 6)


def test_reports(spark, folder):
    rows = receptors.check_receptors(spark, str(folder)).collect()
    by_name = {r["receptor_id"].rsplit("/", 1)[-1]: r for r in rows}
    small, empty, bare = (by_name[f"{n}.pdbqt"] for n in ("small", "empty", "bare"))
    assert small["n_atoms"] == 6 and small["problems"] == []
    assert list(small["atom_types"].items())[0] == ("C", 3)
    assert small["chains"] == ["B", "N"] and tuple(small["residue_range"]) == (110, 444)
    assert small["metals"] == ["ZN"] and composition.ZINC_WITHOUT_PSEUDO in small["notes"]
    assert empty["n_atoms"] == 0 and empty["problems"] == [composition.NO_ATOMS]
    assert empty["residue_range"] is None
    assert composition.NO_POLAR_HYDROGENS in bare["problems"]
    assert composition.NO_CARBON in bare["problems"]
    assert any(p.startswith("3 atoms without a type") for p in bare["problems"])


def test_file_names_with_blanks_find_their_atoms(spark, tmp_path):
    (tmp_path / "with space.pdbqt").write_text(line(1, "ZN", "ZN", "A", 1, 0, 0, 0, kind="Zn"))
    row = receptors.check_receptors(spark, str(tmp_path)).first()
    assert row["n_atoms"] == 1


def test_sites_and_boxes(spark, folder):
    atoms = structures.read_receptors(spark, str(folder / "small.pdbqt"))
    name = atoms.first()["receptor_id"]
    sites = spark.createDataFrame([(name, 111)], "receptor_id string, residue_seq int")
    boxes, missing = receptors.site_boxes(atoms, sites)
    box = boxes.first()
    assert tuple(box["center"]) == (5.0, 6.0, 4.0) and tuple(box["size"]) == (12.0, 14.0, 10.0)
    assert missing.count() == 0
    cube = receptors.site_boxes(atoms, sites, cubic=True)[0].first()
    assert tuple(cube["size"]) == (14.0, 14.0, 14.0)
    wrong = spark.createDataFrame([(name, 111), (name, 999)], "receptor_id string, residue_seq int")
    boxes, missing = receptors.site_boxes(atoms, wrong)
    assert boxes.count() == 0
    assert tuple(missing.select("residue_seq", "covers_from", "covers_to").first()) == (999, 110, 444)
    picked = composition.select_residues(atoms, [110], chain="B", sidechains_only=True)
    assert [r["serial"] for r in picked.collect()] == [3]
    inside = spatial.metals_in_boxes(atoms, receptors.site_boxes(atoms, sites)[0], ["receptor_id"])
    assert tuple(inside.select("n_metals", "several_metals").first()) == (1, False)


def test_type_repair(spark):
    lines = [line(1, "ZN", "ZN", "A", 1, 0, 0, 0, kind=k) + " tail" for k in ("ZN", "cl", "Na", "na", "??")]
    lines += ["REMARK ZN", line(1, "C", "ALA", "A", 1, 0, 0, 0)[:70]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    rows = structures.repair_types(df).orderBy("i").collect()
    assert [r["line"][77:] for r in rows[:5]] == ["Zn tail", "Cl tail", "Na tail", "NA tail", "?? tail"]
    assert [r["changed"] for r in rows] == [True, True, False, True, False, False, False]
    assert rows[5]["line"] == lines[5] and rows[6]["line"] == lines[6]


def test_box_rules(spark):
    df = spark.createDataFrame(
        [((0.0, 0.0, 0.0), (10.0, 20.0, 30.0)), ((0.0, 0.0, 0.0), (40.0, 40.0, 40.0)),
         ((0.0, 0.0, 0.0), (5.0, 20.0, 0.0))],
        "center struct<x:double,y:double,z:double>, size struct<x:double,y:double,z:double>",
    )
    c, s = F.col("center"), F.col("size")
    five = F.lit(5.0)
    rows = df.select(
        G.volume(s), G.is_large(s), F.size(G.box_warnings(s)), G.box_error(s),
        G.box_contains(c, s, five, five, five), G.render_box(c, s), G.grid_points(s["x"]),
    ).collect()
    assert [r[0] for r in rows] == [6000.0, 64000.0, 0.0]
    assert [r[1] for r in rows] == [False, True, False]
    assert [r[2] for r in rows] == [0, 1, 1]
    assert [r[3] is None for r in rows] == [True, True, False]
    assert [r[4] for r in rows] == [True, True, False]
    assert rows[0][5] == "center_x = 0.0\ncenter_y = 0.0\ncenter_z = 0.0\n\nsize_x = 10.0\nsize_y = 20.0\nsize_z = 30.0\n"
    assert [r[6] for r in rows] == [28, 108, 14]


def cloud(n, seed, spread, receptors_=1):
    rng = random.Random(seed)
    return [
        (f"r{rng.randrange(receptors_)}", i, rng.uniform(-spread, spread), rng.uniform(-spread, spread),
         rng.uniform(-spread, spread), rng.random() < 0.1)
        for i in range(n)
    ]


def test_radius_join_equals_brute_force(spark):
    data = cloud(1500, 5, 15, 3)
    df = spark.createDataFrame(data, "receptor_id string, serial int, x double, y double, z double, c boolean")
    near = spatial.neighbours_within(df.where("c"), df, ["receptor_id"])
    got = {(r["center_serial"], r["serial"]) for r in near.collect()}
    want = {
        (a[1], b[1]) for a in data if a[5] for b in data
        if a[0] == b[0] and math.dist(a[2:5], b[2:5]) < 4.5
    }
    assert got == want and len(got) == near.count()
    ranked = spatial.ranked_neighbours(near, ["receptor_id"]).where("nth = 1").collect()
    assert all(r["center_serial"] == r["serial"] for r in ranked)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def zinc_site(spark, *others, zinc=(70.0, 18.0, 50.0)):
    rows = [("r", 1, "ZN", "ZN", "A", 400, *zinc, 0.9, "Zn")]
    rows += [("r", i, k, "RES", "A", 400 + i, *xyz, 0.1, k) for i, (k, xyz) in enumerate(others, 2)]
    atoms = spark.createDataFrame([(*r[:6], *map(float, r[6:10]), r[10]) for r in rows], ATOM_SCHEMA)
    return atoms.withColumn("line_no", F.col("serial").cast("bigint"))


def around(zinc, distance, *directions):
    return [tuple(z + distance * d / math.dist(v, (0, 0, 0)) for z, d in zip(zinc, v)) for v in directions]


TETRAHEDRON = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]


def test_pseudo_point_fills_the_vacant_corner(spark):
    zinc = (70.0, 18.0, 50.0)
    a, b, c, d = around(zinc, 2.05, *TETRAHEDRON)
    atoms = zinc_site(spark, ("NA", a), ("NA", b), ("NA", c))
    placed, summary = receptors.add_zinc_pseudo_atoms(atoms)
    tz = placed.where("atom_type = 'TZ'").collect()
    assert len(tz) == 1 and tz[0]["serial"] == 5
    spot = (tz[0]["x"], tz[0]["y"], tz[0]["z"])
    assert math.dist(spot, zinc) == pytest.approx(2.0, abs=1e-9)
    # Along the normal of the three binders: the vacant corner or its mirror.
    corner = np.array(d) - np.array(zinc)
    offset = np.array(spot) - np.array(zinc)
    cosine = abs(offset @ corner) / np.linalg.norm(corner) / 2.0
    assert cosine == pytest.approx(1.0, abs=1e-9)
    assert placed.where("atom_type = 'Zn'").first()["charge"] == 0.0
    assert tuple(summary.select("n_zinc", "n_pseudo", "problem").first()) == (1, 1, None)
    again = metalsites.with_zinc_pseudo_atoms(placed)
    assert again.where("atom_type = 'TZ'").count() == 1


def test_full_and_missing_sites_are_reported(spark):
    zinc = (0.0, 0.0, 0.0)
    corners = around(zinc, 2.1, *TETRAHEDRON)
    full = zinc_site(spark, *[("NA", p) for p in corners], zinc=zinc)
    assert receptors.add_zinc_pseudo_atoms(full)[1].first()["problem"] == "no zinc has a free place"
    none = zinc_site(spark, ("C", (1.0, 1.0, 1.0))).where("atom_type <> 'Zn'")
    assert receptors.add_zinc_pseudo_atoms(none)[1].first()["problem"] == "no zinc atoms"


def test_carboxylate_counts_once_and_bonded_atoms_are_ruled_out():
    zinc = np.zeros(3)
    nitrogens = np.array(around((0, 0, 0), 2.1, *TETRAHEDRON[:2]))
    # A carboxylate facing the zinc evenly: its point lies midway.
    oxygens = np.array([[-1.6, 1.1, 0.0], [-1.6, -1.1, 0.0]])
    carbon = np.array([[-2.2, 0.0, 0.0]])
    xyz, types = np.vstack([oxygens, nitrogens, carbon]), ["OA", "OA", "NA", "NA", "C"]
    binders = metalsites.binding_points(zinc, xyz, types)
    assert len(binders) == 3
    assert binders[-1] == pytest.approx([-1.6, 0.0, 0.0])
    # Two nitrogens one bond apart (1.3 A): the nearer binds, the other does not.
    pair = np.array([[2.0, 0.0, 0.0], [2.1, 1.3, 0.0]])
    assert metalsites.binding_points(zinc, pair, ["NA", "NA"]).tolist() == [[2.0, 0.0, 0.0]]
    far = np.array([[2.6, 0.0, 0.0]])
    assert len(metalsites.binding_points(zinc, far, ["NA"])) == 0


def brute_binders(zinc, xyz, types):
    """The picking rule spelled out atom by atom, without matrices."""
    def bonded(i, j):
        d = metalsites.DIAMETERS
        return types[i] in d and types[j] in d and math.dist(xyz[i], xyz[j]) < (d[types[i]] + d[types[j]]) / 4

    n = range(len(types))
    links = {i: {j for j in n if j != i and bonded(i, j)} for i in n}
    pairs = []
    for c in n:
        if types[c] in ("C", "A"):
            ends = sorted(j for j in links[c] if types[j] in ("O", "OA") and len(links[j]) == 1)
            pairs += [(c, p, q) for k, p in enumerate(ends) for q in ends[k + 1:]]
    gone = {i for group in pairs for i in group}
    rest = [i for i in n if i not in gone]
    inner = {i: links[i] & set(rest) for i in rest}
    out, banned = 0, set()
    for i in rest:
        if types[i] in metalsites.BINDERS and math.dist(xyz[i], zinc) <= 2.5 and i not in banned:
            out += 1
            banned |= inner[i] | {k for j in inner[i] for k in inner[j]} - {i}
    for _, p, q in pairs:
        d1, d2 = math.dist(xyz[p], zinc), math.dist(xyz[q], zinc)
        w = (1 - ((d2 - d1) / math.dist(xyz[p], xyz[q])) ** 0.5) / 2
        mid = [a + (b - a) * w for a, b in zip(xyz[p], xyz[q])]
        out += math.dist(mid, zinc) <= 2.5
    return out


def test_sites_equal_brute_force_on_a_cloud(spark):
    rng = random.Random(8)
    kinds = ["C", "A", "OA", "OA", "NA", "N", "SA", "HD", "Zn"]
    rows = []
    for i in range(900):
        rows.append((f"r{i % 2}", i, "X", "RES", "A", i, *[rng.uniform(0, 14) for _ in range(3)], 0.0, rng.choice(kinds)))
    atoms = spark.createDataFrame(rows, ATOM_SCHEMA).withColumn("line_no", F.col("serial").cast("bigint"))
    got = {r["center_serial"]: r["n_binders"] for r in metalsites.zinc_sites(atoms).collect()}
    for r in rows:
        if r[10] != "Zn":
            continue
        near = sorted(
            (math.dist(o[6:9], r[6:9]), o[1], o) for o in rows
            if o[0] == r[0] and o[1] != r[1] and math.dist(o[6:9], r[6:9]) < 4.5
        )
        xyz, types = [o[6:9] for _, _, o in near], [o[10].upper() for _, _, o in near]
        assert got[r[1]] == brute_binders(r[6:9], xyz, types)
    assert len(got) > 50 and len(set(got.values())) > 2


def test_pose_text(spark):
    text = (
        "MODEL 1\nREMARK VINA RESULT:      -7.5      0.000      0.000\nMODEL 2\n"
        "REMARK VINA RESULT: bad 1 2\nREMARK VINA RESULT: -7.1 1.5\nREMARK VINA RESULT:  -6.9 1.250 2.5\n"
    )
    df = spark.createDataFrame([(text,)], "t string")
    modes = df.select(structures.scored_modes(F.col("t"))).first()[0]
    assert [tuple(m) for m in modes] == [(1, -7.5, 0.0, 0.0), (2, -6.9, 1.25, 2.5)]


def test_types_in_order_and_canon():
    assert len({t.upper() for t in A.CANONICAL_TYPES}) == 35


def test_first_seen_types(spark, folder):
    atoms = structures.read_receptors(spark, str(folder / "small.pdbqt"))
    assert composition.types_in_order(atoms).first()["atom_types"] == ["N", "C", "HD", "Zn"]
