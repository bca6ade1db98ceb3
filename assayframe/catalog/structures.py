"""Receptor parsing, composition, boxes and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.catalog import standins as S
from assayframe.catalog.registry import query, sql_choose, sql_round
from assayframe.functions import geometry as G
from assayframe.functions.numeric import round_half_even
from assayframe.operators import composition, metalsites, spatial
from assayframe.sources import structures

_METALS = "('ZN', 'MG', 'MN', 'FE', 'CA', 'CU', 'NI', 'CO', 'CD', 'K', 'NA_ION')"
_POINTS = f"""
points AS (
  SELECT CAST(vec_id // {S.ATOMS_PER_RECEPTOR} AS VARCHAR) AS receptor_id, label, CAST(vec_id AS INTEGER) AS serial,
         {sql_choose(S.POINT_NAMES, 'vec_id')} AS name, {sql_choose(S.POINT_CHAINS, 'vec_id // 3')} AS chain,
         CAST(vec_id % 97 AS INTEGER) AS residue_seq,
         CAST(embedding[1] AS DOUBLE) * 50 AS x, CAST(embedding[2] AS DOUBLE) * 50 AS y, CAST(embedding[3] AS DOUBLE) * 50 AS z,
         {sql_choose(S.POINT_TYPES, 'vec_id')} AS atom_type, vec_id AS line_no
  FROM embeddings)
"""


@query(f"""
WITH fields AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 100000 AS INTEGER) AS serial, l_returnflag AS name, l_linestatus AS chain,
         CAST(l_suppkey % 10000 AS INTEGER) AS residue_seq, l_quantity AS x, l_extendedprice / 1024 AS y0, -l_quantity AS z, l_discount AS charge,
         {sql_choose(('C', 'HD', 'Zn', ''), 'l_linenumber')} AS atom_type
  FROM lineitem WHERE l_linenumber <> 6)
SELECT l_orderkey, l_linenumber, l_partkey, serial, name, 'RES' AS residue, chain, residue_seq, x,
       CAST(round(CAST(y0 AS DECIMAL(18,6)), 2) AS DOUBLE) AS y, z, charge, atom_type
FROM fields
""")
def fixed_width_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width atom lines into typed columns; malformed lines left out."""
    line = F.col("l_linenumber")
    y = F.round((F.col("l_extendedprice") / 1024).cast("decimal(18,6)"), 2).cast("string")
    text = S.atom_line(
        F.when(line == 6, "x").otherwise((F.col("l_partkey") % 100000).cast("string")),
        F.col("l_returnflag"), F.col("l_linestatus"),
        (F.col("l_suppkey") % 10000).cast("string"),
        F.col("l_quantity").cast("string"), y, (-F.col("l_quantity")).cast("string"),
        F.col("l_discount").cast("string"), S.choose(("C", "HD", "Zn", ""), line),
    )
    keys = ("l_orderkey", "l_linenumber", "l_partkey")
    lines = S.table(spark, sf_dir, "lineitem").select(*keys, text.alias("line"))
    return structures.parse_atoms(lines, keep=keys).drop()


@query("""
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 2 END AS n_modes,
       -l_quantity AS first_affinity,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax END AS second_affinity,
       l_discount AS first_lb
FROM lineitem
""")
def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes stated in pose text, numbered over the lines that parse."""
    quantity = (-F.col("l_quantity")).cast("string")
    second = F.when(F.col("l_linenumber") % 3 == 0, "oops").otherwise(F.col("l_tax").cast("string"))
    text = F.concat(
        F.lit("MODEL 1\nREMARK VINA RESULT: nope 0 0\nREMARK VINA RESULT:   "), quantity,
        F.lit("  "), F.col("l_discount").cast("string"), F.lit(" 1.5\r\nATOM\nREMARK VINA RESULT: 1 2\n"),
        F.lit("REMARK VINA RESULT: "), second, F.lit(" 1e0 .5 extra\nENDMDL"),
    )
    modes = structures.scored_modes(text)
    return S.table(spark, sf_dir, "lineitem").withColumn("m", modes).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.size("m").alias("n_modes"),
        F.get("m", F.lit(0))["affinity"].alias("first_affinity"),
        F.get("m", F.lit(1))["affinity"].alias("second_affinity"),
        F.get("m", F.lit(0))["rmsd_lb"].alias("first_lb"),
    )


_SPELLINGS = ("ZN", "zn", "Zn", "cl", "HD", "hd", "NA", "Na", "na", "xx", "c", "")
_CANON = ("Zn", "Zn", "Zn", "Cl", "HD", "HD", "NA", "Na", "NA", "xx", "C", "")


@query(f"""
WITH spelled AS (
  SELECT p_partkey, {sql_choose(_SPELLINGS, 'p_partkey')} AS given, {sql_choose(_CANON, 'p_partkey')} AS wanted FROM part)
SELECT p_partkey, given <> wanted AS changed, wanted AS atom_type FROM spelled
""")
def canonical_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom types brought to their accepted spelling in place."""
    key = F.col("p_partkey")
    text = S.atom_line(
        F.lit("1"), F.lit("X"), F.lit("A"), F.lit("1"), F.lit("0.0"), F.lit("0.0"), F.lit("0.0"),
        F.lit("0.0"), S.choose(_SPELLINGS, key),
    )
    lines = S.table(spark, sf_dir, "part").select("p_partkey", text.alias("line"))
    return structures.repair_types(lines).select(
        "p_partkey", "changed", F.trim(F.substring("line", 78, 2)).alias("atom_type")
    )


_TYPE_COUNTS = f"""
{_POINTS},
typed AS (SELECT label, atom_type, count(*) AS n FROM points GROUP BY label, atom_type),
summed AS (
  SELECT label, CAST(sum(n) AS BIGINT) AS n_atoms,
         string_agg(atom_type || '=' || n, ',' ORDER BY n DESC, atom_type) AS atom_types,
         CAST(coalesce(sum(n) FILTER (atom_type = 'HD'), 0) AS BIGINT) AS n_polar_hydrogens,
         CAST(coalesce(sum(n) FILTER (atom_type = 'TZ'), 0) AS BIGINT) AS n_tz,
         CAST(coalesce(sum(n) FILTER (atom_type = ''), 0) AS BIGINT) AS n_blank,
         CAST(coalesce(sum(n) FILTER (atom_type IN ('A', 'C')), 0) AS BIGINT) AS n_carbon,
         string_agg(DISTINCT CASE WHEN upper(atom_type) IN {_METALS} THEN upper(atom_type) END, ', ' ORDER BY CASE WHEN upper(atom_type) IN {_METALS} THEN upper(atom_type) END) AS metals,
         string_agg(DISTINCT CASE WHEN atom_type <> '' AND NOT regexp_full_match(atom_type, '[A-Za-z0-9]+') THEN atom_type END, ', ' ORDER BY CASE WHEN atom_type <> '' AND NOT regexp_full_match(atom_type, '[A-Za-z0-9]+') THEN atom_type END) AS odd
  FROM typed GROUP BY label),
ranged AS (
  SELECT label, string_agg(DISTINCT CASE WHEN chain <> '' THEN chain END, ',' ORDER BY CASE WHEN chain <> '' THEN chain END) AS chains,
         min(residue_seq) AS lo, max(residue_seq) AS hi FROM points GROUP BY label)
"""


@query(f"""
WITH {_TYPE_COUNTS}
SELECT label, n_atoms, atom_types, chains, lo, hi, n_polar_hydrogens, coalesce(metals, '') AS metals, n_tz > 0 AS has_tz,
       concat_ws('; ', CASE WHEN n_polar_hydrogens = 0 THEN 'not one HD atom: nothing here donates a hydrogen bond' END,
         CASE WHEN n_carbon = 0 THEN 'without carbon this can hardly be a protein' END,
         CASE WHEN odd IS NOT NULL THEN 'types not known here: ' || odd END,
         CASE WHEN n_blank > 0 THEN n_blank || ' atoms without a type field' END) AS problems,
       concat_ws('; ', CASE WHEN n_polar_hydrogens > 0 AND n_polar_hydrogens < n_atoms * CAST(0.02 AS DOUBLE)
           THEN 'only ' || n_polar_hydrogens || ' HD atoms among ' || n_atoms || ' atoms' END,
         CASE WHEN metals IS NOT NULL THEN 'metals: ' || metals END,
         CASE WHEN contains(metals, 'ZN') AND n_tz = 0 THEN 'has zinc, lacks TZ points' END,
         CASE WHEN n_tz > 0 THEN n_tz || ' TZ points' END) AS notes
FROM summed JOIN ranged USING (label)
""")
def composition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of each structure with problems and notes."""
    report = composition.receptor_report(S.points(spark, sf_dir), key="label")
    pairs = F.transform(
        F.map_entries("atom_types"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return report.select(
        "label", "n_atoms",
        F.array_join(pairs, ",").alias("atom_types"),
        F.array_join("chains", ",").alias("chains"),
        F.col("residue_range.lo").alias("lo"), F.col("residue_range.hi").alias("hi"),
        "n_polar_hydrogens",
        F.array_join("metals", ", ").alias("metals"),
        F.col("has_zinc_pseudo_atoms").alias("has_tz"),
        F.array_join("problems", "; ").alias("problems"),
        F.array_join("notes", "; ").alias("notes"),
    )


@query(f"""
WITH {_POINTS}
SELECT label, serial, name, residue_seq FROM points
WHERE residue_seq IN (3, 5, 8, 13, 21, 34, 55, 89) AND chain = 'A' AND name NOT IN ('N', 'CA', 'C', 'O', 'OXT')
""")
def select_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side-chain atoms of named residues in one chain."""
    chosen = composition.select_residues(
        S.points(spark, sf_dir), [3, 5, 8, 13, 21, 34, 55, 89], chain="A", sidechains_only=True
    )
    return chosen.select("label", "serial", "name", "residue_seq")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part")
    return part.select(
        F.floor(F.col("p_partkey") % 1000 / 500).cast("string").alias("receptor_id"),
        (F.col("p_size") * 2).cast("int").alias("residue_seq"),
    )


@query(f"""
WITH {_POINTS},
sites AS (SELECT DISTINCT CAST((p_partkey % 1000) // 500 AS VARCHAR) AS receptor_id, CAST(p_size * 2 AS INTEGER) AS residue_seq FROM part),
covered AS (SELECT receptor_id, min(residue_seq) AS covers_from, max(residue_seq) AS covers_to FROM points GROUP BY receptor_id)
SELECT s.receptor_id, s.residue_seq, covers_from, covers_to FROM sites s LEFT JOIN covered USING (receptor_id)
WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.receptor_id = s.receptor_id AND p.residue_seq = s.residue_seq)
""")
def missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested residues that no atom belongs to."""
    return composition.missing_residues(_sites(spark, sf_dir), S.points(spark, sf_dir))


@query(f"""
WITH {_POINTS},
sites AS (SELECT DISTINCT CAST((p_partkey % 1000) // 500 AS VARCHAR) AS receptor_id, CAST(p_size * 2 AS INTEGER) AS residue_seq FROM part)
SELECT serial, receptor_id, residue_seq, name FROM points p WHERE EXISTS (
  SELECT 1 FROM sites s WHERE p.receptor_id = s.receptor_id AND p.residue_seq = s.residue_seq)
""")
def site_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms belonging to a table of requested residues."""
    chosen = composition.select_sites(S.points(spark, sf_dir), _sites(spark, sf_dir))
    return chosen.select("serial", "receptor_id", "residue_seq", "name")


@query("""
WITH first AS (SELECT CAST(ts AS DATE) AS day, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2)
SELECT CAST(day AS VARCHAR) AS day, string_agg(event_type, ',' ORDER BY first_at) AS types FROM first GROUP BY day
""")
def first_seen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct types of each group in order of first sight."""
    rows = S.table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("day"),
        F.col("event_type").alias("atom_type"),
        F.col("event_id").alias("line_no"),
    )
    return composition.types_in_order(rows, key="day").select(
        "day", F.array_join("atom_types", ",").alias("types")
    )


_BOXES = f"""
{_POINTS},
bounds AS (
  SELECT label, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz,
         max(x) - min(x) + 10 AS sx, max(y) - min(y) + 10 AS sy, max(z) - min(z) + 10 AS sz
  FROM points GROUP BY label),
boxes AS (
  SELECT label, {sql_round('cx', 3)} AS center_x, {sql_round('cy', 3)} AS center_y, {sql_round('cz', 3)} AS center_z,
         {sql_round('sx', 3)} AS size_x, {sql_round('sy', 3)} AS size_y, {sql_round('sz', 3)} AS size_z FROM bounds)
"""
_FLAT_BOX = ("center_x", "center_y", "center_z", "size_x", "size_y", "size_z")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.boxes_from_points(S.points(spark, sf_dir), ["label"])


def _flat(boxes: DataFrame) -> DataFrame:
    return boxes.select(
        "label", *[F.col(n.replace("_", ".")).alias(n) for n in _FLAT_BOX]
    )


@query(f"WITH {_BOXES} SELECT label, {', '.join(_FLAT_BOX)} FROM boxes")
def box_from_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padded box around each site."""
    return _flat(_boxes(spark, sf_dir))


@query(f"""
WITH {_BOXES}, cubes AS (SELECT *, greatest(size_x, size_y, size_z) AS side FROM boxes)
SELECT label, center_x, center_y, center_z, side AS size_x, side AS size_y, side AS size_z FROM cubes
""")
def cubic_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padded box with all sides the longest."""
    atoms = S.points(spark, sf_dir)
    return _flat(spatial.boxes_from_points(atoms, ["label"], cubic=True))


@query(f"""
WITH {_BOXES},
varied AS (SELECT label, center_x, center_y, center_z, size_x / (label + 1) AS sx, size_y / 2 AS sy, size_z AS sz FROM boxes),
measured AS (SELECT *, sx * sy * sz AS volume, least(sx, sy, sz) AS smallest FROM varied)
SELECT label, volume, volume > 27000 AS is_large, center_x - sx / 2 AS min_x, center_x + sx / 2 AS max_x,
       0 BETWEEN center_x - sx / 2 AND center_x + sx / 2 AND 0 BETWEEN center_y - sy / 2 AND center_y + sy / 2
         AND 0 BETWEEN center_z - sz / 2 AND center_z + sz / 2 AS holds_origin,
       concat_ws('; ', CASE WHEN volume > 27000 THEN 'volume ' || CAST(round_even(volume, 0) AS BIGINT) || ' A^3 exceeds 27000 A^3' END,
         CASE WHEN smallest < 10 THEN 'smallest side ' || {sql_round('smallest', 1)} || ' A is below 10 A' END) AS warnings
FROM measured
""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume, faces, containment and warnings of boxes."""
    size = G.point(
        F.col("size.x") / (F.col("label") + 1), F.col("size.y") / 2, F.col("size.z")
    )
    center = F.col("center")
    boxes = _boxes(spark, sf_dir).withColumn("size", size)
    zero, size = F.lit(0.0), F.col("size")
    return boxes.select(
        "label",
        G.volume(size).alias("volume"),
        G.is_large(size).alias("is_large"),
        G.box_minimum(center, size)["x"].alias("min_x"),
        G.box_maximum(center, size)["x"].alias("max_x"),
        G.box_contains(center, size, zero, zero, zero).alias("holds_origin"),
        F.array_join(G.box_warnings(size), "; ").alias("warnings"),
    )


@query(f"""
WITH {_BOXES}
SELECT label, 'receptor = r' || label || chr(10) || chr(10)
  || 'center_x = ' || center_x || chr(10) || 'center_y = ' || center_y || chr(10) || 'center_z = ' || center_z || chr(10) || chr(10)
  || 'size_x = ' || size_x || chr(10) || 'size_y = ' || size_y || chr(10) || 'size_z = ' || size_z || chr(10) AS config
FROM boxes
""")
def box_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box configuration text."""
    receptor = F.concat(F.lit("r"), F.col("label").cast("string"))
    return _boxes(spark, sf_dir).select(
        "label", G.render_box(F.col("center"), F.col("size"), receptor).alias("config")
    )


@query("""
SELECT vec_id, CASE vec_id % 4 WHEN 2 THEN NULL ELSE CAST(vec_id AS DOUBLE) END AS center_x,
       CASE vec_id % 4 WHEN 0 THEN CAST(22.5 AS DOUBLE) WHEN 3 THEN CAST(-1 AS DOUBLE) ELSE CAST(label AS DOUBLE) + 1 END AS size_z,
       CASE vec_id % 4 WHEN 2 THEN 'the box lacks center_x' WHEN 3 THEN 'every box side must exceed zero' END AS error
FROM embeddings
""")
def box_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box configurations in list or scalar form, with what is wrong."""
    vec = F.col("vec_id").cast("string")
    depth = F.when(F.col("vec_id") % 4 == 3, "-1.0").otherwise(
        (F.col("label") + 1).cast("double").cast("string")
    )
    listed = F.concat(F.lit('{"center":['), vec, F.lit('.0,1,2],"size":[20,21.5,22.5]}'))
    x = F.when(F.col("vec_id") % 4 == 2, "").otherwise(F.concat(F.lit('"center_x":'), vec, F.lit(",")))
    scalars = F.concat(
        F.lit("{"), x, F.lit('"center_y":1,"center_z":2,"size_x":20,"size_y":21,"size_z":'), depth, F.lit("}")
    )
    config = F.when(F.col("vec_id") % 4 == 0, listed).otherwise(scalars)
    return S.table(spark, sf_dir, "embeddings").withColumn("b", G.parse_box_config(config)).select(
        "vec_id", F.col("b.center.x").alias("center_x"), F.col("b.size.z").alias("size_z"),
        F.col("b.error").alias("error"),
    )


@query(f"""
WITH {_BOXES}, n AS (
  SELECT label, CAST(round_even(size_x / CAST(0.375 AS DOUBLE), 0) AS INTEGER) AS nx, CAST(round_even(size_y / CAST(0.375 AS DOUBLE), 0) AS INTEGER) AS ny,
         CAST(round_even(size_z / CAST(0.375 AS DOUBLE), 0) AS INTEGER) AS nz FROM boxes)
SELECT label, nx + nx % 2 AS npts_x, ny + ny % 2 AS npts_y, nz + nz % 2 AS npts_z FROM n
""")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid intervals along each side of a box."""
    return _boxes(spark, sf_dir).select(
        "label", *[G.grid_points(F.col(f"size.{a}")).alias(f"npts_{a}") for a in G.AXES]
    )


@query(f"""
WITH {_BOXES}
SELECT p.label, p.serial, upper(p.atom_type) IN {_METALS} AS is_metal
FROM points p JOIN boxes b ON p.label = b.label
WHERE x BETWEEN center_x - size_x / 2 AND center_x + size_x / 2 AND y BETWEEN center_y - size_y / 2 AND center_y + size_y / 2
  AND z BETWEEN center_z - size_z / 2 AND center_z + size_z / 2
""")
def points_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside the box of their own structure."""
    from assayframe.functions.atoms import is_metal

    inside = spatial.points_in_boxes(S.points(spark, sf_dir), _boxes(spark, sf_dir), ["label"])
    return inside.select("label", "serial", is_metal(F.col("atom_type")).alias("is_metal"))


@query(f"""
WITH {_BOXES}
SELECT p.label, count(*) AS n_metals, count(*) > 1 AS several_metals
FROM points p JOIN boxes b ON p.label = b.label
WHERE upper(atom_type) IN {_METALS} AND x BETWEEN center_x - size_x / 2 AND center_x + size_x / 2
  AND y BETWEEN center_y - size_y / 2 AND center_y + size_y / 2 AND z BETWEEN center_z - size_z / 2 AND center_z + size_z / 2
GROUP BY p.label
""")
def metals_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metals inside each box."""
    return spatial.metals_in_boxes(S.points(spark, sf_dir), _boxes(spark, sf_dir), ["label"])


@query(f"""
WITH {_POINTS},
pairs AS (
  SELECT a.receptor_id, c.serial AS center_serial, a.serial,
         sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) AS dist
  FROM points a JOIN points c ON a.receptor_id = c.receptor_id)
SELECT receptor_id, center_serial, serial, dist, row_number() OVER (PARTITION BY receptor_id, center_serial ORDER BY dist, serial) AS nth
FROM pairs WHERE dist < 4.5
""")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours within 4.5 of each center, nearest first."""
    atoms = S.points(spark, sf_dir)
    near = spatial.neighbours_within(atoms, atoms, ["receptor_id"])
    return spatial.ranked_neighbours(near, ["receptor_id"]).select(
        "receptor_id", "center_serial", "serial", "dist", F.col("nth").cast("bigint").alias("nth")
    )


@query(f"""
WITH {_POINTS},
r AS (SELECT serial, x AS ax, y AS ay, z AS az, y + 1 AS bx, z + 2 AS bq, x + 3 AS bz, z - 4 AS cx, x + 5 AS cy, y - 6 AS cz FROM points),
d AS (SELECT *, sqrt((ax-bx)*(ax-bx)+(ay-bq)*(ay-bq)+(az-bz)*(az-bz)) AS ab, sqrt((ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)+(az-cz)*(az-cz)) AS ac,
             sqrt((bx-cx)*(bx-cx)+(bq-cy)*(bq-cy)+(bz-cz)*(bz-cz)) AS bc,
             bx-ax AS ux, bq-ay AS uy, bz-az AS uz, cx-bx AS vx, cy-bq AS vy, cz-bz AS vz, -cx AS wx, -cy AS wy, -cz AS wz FROM r),
n AS (SELECT *, uy*vz-uz*vy AS mx, uz*vx-ux*vz AS my, ux*vy-uy*vx AS mz, vy*wz-vz*wy AS nx, vz*wx-vx*wz AS ny, vx*wy-vy*wx AS nz,
             (ab*ab + ac*ac - bc*bc) / (2 * ab * ac) AS cosine FROM d)
SELECT serial, ab AS distance,
       round(degrees(acos({sql_round('cosine', 7)})), 6) AS angle,
       round(degrees(atan2(sqrt(vx*vx+vy*vy+vz*vz) * (ux*nx+uy*ny+uz*nz), mx*nx+my*ny+mz*nz)), 6) AS dihedral
FROM n
""")
def point_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, angles and dihedrals as plain columns."""
    x, y, z = (F.col(a) for a in G.AXES)
    a, b, c = [x, y, z], [y + 1, z + 2, x + 3], [z - 4, x + 5, y - 6]
    origin = [F.lit(0.0)] * 3
    return S.points(spark, sf_dir).select(
        "serial",
        G.distance(a, b).alias("distance"),
        F.round(G.angle_degrees(a, b, c), 6).alias("angle"),
        F.round(G.dihedral_degrees(a, b, c, origin), 6).alias("dihedral"),
    )


@query(f"""
WITH {_POINTS}
SELECT receptor_id, count(*) FILTER (atom_type = 'Zn') AS n_zinc, count(*) FILTER (atom_type = 'TZ') AS n_old_pseudo
FROM points GROUP BY receptor_id
""")
def metal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zinc atoms and old pseudo-atoms of each structure."""
    atoms = S.points(spark, sf_dir)
    return metalsites.zinc_summary(atoms, atoms).select("receptor_id", "n_zinc", "n_old_pseudo")


def _sql_set(values: frozenset[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")"


def _sql_length(*parts: str) -> str:
    return "sqrt(" + " + ".join(f"({p}) * ({p})" for p in parts) + ")"


def _sql_gap(a: str, b: str) -> str:
    return _sql_length(*[f"{a}.{c} - {b}.{c}" for c in "xyz"])


_DIAMETER = "CASE upper(a.atom_type) " + " ".join(
    f"WHEN '{t}' THEN {d}" for t, d in metalsites.DIAMETERS.items()
) + " END"
_CUT, _PSEUDO = metalsites.BINDING_CUTOFF, metalsites.PSEUDO_DISTANCE
# Atoms around each zinc from the nearest outward; bonds among them; carboxylates;
# a recursion over the candidates that carries who is chosen and who is ruled out.
_METAL_SITES = f"""
WITH RECURSIVE {_POINTS},
atoms AS (SELECT * FROM points WHERE upper(atom_type) <> 'TZ'),
metals AS (SELECT receptor_id, serial AS center_serial, x, y, z FROM atoms WHERE upper(atom_type) = 'ZN'),
near AS (
  SELECT m.receptor_id, m.center_serial, a.x, a.y, a.z, upper(a.atom_type) AS t, {_DIAMETER} AS d, {_sql_gap('a', 'm')} AS dist,
         row_number() OVER (PARTITION BY m.receptor_id, m.center_serial ORDER BY {_sql_gap('a', 'm')}, a.line_no) AS n
  FROM metals m JOIN atoms a ON a.receptor_id = m.receptor_id AND a.serial <> m.center_serial WHERE {_sql_gap('a', 'm')} < 4.5),
bonds AS (
  SELECT i.receptor_id, i.center_serial, i.n AS i, j.n AS j FROM near i JOIN near j
  ON i.receptor_id = j.receptor_id AND i.center_serial = j.center_serial AND i.n <> j.n AND {_sql_gap('i', 'j')} < 0.25 * (i.d + j.d)),
degree AS (SELECT receptor_id, center_serial, i AS n, count(*) AS bonds FROM bonds GROUP BY ALL),
ends AS (
  SELECT b.receptor_id, b.center_serial, b.i AS carbon, o.n, o.x, o.y, o.z, o.dist FROM bonds b
  JOIN near c ON c.receptor_id = b.receptor_id AND c.center_serial = b.center_serial AND c.n = b.i AND c.t IN {_sql_set(metalsites.CARBONS)}
  JOIN near o ON o.receptor_id = b.receptor_id AND o.center_serial = b.center_serial AND o.n = b.j AND o.t IN {_sql_set(metalsites.TERMINAL_OXYGENS)}
  JOIN degree g ON g.receptor_id = b.receptor_id AND g.center_serial = b.center_serial AND g.n = b.j AND g.bonds = 1),
groups AS (
  SELECT a.receptor_id, a.center_serial, a.carbon, a.n AS near_n, f.n AS far_n, a.x, a.y, a.z, f.x - a.x AS dx, f.y - a.y AS dy, f.z - a.z AS dz,
         (1 - (greatest(f.dist - a.dist, 0) / {_sql_gap('f', 'a')}) ** {metalsites.CARBOXYL_EXPONENT}) / 2 AS share
  FROM ends a JOIN ends f ON a.receptor_id = f.receptor_id AND a.center_serial = f.center_serial AND a.carbon = f.carbon AND a.n < f.n),
grouped AS (SELECT DISTINCT receptor_id, center_serial, unnest([carbon, near_n, far_n]) AS n FROM groups),
rest AS (SELECT * FROM near ANTI JOIN grouped USING (receptor_id, center_serial, n)),
own AS (SELECT b.* FROM bonds b SEMI JOIN rest r ON r.receptor_id = b.receptor_id AND r.center_serial = b.center_serial AND r.n = b.i
  SEMI JOIN rest q ON q.receptor_id = b.receptor_id AND q.center_serial = b.center_serial AND q.n = b.j),
reach AS (
  SELECT receptor_id, center_serial, i, list(DISTINCT j) AS js FROM (
    SELECT * FROM own UNION ALL SELECT a.receptor_id, a.center_serial, a.i, b.j FROM own a JOIN own b
    ON a.receptor_id = b.receptor_id AND a.center_serial = b.center_serial AND a.j = b.i) GROUP BY ALL),
candidates AS (
  SELECT r.receptor_id, r.center_serial, r.n, coalesce(e.js, []) AS js, row_number() OVER (PARTITION BY r.receptor_id, r.center_serial ORDER BY r.n) AS k
  FROM rest r LEFT JOIN reach e ON e.receptor_id = r.receptor_id AND e.center_serial = r.center_serial AND e.i = r.n
  WHERE r.t IN {_sql_set(metalsites.BINDERS)} AND r.dist <= {_CUT}),
picked AS (
  SELECT receptor_id, center_serial, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS chosen, CAST([] AS BIGINT[]) AS ruled FROM metals
  UNION ALL
  SELECT p.receptor_id, p.center_serial, c.k, CASE WHEN list_contains(p.ruled, c.n) THEN p.chosen ELSE list_append(p.chosen, c.n) END,
         CASE WHEN list_contains(p.ruled, c.n) THEN p.ruled ELSE list_concat(p.ruled, c.js) END
  FROM picked p JOIN candidates c ON c.receptor_id = p.receptor_id AND c.center_serial = p.center_serial AND c.k = p.k + 1),
final AS (SELECT receptor_id, center_serial, max_by(chosen, k) AS chosen FROM picked GROUP BY ALL),
binders AS (
  SELECT f.receptor_id, f.center_serial, 0 AS kind, r.n AS o1, 0 AS o2, 0 AS o3, r.x, r.y, r.z
  FROM (SELECT receptor_id, center_serial, unnest(chosen) AS n FROM final) f JOIN near r USING (receptor_id, center_serial, n)
  UNION ALL
  SELECT g.receptor_id, g.center_serial, 1, carbon, near_n, far_n, g.x + dx * share, g.y + dy * share, g.z + dz * share
  FROM groups g JOIN metals m ON m.receptor_id = g.receptor_id AND m.center_serial = g.center_serial
  WHERE {_sql_length(*[f'g.{c} + d{c} * share - m.{c}' for c in 'xyz'])} <= {_CUT}),
lists AS (SELECT receptor_id, center_serial, count(*) AS n_binders, list(x ORDER BY kind, o1, o2, o3) AS xs, list(y ORDER BY kind, o1, o2, o3) AS ys,
  list(z ORDER BY kind, o1, o2, o3) AS zs FROM binders GROUP BY ALL),
sides AS (
  SELECT m.receptor_id, m.center_serial, coalesce(n_binders, 0) AS n_binders, m.x, m.y, m.z,
         xs[2]-xs[1] AS ux, ys[2]-ys[1] AS uy, zs[2]-zs[1] AS uz, xs[3]-xs[2] AS vx, ys[3]-ys[2] AS vy, zs[3]-zs[2] AS vz,
         m.x-xs[3] AS wx, m.y-ys[3] AS wy, m.z-zs[3] AS wz
  FROM metals m LEFT JOIN lists l ON l.receptor_id = m.receptor_id AND l.center_serial = m.center_serial),
planes AS (SELECT *, uy*vz-uz*vy AS px, uz*vx-ux*vz AS py, ux*vy-uy*vx AS pz, vy*wz-vz*wy AS qx, vz*wx-vx*wz AS qy, vx*wy-vy*wx AS qz FROM sides),
turned AS (SELECT *, {_PSEUDO} * CASE WHEN degrees(atan2({_sql_length('vx', 'vy', 'vz')} * (ux*qx+uy*qy+uz*qz), px*qx+py*qy+pz*qz)) >= 1 THEN 1 ELSE -1 END
  / {_sql_length('px', 'py', 'pz')} AS scale FROM planes),
placed AS (SELECT receptor_id, center_serial, CAST(n_binders AS INTEGER) AS n_binders, x + scale * px AS nx, y + scale * py AS ny, z + scale * pz AS nz, n_binders = 3 AS vacant FROM turned)
SELECT receptor_id, center_serial, n_binders, CASE WHEN vacant THEN {sql_round('nx', 3)} END AS x,
       CASE WHEN vacant THEN {sql_round('ny', 3)} END AS y, CASE WHEN vacant THEN {sql_round('nz', 3)} END AS z FROM placed
"""


@query(_METAL_SITES)
def metal_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding points of each zinc and the pseudo-point beside it."""
    sites = metalsites.zinc_sites(S.points(spark, sf_dir))
    return sites.select(
        "receptor_id", "center_serial", "n_binders",
        *[round_half_even(F.col(a), 3).alias(a) for a in G.AXES],
    )
