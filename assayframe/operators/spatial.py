"""Boxes around sites, points in boxes, and neighbours within a radius."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions import atoms as A
from assayframe.functions import geometry as G
from assayframe.functions.numeric import round_half_even

NEIGHBOUR_RADIUS = 4.5


def boxes_from_points(
    points: DataFrame,
    site: Sequence[str],
    padding: float = G.DEFAULT_PADDING,
    cubic: bool = False,
) -> DataFrame:
    """One padded box per site; ``cubic`` gives all sides the longest length."""
    bounds = points.groupBy(*site).agg(
        *[F.min(a).alias(f"_lo_{a}") for a in G.AXES],
        *[F.max(a).alias(f"_hi_{a}") for a in G.AXES],
    )
    center = G.point(
        *[round_half_even((F.col(f"_lo_{a}") + F.col(f"_hi_{a}")) / 2, 3) for a in G.AXES]
    )
    sides = [
        round_half_even(F.col(f"_hi_{a}") - F.col(f"_lo_{a}") + 2 * padding, 3) for a in G.AXES
    ]
    if cubic:
        sides = [F.greatest(*sides)] * 3
    return bounds.select(*site, center.alias("center"), G.point(*sides).alias("size"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Points inside a box of their own receptor: an equi-join with a range test."""
    inside = G.box_contains(
        F.col("center"), F.col("size"), F.col("x"), F.col("y"), F.col("z")
    )
    return points.join(boxes, list(on)).where(inside)


def metals_in_boxes(atoms: DataFrame, boxes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Metals inside each box; more than one competes for poses."""
    metals = points_in_boxes(atoms.where(A.is_metal(F.col("atom_type"))), boxes, on)
    box_key = [*on, "box_id"] if "box_id" in boxes.columns else list(on)
    return metals.groupBy(*box_key).agg(
        F.count("*").alias("n_metals"),
        (F.count("*") > 1).alias("several_metals"),
    )


def neighbours_within(
    centers: DataFrame,
    atoms: DataFrame,
    on: Sequence[str],
    radius: float = NEIGHBOUR_RADIUS,
    center_key: str = "serial",
) -> DataFrame:
    """Atoms nearer than ``radius`` to each center of the same receptor.

    Space is cut into cubes of the radius. A center is listed in its own and the
    26 cubes around it, an atom in its own cube only, so pairs meet on an
    equi-join of (receptor, cube) and the exact distance decides. Neither side
    is compared as a whole with the other.
    """
    cell = [F.floor(F.col(a) / F.lit(radius)).alias(f"_{a}") for a in G.AXES]
    shifts = F.sequence(F.lit(-1), F.lit(1))
    spread = centers.select(
        *on,
        F.col(center_key).alias("center_serial"),
        *[F.col(a).alias(f"center_{a}") for a in G.AXES],
        *cell,
    )
    for a in G.AXES:
        spread = spread.withColumn("_s", F.explode(shifts)).withColumn(
            f"_{a}", F.col(f"_{a}") + F.col("_s")
        ).drop("_s")
    cubes = [f"_{a}" for a in G.AXES]
    pairs = atoms.select("*", *cell).join(spread, [*on, *cubes])
    squared = G.distance_squared(
        [F.col(a) for a in G.AXES], [F.col(f"center_{a}") for a in G.AXES]
    )
    return (
        pairs.withColumn("dist", F.sqrt(squared)).where(F.col("dist") < radius).drop(*cubes)
    )


def ranked_neighbours(
    neighbours: DataFrame, on: Sequence[str], serial: str = "serial"
) -> DataFrame:
    """Number the neighbours of each center by distance, then serial.

    A group is what fits inside one sphere of the radius around one center.
    """
    order = Window.partitionBy(*on, "center_serial").orderBy("dist", serial)
    return neighbours.withColumn("nth", F.row_number().over(order))

