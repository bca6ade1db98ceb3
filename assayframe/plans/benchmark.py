"""Throughput samples over several configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions.seeds import stable_seed
from assayframe.operators import batchmap, timing
from assayframe.schemas import ScreenConfig


def benchmark(
    ligands: DataFrame,
    configs: dict[str, ScreenConfig],
    scorer: batchmap.OpenScorer,
    n: int = timing.DEFAULT_SAMPLE,
    seed: int = 0,
) -> DataFrame:
    """Outcomes of one sample under each labelled configuration.

    The sample is a bounded top-k, the same for every configuration. Write the
    result before summarising it: reading it twice would run the scorer twice.
    """
    sample = timing.hash_sample(ligands.select("ligand_id", "text"), n, seed)
    out = None
    for label, config in configs.items():
        rows = sample.withColumn(
            "row_seed", stable_seed(config.seed, F.col("ligand_id"))
        ).withColumn("want_poses", F.lit(False))
        x, y, z = config.size
        scored = batchmap.safe_map(rows, scorer, config.to_dict()).select(
            F.lit(label).alias("label"),
            F.lit(round(x * y * z, 1)).alias("box_volume"),
            F.lit(config.exhaustiveness).alias("exhaustiveness"),
            "ligand_id", "status", "elapsed_s", "error",
        )
        out = scored if out is None else out.unionByName(scored)
    return out


def compare(outcomes: DataFrame, n_ligands: int, n_workers: int) -> DataFrame:
    """Statistics and projection per configuration, cheapest first."""
    keys = ["label", "box_volume", "exhaustiveness"]
    stats = timing.timing_stats(outcomes, keys)
    return timing.compare_configurations(stats, n_ligands, n_workers)
