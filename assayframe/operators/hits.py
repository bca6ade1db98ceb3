"""From journal and manifest to ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions import scoring
from assayframe.functions.numeric import parse_int, round_half_even
from assayframe.functions.text import nullif_empty
from assayframe.operators.ordering import with_global_rank
from assayframe.operators.progress import latest_records
from assayframe.schemas import ALL_MODES_COLUMNS, RESULT_COLUMNS
from assayframe.sources.manifest import last_wins

DESCRIPTORS = (
    "mw", "clogp", "tpsa", "heavy_atoms", "rot_bonds", "hbd", "hba",
    "formal_charge", "torsions", "formula", "smiles",
)
RECORD_FIELDS = ("status", "seed", "n_modes")


def scored_records(journal: DataFrame) -> DataFrame:
    """The few columns of a journal row that ranking needs."""
    return journal.select(
        "ligand_id",
        scoring.best_affinity(F.col("modes")).alias("best_affinity"),
        "status",
        "seed",
        scoring.mode_count(F.col("modes")).alias("n_modes"),
        "ordinal",
    )


def _best_first(*extra: str) -> Column:
    """Struct whose minimum is the best row: scored first, lowest, earliest."""
    return F.struct(
        F.col("best_affinity").isNull().alias("_unscored"),
        F.col("best_affinity"),
        F.col("ordinal"),
        *[F.col(c) for c in extra],
    )


def collate(records: DataFrame, manifest: DataFrame, group_variants: bool = True) -> DataFrame:
    """Join scored records to the manifest and keep the best row per compound.

    Grouped, each ligand is first reduced to its best record and its number of
    records, so the join sees one row per ligand however often it was tried, and
    one row per ligand reaches its compound. Both reductions start before the
    shuffle; a compound with a third of all rows stays cheap. The minimum of a
    struct keeps compounds without any score, which ``min_by`` would lose.
    """
    entry = [c for c in manifest.columns if c != "ligand_id"]
    manifest = manifest.withColumn("has_descriptors", F.lit(True))
    compound = F.coalesce(nullif_empty(F.col("compound_id")), F.col("ligand_id"))
    described = F.coalesce("has_descriptors", F.lit(False)).alias("has_descriptors")
    rest = [c for c in entry if c != "compound_id"]
    if not group_variants:
        joined = records.join(manifest, "ligand_id", "left")
        return joined.select(
            compound.alias("compound_id"), "ligand_id", "best_affinity", "status", "seed",
            "n_modes", F.col("ordinal").alias("first_at"),
            F.lit(1).cast("bigint").alias("n_variants"), described, *rest,
        )
    per_ligand = (
        records.groupBy("ligand_id")
        .agg(
            F.min(_best_first(*RECORD_FIELDS)).alias("_b"),
            F.count("*").alias("n_records"),
            F.min("ordinal").alias("first_at"),
        )
        .select("ligand_id", "n_records", "first_at", "_b.*")
    )
    return _best_of_compounds(per_ligand, manifest)


def _best_of_compounds(per_ligand: DataFrame, manifest: DataFrame) -> DataFrame:
    """Join rows that are unique by ligand to the manifest and keep the best row per compound."""
    rest = [c for c in manifest.columns if c not in ("ligand_id", "compound_id", "has_descriptors")]
    joined = per_ligand.join(manifest, "ligand_id", "left").select(
        F.coalesce(nullif_empty(F.col("compound_id")), F.col("ligand_id")).alias("compound_id"),
        "ligand_id", "best_affinity", "status", "seed", "n_modes", "ordinal", "first_at", "n_records",
        F.coalesce("has_descriptors", F.lit(False)).alias("has_descriptors"), *rest,
    )
    carried = ("ligand_id", *RECORD_FIELDS, "has_descriptors", *rest)
    return (
        joined.groupBy("compound_id")
        .agg(
            F.min(_best_first(*carried)).alias("_b"),
            F.sum("n_records").alias("n_variants"),
            F.min("first_at").alias("first_at"),
        )
        .select("compound_id", "n_variants", "first_at", "_b.*")
        .drop("_unscored", "ordinal")
    )


def ligand_states(records: DataFrame) -> DataFrame:
    """Scored records as mergeable states, one per ligand: best and last record, count, first position."""
    last = F.struct("ordinal", "best_affinity", *RECORD_FIELDS)
    return records.groupBy("ligand_id").agg(
        F.min(_best_first(*RECORD_FIELDS)).alias("best"),
        F.max(last).alias("last"),
        F.count("*").alias("n_records"),
        F.min("ordinal").alias("first_at"),
    )


def merged_states(states: DataFrame) -> DataFrame:
    """States of the same ligands from several sets of records, as those of all records."""
    return states.groupBy("ligand_id").agg(
        F.min("best").alias("best"),
        F.max("last").alias("last"),
        F.sum("n_records").alias("n_records"),
        F.min("first_at").alias("first_at"),
    )


def ranked_states(states: DataFrame, manifest: DataFrame, latest_only: bool = False) -> DataFrame:
    """The ranked hit list from the merged states of all records."""
    if latest_only:
        per_ligand = states.select(
            "ligand_id", F.lit(1).cast("bigint").alias("n_records"),
            F.col("last.ordinal").alias("first_at"), "last.*",
        )
    else:
        per_ligand = states.select("ligand_id", "n_records", "first_at", "best.*")
    described = _complete(manifest).withColumn("has_descriptors", F.lit(True))
    ranked = with_global_rank(_best_of_compounds(per_ligand, described), rank_order())
    return with_efficiency(ranked).select(*RESULT_COLUMNS)


def rank_order() -> list[Column]:
    """Scored rows ascending, unscored last; ties by first sight of the compound."""
    return [F.col("best_affinity").asc_nulls_last(), F.col("first_at").asc()]


def with_efficiency(rows: DataFrame) -> DataFrame:
    heavy = F.col("heavy_atoms")
    if dict(rows.dtypes)["heavy_atoms"] == "string":
        heavy = parse_int(heavy)
    return rows.withColumn(
        "ligand_efficiency", scoring.ligand_efficiency(F.col("best_affinity"), heavy)
    )


def _complete(manifest: DataFrame) -> DataFrame:
    """Manifest with every descriptor column, null where it has none.

    A manifest with a column ``ordinal`` may repeat ids, and the last row of each
    counts; without one its ids must be unique, as the readers leave them.
    """
    if "ordinal" in manifest.columns:
        manifest = last_wins(manifest, "ligand_id", "ordinal")
    for name in DESCRIPTORS:
        if name not in manifest.columns:
            manifest = manifest.withColumn(name, F.lit(None).cast("string"))
    return manifest.select("ligand_id", "compound_id", *DESCRIPTORS)


def ranked_hits(
    journal: DataFrame,
    manifest: DataFrame,
    group_variants: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """The ranked hit list with all result columns.

    ``latest_only`` first keeps the last record of each ligand, so a failed
    set-up and its later success count as one variant.
    """
    rows = latest_records(journal) if latest_only else journal
    collated = collate(scored_records(rows), _complete(manifest), group_variants)
    ranked = with_global_rank(collated, rank_order())
    return with_efficiency(ranked).select(*RESULT_COLUMNS)


def top_hits(
    journal: DataFrame, manifest: DataFrame, top: int = 20, group_variants: bool = True
) -> DataFrame:
    """Head of the hit list: a bounded top-k, no full sort."""
    collated = collate(scored_records(journal), _complete(manifest), group_variants)
    head = collated.orderBy(*rank_order()).limit(top)
    return with_efficiency(_number_head(head)).select(
        "rank", "compound_id", "best_affinity", "ligand_efficiency", "mw", "formula"
    )


def _number_head(head: DataFrame) -> DataFrame:
    """Rank a bounded head; the window sees at most its few rows."""
    return head.withColumn(
        "rank", F.row_number().over(Window.orderBy(*rank_order())).cast("bigint")
    )


def join_coverage(
    journal: DataFrame, manifest: DataFrame, group_variants: bool = True
) -> DataFrame:
    """One row: ranked rows with descriptors, all ranked rows, and a warning."""
    collated = collate(scored_records(journal), _complete(manifest), group_variants)
    counts = collated.agg(
        F.count_if(F.col("has_descriptors")).alias("matched"), F.count("*").alias("total")
    )
    matched, total = F.col("matched"), F.col("total")
    return counts.withColumn(
        "warning",
        F.when((total > 0) & (matched == 0), "not one row found its descriptors").when(
            matched < total,
            F.concat(
                (total - matched).cast("string"),
                F.lit(" of "),
                total.cast("string"),
                F.lit(" rows have no descriptors"),
            ),
        ),
    )


def all_modes(journal: DataFrame) -> DataFrame:
    """One row per mode, RMSD to three decimals, a null seed as empty text."""
    exploded = journal.select("ligand_id", "seed", F.explode("modes").alias("m"))
    return exploded.select(
        F.col("ligand_id").alias("Ligand"),
        F.col("m.mode").alias("Mode"),
        F.col("m.affinity").alias("Affinity"),
        F.format_string("%.3f", round_half_even(F.col("m.rmsd_lb"), 3)).alias("RMSD_LB"),
        F.format_string("%.3f", round_half_even(F.col("m.rmsd_ub"), 3)).alias("RMSD_UB"),
        F.coalesce(F.col("seed").cast("string"), F.lit("")).alias("RandomSeed"),
    ).select(*ALL_MODES_COLUMNS)


def sort_rows(rows: DataFrame, column: str, descending: bool = False, tie: str = "ordinal") -> DataFrame:
    """Sort by any column: missing last ascending, first descending.

    Rank is positional, so sorting by it means sorting by affinity.
    """
    key = F.col("best_affinity" if column == "rank" else column)
    order = key.desc_nulls_first() if descending else key.asc_nulls_last()
    return rows.orderBy(order, F.col(tie).asc())
