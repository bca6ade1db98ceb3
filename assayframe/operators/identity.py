"""Unique ids and id surveys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.operators.ordering import with_key_rank


def with_unique_ids(
    records: DataFrame,
    compound: str = "compound_id",
    ordinal: str = "ordinal",
    partitions: int | None = None,
    on_collision: str = "keep",
) -> DataFrame:
    """Append ``ligand_id``: the nth occurrence (n > 1) of a compound gets ``_n``.

    A suffixed id can meet a compound that really carries that name. ``keep``
    leaves both as they are; ``extend`` renames the generated one to end in its
    own position in the library. :func:`id_collisions` reports what is left.
    """
    ranked = with_key_rank(records, [compound], ordinal, "_n", partitions)
    suffixed = F.concat(compound, F.lit("_"), F.col("_n").cast("string"))
    out = ranked.withColumn(
        "ligand_id", F.when(F.col("_n") > 1, suffixed).otherwise(F.col(compound))
    )
    if on_collision == "extend":
        taken = records.select(F.col(compound).alias("ligand_id")).distinct()
        clash = taken.withColumn("_clash", F.lit(True))
        out = out.join(clash, "ligand_id", "left")
        free = F.concat("ligand_id", F.lit("_dup"), F.col(ordinal).cast("string"))
        out = out.withColumn(
            "ligand_id",
            F.when((F.col("_n") > 1) & F.col("_clash").isNotNull(), free).otherwise(
                F.col("ligand_id")
            ),
        ).drop("_clash")
    return out.drop("_n")


def is_duplicate_id(ligand_id: str = "ligand_id", compound: str = "compound_id") -> Column:
    return F.col(ligand_id) != F.col(compound)


def id_collisions(library: DataFrame) -> DataFrame:
    """Ligand ids carried by more than one record, with their counts."""
    return library.groupBy("ligand_id").agg(F.count("*").alias("n")).where("n > 1")


def compound_counts(
    records: DataFrame, compound: str = "compound_id", ordinal: str = "ordinal"
) -> DataFrame:
    return records.groupBy(compound).agg(
        F.count("*").alias("n"), F.min(ordinal).alias("first_at")
    )


def id_survey(
    records: DataFrame, compound: str = "compound_id", ordinal: str = "ordinal"
) -> DataFrame:
    """One row: records, distinct compounds, compounds with variants, most variants."""
    counts = compound_counts(records, compound, ordinal)
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("records"),
        F.count("*").alias("distinct_compounds"),
        F.count_if(F.col("n") > 1).alias("compounds_with_variants"),
        F.coalesce(F.max("n"), F.lit(1)).cast("bigint").alias("max_variants"),
    )


def most_repeated(
    records: DataFrame, compound: str = "compound_id", ordinal: str = "ordinal", top: int = 5
) -> DataFrame:
    """The most repeated compounds; earlier first occurrence wins a tie."""
    counts = compound_counts(records, compound, ordinal).where("n > 1")
    return counts.orderBy(F.desc("n"), F.asc("first_at")).limit(top).select(compound, "n")
