"""Digests over listings, and completeness of file sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Hexadecimal digits of a name's hash that tell leaves apart.
LEAF_DIGITS = 4
# Rows of a table that one task of a join sorts.
ROWS_PER_TASK = 500_000

# File names of a grid-map set.
FIELD_FILE = "receptor.maps.fld"
MAP_PATTERN = r"^receptor\..*\.map\z"


def listing_digest(
    listing: DataFrame, key: str = "dir", name: str = "file_name", size: str = "bytes"
) -> DataFrame:
    """Per folder: number of files, total bytes, and a digest of its listing.

    Files fall into leaves by the first digits of the SHA-256 of their name. A
    leaf's digest is SHA-256 over its sorted ``name:size`` lines, the folder's
    over the sorted ``leaf:digest`` lines of the leaves that hold files. One
    definition at every size: a folder has at most 16**4 leaves, so neither a leaf
    nor the list of leaves ever holds a whole large folder.
    """
    totals = listing.groupBy(key).agg(
        F.count("*").alias("n_files"), F.sum(size).cast("bigint").alias("total_bytes")
    )
    entries = listing.select(
        key,
        F.substring(F.sha2(name, 256), 1, LEAF_DIGITS).alias("_leaf"),
        F.concat(F.col(name), F.lit(":"), F.col(size).cast("string"), F.lit("\n")).alias("_line"),
    )
    leaves = entries.groupBy(key, "_leaf").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_line")), ""), 256).alias("_digest")
    )
    listed = F.array_sort(
        F.collect_list(F.concat(F.col("_leaf"), F.lit(":"), F.col("_digest"), F.lit("\n")))
    )
    digests = leaves.groupBy(key).agg(
        F.sha2(F.array_join(listed, ""), 256).alias("listing_sha256")
    )
    return totals.join(digests, key)


def folder_digests(folders: DataFrame, listing: DataFrame, key: str = "dir") -> DataFrame:
    """Digests for requested folders; one that does not exist is a row too."""
    return (
        folders.select(key)
        .join(listing_digest(listing, key), key, "left")
        .withColumn("exists", F.col("n_files").isNotNull())
    )


def fully_present(
    manifest: DataFrame, listing: DataFrame, key: str = "ligand_id", parts: str = "pdbqt",
    name: str = "file_name",
) -> DataFrame:
    """Ids whose every listed file exists; a row that lists none is complete.

    Only listed names are looked up, so ids that list none never meet in one task.
    Tables too large for the session's shuffle partitions are dealt over more of them,
    which bounds what one task sorts.
    """
    ids = manifest.where(F.col(key).isNotNull())
    named = ids.select(key, F.explode(F.filter(parts, lambda p: p != "")).alias(name))
    there = listing.select(name)
    tasks = -(-max(manifest.count(), listing.count()) // ROWS_PER_TASK)
    wide = tasks > int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        return rows.repartition(tasks, by) if wide else rows

    lacking = dealt(named, name).join(dealt(there, name), name, "left_anti").select(key)
    return dealt(ids.select(key), key).join(dealt(lacking, key), key, "left_anti").distinct()


def map_set_status(
    listing: DataFrame, key: str = "dir", name: str = "file_name"
) -> DataFrame:
    """Per folder: whether it holds a usable set of grid maps, and if not, why."""
    file = F.col(name)
    is_map, is_receptor = file.rlike(MAP_PATTERN), file.endswith(".pdbqt")
    facts = listing.groupBy(key).agg(
        F.count_if(is_map).alias("n_maps"),
        F.coalesce(F.bool_or(file == FIELD_FILE), F.lit(False)).alias("has_field"),
        F.count_if(is_receptor).alias("n_receptors"),
    )
    n_maps, has_field = F.col("n_maps"), F.col("has_field")
    return facts.withColumn("ok", has_field & (n_maps > 0)).withColumn(
        "message",
        F.when(has_field & (n_maps > 0), F.concat(n_maps.cast("string"), F.lit(" maps")))
        .when((F.col("n_receptors") > 0) & (n_maps == 0), "receptors but no maps")
        .when(
            n_maps > 0,
            F.concat(n_maps.cast("string"), F.lit(f" maps but no {FIELD_FILE}")),
        )
        .otherwise("no maps"),
    )


def example_receptors(
    listing: DataFrame, key: str = "dir", name: str = "file_name", n: int = 3
) -> DataFrame:
    """The first ``n`` receptor files of each folder, for its message."""
    first = Window.partitionBy(key).orderBy(name)
    few = (
        listing.where(F.col(name).endswith(".pdbqt"))
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= n)
    )
    return few.groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("receptors"))
