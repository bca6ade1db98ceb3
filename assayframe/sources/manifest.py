"""Ligand manifests, failure lists and ranked exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions.text import nullif_empty
from assayframe.schemas import (
    ALL_MODES_COLUMNS,
    FAILURE_COLUMNS,
    MANIFEST_COLUMNS,
    MANIFEST_SCHEMA,
    RESULT_COLUMNS,
)
from assayframe.sources.quoted_csv import read_quoted_csv

_LISTS = {"pdbqt": ";", "warnings": "; "}


def last_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key, the one with the highest ordinal; null keys dropped.

    An aggregate, not a window: duplicates are reduced before the shuffle, so a
    key that fills a third of the table costs no more than any other.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max_by(whole, F.col(ordinal)).alias("_row")
    )
    return best.select("_row.*")


def read_manifest(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Typed manifest, unique on ``ligand_id`` (the last duplicate wins).

    Columns go by the header's names: their order is free, further ones are
    ignored, missing ones are null. Quoted cells may hold commas, doubled quotes
    and line ends; a backslash is a plain character. Files count in path order and are
    read in splits (:mod:`assayframe.sources.quoted_csv`).
    """
    rows = read_quoted_csv(spark, path)
    typed = []
    for field in MANIFEST_SCHEMA.fields:
        known = field.name in rows.columns
        cell = nullif_empty(F.col(f"`{field.name}`") if known else F.lit(None).cast("string"))
        if field.name in _LISTS:
            cell = F.filter(F.split(cell, _LISTS[field.name]), lambda s: s != "")
        elif not isinstance(field.dataType, T.StringType):
            cell = cell.try_cast(field.dataType)
        typed.append(cell.alias(field.name))
    return last_wins(rows.select(*typed, "place"), "ligand_id", "place").drop("place")


def manifest_text(manifest: DataFrame) -> DataFrame:
    """Manifest in export form: fixed columns, lists joined to text."""
    return manifest.select(
        *[
            F.array_join(c, _LISTS[c]).alias(c) if c in _LISTS else F.col(c)
            for c in MANIFEST_COLUMNS
        ]
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with a header; an empty table still leaves its header line."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def write_manifest(manifest: DataFrame, path: str) -> None:
    write_csv(manifest_text(manifest), path)


def write_failures(failures: DataFrame, path: str) -> None:
    write_csv(failures.select(*FAILURE_COLUMNS), path)


def write_results(ranked: DataFrame, path: str) -> None:
    write_csv(ranked.select(*RESULT_COLUMNS).orderBy("rank"), path)


def write_all_modes(modes: DataFrame, path: str) -> None:
    write_csv(modes.select(*ALL_MODES_COLUMNS), path)


def find_manifest(spark: SparkSession, ligand_dir: str | None, recorded: str | None = None) -> str | None:
    """``manifest.csv`` in the folder, in its parent, or near a recorded path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for base in (ligand_dir, recorded):
        if not base:
            continue
        folder = jvm.org.apache.hadoop.fs.Path(base)
        for place in (folder, folder.getParent()):
            if place is None:
                continue
            candidate = jvm.org.apache.hadoop.fs.Path(place, "manifest.csv")
            if candidate.getFileSystem(conf).exists(candidate):
                return candidate.toString()
    return None
