"""Compound libraries as tables: one row per record, in file order.

Records are cut by the text source's own line separator, so large files stay
splittable, and numbered without shuffling their text. A first SDF block made of
a lone title line, and a blank preamble before the first MOL2 marker, are no
records here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import text as X
from assayframe.operators.identity import with_unique_ids
from assayframe.sources.positions import (
    dropped_opening,
    opening_verdicts,
    scan_pieces,
    with_positions,
)

MOL2_MARKER = "@<TRIPOS>MOLECULE"
_SMI_HEADERS = ("smiles", "smi", "structure")


@dataclass(frozen=True)
class _Format:
    """How one format is cut into pieces and which pieces are records."""

    separator: str | None
    keep: Column
    keep_first: Column


def _sdf_body(piece: Column) -> Column:
    """Drop what is left of the terminator line that opened this piece."""
    return F.regexp_replace(piece, r"^[^\n]*(?:\n|\z)", "")


def _sdf_first_body(piece: Column) -> Column:
    unmarked = F.regexp_replace(piece, r"^\x{feff}", "")
    return F.when(unmarked.startswith("$$$$"), _sdf_body(unmarked)).otherwise(unmarked)


def _smi_line(piece: Column) -> Column:
    return X.strip(X.strip_mark(X.strip(piece)))


def _format(fmt: str) -> _Format:
    piece = F.col("piece")
    if fmt == "sdf":
        keep = X.strip(_sdf_body(piece)) != ""
        return _Format("\n$$$$", keep, keep & (X.strip(_sdf_first_body(piece)) != ""))
    if fmt == "mol2":
        # Only the first piece can be blank: later ones follow a marker.
        keep = F.lit(True)
        return _Format("\n" + MOL2_MARKER, keep, X.strip(piece) != "")
    if fmt == "smi":
        line = _smi_line(piece)
        keep = (line != "") & ~line.startswith("#")
        header = F.lower(F.get(X.words(line), F.lit(0))).isin(*_SMI_HEADERS)
        return _Format(None, keep, keep & ~header)
    raise ValueError(f"unsupported format {fmt!r}")


def _ending_newline(block: Column) -> Column:
    return F.when(block.endswith("\n"), block).otherwise(F.concat(block, F.lit("\n")))


def _records(indexed: DataFrame, fmt: str, id_field: str | None) -> DataFrame:
    piece, first = F.col("piece"), F.col("is_first")
    if fmt == "sdf":
        block = _ending_newline(
            F.when(first, _sdf_first_body(piece)).otherwise(_sdf_body(piece))
        )
        compound = X.record_id(F.col("block"), F.col("index"), id_field)
        raw = X.raw_record_id(F.col("block"), id_field)
    elif fmt == "mol2":
        block = _ending_newline(
            F.when(first, piece).otherwise(F.concat(F.lit(MOL2_MARKER), piece))
        )
        name = F.regexp_extract("block", r"(?md)^@<TRIPOS>MOLECULE[^\n]*\n([^\n]*)", 1)
        raw = X.nullif_empty(X.strip(name))
        compound = F.coalesce(
            X.nullif_empty(X.sanitize_id(name)), X.positional_id(F.col("index"))
        )
    else:
        block = F.get(X.words(_smi_line(piece)), F.lit(0))
        raw = F.get(X.words(_smi_line(piece)), F.lit(1))
        compound = F.coalesce(
            X.nullif_empty(X.sanitize_id(raw)), X.positional_id(F.col("index"))
        )
    return indexed.withColumn("block", block).select(
        compound.alias("compound_id"),
        raw.alias("raw_id"),
        "block",
        F.lit(fmt).alias("fmt"),
        "index",
        "ordinal",
        "source_file",
    )


def formats_of(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Group input paths by the library format their names state."""
    named = spark.createDataFrame([(p,) for p in paths], "path string")
    name = F.element_at(F.split("path", "/"), -1)
    grouped: dict[str, list[str]] = {}
    for row in named.select("path", X.detect_format(name).alias("fmt")).collect():
        grouped.setdefault(row["fmt"], []).append(row["path"])
    return grouped


def read_records(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    id_field: str | None = None,
) -> DataFrame:
    """Records of one library with their compound ids, positions and raw text."""
    paths = [path] if isinstance(path, str) else list(path)
    if fmt is None:
        found = formats_of(spark, paths)
        if len(found) != 1:
            raise ValueError(f"a library is read in one format, found {sorted(found)}")
        fmt = next(iter(found))
    rules = _format(fmt)
    pieces = scan_pieces(spark, paths, rules.separator)
    records = _records(with_positions(pieces, rules.keep, rules.keep_first), fmt, id_field)
    if all(p.endswith(".gz") for p in paths):
        # A compressed file is one split; spread its records before any work.
        records = records.repartition(spark.sparkContext.defaultParallelism)
    return records


def read_library(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    id_field: str | None = None,
    unique_ids: bool = True,
) -> DataFrame:
    """The library table; repeated compound ids get a numbered ligand id."""
    records = read_records(spark, path, fmt, id_field)
    if unique_ids:
        records = with_unique_ids(records)
    else:
        records = records.withColumn("ligand_id", F.col("compound_id"))
    return records.select(
        "ligand_id", "compound_id", "raw_id", "block", "fmt", "index", "ordinal", "source_file"
    )


def count_records(spark: SparkSession, path: str | Sequence[str], fmt: str) -> DataFrame:
    """Records per file, counted as the reader yields them."""
    rules = _format(fmt)
    pieces = scan_pieces(spark, path, rules.separator)
    verdicts = opening_verdicts(rules.keep, rules.keep_first)
    opening = F.when(F.col("split_start") == 0, verdicts)
    counted = pieces.groupBy("source_file").agg(
        F.count_if(rules.keep).alias("_kept"), F.min(opening).alias("_first")
    )
    return counted.select(
        "source_file", (F.col("_kept") - dropped_opening("_first")).cast("bigint").alias("records")
    )
