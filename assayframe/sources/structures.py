"""Receptor structures, pose text and prepared ligands."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import atoms as A
from assayframe.functions import text
from assayframe.functions.numeric import FLOAT_PATTERN
from assayframe.sources.positions import scan_pieces, with_positions


def parse_atoms(lines: DataFrame, line: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """Atom table from fixed-width lines; other and malformed lines are left out."""
    fields = A.atom_fields(F.col(line))
    parsed = lines.where(A.is_atom_line(F.col(line))).select(
        *keep, *[c.alias(name) for name, c in fields.items()]
    )
    # A generator tests the parsed fields; a filter would be pushed below the
    # projection and parse them a second time.
    atom = F.struct(*fields)
    complete = text.explode_if(
        atom, lambda a: reduce(operator.and_, [a[f].isNotNull() for f in A.REQUIRED_FIELDS])
    )
    return parsed.select(*keep, complete.alias("_atom")).select(*keep, "_atom.*")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines of many files with file and line number."""
    placed = with_positions(scan_pieces(spark, path), F.lit(True))
    return placed.select(
        F.col("source_file").alias("receptor_id"),
        F.col("index").alias("line_no"),
        F.col("piece").alias("line"),
    )


def read_receptors(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Atoms of one or many receptor files, keyed by file path and line number."""
    return parse_atoms(read_lines(spark, path), keep=("receptor_id", "line_no"))


def repair_types(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with atom types in accepted spelling, and whether each changed."""
    fixed = A.repaired_line(F.col(line))
    return lines.withColumn("changed", fixed != F.col(line)).withColumn(line, fixed)


def scored_modes(pose_text: Column, tag: str = "VINA RESULT") -> Column:
    """Modes stated in pose text, numbered over the lines that parse.

    A line counts if it holds the tag and the first three words after its first
    colon (or of the whole line, without one) are numbers. One pattern per field
    over the whole text; nothing is evaluated line by line.
    """
    gap = "[" + text.SPACES.replace("\n", "") + "]"
    number = f"({FLOAT_PATTERN})"
    pattern = (
        rf"(?dm)^(?=.*{re.escape(tag)})(?:[^:\n]*:|(?!.*:)){gap}*{number}{gap}+{number}{gap}+{number}(?={gap}|$)"
    )

    def modes(plain: Column) -> Column:
        affinity, lower, upper = (
            F.regexp_extract_all(plain, F.lit(pattern), F.lit(group)) for group in (1, 2, 3)
        )
        lines = F.arrays_zip(affinity.alias("affinity"), lower.alias("lower"), upper.alias("upper"))
        return F.transform(
            lines,
            lambda v, i: F.struct(
                (i + 1).cast("int").alias("mode"),
                v["affinity"].try_cast("double").alias("affinity"),
                v["lower"].try_cast("double").alias("rmsd_lb"),
                v["upper"].try_cast("double").alias("rmsd_ub"),
            ),
        )

    return text.bind(text.plain_line_ends(pose_text), modes)


def read_prepared(spark: SparkSession, path: str, with_text: bool = True) -> DataFrame:
    """Prepared ligands by file name: file stem, path, size and (if wanted) text."""
    if with_text:
        files = spark.read.text(path, wholetext=True, pathGlobFilter="*.pdbqt").select(
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("bytes"),
            F.col("value").alias("text"),
        )
    else:
        files = read_listing(spark, path, "*.pdbqt").select("file_name", "path", "bytes")
    stem = F.regexp_replace("file_name", r"\.pdbqt\z", "")
    return files.withColumn("ligand_id", stem).orderBy("file_name", "path")


def read_listing(spark: SparkSession, path: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """File names and sizes of folders; file contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(path if isinstance(path, str) else list(path))
    )
    return files.select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "path",
        F.col("length").alias("bytes"),
    )


def read_digests(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SHA-256 of the content of each file."""
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return files.select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
