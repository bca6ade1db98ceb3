"""The outcome journal: append-only folders of immutable JSON-lines files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import scoring, text
from assayframe.functions.numeric import round_half_even
from assayframe.schemas import JOURNAL_SCHEMA
from assayframe.session import path_exists
from assayframe.sources.positions import scan_pieces, with_positions

_CORRUPT = "_corrupt"
WIRE_SCHEMA = T.StructType(
    [f for f in JOURNAL_SCHEMA.fields if f.name != "ordinal"]
    + [T.StructField(_CORRUPT, T.StringType())]
)


def complete_record(record: Column) -> Column:
    """A record that parsed, names its ligand and has whole modes.

    A JSON object without ``ligand_id`` is not corrupt to the parser, so the
    second test is needed beside the first.
    """
    broken_mode = F.exists(
        record["modes"],
        lambda m: m.isNull() | m["mode"].isNull() | m["affinity"].isNull(),
    )
    return (
        record[_CORRUPT].isNull()
        & record["ligand_id"].isNotNull()
        & ~F.coalesce(broken_mode, F.lit(False))
    )


def parse_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Journal columns from JSON lines; unreadable lines are left out.

    Fields that old records lack take their defaults; other columns pass through.
    """
    others = [c for c in lines.columns if c != line]
    record = F.from_json(
        F.col(line), WIRE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    parsed = (
        lines.where(text.strip(F.col(line)) != "")
        .select(*others, record.alias("_json"))
        .select(*others, text.explode_if(F.col("_json"), complete_record).alias("_r"))
    )
    r = F.col("_r")
    return parsed.select(
        r["run_id"].alias("run_id"),
        r["ligand_id"].alias("ligand_id"),
        F.coalesce(r["status"], F.lit("ok")).alias("status"),
        r["seed"].alias("seed"),
        F.coalesce(r["elapsed_s"], F.lit(0.0)).alias("elapsed_s"),
        F.coalesce(r["timestamp"], F.lit(0.0)).alias("timestamp"),
        F.coalesce(
            scoring.with_record_defaults(r["modes"]),
            F.array().cast(JOURNAL_SCHEMA["modes"].dataType),
        ).alias("modes"),
        r["error"].alias("error"),
        r["error_kind"].alias("error_kind"),
        *others,
    )


def read_journal(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every complete record, with its position as ``ordinal``.

    Files count in path order, so writers name them in the order of commit. A
    journal that does not exist yet is an empty one.
    """
    paths = [path] if isinstance(path, str) else list(path)
    there = [p for p in paths if any(c in p for c in "*?[{") or path_exists(spark, p)]
    if not there:
        empty = "line string, ordinal bigint, source_file string"
        return parse_records(spark.createDataFrame([], empty))
    pieces = scan_pieces(spark, there)
    placed = with_positions(pieces, text.strip(F.col("piece")) != "")
    lines = placed.select(F.col("piece").alias("line"), "ordinal", "source_file")
    return parse_records(lines)


def to_wire(outcomes: DataFrame) -> DataFrame:
    """Outcome rows in wire form: rounded times, empty fields left out."""
    columns = set(outcomes.columns)
    run_id = [F.col("run_id")] if "run_id" in columns else []
    return outcomes.select(
        *run_id,
        "ligand_id",
        "status",
        F.col("seed").cast("bigint").alias("seed"),
        round_half_even(F.col("elapsed_s"), 4).alias("elapsed_s"),
        round_half_even(F.col("timestamp"), 3).alias("timestamp"),
        F.when(F.size("modes") > 0, F.col("modes")).alias("modes"),
        "error",
        "error_kind",
    )


def append_journal(outcomes: DataFrame, path: str, batch: int | None = None) -> None:
    """Append outcomes as new files; each becomes visible whole on commit.

    ``batch`` names a sub-folder of the journal so that path order is commit
    order; writing the same batch again replaces it, which makes a retried
    batch harmless.
    """
    wire = to_wire(outcomes)
    if batch is None:
        wire.write.mode("append").json(path)
    else:
        wire.write.mode("overwrite").json(f"{path}/batch_id={batch:010d}")
