"""CSV whose quoted cells may hold line ends, read in splits.

Whether a line starts a record depends on how many quotes the file holds before it. One
scan counts the quotes of each split; a running sum over the small table of splits says
whether a split starts inside a cell. The second scan carries the count on from line to
line. Lines that are whole records are parsed where they were read; only the lines of
records that span several are shuffled, to be put together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.operators.ordering import with_running_total
from assayframe.session import materialize
from assayframe.sources.positions import MAX_BROADCAST_SPLITS, scan_pieces

_CELLS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
_BOM = "\ufeff"


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append ``before``, the parity of the quotes before each line in its split, and ``opens``.

    Lines come in order. ``opens`` marks the first line of a file that is not blank.
    """
    split, carry, opened = None, 0, False
    for batch in batches:
        quotes = batch.column("quotes").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(quotes)
        starts = ends - quotes
        splits = list(zip(batch.column("source_file").to_pylist(), batch.column("split_start").to_pylist(), strict=True))
        filled = np.array([bool(x.strip(" ")) for x in batch.column("piece").to_pylist()], bool)
        before, opens = np.empty(len(quotes), np.int64), np.zeros(len(quotes), bool)
        cuts = [0, *(i for i in range(1, len(splits)) if splits[i] != splits[i - 1]), len(splits)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if splits[i] != split:
                split, carry, opened = splits[i], 0, splits[i][1] > 0
            if not opened and filled[i:j].any():
                opens[i + int(filled[i:j].argmax())] = opened = True
            before[i:j] = starts[i:j] - starts[i] + carry
            carry = int(before[j - 1] + quotes[j - 1]) % 2
        columns = [*batch.columns, pa.array(before % 2), pa.array(opens)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "before", "opens"])


def header_names(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The names in the header line; none for files without a line."""
    first = spark.read.csv(path, header=False, quote='"', escape='"').head()
    return [] if first is None else [(name or "").removeprefix(_BOM) for name in first]


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Records as text: ``record``, ``is_header`` and ``place`` (file, split, line), which orders them.

    Every kind of line end becomes a line feed; blank lines between records are left out.
    Cells that hold a quote must be quoted, as all CSV writers do it.
    """
    lines = scan_pieces(spark, path).withColumn("quotes", _quotes(F.col("piece")))
    of_file = Window.partitionBy("source_file").orderBy("split_start")
    splits = materialize(
        lines.groupBy("source_file", "split_start").agg(F.sum("quotes").alias("_n"))
    ).select(
        "source_file", "split_start",
        F.pmod(F.coalesce(F.sum("_n").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(2)).alias("inside"),
    )
    if splits.count() <= MAX_BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    schema = "piece string, source_file string, split_start bigint, _at bigint, quotes int, before bigint, opens boolean"
    counted = lines.mapInArrow(_counted, schema).join(splits, ["source_file", "split_start"])
    starts = F.pmod(F.col("before") + F.col("inside"), F.lit(2)) == 0
    placed = counted.select(
        "piece",
        "opens",
        F.struct("source_file", "split_start", "_at").alias("place"),
        starts.alias("starts"),
        (starts & (F.col("quotes") % 2 == 0)).alias("whole"),
    )
    apart = placed.where("not whole").withColumn("_opens", F.col("starts").cast("bigint"))
    numbered = with_running_total(apart, [F.col("place")], "_opens", "_before")
    joined = numbered.groupBy((F.col("_before") + F.col("_opens")).alias("_record")).agg(
        F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("_lines"), F.bool_or("opens").alias("is_header")
    ).select(F.array_join("_lines.piece", "\n").alias("record"), "is_header", F.col("_lines")[0]["place"].alias("place"))
    whole = placed.where("whole").select(F.col("piece").alias("record"), F.col("opens").alias("is_header"), "place")
    return whole.unionByName(joined).where(F.trim("record") != "")


def read_quoted_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Cells as strings under the header's names, and ``place``; all files must share one header."""
    names = header_names(spark, path)
    if not names:
        return spark.createDataFrame([], "place struct<source_file: string, split_start: bigint, _at: bigint>")
    # Cells go by number until the names are known to fit.
    cells = [f"_c{i}" for i in range(len(names))]
    text = F.regexp_replace("record", f"^{_BOM}", "")
    parsed = csv_records(spark, path).withColumn(
        "_cells", F.from_csv(text, ", ".join(f"{c} string" for c in cells), _CELLS)
    )
    header = F.array(*[F.coalesce(F.col(f"_cells.{c}"), F.lit("")) for c in cells])
    fits = header == F.array(*[F.lit(n) for n in names])
    other = F.raise_error(F.concat(F.lit("another header in "), F.col("place.source_file"))).cast("boolean")
    data = parsed.where(F.when(~F.col("is_header"), F.lit(True)).when(fits, F.lit(False)).otherwise(other))
    first = {n: i for i, n in reversed(list(enumerate(names)))}
    return data.select(*[F.col(f"_cells._c{i}").alias(n) for n, i in first.items() if n != "place"], "place")
