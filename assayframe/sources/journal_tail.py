"""Tailing journals that grow in place.

A streaming source over the files of a folder (or one file). Its offset says, per file,
how many bytes were delivered. A batch ends at line ends, so a line that is still being
written waits for a later batch. A file that became shorter, or came back after it was
gone, starts again from its top. Files are read in ranges, one task each: a line belongs
to the range in which it begins.

Every line carries an ``ordinal``: the number of its file in order of appearance (by
name, where several appear at once) above its byte position. So ordinals are unique,
rise along a file, and never change.

The engine asks a source for its newest offset without saying where the query stands, so
the source keeps its last answer in ``position``, a file of the query's own (say, beside
its checkpoint) that a restarted query reads. ``max_records`` bounds a batch; what is left
stays for the next ones. After a stop between an answer and its batch, one batch may hold
up to twice the bound. No line is lost or repeated, since batches begin at the engine's
own offset; a position that belongs to another query and lies behind that is an error.

A batch costs seconds whatever it holds, so a reader that is far behind may take several
``portions`` of ``max_records`` records in one batch. The bounds of the portions are part of
the offset, and every line carries the number of its ``portion``: the same lines fall into
the same portions however many of them a batch takes.
"""

from __future__ import annotations

import json
import posixpath
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from assayframe.sources.journal import parse_records

NAME = "journal_tail"
SCHEMA = "line string, ordinal bigint, source_file string, portion bigint"
RANGE_BYTES = 32 << 20
BLOCK = 1 << 20
# An ordinal is a file's number above its byte position: files of up to a terabyte.
POSITION_BITS = 40
LINES_OUT = 1 << 14
_ARROW = pa.schema(
    [("line", pa.string()), ("ordinal", pa.int64()), ("source_file", pa.string()), ("portion", pa.int64())]
)

Offset = dict[str, Any]


class Files:
    """The files of a folder, or one file, on whatever file system the path names."""

    def __init__(self, path: str):
        self.system, self.root = fs.FileSystem.from_uri(path)

    def sizes(self) -> dict[str, int]:
        """Bytes per file name; hidden and half-published names are left out. Nothing there is no file."""
        about = self.system.get_file_info(self.root)
        if about.type == fs.FileType.File:
            return {self.root: about.size}
        found = self.system.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True))
        return {
            f.path: f.size
            for f in found
            if f.type == fs.FileType.File and not posixpath.basename(f.path).startswith((".", "_"))
        }

    def last_line_end(self, name: str, low: int, high: int) -> int:
        """Just behind the last line end in [low, high), or ``low`` where there is none."""
        with self.system.open_input_file(name) as file:
            while high > low:
                at = max(low, high - BLOCK)
                found = file.read_at(high - at, at).rfind(b"\n")
                if found >= 0:
                    return at + found + 1
                high = at
        return low

    def line_ends(self, name: str, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Just behind each line end in [low, high), block by block, and whether its line counts (is not blank)."""
        at, half = low, b""
        with self.system.open_input_file(name) as file:
            while at < high:
                block = half + file.read_at(min(BLOCK, high - at), at)
                base, at = at - len(half), min(at + BLOCK, high)
                ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10) + 1
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                # Only a line that begins with a blank can be blank as a whole.
                counts = np.frombuffer(block, np.uint8)[starts] > 32
                for i in np.flatnonzero(~counts).tolist():
                    counts[i] = bool(block[starts[i] : ends[i]].strip())
                half = block[int(ends[-1]) :] if len(ends) else block
                yield ends + base, counts

    def portions(self, name: str, low: int, high: int, first: int, each: int, most: int) -> list[tuple[int, int]]:
        """The next at most ``most`` portions of whole lines: where each ends, and its lines that are not blank.

        The first one takes ``first`` lines, the others ``each``; the last one ends where the
        lines end, if they are too few to fill it, and takes blank lines behind them along.
        """
        out: list[tuple[int, int]] = []
        room, count, end = first, 0, low
        for ends, counts in self.line_ends(name, low, high):
            lines = np.cumsum(counts)
            taken = 0
            while len(ends) and lines[-1] - taken >= room:
                at = int(np.searchsorted(lines, taken + room))
                out.append((int(ends[at]), count + room))
                taken += room
                room, count, end = each, 0, int(ends[at])
                if len(out) == most:
                    return out
            if len(ends):
                more = int(lines[-1]) - taken
                room, count, end = room - more, count + more, int(ends[-1])
        return [*out, (end, count)] if not out or end > out[-1][0] else out

    def lines(self, name: str, start: int, low: int, high: int) -> Iterator[tuple[int, bytes]]:
        """Lines that begin in [low, high) with their places; ``start`` begins a line for certain."""
        with self.system.open_input_file(name) as file:
            at = low if low == start else low - 1
            skipping = low != start
            half, place = b"", at
            while True:
                block = file.read_at(BLOCK, at)
                at += len(block)
                *whole, half = (half + block).split(b"\n")
                for line in whole:
                    if skipping:
                        skipping = False
                    elif place >= high:
                        return
                    else:
                        yield place, line
                    place += len(line) + 1
                if not block or (place >= high and not skipping):
                    return

    def load(self, name: str) -> dict | None:
        if self.system.get_file_info(name).type != fs.FileType.File:
            return None
        with self.system.open_input_stream(name) as file:
            return json.loads(file.read())

    def save(self, name: str, value: dict) -> None:
        self.system.create_dir(posixpath.dirname(name), recursive=True)
        with self.system.open_output_stream(name + ".new") as file:
            file.write(json.dumps(value).encode())
        self.system.move(name + ".new", name)


def advanced(files: Files, since: Offset, max_records: int | None, portions: int = 1) -> Offset:
    """The offset that comes after ``since``: to the last line ends, or by ``portions`` times ``max_records`` lines.

    ``cuts`` are the bounds of the portions between the two: per file, where a part of a
    portion ends and the portion's number.
    """
    known, number = dict(since["files"]), since["next"]
    sizes = files.sizes()
    portion = since.get("portion", 0)
    # Records that the portion at hand may still take, and portions that may still be begun.
    left, more, cuts, moved = max_records, portions - 1, {}, False
    for name in sorted(sizes):
        size = sizes[name]
        if name not in known or size < known[name]["at"]:
            known[name] = {"no": number, "at": 0}
            number += 1
        own = known[name]
        if size == own["at"]:
            continue
        if left is None:
            found = [(files.last_line_end(name, own["at"], size), 0)]
        else:
            full = left == 0
            if full and not more:
                continue
            found = files.portions(name, own["at"], size, left or max_records, max_records, more + (not full))
        if found[-1][0] == own["at"]:
            continue
        moved, marks = True, []
        for k, (end, count) in enumerate(found):
            if k or left == 0:
                left, more, portion = max_records, more - 1, portion + 1
            marks.append([end, portion])
            left = None if left is None else left - count
        cuts[f"{own['no']}"] = marks
        known[name] = {"no": own["no"], "at": found[-1][0]}
    return {
        "next": number, "files": {n: o for n, o in known.items() if n in sizes},
        "portion": portion + moved, "cuts": cuts if moved else since.get("cuts", {}),
    }


def _joined(old: dict[str, list], new: dict[str, list]) -> dict[str, list]:
    """The cuts of two answers, one after the other."""
    out = dict(old)
    for number, marks in new.items():
        out[number] = [*[m for m in out.get(number, []) if m not in marks], *marks]
    return out


class Range(InputPartition):
    """Lines that begin in [low, high) of a file; ``cuts`` are the portions' ends there and their numbers."""

    def __init__(self, name: str, number: int, start: int, low: int, high: int, cuts: list[list[int]]):
        self.name, self.number, self.start, self.low, self.high, self.cuts = name, number, start, low, high, cuts


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        records = options.get("max_records")
        self.max_records = int(records) if records else None
        self.portions = int(options.get("portions") or 1)
        self.range_bytes = int(options.get("range_bytes") or RANGE_BYTES)
        self.position = options["position"]
        self.last: Offset | None = None

    def initialOffset(self) -> Offset:
        return {"next": 0, "files": {}}

    def latestOffset(self) -> Offset:
        place = Files(self.position)
        since = self.last or place.load(place.root) or self.initialOffset()
        now = advanced(Files(self.path), since, self.max_records, self.portions)
        if self.last is None:
            # The last answer before a restart may have had no batch; this one's then begins before it.
            now["cuts"] = _joined(since.get("cuts", {}), now["cuts"])
        if now != self.last:
            place.save(place.root, now)
        self.last = now
        return now

    def partitions(self, start: Offset, end: Offset) -> Sequence[InputPartition]:
        out = []
        for name, to in sorted(end["files"].items(), key=lambda x: x[1]["no"]):
            before = start["files"].get(name)
            first = before["at"] if before and before["no"] == to["no"] else 0
            if first > to["at"] or (before and before["no"] > to["no"]):
                raise ValueError(f"{self.position} lies behind this query at {name}")
            cuts = end.get("cuts", {}).get(f"{to['no']}", [])
            for low in range(first, to["at"], self.range_bytes):
                high = min(low + self.range_bytes, to["at"])
                here = bisect_right(cuts, low, key=lambda c: c[0])
                behind = bisect_left(cuts, high, key=lambda c: c[0])
                out.append(Range(name, to["no"], first, low, high, cuts[here : behind + 1]))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        ends = np.array([end for end, _ in partition.cuts], np.int64)
        # Offsets written before there were portions have no cuts.
        numbers = np.array([number for _, number in partition.cuts] or [0], np.int64)

        def out() -> pa.RecordBatch:
            which = np.searchsorted(ends, [at for at, _ in held], "right").clip(max=len(numbers) - 1)
            columns = [
                pa.array([line.decode("utf-8", "replace") for _, line in held], pa.string()),
                pa.array([partition.number << POSITION_BITS | at for at, _ in held], pa.int64()),
                pa.array([partition.name] * len(held), pa.string()),
                pa.array(numbers[which]),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

        for at, line in Files(self.path).lines(partition.name, partition.start, partition.low, partition.high):
            if line.strip():
                held.append((at, line))
            if len(held) == LINES_OUT:
                yield out()
        if held:
            yield out()

    def commit(self, end: Offset) -> None:
        pass

    def stop(self) -> None:
        pass


class JournalTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


def tail_lines(
    spark: SparkSession, path: str, position: str, max_records: int | None = None, range_bytes: int = RANGE_BYTES,
    portions: int = 1,
) -> DataFrame:
    """``(line, ordinal, source_file, portion)`` of every whole line of a growing file or folder, as a stream."""
    spark.dataSource.register(JournalTail)
    reader = spark.readStream.format(NAME).option("path", path).option("position", position)
    if max_records:
        reader = reader.option("max_records", max_records)
    return reader.option("range_bytes", range_bytes).option("portions", portions).load()


def tail_journal(
    spark: SparkSession, path: str, position: str, max_records: int | None = None, range_bytes: int = RANGE_BYTES,
    portions: int = 1,
) -> DataFrame:
    """Complete records of a growing journal, with their ``ordinal`` and ``portion``, as a stream."""
    return parse_records(tail_lines(spark, path, position, max_records, range_bytes, portions))
