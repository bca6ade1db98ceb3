"""Best-fit packing of token pieces into sequences, from a configuration linear program.

All planning happens on the histogram of piece lengths, at most ``capacity``
numbers, so the driver's share does not grow with the corpus:

1. Lengths are rounded up to units. Over the large ones a covering program asks for
   the least number of sequences of each configuration. Multiplicative weights
   solve it: a length that lags behind weighs more, and knapsack dynamic
   programming prices, for every length at once, the best configuration that holds
   it; all that come close to the best one advance together.
2. The fractional solution is rounded along running sums, never beyond what is
   left of a length; the rest is solved again, a few times.
3. What remains, and then all small pieces, goes by best fit decreasing with exact
   lengths into the gaps of the planned sequences, or into new ones.

The plan is a table of runs: "the next n pieces of this length go to these
sequences at this offset". Pieces take their places by their rank within their
length, which no task counts for a whole length.

Defined cases: a null text is empty and still one piece (its end mark); repeated
rows are packed one by one; other columns pass through untouched; an empty table
gives an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit
from tokenizers.pre_tokenizers import Sequence as Sequenced

from assayframe.llm.common import clean_text, materialize, once_per_worker, packed_rows, rank_in_groups

CAPACITY = 4096
END_ID = 1
# Planning parameters.
UNITS = 1024
SMALL_SHARE = 16
ITERATIONS = 120
STEP = 0.1
NEAR_BEST = 0.85
ROUNDS = 5
# Least fills from which configurations are planted; above 1 none is.
LEAST_FILLS = (0.0, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999, 1.0, 2.0)
# Ids of short words are remembered, up to so many in a worker.
REMEMBERED = 400_000
TEXTS_AT_ONCE = 64
PARTS_AT_ONCE = 256
LONGEST_REMEMBERED = 48

Run = tuple[tuple[int, ...], int]


# -- pieces ---------------------------------------------------------------------------------


class WordCoder:
    """Ids of texts under a tokenizer that drops white space and merges within words only.

    Its pattern cuts a text into parts that are coded one by one, so a part's ids
    can be remembered. New parts go to the tokenizer many at once; a token that
    ends a part says so in its name. They are in small letters, composed and cut
    already, so there the tokenizer only maps bytes and merges. The letters and digits below are all there are
    up to U+024F; texts with other characters, in capitals or in small letters, and
    special strings go to the tokenizer whole.
    """

    LETTERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+"
    # Separators U+001C to U+001F are blanks to one side only; U+0130 has no single lower case.
    FOREIGN = "[\x1c-\x1f\u0130\u0250-\U0010ffff]|<\\|"
    END = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.of_parts = Tokenizer.from_file(path)
        self.of_parts.normalizer = None
        self.of_parts.pre_tokenizer = Sequenced([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.END)]] = True
        self.parts_of = re.compile(self.SPLIT).findall
        self.foreign_in = re.compile(self.FOREIGN).search
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str, tokenizer: Tokenizer | None = None) -> np.ndarray:
        # The fast call leaves out where tokens lie in the text.
        (coded,) = (tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)
        return np.array(coded.ids, np.uint32)

    def foreign(self, text: str) -> bool:
        """Whether the tokenizer must see the whole text."""
        try:
            # Most texts are of characters up to U+00FF, whose small letters are too.
            text.encode("latin-1")
        except UnicodeEncodeError:
            return bool(self.foreign_in(text) or self.foreign_in(text.lower()))
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")

    def _learn(self, parts: list[str]) -> None:
        ids = self._ids(" ".join(parts), self.of_parts)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(parts):
            data = ids.tobytes()
            marks = (4 * cuts).tolist()
            self.known.update(
                zip(parts, [data[x:y] for x, y in zip([0, *marks], marks, strict=False)], strict=True)
            )
        else:
            self.known.update((p, self._ids(p).tobytes()) for p in parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        # Some capitals up to U+024F have their small letter beyond it, and the other way round.
        small = [t.lower() for t in texts]
        rows = [
            None if self.foreign(t) else self.parts_of(low) for t, low in zip(texts, small, strict=True)
        ]
        new = set().union(*[r for r in rows if r]).difference(known)
        learned = list(new)
        for first in range(0, len(learned), PARTS_AT_ONCE):
            self._learn(learned[first : first + PARTS_AT_ONCE])
        out = [
            self._ids(t).tobytes() if parts is None else b"".join(map(known.__getitem__, parts))
            for t, parts in zip(texts, rows, strict=True)
        ]
        for long in [p for p in new if len(p) > LONGEST_REMEMBERED]:
            del known[long]
        return out


def _piece_type(with_ids: bool) -> ArrayType:
    ids = [StructField("ids", ArrayType(IntegerType()))] if with_ids else []
    return ArrayType(
        StructType(
            [
                StructField("piece", IntegerType()),
                StructField("start", LongType()),
                StructField("length", LongType()),
                StructField("ids_crc32", LongType()),
                *ids,
            ]
        )
    )


def piece_cutter(path: str, capacity: int, end_id: int, with_ids: bool = False) -> Callable:
    """A function from a text column to its pieces, an array of structs."""
    kind = _piece_type(with_ids)
    last = np.array([end_id], np.uint32).tobytes()

    @F.arrow_udf(kind)
    def cut(texts: pa.Array) -> pa.Array:
        coder = once_per_worker(("words", path), lambda: WordCoder(path))
        ends, piece, start, length, crc, parts = [0], [], [], [], [], []
        whole = [t or "" for t in texts.to_pylist()]
        for first in range(0, len(whole), TEXTS_AT_ONCE):
            for coded in coder.encode(whole[first : first + TEXTS_AT_ONCE]):
                ids = coded + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part)
                ends.append(len(piece))
        columns = [
            pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
        ]
        if with_ids:
            flat = pa.array(np.frombuffer(b"".join(parts), np.int32))
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), flat))
        rows = pa.StructArray.from_arrays(columns, names=kind.elementType.names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return cut


def pieces(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: Sequence[str] | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``row`` (columns ``keep``, all by default), ``piece``, ``start``, ``length``, ``ids_crc32``."""
    cut = piece_cutter(path, capacity, end_id, with_ids)
    packed = packed_rows(docs, keep, body=clean_text(docs[text]))
    return packed.select("row", F.explode(cut("body")).alias("p")).select("row", "p.*")


# -- plan -----------------------------------------------------------------------------------


def _best_fill(value: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total value within each number of units, and the item taken last (0: none).

    ``value[u]`` is the worth of an item of u units, at most 0 for an absent one.
    """
    best = np.zeros(units + 1)
    took = np.zeros(units + 1, np.int64)
    items = np.flatnonzero(value > 0)
    for room in range(1, units + 1):
        fits = items[: np.searchsorted(items, room, "right")]
        best[room] = best[room - 1]
        if len(fits):
            worth = value[fits] + best[room - fits]
            at = int(worth.argmax())
            if worth[at] > best[room]:
                best[room], took[room] = worth[at], fits[at]
    return best, took


def _configuration(first: int, took: np.ndarray, units: int) -> tuple[int, ...]:
    """The configuration that holds ``first`` and the best fill of what it leaves."""
    out, room = [first], units - first
    while room > 0:
        if took[room]:
            out.append(int(took[room]))
            room -= int(took[room])
        else:
            room -= 1
    return tuple(sorted(out, reverse=True))


def _solve(demand: np.ndarray, units: int) -> dict[tuple[int, ...], float]:
    """A near-least fractional cover of the demand per unit length by configurations."""
    present = np.flatnonzero(demand)
    weight = np.where(demand > 0, 1.0, 0.0)
    covered = np.zeros(units + 1)
    found: dict[tuple[int, ...], float] = defaultdict(float)
    for _ in range(ITERATIONS):
        value = np.divide(weight, demand, out=np.zeros(units + 1), where=demand > 0)
        best, took = _best_fill(value, units)
        holds = value[present] + best[units - present]
        chosen = present[holds >= NEAR_BEST * holds.max()]
        batch: dict[tuple[int, ...], float] = defaultdict(float)
        for first in chosen.tolist():
            batch[_configuration(first, took, units)] += float(demand[first])
        gain = np.zeros(units + 1)
        for config, share in batch.items():
            for u in config:
                gain[u] += share
        rate = np.divide(gain, demand, out=np.zeros(units + 1), where=demand > 0)
        step = STEP / rate.max()
        for config, share in batch.items():
            found[config] += step * share
        covered += step * rate
        weight *= np.exp(-step * rate)
        weight /= weight.max()
    # Scaled so that lengths are covered once on average; rounding mends the rest.
    scale = float(np.average(covered[present], weights=present * demand[present]))
    return {c: x / scale for c, x in found.items()}


def _rounded(solution: dict[tuple[int, ...], float], demand: np.ndarray) -> dict[tuple[int, ...], int]:
    """Whole multiplicities along running sums, within what is left of the demand (taken off it)."""
    out: dict[tuple[int, ...], int] = defaultdict(int)
    carried = 0.0
    for config in sorted(solution, key=lambda c: (-sum(c), c)):
        carried += solution[config]
        times = int(carried)
        for u, same in groupby(config):
            times = min(times, int(demand[u]) // len(list(same)))
        if times:
            carried -= times
            out[config] += times
            for u in config:
                demand[u] -= times
        carried = min(carried, 1.0)
    return out


class _Gaps:
    """Runs of sequences by their free room; smallest room that fits is found first."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[Run]] = defaultdict(list)
        self.rooms = 0

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        room = self.capacity - sum(lengths)
        self.by_room[room].append((lengths, count))
        self.rooms |= 1 << room

    def take(self, length: int, most: int) -> tuple[tuple[int, ...], int] | None:
        """Up to ``most`` sequences of the run with the least room for ``length``."""
        wide = self.rooms >> length
        if not wide:
            return None
        room = length + (wide & -wide).bit_length() - 1
        runs = self.by_room[room]
        lengths, count = runs.pop()
        if count > most:
            runs.append((lengths, count - most))
            count = most
        if not runs:
            self.rooms ^= 1 << room
        return lengths, count

    def put(self, length: int, count: int) -> None:
        """Place pieces of one length by best fit, opening sequences where nothing fits."""
        while count:
            got = self.take(length, count)
            if got is None:
                each = self.capacity // length
                full, rest = divmod(count, each)
                if full:
                    self.add((length,) * each, full)
                if rest:
                    self.add((length,) * rest, 1)
                return
            lengths, n = got
            times = min((self.capacity - sum(lengths)) // length, count // n)
            self.add((*lengths, *(length,) * times), n)
            count -= n * times

    def runs(self) -> list[Run]:
        return [run for room in sorted(self.by_room) for run in self.by_room[room]]


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best fit decreasing alone, as runs of (lengths, number of sequences)."""
    return _filled([], {}, dict(histogram), capacity)


def _filled(
    chosen: list[tuple[tuple[int, ...], int]], exact: dict[int, list[tuple[int, int]]], rest: dict[int, int], capacity: int
) -> list[Run]:
    """Sequences of the chosen configurations with true lengths, and all else by best fit decreasing."""
    gaps = _Gaps(capacity)
    exact = {u: list(have) for u, have in exact.items()}
    rest = dict(rest)

    def draw(u: int, most: int) -> tuple[int, int]:
        length, have = exact[u].pop()
        if have > most:
            exact[u].append((length, have - most))
        return length, min(have, most)

    for config, times in chosen:
        open_runs: list[Run] = [((), times)]
        for u in config:
            filled: list[Run] = []
            for lengths, count in open_runs:
                while count:
                    length, n = draw(u, count)
                    filled.append(((*lengths, length), n))
                    count -= n
            open_runs = filled
        for lengths, count in open_runs:
            gaps.add(lengths, count)
    for left in exact.values():
        for length, count in left:
            rest[length] = rest.get(length, 0) + count
    for length in sorted(rest, reverse=True):
        gaps.put(length, rest[length])
    return gaps.runs()


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Sequences as runs of (lengths, number of sequences) for a histogram of piece lengths.

    Rounding plants the program's configurations from a least fill on; of a few such
    levels the one that needs the fewest sequences is taken. The highest plants none,
    so a plan is never above best fit decreasing.
    """
    unit = max(1, capacity // UNITS)
    units = capacity // unit
    exact: dict[int, list[tuple[int, int]]] = defaultdict(list)
    demand = np.zeros(units + 1, np.int64)
    rest: dict[int, int] = {}
    for length, count in sorted(histogram.items()):
        u = -(-length // unit)
        if length * SMALL_SHARE > capacity and u <= units:
            exact[u].append((length, count))
            demand[u] += count
        else:
            rest[length] = count
    chosen: list[tuple[tuple[int, ...], int]] = []
    for _ in range(ROUNDS):
        if not demand.any():
            break
        found = _rounded(_solve(demand.astype(float), units), demand)
        if not found:
            break
        chosen += sorted(found.items(), key=lambda x: (-sum(x[0]), x[0]))
    plans = [
        _filled([x for x in chosen if sum(x[0]) >= least * units], exact, rest, capacity) for least in LEAST_FILLS
    ]
    return min(plans, key=lambda runs: sum(n for _, n in runs))


def places(runs: list[Run]) -> np.ndarray:
    """The plan per length: columns length, first rank, per sequence, first sequence, offset; sorted."""
    next_rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, count in runs:
        offset = 0
        for length, same in groupby(sorted(lengths, reverse=True)):
            each = len(list(same))
            rows.append((length, next_rank[length], each, sequence, offset))
            next_rank[length] += each * count
            offset += each * length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def plan_rows(rows: np.ndarray, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The row of ``places`` that holds each piece: by length first, then by rank among its rows.

    Both become small numbers before they share a key, so that lengths and ranks of
    any size fit: a length its place among lengths, a rank its place among first ranks.
    """
    lengths, ranks = np.unique(rows[:, 0]), np.unique(rows[:, 1])
    keys = np.searchsorted(lengths, rows[:, 0]) * (len(ranks) + 1) + np.searchsorted(ranks, rows[:, 1], "right")
    asked = np.searchsorted(lengths, length) * (len(ranks) + 1) + np.searchsorted(ranks, rank, "right")
    return np.searchsorted(keys, asked, "right") - 1


_PLACE = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])


def pack(pieces_table: DataFrame, order: Sequence[str], capacity: int = CAPACITY) -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to a materialized table with a column ``length``.

    ``order`` names columns that tell pieces apart. The plan is broadcast: its
    size follows the number of lengths and configurations, not of pieces.
    """
    counts = pieces_table.groupBy("length").agg(F.count("*").alias("n")).collect()
    table = places(plan({r["length"]: r["n"] for r in counts}, capacity))
    shared = pieces_table.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(_PLACE)
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows = shared.value
        size = length.to_numpy(zero_copy_only=False)
        at = rank.to_numpy(zero_copy_only=False)
        found = rows[plan_rows(rows, size, at)]
        turn, nth = np.divmod(at - found[:, 1], found[:, 2])
        return pa.StructArray.from_arrays(
            [pa.array(found[:, 3] + turn), pa.array(found[:, 4] + nth * size)], names=_PLACE.names
        )

    ranked = rank_in_groups(pieces_table, "length", order, "_rank", rows_per_slice=4_000)
    return (
        ranked.withColumn("_place", place("length", "_rank"))
        .select("*", "_place.sequence_id", "_place.offset")
        .drop("_rank", "_place")
    )


def packed_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document."""
    cut = materialize(
        pieces(docs, path, text, keep=[doc_id]).select(
            F.col("row")[doc_id].alias("doc_id"), "piece", "start", "length", "ids_crc32"
        )
    )
    return pack(cut, ["doc_id", "piece", "ids_crc32"])
