"""SimHash near-duplicates by an embedding into segment popcounts.

A fingerprint of 64 bits maps to its popcounts over 32 segments of two bits. The
Manhattan distance of two such vectors never exceeds the number of differing
bits, so fingerprints within reach are within reach in the embedding, and a range
join there finds them all: the segments form ``groups`` blocks of coordinates, at
most ``reach`` blocks can differ between neighbours, so two neighbours share the
grid cell of at least one choice of ``groups - reach`` blocks. Members of a cell
are compared by Manhattan distance first, and by exact Hamming distance last.

Equal fingerprints are one node from the start. A cell holding many different
fingerprints is cut into blocks and every pair of blocks goes to its own task, so
no task holds more than two blocks. Each comparison task answers with stars, one
centre per connected set, never with all pairs of a dense set.

Defined cases: null and empty texts have no words and the fingerprint zero, which
links like any other; repeated rows have one fingerprint; a null ``doc_id`` is
ignored when a component is named and gets that name too (null where no member
has an id); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from assayframe.llm.common import materialize, packed_rows
from assayframe.llm.components import components

SHINGLE = 4
REACH = 4
GROUPS = 7
BLOCK_ROWS = 4096
HASHES_AT_ONCE = 1 << 17
LOW = 0x5555555555555555
# A hot-cell list up to this many rows (24 bytes each) is broadcast, a longer one is joined.
BROADCAST_CELLS = 100_000


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Majority bit by bit of the XXH64 (seed 42) of all word shingles, as a signed long."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    total = len(starts)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, HASHES_AT_ONCE):
        spans = zip(
            starts[at : at + HASHES_AT_ONCE].tolist(), ends[at : at + HASHES_AT_ONCE].tolist(), strict=True
        )
        hashes = np.array([digest(joined[x:y], 42) for x, y in spans], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
        ones += np.ones(len(bits), np.float32).dot(bits.astype(np.float32)).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


@F.arrow_udf(LongType())
def _fingerprint_udf(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(x) for x in texts.to_pylist()], pa.int64())


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    return df.withColumn(name, _fingerprint_udf(F.coalesce(text.cast("binary"), F.lit(b""))))


def _embedded(fp: Column) -> Column:
    """Popcounts of all two-bit segments, each in its own two bits."""
    high = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(high).bitwiseAND(F.lit(LOW))
    two = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def _group_masks(groups: int) -> list[int]:
    """Bits of each block of coordinates; 32 segments dealt out as evenly as can be."""
    edges = [32 * g // groups for g in range(groups + 1)]
    return [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(fps: DataFrame, reach: int = REACH, groups: int = GROUPS) -> DataFrame:
    """``(cell, fp)``: every grid cell in which a fingerprint must meet its neighbours."""
    masks = _group_masks(groups)
    choices = [sum(pick) for pick in combinations(masks, groups - reach)]
    keys = F.array(
        *[
            F.xxhash64(F.lit(i), F.col("_e").bitwiseAND(F.lit(_signed(m))))
            for i, m in enumerate(choices)
        ]
    )
    return fps.select("fp", _embedded(F.col("fp")).alias("_e")).select(
        "fp", F.explode(keys).alias("cell")
    )


def _blocked(placed: DataFrame, block_rows: int) -> DataFrame:
    """Cut cells of more than ``block_rows`` members into blocks, one task group per pair of blocks."""
    hot = materialize(
        placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
        .select("cell", F.ceil(2 * F.col("n") / block_rows).cast("int").alias("blocks"))
    )
    few = hot.count() <= BROADCAST_CELLS
    joined = placed.join(F.broadcast(hot) if few else hot, "cell", "left")
    block = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.xxhash64(
            "cell", F.least(other, F.col("block")), F.greatest(other, F.col("block"))
        ),
    )
    return (
        joined.withColumn("block", block)
        .withColumn("groups", F.when(F.col("blocks").isNull(), F.array("cell")).otherwise(pairs))
        .select(F.explode("groups").alias("cell"), "fp")
    )


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of two packed vectors of counts 0, 1, 2."""
    mixed = x ^ y
    ones = mixed & np.uint64(LOW)
    twos = (mixed >> np.uint64(1)) & np.uint64(LOW) & ~ones
    return np.bitwise_count(ones) + 2 * np.bitwise_count(twos)


def _near(x: np.ndarray, y: np.ndarray, ex: np.ndarray, ey: np.ndarray, reach: int) -> np.ndarray:
    """Positions within reach: Manhattan bound first, exact distance on what is left."""
    at = np.flatnonzero(_manhattan(ex, ey) <= reach)
    other = y[at] if y.ndim else y
    return at[np.bitwise_count(x[at] ^ other) <= reach]


def _stars(members: np.ndarray, embedded: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Each connected set of one cell as a star around its first member."""
    left = np.arange(1, len(members))
    todo, centre, roots, leaves = [0], 0, [], []
    while True:
        if todo:
            i = todo.pop()
            found = left[
                _near(members[left], members[i], embedded[left], embedded[i], reach)
            ]
            if len(found):
                left = np.setdiff1d(left, found, assume_unique=True)
                roots.append(np.full(len(found), centre))
                leaves.append(found)
                todo.extend(found.tolist())
        if not len(left):
            break
        if not todo:
            centre = int(left[0])
            left, todo = left[1:], [centre]
    if not roots:
        return members[:0], members[:0]
    return members[np.concatenate(roots)], members[np.concatenate(leaves)]


def _links_of(cell: np.ndarray, fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the cells of one sorted stretch of rows."""
    embedded = fp - ((fp >> np.uint64(1)) & np.uint64(LOW))
    edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    sizes = np.diff(edges)
    a, b = [], []
    small = np.repeat(sizes <= 8, sizes)
    for step in range(1, 8):
        at = np.flatnonzero((cell[step:] == cell[:-step]) & small[step:])
        if not len(at):
            break
        at = at[_near(fp[at], fp[at + step], embedded[at], embedded[at + step], reach)]
        a.append(fp[at])
        b.append(fp[at + step])
    for k in np.flatnonzero(sizes > 8):
        x, y = edges[k], edges[k + 1]
        roots, leaves = _stars(fp[x:y], embedded[x:y], reach)
        a.append(roots)
        b.append(leaves)
    if not a:
        return fp[:0], fp[:0]
    return np.concatenate(a), np.concatenate(b)


def _cell_links(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_cell, kept_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def answer(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _links_of(cell, fp, reach)
            pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"]
            )

        for batch in batches:
            cell = np.concatenate((kept_cell, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate(
                (kept_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            )
            if not len(cell):
                continue
            whole = int(np.searchsorted(cell, cell[-1]))
            if whole:
                yield answer(cell[:whole], fp[:whole])
            kept_cell, kept_fp = cell[whole:], fp[whole:]
        if len(kept_cell):
            yield answer(kept_cell, kept_fp)

    return run


def near_links(
    fps: DataFrame, reach: int = REACH, groups: int = GROUPS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints at ``reach`` or fewer differing bits.

    ``fps`` holds each ``fp`` once. Links connect what is connected; a dense set
    comes as stars, so the number of links follows the number of fingerprints.
    """
    if not 0 < reach < groups <= 32:
        raise ValueError("groups must exceed reach and not exceed 32")
    return (
        _blocked(cells(fps, reach, groups), block_rows)
        .repartition("cell")
        .sortWithinPartitions("cell", "fp")
        .select("cell", "fp")
        .mapInArrow(_cell_links(reach), "a bigint, b bigint")
    )


def grouped(keyed: DataFrame, reach: int = REACH, groups: int = GROUPS) -> DataFrame:
    """``(fp, root, component_id)`` for a materialized table ``(doc_id, fp)``."""
    fps = materialize(keyed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(fps.select("fp"), reach, groups), "a", "b")
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp, root, component_id)``, one row per row of ``docs``."""
    keyed = materialize(
        with_fingerprint(
            docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("body")), F.col("body"), "fp"
        ).select("doc_id", "fp")
    )
    return keyed.join(grouped(keyed), "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Keep of each group the document that names it; of repeated rows, one.

    A group without any id keeps one row. Other columns pass through untouched.
    """
    found = materialize(near_groups(docs, text, doc_id))
    names = F.col("doc_id").eqNullSafe(F.col("component_id"))
    named = found.where(names)
    # An id counts by all of its rows, also by those that do not name their group.
    uses = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(names).alias("names")).where("names")
    once = uses.where("n = 1 and doc_id is not null").select(F.col("doc_id").alias("_id"))
    packed = packed_rows(docs, _id=docs[doc_id], _text=docs[text])
    single = packed.join(once, "_id", "left_semi").select("row.*")
    again = materialize(uses.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return single
    # Ids that several rows share: look at each row's own group and keep one row of it.
    shared = named.select("doc_id", "fp", "root").distinct()
    several = (
        with_fingerprint(
            packed.join(again, F.col("_id").eqNullSafe(F.col("_again"))), F.col("_text"), "_fp"
        )
        .join(shared, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_fp") == F.col("fp")))
        .dropDuplicates(["root"])
    )
    return single.unionByName(several.select("row.*"))


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
