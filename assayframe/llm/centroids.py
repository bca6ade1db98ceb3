"""Centroid clustering over whole numbers, with distances taken once per distinct subvector.

Vectors become whole numbers, floor(256 * x). A task encodes portions of them without
loss: first the different vectors of a portion, then blocks of their dimensions, each
block as a dictionary of distinct subvectors and a code per vector. The width of the
blocks is the one that makes a round cheapest: with wide blocks few sums per vector,
with narrow ones short dictionaries. Encoded portions are written once.

A round gives every portion the centroids (``k`` of them, a fixed number). The portion
takes the exact squared distance of every subvector in its dictionaries to the same
block of every centroid, and a vector's distance is the sum over its codes. Sums and
counts per cluster come from the same codes: how often a cluster has a code, times
the code's subvector. They leave a task as at most ``k`` rows and are added by Spark,
in whole numbers, so any order gives the same centroids. No vector is shuffled, and a
vector that a third of all rows share is one entry of each portion.

Defined cases: vectors with another number of components, and those with a null or
non-finite one, are left out; a null id is kept and never a first centroid unless
ids run out; repeated rows count each; fewer vectors than ``k`` give as many
centroids as there are vectors; other columns are ignored, whatever their names; an
empty table gives an empty table. Components of 2**19 or more in size are an error,
since distances must fit in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import materialize

COMPONENTS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SALT = "2:"
# A portion holds so many vectors at most; codes are 16-bit numbers.
PORTION = 1 << 15
WIDTHS = (8, 4, 2, 1)
LARGEST = 1 << 27
# Below this size sums of 64 squares are exact in doubles.
EXACT = 1 << 22

_ENCODED = "n bigint, width int, ids binary, missing binary, which binary, sizes binary, subvectors binary, codes binary"


def _keys(block: np.ndarray) -> np.ndarray | None:
    """One whole number per subvector, different for different ones, or None where 63 bits are too few."""
    low = int(block.min())
    bits = max(1, int(block.max() - low).bit_length())
    if bits * block.shape[1] > 63:
        return None
    key = np.zeros(len(block), np.int64)
    for column in block.T:
        key = key << bits | (column.astype(np.int64) - low)
    return key


def _dictionaries(vectors: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Per block its distinct subvectors and every vector's code; None if the blocks are too wide."""
    out = []
    for at in range(0, vectors.shape[1], width):
        block = vectors[:, at : at + width]
        key = _keys(block)
        if key is None:
            return None
        _, first, code = np.unique(key, return_index=True, return_inverse=True)
        out.append((block[first], code))
    return out


def _cost(blocks: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """Multiplications of a round over the dictionaries, and additions over the codes."""
    return sum(d.size for d, _ in blocks) + sum(len(c) for _, c in blocks)


@dataclass(frozen=True)
class Portion:
    """Vectors of a portion: distinct ones by blocks, and which of them each row holds."""

    which: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, vectors: np.ndarray) -> Portion:
        different, which = np.unique(vectors, axis=0, return_inverse=True)
        tried = [b for w in WIDTHS if (b := _dictionaries(different, w)) is not None]
        return cls(which.reshape(-1), min(tried, key=_cost))

    def vectors(self) -> np.ndarray:
        return np.hstack([d[c] for d, c in self.blocks])[self.which]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of every distinct vector; ties go to the smaller number."""
        count = len(self.blocks[0][1])
        total = np.zeros((count, len(centroids)), np.int64)
        small = max(int(np.abs(centroids).max()), *(int(np.abs(d).max()) for d, _ in self.blocks)) < EXACT
        at = 0
        for subvectors, code in self.blocks:
            x = subvectors.astype(np.float64 if small else np.int64)
            c = centroids[:, at : at + x.shape[1]].astype(x.dtype)
            table = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
            total += table.astype(np.int64)[code]
            at += x.shape[1]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(count), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows per cluster, and componentwise sums from how often a cluster has each code."""
        times = np.bincount(self.which, minlength=len(cluster))
        parts = []
        for subvectors, code in self.blocks:
            often = np.zeros((k, len(subvectors)), np.int64)
            np.add.at(often, (cluster, code), times)
            parts.append(often @ subvectors.astype(np.int64))
        rows = np.zeros(k, np.int64)
        np.add.at(rows, cluster, times)
        return rows, np.hstack(parts)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        ids, missing, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        for k in range(0, len(ids), PORTION):
            part = slice(k, k + PORTION)
            made = Portion.of(vectors[part])
            row = {
                "n": len(ids[part]), "width": made.blocks[0][0].shape[1],
                "ids": ids[part].tobytes(), "missing": np.packbits(missing[part]).tobytes(),
                "which": made.which.astype("<u2").tobytes(),
                "sizes": np.array([len(d) for d, _ in made.blocks], "<i4").tobytes(),
                "subvectors": np.concatenate([d.reshape(-1) for d, _ in made.blocks]).astype("<i4").tobytes(),
                "codes": np.concatenate([c for _, c in made.blocks]).astype("<u2").tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], _SCHEMA)

    for batch in batches:
        ids = batch.column(0)
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        numbers = np.floor(SCALE * flat.reshape(-1, COMPONENTS))
        if np.abs(numbers).max(initial=0) >= LARGEST:
            raise ValueError("a component is too large for distances in 64 bits")
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), missing, numbers.astype(np.int32)))
        if sum(len(x) for x, _, _ in held) >= PORTION:
            yield from out()
    if held:
        yield from out()


_SCHEMA = pa.schema(
    [("n", pa.int64()), ("width", pa.int32())]
    + [(c, pa.binary()) for c in ("ids", "missing", "which", "sizes", "subvectors", "codes")]
)


def _decoded(row: dict) -> Portion:
    sizes = np.frombuffer(row["sizes"], "<i4")
    subvectors = np.frombuffer(row["subvectors"], "<i4").reshape(-1, row["width"])
    codes = np.frombuffer(row["codes"], "<u2").reshape(len(sizes), -1)
    cuts = np.cumsum(sizes)[:-1]
    return Portion(np.frombuffer(row["which"], "<u2"), list(zip(np.split(subvectors, cuts), codes, strict=True)))


def kept_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the vectors that take part."""
    x = table[embedding].cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return table.where((F.size(table[embedding]) == COMPONENTS) & whole).select(
        table[vec_id].cast("bigint").alias("vec_id"), x.alias("x")
    )


def encoded(kept: DataFrame) -> DataFrame:
    """Portions of vectors as dictionaries and codes, written once."""
    return materialize(kept.mapInArrow(_encode, _ENCODED))


def first_centroids(kept: DataFrame, k: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The vectors of the ``k`` rows with the least hash of salt and id; ``k`` bounds what is fetched."""
    drawn = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(drawn.asc_nulls_last(), "x").limit(k).collect()
    return np.floor(SCALE * np.array([r["x"] for r in rows], np.float64).reshape(-1, COMPONENTS)).astype(np.int64)


def _assigned(centroids: np.ndarray, emit: Callable[[dict, Portion, np.ndarray, np.ndarray], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                portion = _decoded(row)
                yield emit(row, portion, *portion.nearest(centroids))

    return run


def next_centroids(portions: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: exact floors of the means; empty clusters stay."""
    k = len(centroids)
    names = [f"s{d}" for d in range(COMPONENTS)]

    def sums(_: dict, portion: Portion, cluster: np.ndarray, __: np.ndarray) -> pa.RecordBatch:
        rows, total = portion.sums(cluster, k)
        used = np.flatnonzero(rows)
        columns = [used, rows[used], *np.ascontiguousarray(total[used].T)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "n", *names])

    ddl = "cluster bigint, n bigint, " + ", ".join(f"{s} bigint" for s in names)
    found = (
        portions.mapInArrow(_assigned(centroids, sums), ddl)
        .groupBy("cluster")
        .agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
        .collect()
    )
    out = centroids.copy()
    for r in found:
        out[r["cluster"]] = [r[s] // r["n"] for s in names]
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` per vector, and the centroids."""
    spark = table.sparkSession
    kept = kept_vectors(table, vec_id, embedding)
    portions = encoded(kept)
    centroids = first_centroids(kept, k)
    if len(centroids):
        for _ in range(rounds):
            centroids = next_centroids(portions, centroids)

    def inertia(_: dict, portion: Portion, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        total = np.zeros(len(centroids), np.int64)
        np.add.at(total, cluster, distance * np.bincount(portion.which, minlength=len(cluster)))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cluster", "d"])

    def rows(row: dict, portion: Portion, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        missing = np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=row["n"]).astype(bool)
        ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=missing)
        columns = [ids, pa.array(cluster[portion.which].astype(np.int32)), pa.array(distance[portion.which])]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    within = portions.mapInArrow(_assigned(centroids, inertia), "cluster bigint, d bigint").groupBy("cluster").agg(F.sum("d").alias("d"))
    per_cluster = {r["cluster"]: r["d"] for r in within.collect()}
    about = [
        (c, per_cluster.get(c, 0), sum(per_cluster.values()), centroid_digest(x)) for c, x in enumerate(centroids)
    ]
    # One row per centroid.
    facts = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = portions.mapInArrow(_assigned(centroids, rows), "vec_id bigint, cluster int, distance bigint")
    return (
        out.join(F.broadcast(facts), "cluster").select(
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
        ),
        centroids,
    )


def oracle(table: str = "embeddings", k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same clusters in DuckDB SQL, a step of CTEs per round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    far{r} AS MATERIALIZED (SELECT v.rid, c.k, sum((v.v - c.v) * (v.v - c.v)) AS dist FROM comp v JOIN cent{r} c ON v.d = c.d GROUP BY v.rid, c.k),
    near{r} AS MATERIALIZED (SELECT rid, k, dist FROM far{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, k) = 1)""")
        if r < rounds:
            steps.append(f"""
    mean{r} AS (SELECT n.k, v.d, CAST(floor(CAST(sum(v.v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM near{r} n JOIN comp v ON v.rid = n.rid GROUP BY n.k, v.d),
    cent{r + 1} AS MATERIALIZED (SELECT c.k, c.d, coalesce(m.v, c.v) AS v FROM cent{r} c LEFT JOIN mean{r} m ON m.k = c.k AND m.d = c.d)""")
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
      FROM {table} WHERE len(embedding) = {COMPONENTS}
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
    comp AS MATERIALIZED (SELECT rid, unnest(range(1, {COMPONENTS + 1})) AS d, unnest(x) AS v FROM kept),
    drawn AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SALT}' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS k FROM kept),
    cent0 AS MATERIALIZED (SELECT k, d, v FROM drawn JOIN comp USING (rid) WHERE k < {k}),{",".join(steps)},
    names AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM cent{rounds} GROUP BY k)
    SELECT kept.vec_id, CAST(k AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
      CAST(sum(dist) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM near{rounds} JOIN kept USING (rid) JOIN names USING (k)"""
