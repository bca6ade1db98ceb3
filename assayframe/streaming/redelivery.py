"""First deliveries of a stream, with no key kept in memory.

Keys seen before lie on disk in runs of doubling size. Recent runs are small and are
compared exactly. Each older run has a membership filter, a bitmap of about 16 bits a
key cut into pieces of 4 KB: all bits of a key lie in one piece, so a batch looks its
keys up in all filters by one equality join. Only keys with all bits set are suspected
and compared exactly, in the parts of the runs where their hash lies; those parts are
read where they lie and meet the suspected hashes, so old keys are not shuffled unless
very many are suspected. A filter has no false negative and every hit is checked, so no first delivery is lost and
no second one passes, however late.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assayframe.session import path_exists
from assayframe.streaming.runs import Run, Runs, covering

DELIVERY_KEY = ("run_id", "ligand_id", "timestamp")
PIECE_BITS = 32_768
PROBES = 4
# So many suspected hashes (8 bytes each) go to every task; more are shuffled with the keys.
BROADCAST_HASHES = 500_000


def _places() -> list[Column]:
    """The bit positions of a key in its piece: 15 bits each of one more hash."""
    mixed = F.xxhash64(F.lit(PROBES), F.col("_hash"))
    return [F.shiftright(mixed, 15 * i).bitwiseAND(F.lit(PIECE_BITS - 1)).cast("int") for i in range(PROBES)]


def _piece(pieces: int) -> Column:
    """The piece of a key in a filter of so many; the hash itself also tells the key's part."""
    return F.pmod(F.xxhash64(F.lit(0), F.col("_hash")), F.lit(pieces))


def _all_set(words: Column) -> Column:
    """Whether a piece, as 64-bit words, has every bit of the key."""
    found = [F.getbit(F.get(words, F.shiftright(p, 6)), p.bitwiseAND(F.lit(63))) == 1 for p in _places()]
    return reduce(lambda x, y: x & y, found)


class RedeliveryGuard:
    """Batch operator that writes each record once, at its first delivery.

    Null key fields are values like any other. Of equal keys within one batch any one
    record stays. ``recent`` is the number of batches from which on a run gets a filter,
    ``bits`` the filter's size per key, ``part_keys`` the keys of one part of a run.
    """

    def __init__(
        self, spark: SparkSession, folder: str, key: Sequence[str] = DELIVERY_KEY,
        recent: int = 4, bits: float = 16, part_keys: int = 1_000_000,
    ) -> None:
        self.spark, self.folder, self.key = spark, folder, list(key)
        self.recent, self.bits, self.part_keys = recent, bits, part_keys
        self.runs = Runs(spark, f"{folder}/keys", lambda keys: keys.select(*self.key, "_hash"))
        self._in = f"{folder}/in"
        self._held: list[DataFrame] = []

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # Through a file, so that the batch lies in as many tasks as its size asks for, not in one per shuffle partition.
        batch.dropDuplicates(self.key).withColumn("_hash", F.xxhash64(*self.key)).write.mode("overwrite").parquet(self._in)
        rows = self.spark.read.schema(StructType([*batch.schema.fields, StructField("_hash", LongType())])).parquet(self._in)
        self.runs.schema = rows.select(
            *self.key, "_hash", F.lit(0).alias("_parts"), F.lit(0).alias("_part")
        ).schema
        try:
            fresh = rows
            if seen := self._seen(rows, covering(batch_id)):
                before = reduce(DataFrame.unionByName, seen)
                same = [rows[c].eqNullSafe(before[c]) for c in self.key]
                fresh = fresh.join(before, [rows["_hash"] == before["_hash"], *same], "left_anti")
            fresh.write.mode("overwrite").parquet(self._out(batch_id))
        finally:
            for held in self._held:
                held.unpersist()
            self._held.clear()
        firsts = self.spark.read.parquet(self._out(batch_id)).select(*self.key, "_hash")
        run = self.runs.add(batch_id, firsts, self._write_keys)
        if self._filtered(run):
            self._write_filter(run)

    def results(self) -> DataFrame:
        """All first deliveries of the batches folded in so far."""
        outs = [self._out(b) for b in range(self.runs.batches())]
        if not outs:
            raise ValueError("no batch was folded in yet")
        return self.spark.read.parquet(*outs).drop("_hash")

    def _out(self, batch_id: int) -> str:
        return f"{self.folder}/out/{batch_id:010d}"

    def _filtered(self, run: Run) -> bool:
        return run[1] - run[0] >= self.recent

    def _write_keys(self, keys: DataFrame, path: str) -> None:
        """Keys in parts by hash, so that a check reads only the parts it asks for."""
        parts = max(1, -(-keys.count() // self.part_keys))
        part = F.pmod(F.col("_hash"), F.lit(parts)).cast("int")
        keys.select("*", F.lit(parts).alias("_parts"), part.alias("_part")).repartitionById(
            parts, F.col("_part")
        ).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_parts", "_part").parquet(path)

    def _filter(self, run: Run) -> str:
        return f"{self.runs.beside(run)}/pieces"

    def _write_filter(self, run: Run) -> None:
        """The filter of a run; its folder names tell its pieces and the run's parts."""
        keys = self.runs.table(run)
        pieces = max(1, -(-int(keys.count() * self.bits) // PIECE_BITS))
        # Bytes of a word are read from the highest on: 56 turns their order round.
        place = keys.select("_parts", _piece(pieces).alias("piece"), F.explode(F.array(*_places())).alias("place"))
        bitmap = place.groupBy("piece").agg(
            F.max("_parts").alias("_parts"),
            F.bitmap_construct_agg(F.col("place").bitwiseXOR(F.lit(56)).cast("bigint")).alias("bits"),
        )
        words = F.transform(
            F.sequence(F.lit(0), F.lit(PIECE_BITS // 64 - 1)),
            lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint"),
        )
        bitmap.select("piece", words.alias("words"), F.lit(pieces).alias("_pieces"), "_parts").write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "static").partitionBy("_pieces", "_parts").parquet(self._filter(run))

    def _sizes(self, run: Run) -> tuple[int, int] | None:
        """Pieces of a run's filter and parts of the run; None if it has no key."""
        place, files = self.runs._hadoop(f"{self._filter(run)}/_pieces=*/_parts=*")
        for status in files.globStatus(place) or []:
            laid = status.getPath()
            return int(laid.getParent().getName().split("=")[1]), int(laid.getName().split("=")[1])
        return None

    def _seen(self, rows: DataFrame, runs: list[Run]) -> list[DataFrame]:
        """Tables of earlier keys that together hold every key of ``rows`` that came before."""
        # Without its filter (an operator with another ``recent`` wrote the run) all of a run is compared.
        known = [r for r in runs if self._filtered(r) and path_exists(self.spark, f"{self._filter(r)}/_SUCCESS")]
        exact = [r for r in runs if r not in known]
        seen = [self.runs.read(exact).select(*self.key, "_hash")] if exact else []
        if known and (found := self._suspected(rows, *known)) is not None:
            seen.append(found)
        return seen

    def _suspected(self, rows: DataFrame, *runs: Run) -> DataFrame | None:
        """The keys of older runs whose hash is that of a suspected key of ``rows``; None if none is suspected."""
        sizes = {i: laid for i, run in enumerate(runs) if (laid := self._sizes(run))}
        if not sizes:
            return None
        ask = [
            F.struct(F.lit(i).alias("run"), _piece(pieces).alias("piece"), F.pmod("_hash", F.lit(parts)).cast("int").alias("part"))
            for i, (pieces, parts) in sizes.items()
        ]
        asked = rows.select("_hash", F.inline(F.array(*ask)))
        filters = [
            self.spark.read.schema("piece bigint, words array<bigint>").parquet(self._filter(runs[i])).select(
                F.lit(i).alias("run"), "piece", "words"
            )
            for i in sizes
        ]
        suspects = asked.join(reduce(DataFrame.unionByName, filters), ["run", "piece"]).where(
            _all_set(F.col("words"))
        ).select("run", "part", "_hash").persist()
        self._held.append(suspects)
        # Part numbers are folder names of the run: they grow with its files, not with its keys.
        wanted = suspects.groupBy("run", "part").count().collect()
        if not wanted:
            return None
        hashes = suspects.select("_hash")
        few = sum(r["count"] for r in wanted) <= BROADCAST_HASHES
        hashes = F.broadcast(hashes) if few else hashes.hint("shuffle_hash")
        asked_parts = [(runs[i], [r["part"] for r in wanted if r["run"] == i]) for i in sizes]
        keys = [self.runs.table(run).where(F.col("_part").isin(parts)) for run, parts in asked_parts if parts]
        return reduce(DataFrame.unionByName, keys).select(*self.key, "_hash").join(hashes, "_hash", "left_semi")
