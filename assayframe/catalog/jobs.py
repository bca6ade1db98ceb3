"""User functions over rows, and streaming views, as queries."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.catalog import standins as S
from assayframe.catalog.registry import ORACLES, query, sql_seed
from assayframe.functions.scoring import best_affinity
from assayframe.functions.seeds import stable_seed
from assayframe.operators import batchmap
from assayframe.sources.journal_tail import tail_journal, tail_lines
from assayframe.streaming import journal_stream as J
from assayframe.streaming import online
from assayframe.streaming.redelivery import RedeliveryGuard


class PriceScorer:
    """Deterministic scorer: reads ``price status`` and returns two modes."""

    def score(
        self, ligand_id: str, text: str, seed: int, want_poses: bool
    ) -> tuple[Sequence[tuple[float, float, float]], str | None]:
        price, status, priority = text.split("|")
        if status == "P":
            raise batchmap.ScoringError(f"could not load {ligand_id}")
        if priority.startswith("5"):
            raise batchmap.ScoringError("cannot find affinity maps", setup=True)
        if priority.startswith("4"):
            raise ValueError("unspecified")
        modes = [(-float(price), 0.0, 0.0), (-float(price) / 2, 1.0, 2.0)]
        return modes, f"REMARK {seed}" if want_poses else None


@query(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS ligand_id,
       CASE WHEN o_orderstatus = 'P' OR o_orderpriority[1] IN ('4', '5') THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN o_orderstatus <> 'P' AND o_orderpriority[1] NOT IN ('4', '5') THEN -o_totalprice END AS best_affinity,
       {sql_seed("'3:' || o_orderkey")} AS row_seed,
       CASE WHEN o_orderstatus = 'P' THEN 'could not load ' || o_orderkey
            WHEN o_orderpriority[1] = '5' THEN 'cannot find affinity maps' WHEN o_orderpriority[1] = '4' THEN 'ValueError: unspecified' END AS error,
       CASE WHEN o_orderstatus <> 'P' AND o_orderpriority[1] = '5' THEN 'setup'
            WHEN o_orderstatus = 'P' OR o_orderpriority[1] = '4' THEN 'ligand' END AS error_kind,
       CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'P' AND o_orderpriority[1] NOT IN ('4', '5')
            THEN 'REMARK ' || ({sql_seed("'3:' || o_orderkey")}) END AS poses
FROM orders
""")
def safe_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer over every row; failures come back as rows."""
    key = F.col("o_orderkey").cast("string")
    rows = S.table(spark, sf_dir, "orders").select(
        key.alias("ligand_id"),
        F.concat_ws("|", F.col("o_totalprice").cast("string"), "o_orderstatus", "o_orderpriority").alias("text"),
        stable_seed(3, key).alias("row_seed"),
        (F.col("o_custkey") % 2 == 0).alias("want_poses"),
    )
    scored = batchmap.safe_map(rows, lambda config: PriceScorer(), {"seed": 3})
    return scored.select(
        "ligand_id", "status", best_affinity(F.col("modes")).alias("best_affinity"),
        "row_seed", "error", "error_kind", "poses",
    )


def _parse(record: dict[str, Any], config: dict[str, Any]) -> dict[str, Any] | None:
    name = record["block"]
    if name.endswith("7"):
        raise ValueError(f"bad record {name}")
    return {"smiles": name.lower(), "rot_bonds": len(name) % 5} if not name.endswith("9") else None


def _embed(record: dict[str, Any], config: dict[str, Any]) -> dict[str, Any]:
    if record["block"].endswith("3"):
        raise ValueError("no geometry")
    return {"texts": [record["smiles"]], "torsions": 30 + int(record["block"][-1])}


def _embed_plainly(record: dict[str, Any], config: dict[str, Any]) -> dict[str, Any]:
    return {"texts": ["kept"], "torsions": 1}


@query("""
WITH c AS (SELECT c_name, right(c_name, 1) AS d FROM customer)
SELECT c_name AS ligand_id, CASE WHEN d IN ('7', '9') THEN 'failed' ELSE 'ok' END AS outcome,
       CASE WHEN d IN ('7', '9') THEN 'parse' END AS stage,
       CASE d WHEN '7' THEN 'bad record ' || c_name WHEN '9' THEN 'parse produced nothing' END AS error,
       CASE WHEN d IN ('7', '9') THEN NULL WHEN d = '3' THEN 'kept' ELSE lower(c_name) END AS text,
       CASE WHEN d IN ('7', '9') THEN NULL WHEN d = '3' THEN 1 ELSE 30 + CAST(d AS INTEGER) END AS torsions,
       CASE WHEN d = '3' THEN 'embed failed (no geometry); used fallback'
            WHEN d IN ('4', '5', '6', '8') THEN (30 + CAST(d AS INTEGER)) || ' active torsions; scoring will be slow and imprecise' ELSE '' END AS warnings
FROM c
""")
def staged_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages over every row; the first failing one names the failure."""
    rows = S.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("ligand_id"), F.col("c_mktsegment").alias("compound_id"),
        F.col("c_name").alias("block"),
    )
    done = batchmap.run_stages(
        rows, [("parse", _parse), ("embed", _embed)], {}, {"embed": _embed_plainly}
    )
    return done.select(
        "ligand_id", "outcome", "stage", "error", F.get("texts", F.lit(0)).alias("text"),
        "torsions", F.array_join("warnings", "; ").alias("warnings"),
    )


EVENT_FILES = 9


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of journal records.

    All rows are dealt by a hash over files that several micro-batches read, so
    times and ordinals arrive out of order.
    """
    folder = J.scratch_folder(spark, "events")
    stored = spark.read.parquet(f"{sf_dir}/events.parquet")
    stored.repartition(EVENT_FILES, F.xxhash64("event_id")).write.option(
        "maxRecordsPerFile", 250_000
    ).parquet(folder)
    events = (
        spark.readStream.schema(stored.schema)
        .option("maxFilesPerTrigger", EVENT_FILES // 3)
        .parquet(folder)
    )
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").cast("string").alias("run_id"),
        k.cast("string").alias("ligand_id"),
        F.when(failed, "failed").when(F.col("event_type") == "view", "skipped").otherwise("ok").alias("status"),
        F.when(failed, "setup").alias("error_kind"),
        F.col("event_id").alias("ordinal"),
        F.floor(S.epoch_seconds("ts") / 86400).cast("double").alias("timestamp"),
        F.when(F.col("event_type") == "purchase", "finished").when(failed, "failed")
        .when(F.col("event_type") == "signup", "cancelled").otherwise("running").alias("state"),
    )


@query("""
SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) FILTER (event_type NOT IN ('error', 'view')) AS completed,
       count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped
FROM events GROUP BY user_id
""")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts per run from a stream."""
    counts = J.stream_status(_event_stream(spark, sf_dir))
    return J.newest(J.drain_to_table(counts, "update", "status"), "run_id")


@query("""
WITH marked AS (
  SELECT user_id, event_id, event_type = 'error' AS hit,
         count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
streaks AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM marked WHERE hit)
SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS ordinal, streak FROM streaks WHERE streak = 5
""")
def stream_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a stream at which five set-ups in a row have failed."""
    folder = J.scratch_folder(spark, "stops")
    watch = J.StreakWatch(spark, folder)
    J.catch_up(_event_stream(spark, sf_dir), watch, f"{folder}/checkpoint")
    return watch.results()


@query("""
WITH states AS (
  SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'running' END AS state FROM events),
moved AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM states)
SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS ordinal, state FROM moved
WHERE state <> 'running' AND state IS DISTINCT FROM previous
""")
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry into a terminal state, once."""
    folder = J.scratch_folder(spark, "transitions")
    watch = J.TransitionWatch(spark, folder)
    J.catch_up(_event_stream(spark, sf_dir), watch, f"{folder}/checkpoint")
    return watch.results()


@query("""
SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id, json_extract_string(props, '$.k') AS ligand_id,
       floor(epoch(ts) / 86400) AS timestamp FROM events
""")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a stream, each once however often it was delivered."""
    rows = _event_stream(spark, sf_dir).select("run_id", "ligand_id", "timestamp")
    return J.drain_to_table(J.without_redelivery(rows), "append", "unique").drop("batch")


@query(ORACLES["stream_deduplicated"])
def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records, told apart by keys on disk and membership filters instead of state."""
    folder = J.scratch_folder(spark, "first")
    guard = RedeliveryGuard(spark, folder, recent=2)
    rows = _event_stream(spark, sf_dir).select("run_id", "ligand_id", "timestamp")
    J.catch_up(rows, guard, f"{folder}/checkpoint")
    return guard.results()


TAIL_RECORDS = 10_000
# A reader far behind takes so many times that in one micro-batch.
PORTIONS = 100
TAIL_BYTES = 8 << 20
RUNS = 40


def _event_journal(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The events in order as files of JSON lines, and a place for the reader's position."""
    folder = J.scratch_folder(spark, "tail")
    failed = F.col("event_type") == "error"
    (
        S.table(spark, sf_dir, "events")
        .repartitionByRange(EVENT_FILES, "event_id")
        .sortWithinPartitions("event_id")
        .select(
            F.to_json(
                F.struct(
                    (F.col("user_id") % RUNS).cast("string").alias("run_id"),
                    F.col("event_id").cast("string").alias("ligand_id"),
                    F.when(failed, "failed").when(F.col("event_type") == "view", "skipped").otherwise("ok").alias("status"),
                    F.when(failed, "setup").alias("error_kind"),
                    F.when(F.col("event_type") == "purchase", "finished").when(failed, "failed")
                    .when(F.col("event_type") == "signup", "cancelled").otherwise("running").alias("state"),
                )
            ).alias("value")
        )
        .write.text(f"{folder}/journal")
    )
    return f"{folder}/journal", f"{folder}/position"


# The batch of an event: the source numbers portions of so many records, in order.
_EVENT_BATCH = f"(row_number() OVER (ORDER BY event_id) - 1) // {TAIL_RECORDS}"


@query(f"""
WITH e AS (SELECT *, {_EVENT_BATCH} AS batch FROM events)
SELECT batch, CAST(user_id % {RUNS} AS VARCHAR) AS run_id, count(*) FILTER (event_type NOT IN ('error', 'view')) AS completed,
       count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped
FROM e GROUP BY ALL
""")
def journal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A growing journal read by bytes, so many records a batch: what each batch brought per run."""
    path, position = _event_journal(spark, sf_dir)
    records = tail_journal(spark, path, position, TAIL_RECORDS, TAIL_BYTES, PORTIONS).select("run_id", "status", "portion")
    return online.drain_table(records, J.scratch_folder(spark, "tailed")).groupBy("batch", "run_id").agg(
        F.count_if(F.col("status") == "ok").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )


@query(f"""
WITH e AS (SELECT user_id % {RUNS} AS run, event_id, event_type = 'error' AS hit, {_EVENT_BATCH} AS batch FROM events),
marked AS (SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY run ORDER BY event_id) AS island FROM e),
streaks AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY event_id) AS streak FROM marked WHERE hit)
SELECT CAST(run AS VARCHAR) AS run_id, event_id AS ordinal, 'stop' AS event, '5' AS detail, batch FROM streaks WHERE streak = 5
""")
def online_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker's rows, each from the micro-batch in which five set-ups in a row had failed."""
    path, position = _event_journal(spark, sf_dir)
    records = tail_journal(spark, path, position, TAIL_RECORDS, TAIL_BYTES, PORTIONS).withColumn("ordinal", F.col("ligand_id").cast("bigint"))
    return online.drain_table(online.stops(records), J.scratch_folder(spark, "breaker"))


@query(f"""
WITH e AS (SELECT user_id % {RUNS} AS run, event_id, {_EVENT_BATCH} AS batch,
  CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'running' END AS state FROM events),
moved AS (SELECT *, lag(state) OVER (PARTITION BY run ORDER BY event_id) AS previous FROM e)
SELECT CAST(run AS VARCHAR) AS run_id, event_id AS ordinal, 'entered' AS event, state AS detail, batch FROM moved
WHERE state <> 'running' AND state IS DISTINCT FROM previous
""")
def online_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry into a terminal state, from the micro-batch in which it happened."""
    path, position = _event_journal(spark, sf_dir)
    record = F.from_json("line", "run_id string, ligand_id string, state string")
    states = tail_lines(spark, path, position, TAIL_RECORDS, TAIL_BYTES, PORTIONS).select(record.alias("r"), "portion").select(
        "r.run_id", F.col("r.ligand_id").cast("bigint").alias("ordinal"), "r.state", "portion"
    )
    return online.drain_table(online.entries(states), J.scratch_folder(spark, "entries"))
