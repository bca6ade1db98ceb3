"""Journal parsing, resume algebra, status and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.catalog import standins as S
from assayframe.catalog.registry import query
from assayframe.operators import batchmap, digests, drift, progress
from assayframe.plans import regression
from assayframe.sources.journal import parse_records
from assayframe.sources.manifest import last_wins

_EVENTS = """
events_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
journal AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, user_id || '-' || k AS ligand_id,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'skipped' ELSE 'ok' END AS status,
         CASE WHEN event_type = 'error' AND k < 20 THEN 'setup' WHEN event_type = 'error' THEN 'ligand' END AS error_kind,
         epoch(ts) AS timestamp, value AS elapsed_s, event_id AS ordinal
  FROM events_k)
"""

@query("""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 11 NOT IN (0, 1, 2, 3))
SELECT event_id AS ordinal, 'U' || user_id AS ligand_id,
       CASE WHEN event_id % 5 = 0 THEN 'ok' ELSE event_type END AS status,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(k AS BIGINT) END AS seed,
       CASE WHEN event_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS elapsed_s,
       CASE WHEN k < 50 THEN 0 ELSE 2 END AS n_modes,
       CASE WHEN k < 50 THEN NULL ELSE least(value, value - 1) END AS best_affinity,
       CASE WHEN k < 50 THEN NULL ELSE CAST(k AS DOUBLE) END AS rmsd_ub,
       CASE WHEN event_type = 'error' THEN 'broke' END AS error
FROM e
""")
def journal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines into records; broken, half-written and nameless ones left out."""
    k = F.get_json_object("props", "$.k")
    event = F.col("event_id")
    value = F.col("value").cast("string")
    whole = F.concat(
        F.lit('{"ligand_id":"U'), F.col("user_id").cast("string"), F.lit('"'),
        F.when(event % 5 == 0, "").otherwise(
            F.concat(F.lit(',"status":"'), F.col("event_type"), F.lit('"'))
        ),
        F.when(event % 3 == 0, ',"seed":null').otherwise(F.concat(F.lit(',"seed":'), k)),
        F.when(event % 4 == 0, "").otherwise(F.concat(F.lit(',"elapsed_s":'), value)),
        F.when(k.cast("int") < 50, "").otherwise(
            F.concat(
                F.lit(',"modes":[{"mode":1,"affinity":'), value,
                F.lit('},{"mode":2,"affinity":'), (F.col("value") - 1).cast("string"),
                F.lit(',"rmsd_ub":'), k, F.lit("}]"),
            )
        ),
        F.when(F.col("event_type") == "error", ',"error":"broke"').otherwise(""),
        F.lit("}"),
    )
    spoiled = event % 11
    line = (
        F.when(spoiled == 0, F.substring(whole, 1, 20))
        .when(spoiled == 1, F.replace(whole, F.lit('"ligand_id"'), F.lit('"other"')))
        .when(spoiled == 2, F.lit('{"ligand_id":"X","modes":[{"mode":1}]}'))
        .when(spoiled == 3, F.lit("   "))
        .otherwise(whole)
    )
    lines = S.table(spark, sf_dir, "events").select(line.alias("line"), event.alias("ordinal"))
    modes = F.col("modes")
    return parse_records(lines).select(
        "ordinal", "ligand_id", "status", "seed", "elapsed_s",
        F.size(modes).alias("n_modes"),
        F.array_min(F.transform(modes, lambda m: m["affinity"])).alias("best_affinity"),
        F.get(modes, F.lit(1))["rmsd_ub"].alias("rmsd_ub"),
        "error",
    )


@query("""
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back = 1
""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key."""
    rows = S.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return last_wins(rows, "user_id", "event_id")


@query(f"WITH {_EVENTS} SELECT DISTINCT ligand_id FROM journal WHERE error_kind IS DISTINCT FROM 'setup'")
def resume_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids a resumed run will not attempt again."""
    return progress.completed_ids(S.event_journal(spark, sf_dir))


@query(f"""
WITH {_EVENTS},
last AS (SELECT ligand_id, error_kind, row_number() OVER (PARTITION BY ligand_id ORDER BY ordinal DESC) AS back FROM journal)
SELECT ligand_id FROM last WHERE back = 1 AND error_kind = 'setup'
""")
def retryable_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids whose last record is a failed set-up."""
    return progress.retryable_ids(S.event_journal(spark, sf_dir))


@query(f"""
WITH {_EVENTS}
SELECT 'never' AS policy, count(DISTINCT ligand_id) AS n FROM journal
UNION ALL SELECT 'setup_only', count(DISTINCT ligand_id) FROM journal WHERE error_kind IS DISTINCT FROM 'setup'
UNION ALL SELECT 'all', count(DISTINCT ligand_id) FROM journal WHERE status = 'ok'
""")
def retry_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids each retry policy leaves alone."""
    journal = S.event_journal(spark, sf_dir)
    out = None
    for policy in progress.RETRY_POLICIES:
        row = progress.finished_ids(journal, policy).agg(F.count("*").alias("n")).select(
            F.lit(policy).alias("policy"), "n"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_quantity > 25)
""")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work whose id is not done."""
    done = (
        S.table(spark, sf_dir, "lineitem")
        .where((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25))
        .select(F.col("l_orderkey").alias("o_orderkey"))
    )
    work = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return progress.todo(work, done, ["o_orderkey"])


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderkey < (SELECT 5 * count(*) FROM customer)
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
""")
def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit on how far the input is read, before finished work is taken out."""
    limit = S.table(spark, sf_dir, "customer").agg((F.count("*") * 5).alias("n")).scalar()
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = (
        S.table(spark, sf_dir, "lineitem")
        .where(F.col("l_quantity") > 45)
        .select(F.col("l_orderkey").alias("o_orderkey"))
    )
    return progress.todo(
        progress.scan_limited(orders, limit, "o_orderkey"), done, ["o_orderkey"]
    )


@query("""
WITH ids AS (SELECT p_name || '-' || p_partkey AS ligand_id FROM part)
SELECT ligand_id, row_number() OVER (ORDER BY ligand_id) <= 500 AS want_poses FROM ids
""")
def leading_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag on the first 500 of all ids in sorted order."""
    ids = S.table(spark, sf_dir, "part").select(
        F.concat_ws("-", "p_name", "p_partkey").alias("ligand_id")
    )
    return progress.with_leading_flag(ids)


_STATUS = """
counts AS (
  SELECT run_id, count(*) FILTER (status = 'ok') AS completed, count(*) FILTER (status = 'failed') AS failed,
         count(*) FILTER (status NOT IN ('ok', 'failed')) AS skipped FROM counted GROUP BY run_id),
runs AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(count(*) * 11 // 10 AS BIGINT) AS total,
         min(epoch(ts)) AS started_at, max(epoch(ts)) AS updated_at FROM events GROUP BY user_id),
done AS (SELECT *, completed + failed + skipped AS done FROM runs JOIN counts USING (run_id)),
rated AS (
  SELECT *, greatest(0, total - done) AS remaining, done / total AS fraction,
         CASE WHEN done > 0 AND updated_at > started_at THEN done / (updated_at - started_at) END AS rate_per_s FROM done)
SELECT run_id, total, completed, failed, skipped, done, remaining, fraction, rate_per_s,
       CASE WHEN rate_per_s > 0 AND remaining > 0 THEN remaining / rate_per_s END AS eta_s
FROM rated
"""
_STATUS_COLUMNS = (
    "run_id", "total", "completed", "failed", "skipped", "done", "remaining", "fraction",
    "rate_per_s", "eta_s",
)


@query(f"WITH {_EVENTS}, counted AS (SELECT * FROM journal), {_STATUS}")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every run, counted from the journal."""
    status = progress.run_status(S.event_journal(spark, sf_dir), S.event_runs(spark, sf_dir))
    return status.select(*_STATUS_COLUMNS)


@query(f"""
WITH {_EVENTS}, counted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, ligand_id ORDER BY ordinal DESC) AS back FROM journal) WHERE back = 1),
{_STATUS}
""")
def run_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counting each ligand once, by its last record."""
    status = progress.run_status(
        S.event_journal(spark, sf_dir), S.event_runs(spark, sf_dir), latest_only=True
    )
    return status.select(*_STATUS_COLUMNS)


@query("""
WITH marked AS (
  SELECT user_id, event_id, event_type = 'error' AS hit,
         count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
streaks AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM marked WHERE hit)
SELECT user_id, event_id, streak FROM streaks WHERE streak = 3
""")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at which a run of failures reaches three."""
    events = S.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    streaks = progress.setup_streaks(
        events, ["user_id"], "event_id", failed=F.col("event_type") == "error"
    )
    return streaks.where(F.col("streak") == 3).select("user_id", "event_id", "streak")


@query("""
SELECT l_orderkey AS dir, count(*) FILTER (l_linenumber BETWEEN 2 AND 4) AS n_maps, bool_or(l_linenumber = 1) AS has_field,
       count(*) FILTER (l_linenumber >= 5) AS n_receptors,
       bool_or(l_linenumber = 1) AND count(*) FILTER (l_linenumber BETWEEN 2 AND 4) > 0 AS ok,
       CASE WHEN bool_or(l_linenumber = 1) AND count(*) FILTER (l_linenumber BETWEEN 2 AND 4) > 0
            THEN count(*) FILTER (l_linenumber BETWEEN 2 AND 4) || ' maps'
            WHEN count(*) FILTER (l_linenumber >= 5) > 0 AND count(*) FILTER (l_linenumber BETWEEN 2 AND 4) = 0 THEN 'receptors but no maps'
            WHEN count(*) FILTER (l_linenumber BETWEEN 2 AND 4) > 0
            THEN count(*) FILTER (l_linenumber BETWEEN 2 AND 4) || ' maps but no receptor.maps.fld' ELSE 'no maps' END AS message
FROM lineitem GROUP BY l_orderkey
""")
def set_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each folder holds a whole set of files, and if not, why."""
    line = F.col("l_linenumber")
    name = (
        F.when(line == 1, digests.FIELD_FILE)
        .when(line <= 4, F.concat(F.lit("receptor."), line.cast("string"), F.lit(".map")))
        .otherwise(F.concat(F.lit("r"), F.col("l_partkey").cast("string"), F.lit(".pdbqt")))
    )
    listing = S.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("dir"), name.alias("file_name")
    )
    return digests.map_set_status(listing)


@query("""
WITH parts AS (
  SELECT o_orderkey, o_orderkey || '_' || k AS part FROM orders, (SELECT unnest(range(1, 4)) AS k) WHERE k <= o_orderkey % 4),
have AS (SELECT DISTINCT l_orderkey || '_' || l_linenumber AS part FROM lineitem),
lacking AS (SELECT DISTINCT o_orderkey FROM parts WHERE part NOT IN (SELECT part FROM have))
SELECT CAST(o_orderkey AS VARCHAR) AS ligand_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM lacking)
""")
def all_parts_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids whose every listed file exists."""
    key = F.col("o_orderkey")
    count = (key % 4).cast("int")
    parts = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.lit(3)),
            lambda k: F.when(k <= count, F.concat(key.cast("string"), F.lit("_"), k.cast("string"))),
        ),
        lambda p: p.isNotNull(),
    )
    manifest = S.table(spark, sf_dir, "orders").select(
        key.cast("string").alias("ligand_id"), parts.alias("pdbqt")
    )
    listing = S.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("file_name")
    )
    return digests.fully_present(manifest, listing)


def _digest_sql(listing: str) -> str:
    return f"""
WITH files AS ({listing}),
leaves AS (SELECT dir, substr(sha256(file_name), 1, 4) AS leaf,
    sha256(string_agg(file_name || ':' || bytes || chr(10), '' ORDER BY file_name || ':' || bytes || chr(10))) AS digest FROM files GROUP BY ALL),
roots AS (SELECT dir, sha256(string_agg(leaf || ':' || digest || chr(10), '' ORDER BY leaf)) AS listing_sha256 FROM leaves GROUP BY dir)
SELECT dir, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS total_bytes, any_value(listing_sha256) AS listing_sha256
FROM files JOIN roots USING (dir) GROUP BY dir
"""


@query(_digest_sql("SELECT 'all' AS dir, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS file_name, CAST(l_quantity AS INTEGER) AS bytes FROM lineitem"))
def listing_digest_one_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same digest where one folder holds every file."""
    listing = S.table(spark, sf_dir, "lineitem").select(
        F.lit("all").alias("dir"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("file_name"),
        F.col("l_quantity").cast("int").alias("bytes"),
    )
    return digests.listing_digest(listing)


@query(_digest_sql("SELECT p_brand AS dir, p_name || '-' || p_partkey AS file_name, p_size AS bytes FROM part"))
def listing_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest over the sorted names and sizes of each folder."""
    listing = S.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("dir"),
        F.concat_ws("-", "p_name", "p_partkey").alias("file_name"),
        F.col("p_size").alias("bytes"),
    )
    return digests.listing_digest(listing)


@query("""
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ligand_id,
       CASE WHEN l_quantity > 40 THEN 'filter' END AS stage,
       CASE WHEN l_quantity > 40 THEN CAST(l_quantity AS INTEGER) || ' rotatable bonds, the limit is 40' END AS error
FROM lineitem
""")
def filter_with_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over a limit become failures, the rest passes."""
    rows = S.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ligand_id"),
        F.col("l_partkey").cast("string").alias("compound_id"),
        F.col("l_quantity").cast("int").alias("rot_bonds"),
    )
    kept, rejected = batchmap.reject_over_limit(rows, "rot_bonds", 40)
    nothing = F.lit(None).cast("string")
    passed = kept.select("ligand_id", nothing.alias("stage"), nothing.alias("error"))
    return passed.unionByName(rejected.select("ligand_id", "stage", "error"))


@query("""
WITH configs AS (
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'vina' WHEN 1 THEN 'vinardo' WHEN 2 THEN 'ad4' WHEN 3 THEN 'autodock4' ELSE p_type END AS engine,
         p_size - 2 AS exhaustiveness, p_size % 7 AS n_modes, CASE WHEN p_size > 30 THEN p_name END AS parameter_file FROM part)
SELECT p_partkey, concat_ws('; ',
  CASE WHEN engine NOT IN ('vina', 'vinardo', 'ad4', 'autodock4') THEN 'unknown engine ' || engine END,
  CASE WHEN engine = 'autodock4' THEN 'autodock4 is not available' END,
  CASE WHEN exhaustiveness < 1 THEN 'exhaustiveness is below 1' END,
  CASE WHEN n_modes < 1 THEN 'n_modes is below 1' END,
  CASE WHEN parameter_file IS NOT NULL AND engine NOT IN ('ad4', 'autodock4') THEN engine || ' cannot use a parameter file' END) AS problems
FROM configs
""")
def config_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each configuration of a sweep."""
    kind = F.col("p_partkey") % 5
    configs = S.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(kind == 0, "vina").when(kind == 1, "vinardo").when(kind == 2, "ad4")
        .when(kind == 3, "autodock4").otherwise(F.col("p_type")).alias("engine"),
        (F.col("p_size") - 2).alias("exhaustiveness"),
        (F.col("p_size") % 7).alias("n_modes"),
        F.when(F.col("p_size") > 30, F.col("p_name")).alias("parameter_file"),
    )
    return batchmap.config_problems(configs).select(
        "p_partkey", F.array_join("problems", "; ").alias("problems")
    )


_DRIFT = """
measured AS (
  SELECT p_brand AS ligand_id, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS affinity FROM part GROUP BY p_brand),
reference AS (
  SELECT p_brand AS ligand_id, CAST(sum(CAST(p_retailprice + CASE WHEN p_size > 48 THEN 20 ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS expected FROM part GROUP BY p_brand
  UNION ALL
  SELECT p_type, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM part GROUP BY p_type),
compared AS (
  SELECT ligand_id, expected, affinity, abs(affinity - expected) AS deviation,
         CASE WHEN affinity IS NULL THEN 'missing' WHEN abs(affinity - expected) > 0.5 THEN 'drifted' ELSE 'ok' END AS verdict
  FROM reference LEFT JOIN measured USING (ligand_id))
"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part")
    def average(price: Column) -> Column:
        return F.sum(price.cast("decimal(18,2)")).cast("double") / F.count("*")

    # Some recorded prices are off on purpose.
    noted = F.col("p_retailprice") + F.when(F.col("p_size") > 48, 20).otherwise(0)
    mean = average(F.col("p_retailprice"))
    measured = part.groupBy(F.col("p_brand").alias("ligand_id")).agg(mean.alias("affinity"))
    recorded = part.groupBy(F.col("p_brand").alias("ligand_id")).agg(
        average(noted).alias("expected")
    )
    gone = part.groupBy(F.col("p_type").alias("ligand_id")).agg(mean.alias("expected"))
    return drift.compare_to_reference(recorded.unionByName(gone), measured)


@query(f"WITH {_DRIFT} SELECT * FROM compared")
def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured values against recorded ones, within a tolerance either way."""
    return _drift(spark, sf_dir)


@query(f"""
WITH {_DRIFT}
SELECT count(*) AS n_reference, count(*) FILTER (verdict = 'missing') AS n_missing,
       count(*) FILTER (verdict = 'drifted') AS n_drifted, max(deviation) AS largest_deviation,
       count(*) > 0 AND count(*) FILTER (verdict <> 'ok') = 0 AS passed FROM compared
""")
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison in one row."""
    return drift.drift_summary(_drift(spark, sf_dir))


@query("""
WITH best AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ligand_id, arg_max(CAST(-o_totalprice AS DOUBLE), o_orderkey) AS affinity
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT ligand_id, affinity, format('{:<28} {:+.2f} kcal/mol', ligand_id, affinity) AS line FROM best
""")
def affinity_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored ligand's value as a run's check lists it, best first."""
    return regression.affinity_listing(S.order_journal(spark, sf_dir))
