"""Hit lists, mode tables and join coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.catalog import standins as S
from assayframe.catalog.registry import ORACLES, query, sql_round
from assayframe.functions import scoring
from assayframe.functions.numeric import parse_int
from assayframe.operators import hits
from assayframe.operators.ordering import with_global_rank
from assayframe.streaming import journal_stream as J
from assayframe.streaming.report import ReportFold

_COLLATED = """
journal AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ligand_id,
         CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status,
         o_orderkey AS seed,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE least(-o_totalprice / 2, -o_totalprice) END AS best_affinity,
         CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END AS n_modes,
         o_orderkey AS ordinal
  FROM orders),
manifest AS (
  SELECT CAST(c_custkey AS VARCHAR) AS ligand_id, 'N' || c_nationkey AS compound_id,
         c_acctbal AS mw, c_acctbal / 4 AS clogp, c_acctbal / 2 AS tpsa,
         CAST(c_custkey % 40 AS VARCHAR) AS heavy_atoms,
         CAST(c_custkey % 9 AS INTEGER) AS rot_bonds, CAST(c_custkey % 5 AS INTEGER) AS hbd,
         CAST(c_custkey % 6 AS INTEGER) AS hba, CAST(c_custkey % 3 AS INTEGER) AS formal_charge,
         CAST(c_custkey % 12 AS INTEGER) AS torsions,
         c_mktsegment AS formula, c_name AS smiles
  FROM customer WHERE c_custkey % 7 <> 0),
joined AS (
  SELECT j.*, m.* EXCLUDE (ligand_id, compound_id),
         coalesce(nullif(m.compound_id, ''), j.ligand_id) AS compound_id,
         m.ligand_id IS NOT NULL AS has_descriptors
  FROM journal j LEFT JOIN manifest m ON j.ligand_id = m.ligand_id),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY best_affinity ASC NULLS LAST, ordinal) AS nth,
         count(*) OVER (PARTITION BY compound_id) AS n_variants,
         min(ordinal) OVER (PARTITION BY compound_id) AS first_at
  FROM joined),
best AS (SELECT * FROM numbered WHERE nth = 1),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY best_affinity ASC NULLS LAST, first_at) AS rank,
         best_affinity / nullif(TRY_CAST(heavy_atoms AS INTEGER), 0) AS per_atom
  FROM best)
"""

_EFFICIENCY = f"{sql_round('per_atom', 4)} AS ligand_efficiency"


@query(f"""
WITH {_COLLATED}
SELECT rank, compound_id, ligand_id, best_affinity, {_EFFICIENCY}, mw, clogp, tpsa, heavy_atoms,
       rot_bonds, hbd, hba, formal_charge, torsions, n_variants, n_modes, formula, smiles, status, seed
FROM ranked
""")
def hit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked hit list, best variant per compound."""
    return hits.ranked_hits(S.order_journal(spark, sf_dir), S.customer_manifest(spark, sf_dir))


FOLLOWED_FILES = 7


@query(ORACLES["hit_list"])
def hit_list_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hit list from a journal that arrives shuffled, folded in file by file."""
    folder = J.scratch_folder(spark, "followed")
    journal = S.order_journal(spark, sf_dir)
    journal.repartition(FOLLOWED_FILES, F.xxhash64("ordinal")).write.parquet(f"{folder}/journal")
    stream = spark.readStream.schema(journal.schema).option("maxFilesPerTrigger", 1)
    fold = ReportFold(spark, folder)
    J.catch_up(stream.parquet(f"{folder}/journal"), fold, f"{folder}/checkpoint")
    return fold.results(S.customer_manifest(spark, sf_dir))


@query(f"""
WITH {_COLLATED}
SELECT row_number() OVER (ORDER BY best_affinity ASC NULLS LAST, ordinal) AS rank,
       compound_id, ligand_id, best_affinity, mw, CAST(1 AS BIGINT) AS n_variants, status, seed
FROM joined
""")
def flat_hit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record ranked on its own."""
    ranked = hits.ranked_hits(
        S.order_journal(spark, sf_dir), S.customer_manifest(spark, sf_dir), group_variants=False
    )
    return ranked.select(
        "rank", "compound_id", "ligand_id", "best_affinity", "mw", "n_variants", "status", "seed"
    )


@query("""
WITH journal AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ligand_id, o_orderkey AS ordinal, o_orderstatus,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE -o_totalprice END AS best_affinity,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back
  FROM orders),
latest AS (SELECT * FROM journal WHERE back = 1),
joined AS (
  SELECT l.*, CASE WHEN c.c_custkey IS NULL THEN l.ligand_id ELSE 'N' || c.c_nationkey END AS compound_id
  FROM latest l LEFT JOIN customer c ON l.ligand_id = CAST(c.c_custkey AS VARCHAR) AND c.c_custkey % 7 <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY best_affinity ASC NULLS LAST, ordinal) AS nth,
         count(*) OVER (PARTITION BY compound_id) AS n_variants,
         min(ordinal) OVER (PARTITION BY compound_id) AS first_at
  FROM joined)
SELECT row_number() OVER (ORDER BY best_affinity ASC NULLS LAST, first_at) AS rank,
       compound_id, ligand_id, best_affinity, n_variants
FROM numbered WHERE nth = 1
""")
def latest_hit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit list over the last record of each ligand."""
    ranked = hits.ranked_hits(
        S.order_journal(spark, sf_dir), S.customer_manifest(spark, sf_dir), latest_only=True
    )
    return ranked.select("rank", "compound_id", "ligand_id", "best_affinity", "n_variants")


@query(f"""
WITH {_COLLATED}
SELECT rank, compound_id, best_affinity, {_EFFICIENCY}, mw, formula FROM ranked WHERE rank <= 20
""")
def top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the hit list as the report prints it."""
    return hits.top_hits(
        S.order_journal(spark, sf_dir), S.customer_manifest(spark, sf_dir), top=20
    )


@query(f"""
WITH {_COLLATED},
counts AS (SELECT count(*) FILTER (has_descriptors) AS matched, count(*) AS total FROM best)
SELECT matched, total,
       CASE WHEN total > 0 AND matched = 0 THEN 'not one row found its descriptors'
            WHEN matched < total THEN (total - matched) || ' of ' || total || ' rows have no descriptors' END AS warning
FROM counts
""")
def join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ranked rows found their manifest entry."""
    return hits.join_coverage(
        S.order_journal(spark, sf_dir), S.customer_manifest(spark, sf_dir)
    )


_LINE_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey"


@query(f"""
SELECT {_LINE_ID} AS ligand_id,
       CASE WHEN l_returnflag <> 'R' THEN least(-l_extendedprice / 1000, -l_quantity, l_tax - 1) END AS best_affinity,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE 3 END AS n_modes
FROM lineitem
""")
def best_of_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best affinity over the modes of each record."""
    return S.line_journal(spark, sf_dir).select(
        "ligand_id",
        scoring.best_affinity(F.col("modes")).alias("best_affinity"),
        scoring.mode_count(F.col("modes")).alias("n_modes"),
    )


@query(f"""
WITH modes AS (
  SELECT {_LINE_ID} AS ligand, 1 AS mode, -l_extendedprice / 1000 AS affinity, l_tax AS lb, l_discount AS ub, l_linenumber, l_suppkey
  FROM lineitem WHERE l_returnflag <> 'R'
  UNION ALL
  SELECT {_LINE_ID}, 2, -l_quantity, l_discount, l_tax, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'
  UNION ALL
  SELECT {_LINE_ID}, 3, l_tax - 1, l_tax, l_tax, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT ligand AS "Ligand", mode AS "Mode", affinity AS "Affinity",
       printf('%.3f', lb) AS "RMSD_LB", printf('%.3f', ub) AS "RMSD_UB",
       CASE WHEN l_linenumber <> 7 THEN CAST(l_suppkey AS VARCHAR) ELSE '' END AS "RandomSeed"
FROM modes
""")
def all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mode of every record."""
    return hits.all_modes(S.line_journal(spark, sf_dir))


@query("""
SELECT l_returnflag, count(*) AS n_records,
       count(*) FILTER (l_returnflag <> 'R' AND NOT (-l_extendedprice / 1000 <= -l_quantity AND -l_quantity <= l_tax - 1)) AS n_unsorted
FROM lineitem GROUP BY l_returnflag
""")
def mode_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose modes are not listed best first."""
    modes = F.col("modes")
    unsorted = (F.size(modes) > 0) & ~scoring.modes_sorted(modes)
    return S.line_journal(spark, sf_dir).groupBy("l_returnflag").agg(
        F.count("*").alias("n_records"), F.count_if(unsorted).alias("n_unsorted")
    )


@query(f"""
WITH rows AS (
  SELECT o_orderkey, -o_totalprice AS affinity,
         CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '1.5' WHEN 2 THEN ' ' || (c_custkey % 40) || ' '
              ELSE CAST(c_custkey % 40 AS VARCHAR) END AS heavy
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
parsed AS (SELECT *, CASE WHEN regexp_full_match(trim(heavy), '[+-]?[0-9]+') THEN CAST(trim(heavy) AS INTEGER) END AS n FROM rows),
divided AS (SELECT *, affinity / nullif(n, 0) AS per_atom FROM parsed)
SELECT o_orderkey, n AS heavy_atoms, {_EFFICIENCY} FROM divided
""")
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affinity per heavy atom, heavy atoms given as text."""
    key = F.col("c_custkey")
    atoms = (key % 40).cast("string")
    heavy = (
        F.when(key % 5 == 0, "")
        .when(key % 5 == 1, "1.5")
        .when(key % 5 == 2, F.concat(F.lit(" "), atoms, F.lit(" ")))
        .otherwise(atoms)
    )
    joined = S.table(spark, sf_dir, "orders").join(
        S.table(spark, sf_dir, "customer"), F.col("o_custkey") == key, "left"
    )
    n = parse_int(heavy)
    return joined.select(
        "o_orderkey",
        n.alias("heavy_atoms"),
        scoring.ligand_efficiency(-F.col("o_totalprice"), n).alias("ligand_efficiency"),
    )


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS best_affinity,
       row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END DESC NULLS FIRST, o_orderkey) AS place
FROM orders
""")
def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending numeric sort: missing values lead, as a block."""
    rows = S.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("best_affinity"),
    )
    order = [F.col("best_affinity").desc_nulls_first(), F.col("o_orderkey").asc()]
    return with_global_rank(rows, order, "place")
