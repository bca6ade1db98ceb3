"""Readers and writers as queries: whole tables go out as files and come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.catalog import standins as S
from assayframe.catalog.registry import query
from assayframe.operators import hits
from assayframe.schemas import MANIFEST_COLUMNS
from assayframe.sources import journal as J
from assayframe.sources import library as L
from assayframe.sources import manifest as M
from assayframe.streaming.journal_stream import scratch_folder

FILES = 8


def _written(spark: SparkSession, rows: DataFrame, order: str, record: Column) -> str:
    """Folder of text files that hold the records in the order of a column."""
    folder = f"{scratch_folder(spark, 'library')}/text"
    rows.repartitionByRange(FILES, order).sortWithinPartitions(order).select(
        record.alias("value")
    ).write.text(folder)
    return folder


def _sdf(spark: SparkSession, sf_dir: str) -> str:
    docs = S.table(spark, sf_dir, "documents")
    title = F.concat(F.lit("D"), (F.col("doc_id") % 300).cast("string"))
    record = F.concat_ws("\n", title, F.lit("  written"), F.col("text"), F.lit("M  END"), F.lit("$$$$"))
    return _written(spark, docs, "doc_id", record)


@query(r"""
SELECT 'D' || doc_id % 300 AS compound_id, 'D' || doc_id % 300 AS raw_id, 'sdf' AS fmt,
       sha256('D' || doc_id % 300 || chr(10) || '  written' || chr(10) || text || chr(10) || 'M  END' || chr(10)) AS block_sha256
FROM documents
""")
def read_sdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of an SDF library."""
    got = L.read_library(spark, _sdf(spark, sf_dir), fmt="sdf", unique_ids=False)
    return got.select("compound_id", "raw_id", "fmt", F.sha2("block", 256).alias("block_sha256"))


@query("SELECT 'C' || p_partkey AS block, 'P' || p_partkey % 700 AS compound_id, 'P' || p_partkey % 700 AS raw_id FROM part")
def read_smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a SMILES library."""
    key = F.col("p_partkey")
    line = F.concat(F.lit("C"), key.cast("string"), F.lit(" P"), (key % 700).cast("string"), F.lit(" more"))
    folder = _written(spark, S.table(spark, sf_dir, "part"), "p_partkey", line)
    return L.read_library(spark, folder, fmt="smi", unique_ids=False).select(
        "block", "compound_id", "raw_id"
    )


@query("""
SELECT 'P' || p_partkey AS compound_id, '@<TRIPOS>MOLECULE' || chr(10) || 'P' || p_partkey || chr(10) || p_name || chr(10) AS block FROM part
""")
def read_mol2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of a MOL2 library."""
    record = F.concat_ws(
        "\n", F.lit("@<TRIPOS>MOLECULE"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")), "p_name"
    )
    folder = _written(spark, S.table(spark, sf_dir, "part"), "p_partkey", record)
    return L.read_library(spark, folder, fmt="mol2", unique_ids=False).select("compound_id", "block")


@query("SELECT count(*) AS records, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS gaps FROM documents")
def record_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in the library: gapless, and in the order the records were written."""
    got = L.read_library(spark, _sdf(spark, sf_dir), fmt="sdf", unique_ids=False)
    length = F.length("block")
    docs = S.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("D"), (F.col("doc_id") % 300).cast("string")).alias("want"),
        (F.length("text") + F.length("want") + 19).alias("size"),
    )
    low = got.agg(F.min("ordinal").alias("low")).first()["low"] or 0
    placed = got.select((F.col("ordinal") - low).alias("ordinal"), "compound_id", length.alias("length"))
    joined = placed.join(docs, "ordinal", "left")
    return joined.agg(
        F.count("*").alias("records"),
        F.count_if((F.col("want") != F.col("compound_id")) | (F.col("size") != F.col("length"))).alias("out_of_order"),
        F.count_if(F.col("want").isNull()).alias("gaps"),
    )


@query("SELECT count(*) AS records FROM documents")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a library, counted without reading them out."""
    counts = L.count_records(spark, _sdf(spark, sf_dir), "sdf")
    return counts.agg(F.sum("records").alias("records"))


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS ligand_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status,
       o_orderkey AS seed FROM orders
""")
def journal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes appended to a journal in two batches and read back."""
    folder = f"{scratch_folder(spark, 'journal')}/journal"
    rows = S.order_journal(spark, sf_dir).select(
        "*", F.lit(1.5).alias("elapsed_s"), F.col("seed").cast("double").alias("timestamp"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("error_kind"),
    )
    for batch in range(2):
        J.append_journal(rows.where(F.col("seed") % 2 == batch), folder, batch)
    return J.read_journal(spark, folder).select("ligand_id", "status", "seed")


@query("""
WITH j AS (SELECT CAST(o_custkey AS VARCHAR) AS ligand_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE -o_totalprice END AS best, o_orderkey AS ordinal FROM orders),
m AS (SELECT CAST(c_custkey AS VARCHAR) AS ligand_id, 'N' || (c_nationkey + 1) AS compound_id, 'say "' || c_name || '", \\' || chr(10) || c_mktsegment AS smiles
      FROM customer WHERE c_custkey % 7 <> 0),
n AS (SELECT coalesce(m.compound_id, j.ligand_id) AS compound_id, j.ligand_id, m.smiles,
      row_number() OVER (PARTITION BY coalesce(m.compound_id, j.ligand_id) ORDER BY best NULLS LAST, ordinal) AS nth,
      count(*) OVER (PARTITION BY coalesce(m.compound_id, j.ligand_id)) AS n_variants FROM j LEFT JOIN m ON j.ligand_id = m.ligand_id)
SELECT compound_id, ligand_id, smiles, n_variants FROM n WHERE nth = 1
""".replace("\\\\", "\\"))
def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest file with every id twice, columns in another order, quotes and line ends; the last row counts."""
    known = S.table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    folder = f"{scratch_folder(spark, 'manifest')}/csv"
    twice = known.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_again"))
    rows = twice.repartition(FILES, "c_custkey").sortWithinPartitions("_again").select(
        F.concat(F.lit('say "'), "c_name", F.lit('", \\\n'), "c_mktsegment").alias("smiles"),
        F.lit("theirs").alias("further"),
        F.concat(F.lit("N"), (F.col("c_nationkey") + F.col("_again")).cast("string")).alias("compound_id"),
        F.col("c_custkey").cast("string").alias("ligand_id"),
    )
    M.write_csv(rows, folder)
    manifest = M.read_manifest(spark, folder).select(*MANIFEST_COLUMNS)
    ranked = hits.ranked_hits(S.order_journal(spark, sf_dir), manifest)
    return ranked.select("compound_id", "ligand_id", "smiles", F.col("n_variants").cast("bigint").alias("n_variants"))

