"""Screening tables derived from the shared test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.schemas import JOURNAL_SCHEMA

MODES = JOURNAL_SCHEMA["modes"].dataType

# Atom types dealt to the points of the embeddings table, by vec_id.
POINT_TYPES = ("C", "A", "OA", "N", "HD", "C", "NA", "Zn", "C", "SA", "Mg", "", "A", "C", "O*", "TZ")
POINT_CHAINS = ("A", "B", "N", "")
POINT_NAMES = ("N", "CA", "C", "O", "CB", "CG", "ZN")
ATOMS_PER_RECEPTOR = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a UTC wall-clock time, whatever the session zone."""
    instant = F.concat(F.col(ts).cast("string"), F.lit("Z")).cast("timestamp")
    return F.unix_micros(instant) / 1e6


def choose(options: Sequence[str], index: Column) -> Column:
    """``options[index % len(options)]``."""
    values = F.array(*[F.lit(o) for o in options])
    return F.get(values, F.pmod(index, F.lit(len(options))).cast("int"))


def modes(*triples: tuple[Column, Column, Column]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("mode"),
                a.cast("double").alias("affinity"),
                lb.cast("double").alias("rmsd_lb"),
                ub.cast("double").alias("rmsd_ub"),
            )
            for i, (a, lb, ub) in enumerate(triples, start=1)
        ]
    ).cast(MODES)


def no_modes() -> Column:
    return F.array().cast(MODES)


def order_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a journal: pending orders failed, the second mode is the best."""
    price, zero = F.col("o_totalprice"), F.lit(0.0)
    failed = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("ligand_id"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.col("o_orderkey").alias("seed"),
        F.when(failed, no_modes())
        .otherwise(modes((-price / 2, zero, zero), (-price, zero, zero)))
        .alias("modes"),
        F.col("o_orderkey").alias("ordinal"),
    )


def customer_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a manifest that lacks every seventh one."""
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .where(key % 7 != 0)
        .select(
            key.cast("string").alias("ligand_id"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("compound_id"),
            F.col("c_acctbal").alias("mw"),
            (F.col("c_acctbal") / 4).alias("clogp"),
            (F.col("c_acctbal") / 2).alias("tpsa"),
            (key % 40).cast("string").alias("heavy_atoms"),
            (key % 9).cast("int").alias("rot_bonds"),
            (key % 5).cast("int").alias("hbd"),
            (key % 6).cast("int").alias("hba"),
            (key % 3).cast("int").alias("formal_charge"),
            (key % 12).cast("int").alias("torsions"),
            F.col("c_mktsegment").alias("formula"),
            F.col("c_name").alias("smiles"),
        )
    )


def line_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as journal records with three modes; returned ones have none."""
    seed = F.when(F.col("l_linenumber") != 7, F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ligand_id"),
        "l_returnflag",
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"),
        seed.alias("seed"),
        F.when(F.col("l_returnflag") == "R", no_modes())
        .otherwise(
            modes(
                (-F.col("l_extendedprice") / 1000, F.col("l_tax"), F.col("l_discount")),
                (-F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")),
                (F.col("l_tax") - 1, F.col("l_tax"), F.col("l_tax")),
            )
        )
        .alias("modes"),
    )


def event_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal: errors failed, those with k < 20 in the set-up."""
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.concat_ws("-", F.col("user_id"), k).alias("ligand_id"),
        F.when(failed, "failed")
        .when(F.col("event_type") == "view", "skipped")
        .otherwise("ok")
        .alias("status"),
        F.when(failed & (k < 20), "setup").when(failed, "ligand").alias("error_kind"),
        epoch_seconds("ts").alias("timestamp"),
        F.col("value").alias("elapsed_s"),
        F.col("event_id").alias("ordinal"),
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run record per user, expecting a tenth more rows than it has."""
    stamp = epoch_seconds("ts")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").cast("string").alias("run_id"))
        .agg(
            F.floor(F.count("*") * 11 / 10).alias("total"),
            F.min(stamp).alias("started_at"),
            F.max(stamp).alias("updated_at"),
        )
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as atoms: the first three components are coordinates."""
    vec = F.col("vec_id")
    coordinate = [(F.col("embedding")[i].cast("double") * 50.0) for i in range(3)]
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec / ATOMS_PER_RECEPTOR).cast("string").alias("receptor_id"),
        F.col("label"),
        vec.cast("int").alias("serial"),
        choose(POINT_NAMES, vec).alias("name"),
        choose(POINT_CHAINS, F.floor(vec / 3)).alias("chain"),
        F.pmod(vec, F.lit(97)).cast("int").alias("residue_seq"),
        coordinate[0].alias("x"),
        coordinate[1].alias("y"),
        coordinate[2].alias("z"),
        F.lit(0.1).alias("charge"),
        choose(POINT_TYPES, vec).alias("atom_type"),
        vec.alias("line_no"),
    )


def atom_line(
    serial: Column, name: Column, chain: Column, seq: Column,
    x: Column, y: Column, z: Column, charge: Column, atom_type: Column,
) -> Column:
    """A 79-column atom line; numbers are given as text."""
    return F.concat(
        F.lit("ATOM  "), F.lpad(serial, 5, " "), F.lit(" "), F.rpad(name, 4, " "),
        F.lit(" RES "), F.rpad(chain, 1, " "), F.lpad(seq, 4, " "), F.lit("    "),
        F.lpad(x, 8, " "), F.lpad(y, 8, " "), F.lpad(z, 8, " "),
        F.lit("  1.00  0.00    "), F.lpad(charge, 6, " "), F.lit(" "), F.rpad(atom_type, 2, " "),
    )
