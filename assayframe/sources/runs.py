"""Run records, recorded reference values and metadata rows."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.schemas import RUN_SCHEMA, SCHEMA_VERSION


def run_record(spark: SparkSession, run_id: str, **fields: Any) -> DataFrame:
    """One row describing a run; unknown fields are an error."""
    row = {name: None for name in RUN_SCHEMA.fieldNames()}
    row.update({"run_id": run_id, "schema_version": SCHEMA_VERSION, "state": "pending"})
    config = fields.pop("config", None)
    if config is not None:
        fields["config_json"] = json.dumps(config, sort_keys=True)
    unknown = set(fields) - set(row)
    if unknown:
        raise ValueError(f"unknown run fields {sorted(unknown)}")
    row.update(fields)
    return spark.createDataFrame([tuple(row.values())], RUN_SCHEMA)


def append_run(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Latest record per run; a layout newer than this reader's fails the job."""
    rows = spark.read.schema(RUN_SCHEMA).json(path)
    checked = rows.where(
        F.when(
            F.col("schema_version") > SCHEMA_VERSION,
            F.raise_error(F.lit("run record written by a newer layout")).cast("boolean"),
        ).otherwise(F.lit(True))
    )
    newest = F.max_by(F.struct(*RUN_SCHEMA.fieldNames()), F.coalesce("updated_at", F.lit(0.0)))
    return checked.groupBy("run_id").agg(newest.alias("_r")).select("_r.*")


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Expected value per ligand, from a JSON record holding a map of values."""
    record = spark.read.schema("affinities map<string,double>").json(path, multiLine=True)
    return record.select(F.explode("affinities").alias("ligand_id", "expected"))


def read_recorded(spark: SparkSession, path: str) -> DataFrame:
    """Expected values written by :func:`write_reference`."""
    return spark.read.schema("ligand_id string, expected double, settings string").json(path)


def write_reference(measured: DataFrame, path: str, settings: dict[str, Any]) -> None:
    """Record measured values as the new reference; refuses an empty table."""
    if measured.isEmpty():
        raise ValueError("no measured values; refusing to record a reference")
    rows = measured.select("ligand_id", F.col("affinity").alias("expected"))
    rows.withColumn("settings", F.lit(json.dumps(settings, sort_keys=True))).write.mode(
        "overwrite"
    ).json(path)


def write_metadata(spark: SparkSession, path: str, payload: dict[str, Any]) -> None:
    """One JSON metadata record, with the layout version."""
    text = json.dumps({"schema_version": SCHEMA_VERSION, **payload}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata records as JSON text with their parsed version; broken ones left out."""
    rows = spark.read.text(path).select(
        F.col("value").alias("record"),
        F.try_variant_get(F.try_parse_json("value"), "$.schema_version", "int").alias(
            "schema_version"
        ),
    )
    return rows.where("schema_version is not null")
