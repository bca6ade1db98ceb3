"""Completeness of file sets: ids that list nothing and large tables stay spread over tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.operators import digests


def test_no_task_of_the_completeness_check_holds_all_ids_that_list_nothing(spark, monkeypatch):
    monkeypatch.setattr(digests, "ROWS_PER_TASK", 100)
    manifest = spark.range(2000).selectExpr(
        "cast(id as string) AS ligand_id",
        "CASE WHEN id % 8 < 3 THEN array() WHEN id % 8 = 3 THEN NULL ELSE array(concat('f', id), '', NULL, concat('g', id)) END AS pdbqt",
    )
    manifest = manifest.unionByName(manifest.where("ligand_id < 50")).unionByName(
        spark.sql("SELECT CAST(NULL AS string) AS ligand_id, array('f1') AS pdbqt")
    )
    listing = spark.range(2000).where("id % 3 <> 0").selectExpr("explode(array(concat('f', id), concat('g', id), concat('f', id))) AS file_name")
    found = digests.fully_present(manifest, listing)
    got = [r["ligand_id"] for r in found.collect()]
    assert sorted(got) == sorted(str(i) for i in range(2000) if i % 8 < 4 or i % 3)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 20 and max(sizes) < 200
    assert "LeftOuter" not in found._jdf.queryExecution().toString()
