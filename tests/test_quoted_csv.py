from __future__ import annotations

import csv
import random

import pytest

from assayframe.sources.manifest import read_manifest
from assayframe.sources.quoted_csv import csv_records, read_quoted_csv


def written(folder, seed, names, n=400, end="\r\n"):
    rng = random.Random(seed)
    cells = ["x", "", "a,b", 'say "q"', "two\nlines", "\n", '"', '"\n"', "long " * 40, "\n\nz,\n"]
    rows = [[f"{seed}-{i}", *(rng.choice(cells) for _ in names[1:])] for i in range(n)]
    with open(folder / f"{seed}.csv", "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=end).writerows([names, *rows])
    return rows


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_files_equal_the_csv_module(spark, tmp_path, small_splits):
    names = ["id", "first", "second"]
    want = [r for s, end in ((1, "\r\n"), (2, "\n")) for r in written(tmp_path, s, names, end=end)]
    got = read_quoted_csv(spark, str(tmp_path))
    assert csv_records(spark, str(tmp_path)).select("place.split_start").distinct().count() > 20
    rows = {r["id"]: (r["first"] or "", r["second"] or "") for r in got.collect()}
    assert got.count() == len(want) == len(rows)
    assert rows == {r[0]: (r[1], r[2]) for r in want}
    # Places follow the order in the files.
    ordered = [r["id"] for r in got.orderBy("place").collect()]
    assert ordered == [r[0] for r in want]


def test_headers_empty_files_and_blank_lines(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none/a.csv").write_text("")
    assert read_manifest(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "only").mkdir()
    (tmp_path / "only/a.csv").write_text("ligand_id,compound_id\n")
    assert read_manifest(spark, str(tmp_path / "only")).count() == 0
    (tmp_path / "bom").mkdir()
    (tmp_path / "bom/a.csv").write_text('﻿"ligand_id",further,smiles\n\nA,1,"C\nC"\n\nB,2\n"A",3,D', encoding="utf-8")
    got = {r["ligand_id"]: r["smiles"] for r in read_manifest(spark, str(tmp_path / "bom")).collect()}
    assert got == {"A": "D", "B": None}
    (tmp_path / "two").mkdir()
    (tmp_path / "two/a.csv").write_text("ligand_id,smiles\nA,C\n")
    (tmp_path / "two/b.csv").write_text("smiles,ligand_id\nC,A\n")
    with pytest.raises(Exception, match="another header"):
        read_manifest(spark, str(tmp_path / "two")).collect()
