from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from assayframe.functions import text
from assayframe.operators import identity
from assayframe.sources.library import count_records, read_library, read_records


def sdf(*records: tuple[str, dict[str, str]], end: str = "\n", last: bool = True) -> str:
    blocks = []
    for title, fields in records:
        lines = [title, "  prog", "", "  0  0", "M  END"]
        for name, value in fields.items():
            lines += [f"> <{name}>", value, ""]
        blocks.append(end.join(lines) + end)
    joined = ("$$$$" + end).join(blocks)
    return joined + ("$$$$" + end if last else "")


def collected(df):
    return [
        (r["ligand_id"], r["compound_id"], r["index"])
        for r in df.orderBy("ordinal").select("ligand_id", "compound_id", "index").collect()
    ]


def test_two_records_with_a_property(spark, tmp_path):
    path = tmp_path / "a.sdf"
    path.write_text(sdf(("", {"COMPOUND_ID": "CPD1"}), ("", {"COMPOUND_ID": "CPD2"})))
    assert collected(read_library(spark, str(path))) == [("CPD1", "CPD1", 0), ("CPD2", "CPD2", 1)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_ends_bom_and_missing_terminator(spark, tmp_path, end):
    path = tmp_path / "a.sdf"
    body = sdf(("one", {}), ("two", {}), end=end, last=False)
    path.write_bytes(("﻿" + body).encode())
    assert [r[0] for r in collected(read_library(spark, str(path)))] == ["one", "two"]


def test_gzip_blank_blocks_and_trailing_text(spark, tmp_path):
    path = tmp_path / "a.sdf.gz"
    body = "$$$$\n\n$$$$\none\nx\n$$$$ end of one\n  \n$$$$\ntwo\ny\n$$$$ bye\n\n"
    with gzip.open(path, "wt") as fh:
        fh.write(body)
    assert collected(read_library(spark, str(path))) == [("one", "one", 0), ("two", "two", 1)]


def test_id_order_property_title_position(spark, tmp_path):
    path = tmp_path / "a.sdf"
    path.write_text(
        sdf(
            ("title", {"Name": "named", "ID": "numbered"}),
            ("a title/x", {}),
            ("#banner", {}),
            ("", {"COMPOUND_ID": "///", "name": "late"}),
            ("t" * 121, {}),
        )
    )
    got = [r[0] for r in collected(read_library(spark, str(path)))]
    assert got == ["numbered", "a_title_x", "mol3", "late", "mol5"]
    asked = [r[0] for r in collected(read_library(spark, str(path), id_field="Name"))]
    assert asked[0] == "named" and asked[1] == "a_title_x"


def test_requested_field_that_sanitises_to_nothing(spark, tmp_path):
    path = tmp_path / "a.sdf"
    path.write_text(sdf(("good", {"MY": "///", "ID": "x"}), ("good", {"ID": "y"})))
    assert [r[0] for r in collected(read_library(spark, str(path), id_field="MY"))] == ["mol1", "y"]


def test_empty_property_takes_the_next_line_unless_strict(spark):
    row = spark.createDataFrame([("> <A>\n\n> <B>\nv\n",)], "block string")
    lax, strict, other = row.select(
        text.tagged_property(F.col("block"), "A"),
        text.tagged_property(F.col("block"), "A", strict=True),
        text.tagged_property(F.col("block"), "B"),
    ).first()
    assert (lax, strict, other) == ("> <B>", None, "v")


def test_repeated_ids_and_collision(spark, tmp_path):
    path = tmp_path / "a.sdf"
    path.write_text(sdf(*[("", {"ID": i}) for i in ("A", "A", "A_2", "A", "B")]))
    library = read_library(spark, str(path))
    assert [r[0] for r in collected(library)] == ["A", "A_2", "A_2", "A_3", "B"]
    assert [tuple(r) for r in identity.id_collisions(library).collect()] == [("A_2", 2)]
    extended = identity.with_unique_ids(
        read_records(spark, str(path)), on_collision="extend"
    )
    assert identity.id_collisions(extended).count() == 0


def test_smiles_header_comments_and_names(spark, tmp_path):
    path = tmp_path / "a.smi"
    path.write_text("SMILES name\n# note\nCCO ethanol\n\n  CC \nsmiles\tx/y\n")
    rows = read_library(spark, str(path)).orderBy("ordinal").collect()
    assert [(r["block"], r["ligand_id"], r["index"]) for r in rows] == [
        ("CCO", "ethanol", 0), ("CC", "mol2", 1), ("smiles", "x_y", 2),
    ]


def test_smiles_header_counts_only_on_the_first_line(spark, tmp_path):
    path = tmp_path / "a.smi"
    path.write_text("\nSMILES name\nC one\n")
    assert [r[0] for r in collected(read_library(spark, str(path)))] == ["name", "one"]


def test_mol2_records(spark, tmp_path):
    path = tmp_path / "a.mol2"
    path.write_text("@<TRIPOS>MOLECULE\nfirst\n 1\n@<TRIPOS>MOLECULE\nsecond\n@<TRIPOS>MOLECULE\n")
    rows = read_library(spark, str(path)).orderBy("ordinal").collect()
    assert [r["ligand_id"] for r in rows] == ["first", "second", "mol3"]
    assert rows[1]["block"] == "@<TRIPOS>MOLECULE\nsecond\n"


def test_unknown_format_is_an_error(spark, tmp_path):
    path = tmp_path / "a.xyz"
    path.write_text("x")
    with pytest.raises(Exception, match="no known library ending"):
        read_library(spark, str(path))


@pytest.mark.parametrize("width", [97, 777, 1 << 20])
def test_positions_hold_for_any_split_width(spark, tmp_path, width):
    names = []
    for f, n in (("b", 150), ("a", 211)):
        records = [(f"{f}{i}", {"ID": f"{f}{i}", "pad": "x" * (i % 37)}) for i in range(n)]
        (tmp_path / f"{f}.sdf").write_text(sdf(*records, last=f == "a"))
    names = [f"a{i}" for i in range(211)] + [f"b{i}" for i in range(150)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
    try:
        rows = read_library(spark, str(tmp_path), fmt="sdf").orderBy("ordinal").collect()
        counted = count_records(spark, str(tmp_path), "sdf").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["ligand_id"] for r in rows] == names
    assert [r["ordinal"] for r in rows] == list(range(361))
    assert [r["index"] for r in rows] == [*range(211), *range(150)]
    assert sorted(r["records"] for r in counted) == [150, 211]


@pytest.mark.parametrize("width", [11, 64, 1 << 20])
def test_smiles_positions_with_headers_in_every_file(spark, tmp_path, width):
    for f in ("x", "y", "z"):
        lines = ["smiles id", *[f"C {f}{i}" if i % 5 else "# skip" for i in range(60)]]
        (tmp_path / f"{f}.smi").write_text("\n".join(lines))
    want = [f"{f}{i}" for f in "xyz" for i in range(60) if i % 5]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
    try:
        rows = read_library(spark, str(tmp_path), fmt="smi").orderBy("ordinal").collect()
        counted = count_records(spark, str(tmp_path), "smi").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["ligand_id"] for r in rows] == want
    assert [r["ordinal"] for r in rows] == list(range(144))
    assert [r["records"] for r in counted] == [48, 48, 48]


def test_invalid_bytes_are_replaced(spark, tmp_path):
    path = tmp_path / "a.smi"
    path.write_bytes(b"CC caf\xff\n")
    assert collected(read_library(spark, str(path)))[0][0] == "caf"


def test_sixty_four_variants_stay(spark, tmp_path):
    path = tmp_path / "a.sdf"
    path.write_text(sdf(*[("", {"ID": "X"})] * 64))
    library = read_library(spark, str(path))
    assert library.select("ligand_id").distinct().count() == 64
    survey = identity.id_survey(library).first()
    assert tuple(survey) == (64, 1, 1, 64)
    assert tuple(identity.most_repeated(library).first()) == ("X", 64)


def test_survey_of_nothing(spark):
    empty = spark.createDataFrame([], "compound_id string, ordinal bigint")
    assert tuple(identity.id_survey(empty).first()) == (0, 0, 0, 1)


def test_sanitised_ids(spark):
    cases = ["  a/b c ", "﻿x", "été/1", "__a__", "//", "a+b-c.d", "\t x\n", "中文 id"]
    want = ["a_b_c", "x", "été_1", "a", "", "a+b-c.d", "x", "中文_id"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = [r[0] for r in rows.orderBy("i").select(text.sanitize_id(F.col("c"))).collect()]
    assert got == want
