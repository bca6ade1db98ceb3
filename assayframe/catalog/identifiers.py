"""Identifiers, seeds and text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.catalog import standins as S
from assayframe.catalog.registry import (
    LINE_END,
    WHITESPACE,
    query,
    sql_choose,
    sql_sanitize,
    sql_seed,
    sql_strip,
)
from assayframe.functions import seeds, text
from assayframe.operators import identity, timing

_PART_ORDINAL = "(l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey"


def _parts_as_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("compound_id"),
        F.expr(_PART_ORDINAL).alias("ordinal"),
    )


@query("""
WITH counts AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS distinct_compounds,
       count(*) FILTER (n > 1) AS compounds_with_variants,
       coalesce(max(CASE WHEN n > 1 THEN n END), 1) AS max_variants
FROM counts
""")
def id_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against distinct compounds."""
    return identity.id_survey(_parts_as_compounds(spark, sf_dir))


@query(f"""
SELECT CAST(l_partkey AS VARCHAR) AS compound_id, count(*) AS n
FROM lineitem GROUP BY l_partkey HAVING count(*) > 1
ORDER BY n DESC, min({_PART_ORDINAL}) LIMIT 5
""")
def most_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most repeated compounds."""
    return identity.most_repeated(_parts_as_compounds(spark, sf_dir))


_UNIQUE = """
numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
named AS (SELECT doc_id, source AS compound_id, CASE WHEN n > 1 THEN source || '_' || n ELSE source END AS ligand_id FROM numbered)
"""


def _documents_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select(
        F.col("source").alias("compound_id"), F.col("doc_id").alias("ordinal")
    )


@query(f"""
WITH {_UNIQUE} SELECT doc_id AS ordinal, compound_id, ligand_id, ligand_id <> compound_id AS is_duplicate FROM named
""")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated compound ids numbered in file order."""
    named = identity.with_unique_ids(_documents_as_records(spark, sf_dir))
    return named.withColumn("is_duplicate", identity.is_duplicate_id())


@query("""
WITH records AS (SELECT 'P' || l_partkey AS compound_id, (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey AS ordinal
  FROM lineitem UNION ALL SELECT 'P' || p_partkey || '_2', 9000000000000000 + p_partkey FROM part),
numbered AS (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY ordinal) AS n FROM records),
named AS (SELECT CASE WHEN n > 1 THEN compound_id || '_' || n ELSE compound_id END AS ligand_id FROM numbered)
SELECT ligand_id, count(*) AS n FROM named GROUP BY ligand_id HAVING count(*) > 1
""")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered ids that meet a compound really called that."""
    lines = S.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("compound_id"),
        F.expr(_PART_ORDINAL).alias("ordinal"),
    )
    parts = S.table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("_2")).alias("compound_id"),
        (F.lit(9000000000000000) + F.col("p_partkey")).alias("ordinal"),
    )
    return identity.id_collisions(identity.with_unique_ids(lines.unionByName(parts)))


@query(f"""
SELECT 'page' AS kind, page_id AS id, {sql_sanitize('url')} AS safe FROM pages
UNION ALL SELECT 'document', doc_id, {sql_sanitize('text')} FROM documents
""")
def sanitize_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls and whole texts made safe as file names."""
    pages = S.table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("id"),
        text.sanitize_id(F.col("url")).alias("safe"),
    )
    documents = S.table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"),
        F.col("doc_id").alias("id"),
        text.sanitize_id(F.col("text")).alias("safe"),
    )
    return pages.unionByName(documents)


_ENDINGS = (".sdf", ".SDF.gz", ".sd", ".mol", ".smi", ".Smiles", ".ism.gz", ".txt", ".mol2", ".MOL2.GZ", ".pdb", ".gz", "")
_STRUCTURE_ENDINGS = (".pdb", ".PDBQT", ".pqr", ".cif", ".mmCIF", ".bcif", ".pdb.gz", ".sdf")


@query(f"""
WITH named AS (SELECT page_id, url || {sql_choose(_ENDINGS, 'page_id')} AS name, url || {sql_choose(_STRUCTURE_ENDINGS, 'page_id')} AS structure FROM pages),
bare AS (SELECT *, regexp_replace(lower(name), '\\.gz$', '') AS base FROM named)
SELECT page_id,
       CASE WHEN regexp_matches(base, '\\.(sdf|sd|mol)$') THEN 'sdf'
            WHEN regexp_matches(base, '\\.(smi|smiles|ism|txt)$') THEN 'smi'
            WHEN regexp_matches(base, '\\.mol2$') THEN 'mol2' END AS fmt,
       CASE WHEN regexp_matches(lower(structure), '\\.(pdb|pdbqt|pqr)$') THEN 'native'
            WHEN regexp_matches(lower(structure), '\\.(cif|mmcif|bcif)$') THEN 'convert' END AS route
FROM bare
""")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library format and structure route by file name."""
    page = F.col("page_id")
    return S.table(spark, sf_dir, "pages").select(
        "page_id",
        text.format_or_null(F.concat("url", S.choose(_ENDINGS, page))).alias("fmt"),
        text.structure_route(F.concat("url", S.choose(_STRUCTURE_ENDINGS, page))).alias("route"),
    )


_TITLES = ("#banner", "", "  Title of one ", "$generated")


@query(f"""
WITH blocks AS (
  SELECT c_custkey,
         {sql_choose(_TITLES, 'c_custkey')} || chr(10) || 'body' || chr(10)
         || CASE WHEN c_custkey % 3 = 0 THEN '> <Name>' || chr(10) || c_name || chr(10) || chr(10) ELSE '' END
         || CASE WHEN c_custkey % 5 = 0 THEN '>  <ID> (7)' || chr(10) || ' ' || c_mktsegment || '/' || c_nationkey || ' ' || chr(10) || chr(10) ELSE '' END
         || CASE WHEN c_custkey % 7 = 0 THEN '> <COMPOUND_ID>' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '///' ELSE 'CPD ' || c_custkey END || chr(10) || chr(10) ELSE '' END AS block
  FROM customer),
found AS (
  SELECT c_custkey, block,
         nullif({sql_sanitize("regexp_extract(block, '(?m)^>\\s+<COMPOUND_ID>.*$\\n*([^\\n]*)', 1)")}, '') AS p1,
         nullif({sql_sanitize("regexp_extract(block, '(?m)^>\\s+<ID>.*$\\n*([^\\n]*)', 1)")}, '') AS p2,
         nullif({sql_sanitize("regexp_extract(block, '(?m)^>\\s+<Name>.*$\\n*([^\\n]*)', 1)")}, '') AS p3,
         trim(string_split(block, chr(10))[1]) AS title
  FROM blocks)
SELECT c_custkey, coalesce(p1, p2, p3,
         CASE WHEN title <> '' AND NOT regexp_matches(title, '^[#$]') THEN nullif({sql_sanitize('title')}, '') END,
         'mol' || (c_custkey + 1)) AS compound_id
FROM found
""")
def id_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier of a record block: properties, then title, then position."""
    key = F.col("c_custkey")
    newline = F.lit("\n")

    def part(test: Column, header: str, value: Column) -> Column:
        return F.when(test, F.concat(F.lit(header), newline, value, newline, newline)).otherwise("")

    block = F.concat(
        S.choose(_TITLES, key), newline, F.lit("body"), newline,
        part(key % 3 == 0, "> <Name>", F.col("c_name")),
        part(
            key % 5 == 0, ">  <ID> (7)",
            F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("/"),
                     F.col("c_nationkey").cast("string"), F.lit(" ")),
        ),
        part(
            key % 7 == 0, "> <COMPOUND_ID>",
            F.when(key % 2 == 0, "///").otherwise(F.concat(F.lit("CPD "), key.cast("string"))),
        ),
    )
    return S.table(spark, sf_dir, "customer").select(
        "c_custkey", text.record_id(block, key).alias("compound_id")
    )


@query(f"""
WITH blocks AS (
  SELECT page_id, 'title' || chr(10) || '> <URL>' || chr(10) || chr(10) || '  ' || url || ' ' || chr(10) || chr(10)
         || '>  <HTML> (1)' || chr(10) || html || chr(10) || '> <EMPTY>' || chr(10) AS block
  FROM pages)
SELECT page_id,
       nullif({sql_strip("regexp_extract(block, '(?m)^>\\s+<URL>.*$\\n*([^\\n]*)', 1)")}, '') AS url,
       nullif({sql_strip("regexp_extract(block, '(?m)^>\\s+<HTML>.*$\\n*([^\\n]*)', 1)")}, '') AS html,
       nullif({sql_strip("regexp_extract(block, '(?m)^>\\s+<EMPTY>.*$\\n*([^\\n]*)', 1)")}, '') AS empty
FROM blocks
""")
def tagged_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged property values of a record block."""
    block = F.concat(
        F.lit("title\n> <URL>\n\n  "), F.col("url"), F.lit(" \n\n>  <HTML> (1)\n"), F.col("html"),
        F.lit("\n> <EMPTY>\n"),
    )
    return S.table(spark, sf_dir, "pages").select(
        "page_id",
        text.tagged_property(block, "URL").alias("url"),
        text.tagged_property(block, "HTML").alias("html"),
        text.tagged_property(block, "EMPTY").alias("empty"),
    )


@query(f"SELECT c_custkey, {sql_seed(chr(39) + '42:' + chr(39) + ' || c_name')} AS seed FROM customer")
def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed of each id under run seed 42."""
    return S.table(spark, sf_dir, "customer").select(
        "c_custkey", seeds.stable_seed(42, F.col("c_name")).alias("seed")
    )


@query(f"""
SELECT c_custkey, k AS conformer,
       {sql_seed("'42:' || c_name || '#conf' || k")} AS seed,
       c_name || '_c' || k || '.pdbqt' AS file_name
FROM customer, (SELECT unnest([1, 2, 3]) AS k)
""")
def conformer_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three start geometries per id, each with its seed and file name."""
    from assayframe.operators.batchmap import with_conformers

    rows = S.table(spark, sf_dir, "customer").withColumn("ligand_id", F.col("c_name"))
    return with_conformers(rows, 3, 42).select(
        "c_custkey", "conformer", F.col("row_seed").alias("seed"), "file_name"
    )


@query("""
WITH hashed AS (SELECT p_partkey, p_name, sha256('7:' || p_partkey) AS h FROM part)
SELECT p_partkey, p_name FROM hashed ORDER BY h, p_partkey LIMIT 50
""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows spread over the table, always the same."""
    return timing.hash_sample(
        S.table(spark, sf_dir, "part").select("p_partkey", "p_name"), 50, 7, "p_partkey"
    )


_NOISE = (
    " residue 4 has a MISSING ATOM", " two altLocs found", " no Template fits", "",
    " INITIAL_COORDS: 230", " ZN is not a valid AutoDock type. Atom type ZN refused",
)


@query(f"""
WITH logs AS (SELECT doc_id, text || {sql_choose(_NOISE, 'doc_id')} AS raw FROM documents),
stripped AS (SELECT *, {sql_strip('raw')} AS clean, lower({sql_strip('raw')}) AS low FROM logs),
classed AS (
  SELECT *, CASE WHEN contains(low, 'missing atom') OR contains(low, 'incomplete') THEN 'missing_atoms'
                 WHEN contains(low, 'altloc') THEN 'alternate_locations'
                 WHEN contains(low, 'template') THEN 'unknown_template' ELSE 'other' END AS cause
  FROM stripped)
SELECT doc_id, cause, right(clean, CASE WHEN cause = 'other' THEN 800 ELSE 600 END) AS tail,
       CASE WHEN regexp_matches(raw, 'INITIAL_COORDS|ETK_MINIMIZATION|FINAL_CHIRAL')
            THEN 'no 3D geometry was found: ' || left(raw, 120)
            ELSE left(raw, 200) END AS readable,
       left(regexp_split_to_array(clean, '{LINE_END}')[1], 200) AS brief,
       CASE WHEN contains(raw, 'not a valid AutoDock type') THEN regexp_extract(raw, 'Atom type{WHITESPACE}*([^\\s]+)', 1) END AS refused_type
FROM classed
""")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cause, quoted tail and readable forms of tool output."""
    raw = F.concat("text", S.choose(_NOISE, F.col("doc_id")))
    return S.table(spark, sf_dir, "documents").withColumn("raw", raw).select(
        "doc_id",
        text.prep_tool_error_class(F.col("raw")).alias("cause"),
        text.prep_tool_error_tail(F.col("raw")).alias("tail"),
        text.readable_error(F.col("raw")).alias("readable"),
        text.brief_error(F.col("raw"), F.lit("")).alias("brief"),
        text.rejected_atom_type(F.col("raw")).alias("refused_type"),
    )


@query(f"""
WITH logs AS (SELECT conv_id, turn, replace(text, '. ', '.' || chr(10) || ' Removing Residue ') || chr(10) || role || ' DELETED' AS log FROM conversations),
hits AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(log, '{LINE_END}'), lambda s: regexp_matches(lower(s), 'deleted|removing residue')) AS found FROM logs)
SELECT conv_id, turn, len(found) AS n_lines,
       array_to_string(list_transform(found, lambda s: left({sql_strip('s')}, 120)), '|') AS lines
FROM hits
""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log that report removed residues."""
    log = F.concat(
        F.replace(F.col("text"), F.lit(". "), F.lit(".\n Removing Residue ")),
        F.lit("\n"), F.col("role"), F.lit(" DELETED"),
    )
    found = text.deletion_lines(log)
    return S.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(found).cast("bigint").alias("n_lines"),
        F.array_join(found, "|").alias("lines"),
    )


@query("""
WITH whole AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)
SELECT o_orderkey,
       CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm'
            WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration
FROM whole
""")
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as hours and minutes."""
    return S.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.duration_text(F.col("o_totalprice")).alias("duration")
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE l_linenumber % 4 WHEN 0 THEN CAST(l_quantity AS INTEGER)
            WHEN 1 THEN CAST(l_suppkey AS INTEGER)
            WHEN 2 THEN 2 ELSE CAST(l_suppkey AS INTEGER) END AS torsions
FROM lineitem
""")
def torsion_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Torsions stated in prepared text, else counted branches."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    supplier = F.col("l_suppkey").cast("string")
    kind = F.col("l_linenumber") % 4
    branches = "ROOT\nBRANCH 1 2\nENDBRANCH 1 2\nBRANCH 2 3\nENDBRANCH 2 3\n"
    body = (
        F.when(kind == 0, F.concat(F.lit(branches + "TORSDOF "), quantity, F.lit("\n")))
        .when(
            kind == 1,
            F.concat(F.lit("REMARK  "), supplier, F.lit(" active torsions:\n" + branches),
                     F.lit("TORSDOF "), quantity),
        )
        .when(kind == 2, F.lit(branches + "TORSDOF none\n"))
        .otherwise(
            F.concat(F.lit("TORSDOF x\r\n" + branches + "BRANCH 9 active torsions\nREMARK v1.5 has "),
                     supplier, F.lit(" active torsions"))
        )
    )
    return S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.torsion_count(body).alias("torsions")
    )
