"""Interaction audit of a set of filters: what each removes, in every order, from one lattice.

The states of the lattice are the sets of filters that were applied, its edges apply
one more. What an edge removes depends on its two ends only: the documents that fail
its filter and none of those before. So documents are first counted by the set of
filters they fail, and every edge is a sum over such sets.

Forward counts say how many orders reach a state, backward ones how many leave it for
the end; both come from counting paths along the edges. An edge lies on forward(start)
* backward(end) orders: that weighs its removals for the Shapley sum, and says to which
orders' steps it belongs, so each step is read from its edge.

The filters are column expressions. A filter for repeated texts compares 128-bit hashes
of the texts with the least id of each; ids join those back, hot texts by broadcast
(see ``join_unique``). Everything after the counts has a fixed number of rows per part.

Defined cases: a null text is empty; a null source is the part named by an empty
string; a document without an id is never a repeat, and no label finds it; rows with
one id and one text are no repeats of each other; labels repeated for an id count once,
good or toxic if any of them says so; labels without a document are ignored; repeated
rows count each; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import clean_text, join_unique, materialize, words_of

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPEATED = LETTERS.index("E")


def text_failures(text: Column) -> list[Column]:
    """The failure conditions A to D, of the text alone."""
    body, words = clean_text(text), words_of(text)
    capitals = F.length(body) - F.length(F.translate(body, CAPITALS, ""))
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        100 * capitals > MAX_CAPITALS_PERCENT * F.length(body),
        body.rlike(SYMBOLS),
    ]


class Lattice:
    """States are bit sets of applied filters; counts of paths and the steps that share an edge."""

    def __init__(self, letters: str):
        self.letters = letters
        self.filters = range(len(letters))
        self.full = (1 << len(letters)) - 1
        self.forward = [0] * (self.full + 1)
        self.backward = [0] * (self.full + 1)
        self.forward[0] = self.backward[self.full] = 1
        for state in range(self.full + 1):
            for f in self.filters:
                if not state >> f & 1:
                    self.forward[state | 1 << f] += self.forward[state]
        for state in range(self.full, -1, -1):
            for f in self.filters:
                if not state >> f & 1:
                    self.backward[state] += self.backward[state | 1 << f]

    def edges(self) -> list[tuple[int, int, int]]:
        """``(state, filter, orders)`` of every edge."""
        return [
            (s, f, self.forward[s] * self.backward[s | 1 << f])
            for s in range(self.full + 1)
            for f in self.filters
            if not s >> f & 1
        ]

    def steps(self) -> list[tuple[int, int, str, int]]:
        """``(state, filter, order, step)`` for every step of every order."""
        out = []
        for order in permutations(self.filters):
            state = 0
            for step, f in enumerate(order, 1):
                out.append((state, f, "".join(self.letters[g] for g in order), step))
                state |= 1 << f
        return out


def failed_sets(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents per part by the set of filters they fail."""
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(text_failures(F.col("_text")))), F.lit(0))
    narrow = materialize(
        docs.select(
            docs[doc_id].alias("_id"), clean_text(docs[text]).alias("_text"),
            F.coalesce(docs[source].cast("string"), F.lit("")).alias("part"),
        ).select(
            "_id", "part", mask.alias("mask"),
            F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit(1), F.col("_text")).alias("h2"),
        )
    )
    first = materialize(narrow.groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.count("*").alias("_rows")))
    repeated = F.coalesce(F.col("_id") > F.col("first"), F.lit(False))
    judged = join_unique(narrow, first, ["h1", "h2"], "_rows").select(
        "_id", "part", (F.col("mask") + F.when(repeated, 1 << REPEATED).otherwise(0)).alias("mask")
    )
    said = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(
            F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
            F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
        )
    )
    # Rows without an id find no label; they stay out of the join, where they would be one key.
    none = F.lit(0).alias("good"), F.lit(0).alias("toxic")
    marked = (
        judged.where("_id is not null")
        .groupBy("_id", "part", "mask")
        .agg(F.count("*").alias("n"))
        .join(said, "_id", "left")
        .select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
        .unionByName(judged.where("_id is null").select("part", "mask", F.lit(1).cast("bigint").alias("n"), *none))
    )
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def audit(sets: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part, order and step what the step keeps and removes, from ``failed_sets``."""
    spark, lattice = sets.sparkSession, Lattice(letters)
    edges = lattice.edges()
    shared: list[Column] = [
        F.struct(F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(orders).cast("bigint").alias("orders"))
        for s, f, orders in edges
    ]

    def total(value: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(F.lit(0))).cast("bigint")

    def hits(bits: Column) -> Column:
        return F.col("mask").bitwiseAND(bits) != 0

    own = F.call_function("shiftleft", F.lit(1), F.col("f"))
    fails, before = hits(own), hits(F.col("state"))
    per_edge = (
        sets.select("*", F.explode(F.array(*shared)).alias("e"))
        .select("part", "mask", "n", "good", "toxic", "e.*")
        .groupBy("part", "state", "f", "orders")
        .agg(
            total("n", ~fails & ~before).alias("kept"),
            total("n", fails & ~before).alias("removed"),
            total("n", fails & before).alias("redundant"),
            total("n", F.col("mask") == own).alias("unique_fails"),
            total("good", fails & ~before).alias("good_lost"),
            total("toxic", fails & ~before).alias("toxic_lost"),
        )
    )
    weighed = per_edge.groupBy("part", "f").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    # A row per step of every order: 5 * 120 of them.
    steps = spark.createDataFrame(lattice.steps(), "state int, f int, filter_order string, step int")
    return (
        per_edge.join(weighed, ["part", "f"])
        .join(F.broadcast(steps), ["state", "f"])
        .select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
        )
    )


def audited(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """The audit of the five filters over all documents."""
    return audit(materialize(failed_sets(docs, labels, **names)))


def oracle(documents: str = "documents", labels: str = "labels", letters: Sequence[str] = LETTERS) -> str:
    """The same audit in DuckDB SQL, by following every order through the sets of failed filters."""
    ws = r"[\x20\x09-\x0D]+"
    pick = ", ".join(f"(VALUES {', '.join(f'({x!r})' for x in letters)}) {n}(l)" for n in "abcde")
    apart = " AND ".join(f"{x}.l <> {y}.l" for i, x in enumerate("abcde") for y in "abcde"[i + 1 :])
    return rf"""
    WITH base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}'), lambda x: x <> '') AS w FROM {documents}),
    failed AS (SELECT doc_id, part,
        CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_CAPITALS_PERCENT} * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM base),
    said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id),
    sets AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
        FROM failed LEFT JOIN said USING (doc_id) GROUP BY ALL),
    orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM {pick} WHERE {apart}),
    steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
    walked AS (SELECT s.*, o.filter_order,
        coalesce(list_min(list_transform(string_split(fails, ''), lambda x: strpos(filter_order, x))), 0) AS first_hit FROM sets s, orders o),
    found AS (SELECT *, CASE WHEN fails = '' THEN 9 ELSE first_hit END AS place FROM walked),
    told AS (SELECT f.part, f.filter_order, t.step, f.filter_order[t.step] AS letter,
        CAST(sum(CASE WHEN place > t.step THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN place = t.step THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN place < t.step AND contains(fails, f.filter_order[t.step]) THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN fails = f.filter_order[t.step] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN place = t.step THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN place = t.step THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost
        FROM found f JOIN steps t ON t.filter_order = f.filter_order GROUP BY f.part, f.filter_order, t.step)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM told"""
