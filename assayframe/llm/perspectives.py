"""Multi-party dialogues rendered once per participant, with masks.

For every participant of a conversation the whole dialogue is written with that
speaker as the assistant and all others as named users; a mask lists the stretches
the assistant wrote, as character offsets ``start-end`` into the text. Speakers
that are no participants (system prompts) keep their own tag for everyone.

A long dialogue comes as parts of at most ``PART_TURNS`` turns, each a row with its
own offsets; the parts of a perspective in order are the dialogue. So a
conversation that holds a third of all turns is never one row. Turns get their
position from one sort over all tasks.

Defined cases: null text is empty; a null role is the speaker ``unknown``; a null
conversation id is one conversation; null turns come first, equal turns are
ordered by speaker, then text, and repeated rows stay; tags inside texts are
broken up; a conversation without participants gives no row; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import materialize
from assayframe.operators.ordering import with_global_rank

PART_TURNS = 64
END = "<|end|>"


def _head(speaker: Column, perspective: Column, outside: Sequence[str]) -> Column:
    name = F.translate(speaker, "<|>\n", "____")
    return (
        F.when(speaker.isin(*outside), F.concat(F.lit("<|"), name, F.lit("|>\n")))
        .when(speaker == perspective, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user:"), name, F.lit("|>\n")))
    )


def perspectives(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    outside: Sequence[str] = ("system",),
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """``conv_id, perspective, part, n_turns, text, mask`` per conversation, participant and part."""
    said = turns.select(
        turns[conversation].alias("conv_id"),
        F.coalesce(F.concat(F.lit("="), turns[conversation].cast("string")), F.lit("~")).alias("ck"),
        turns[turn].alias("turn"),
        F.coalesce(turns[speaker], F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(turns[text], F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    )
    ranked = materialize(
        with_global_rank(
            said,
            [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("body")],
            "rank",
        )
    )
    firsts = ranked.groupBy("ck").agg(F.min("rank").alias("first"))
    parts = (
        ranked.join(firsts, "ck")
        .withColumn("part", F.expr(f"(rank - first) div {part_turns}"))
        .groupBy("ck", "part")
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.sort_array(F.collect_list(F.struct("rank", "speaker", "body"))).alias("turns"),
        )
    )
    people = ranked.where(~F.col("speaker").isin(*outside)).select("ck", F.col("speaker").alias("perspective")).distinct()
    seen = parts.join(people, "ck")
    segments = F.transform(
        "turns",
        lambda t: F.struct(
            _head(t["speaker"], F.col("perspective"), outside).alias("head"),
            F.concat(t["body"], F.lit(END)).alias("rest"),
            (t["speaker"] == F.col("perspective")).alias("own"),
        ),
    )
    # Offsets of a part's turns, at most part_turns of them.
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("mask"))

    def step(state: Column, s: Column) -> Column:
        begin = state["at"] + F.length(s["head"])
        end = begin + F.length(s["rest"])
        span = F.concat(
            F.when(state["mask"] == "", F.lit("")).otherwise(F.lit(",")),
            begin.cast("string"), F.lit("-"), end.cast("string"),
        )
        return F.struct(
            (end + 1).alias("at"),
            F.concat(state["mask"], F.when(s["own"], span).otherwise(F.lit(""))).alias("mask"),
        )

    return seen.withColumn("segments", segments).select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(
            F.transform("segments", lambda s: F.concat(s["head"], s["rest"], F.lit("\n"))), ""
        ).alias("text"),
        F.aggregate("segments", start, step, lambda s: s["mask"]).alias("mask"),
    )


def oracle(conversations: str = "conversations", part_turns: int = PART_TURNS) -> str:
    """The same rows in DuckDB SQL, for the default arguments."""
    name = "translate(t.sp, '<|>' || chr(10), '____')"
    return f"""
    WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sp, body) - 1 AS pos FROM (
      SELECT conv_id, turn, coalesce(role, 'unknown') AS sp, replace(coalesce(text, ''), '<|', '< |') AS body FROM {conversations})),
    p AS (SELECT DISTINCT conv_id, sp AS perspective FROM t WHERE sp <> 'system'),
    s AS (SELECT t.*, p.perspective, pos // {part_turns} AS part, body || '{END}' AS rest,
      CASE WHEN t.sp = 'system' THEN '<|' || {name} || '|>' WHEN t.sp = p.perspective THEN '<|assistant|>'
        ELSE '<|user:' || {name} || '|>' END || chr(10) AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    c AS (SELECT *, sum(length(head) + length(rest) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos) - 1 AS e FROM s)
    SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || rest || chr(10), '' ORDER BY pos) AS text,
      coalesce(string_agg(CASE WHEN sp = perspective THEN CAST(e - length(rest) AS VARCHAR) || '-' || CAST(e AS VARCHAR) END, ',' ORDER BY pos), '') AS mask
    FROM c GROUP BY conv_id, perspective, part
    """
