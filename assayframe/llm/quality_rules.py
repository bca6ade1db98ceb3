"""Quality rules whose thresholds follow the data, per language and source.

Every document gets a few integer measures. Each (language, source) group keeps a
mergeable sketch of each measure: counts over log-linear buckets, so merging is
adding, and the same rows give the same sketch in any order and after any lost
task. Sketches count the documents that pass the base rule. Two quantiles of a
sketch give an upper fence: the high one plus a multiple of the range between them.
What a group says is shrunk towards what its language says, and that towards
everything, by numbers of rows. Documents then join their group's fences.

Defined cases: a null text has no words and fails the base rule; a null language
or source is a group of its own; repeated rows are measured and kept or dropped
alike; a group whose rows all fail the base rule has no fences and keeps nothing; an
empty table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import WORD_BREAK, clean_text, materialize, packed_rows, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Fence:
    """Upper fence of one measure: high quantile + reach / 10 * range down to the low quantile.

    Quantiles are in per cent. A range counts as ``LEAST_RANGE`` at least. For a ``tail``
    a group's range of 0 says nothing, and its language's takes its place.
    """

    measure: str
    low: int
    high: int
    reach: int
    tail: bool = False


# Measures are per thousand characters, words or lines. Repeats are absent from most
# documents, so their range is that of the upper tail.
FENCES = (
    Fence("symbol_rate", 25, 75, 60),
    Fence("upper_rate", 25, 75, 250),
    Fence("mark_rate", 25, 75, 120),
    Fence("repeat_rate", 75, 99, 10, tail=True),
    Fence("dup_line_rate", 75, 99, 15, tail=True),
)
# Two buckets of a sketch.
LEAST_RANGE = 2
# A group with so many rows weighs as much as its parent.
PRIOR_ROWS = 100
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# Buckets hold a value's leading bits: exact below 64, within 1/32 above.
SKETCH_BITS = 6


def measures(df: DataFrame, text: str) -> DataFrame:
    """Append the base counts and rates of the text column, staged so that nothing runs twice."""
    lines = F.filter(
        F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    )
    grams = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
            lambda i: F.xxhash64(*[F.col("_hashes")[i + k] for k in range(WINDOW)]),
        ),
    )
    placed = F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    )
    last = F.size("_placed") - 1
    repeated = F.sort_array(
        F.filter(
            F.transform(
                "_placed",
                lambda x, i: F.when(
                    ((i > 0) & (F.col("_placed")[F.greatest(i - 1, F.lit(0))]["g"] == x["g"]))
                    | ((i < last) & (F.col("_placed")[F.least(i + 1, last)]["g"] == x["g"])),
                    x["i"],
                ),
            ),
            lambda x: x.isNotNull(),
        )
    )
    end = F.size("_repeated") - 1
    steps = F.transform(
        "_repeated",
        lambda p, i: F.when(
            i < end, F.least(F.lit(WINDOW), F.col("_repeated")[F.least(i + 1, end)] - p)
        ).otherwise(F.lit(WINDOW)),
    )
    covered = F.aggregate(F.col("_steps"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    counted = (
        df.withColumn("_text", clean_text(F.col(text)))
        .withColumn("_words", words_of(F.col("_text")))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_grams", grams)
        .withColumn("_placed", placed)
        .withColumn("_repeated", repeated)
        .withColumn("_steps", steps)
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint"))
        .withColumn(
            "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")
        )
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
        .withColumn("n_lines", F.size("_lines").cast("bigint"))
        .withColumn("n_upper", F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("bigint"))
        .withColumn("n_marks", F.regexp_count("_text", F.lit(r"[\p{P}\p{S}]")).cast("bigint"))
        .drop("_text", "_words", "_lines", "_hashes", "_grams", "_placed", "_repeated", "_steps")
    )

    def rate(part: str, whole: str) -> Column:
        return F.expr(f"1000 * {part} div greatest({whole}, 1)")

    return counted.withColumns(
        {
            "symbol_rate": rate("n_symbols", "word_chars"),
            "upper_rate": rate("n_upper", "word_chars"),
            "mark_rate": rate("n_marks", "word_chars"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
            "dup_line_rate": rate("n_dup_lines", "n_lines"),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )


def bucket_floor(value: str) -> str:
    """Least value of the bucket that holds ``value``."""
    drop = f"cast(greatest(length(bin({value})) - {SKETCH_BITS}, 0) as int)"
    return f"shiftleft(shiftright({value}, {drop}), {drop})"


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per bucket of every measure: per group, per language and over all.

    Columns ``level`` (0 group, 1 language, 2 all), ``lang_key``, ``source_key``,
    ``measure``, ``bucket``, ``n``. Two such tables merge by adding ``n``.
    """
    pairs = ", ".join(f"'{f.measure}', {bucket_floor(f.measure)}" for f in FENCES)
    own = (
        measured.select(
            "lang_key", "source_key", F.expr(f"stack({len(FENCES)}, {pairs}) as (measure, bucket)")
        )
        .groupBy("lang_key", "source_key", "measure", "bucket")
        .agg(F.count("*").alias("n"))
    )
    up = F.expr(
        "inline(array(named_struct('level', 0, 'lk', lang_key, 'sk', source_key), "
        "named_struct('level', 1, 'lk', lang_key, 'sk', ''), "
        "named_struct('level', 2, 'lk', '', 'sk', '')))"
    )
    return (
        own.select("measure", "bucket", "n", up)
        .groupBy("level", F.col("lk").alias("lang_key"), F.col("sk").alias("source_key"), "measure", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def _per_measure(part: str) -> str:
    return "CASE measure " + " ".join(f"WHEN '{f.measure}' THEN {getattr(f, part)}" for f in FENCES) + " END"


def fences(sketch: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """One row per (lang_key, source_key) with a fence column per measure."""
    group = ["level", "lang_key", "source_key", "measure"]
    running = Window.partitionBy(*group).orderBy("bucket")
    whole = Window.partitionBy(*group)
    ranked = sketch.withColumn("upto", F.sum("n").over(running)).withColumn(
        "total", F.sum("n").over(whole)
    )
    limits = ranked.groupBy(*group).agg(
        F.min(F.expr(f"CASE WHEN 100 * upto >= ({_per_measure('low')}) * total THEN bucket END")).alias("low"),
        F.min(F.expr(f"CASE WHEN 100 * upto >= ({_per_measure('high')}) * total THEN bucket END")).alias("high"),
        F.max("total").alias("rows"),
    )
    names = [f.measure for f in FENCES]
    said = [
        F.max(F.when(F.col("measure") == n, F.struct("high", (F.col("high") - F.col("low")).alias("range")))).alias(n)
        for n in names
    ]
    wide = limits.groupBy("level", "lang_key", "source_key").agg(F.max("rows").alias("rows"), *said)
    own = wide.where("level = 0").select(
        "lang_key", "source_key", F.struct("rows", *names).alias("own"), (F.col("level") + 2).alias("top")
    )
    lang = wide.where("level = 1").select("lang_key", F.struct("rows", *names).alias("by_lang"))
    everything = wide.where("level = 2").select(F.col("level").alias("top"), F.struct("rows", *names).alias("over_all"))

    def shrunk(f: Fence, part: str) -> str:
        top = f"over_all.{f.measure}.{part}"
        for at in ("by_lang", "own"):
            own = f"{at}.{f.measure}.{part}"
            mixed = f"(({at}.rows * {own} + {prior_rows} * {top}) div ({at}.rows + {prior_rows}))"
            top = f"(CASE WHEN {own} = 0 THEN {top} ELSE {mixed} END)" if f.tail and part == "range" else mixed
        return top

    return (
        own.join(lang, "lang_key")
        .join(everything, "top")
        .select(
            "lang_key", "source_key",
            *[
                F.expr(
                    f"{shrunk(f, 'high')} + {f.reach} * greatest({shrunk(f, 'range')}, {LEAST_RANGE}) div 10"
                ).alias(f"max_{f.measure}")
                for f in FENCES
            ],
        )
    )


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    prior_rows: int = PRIOR_ROWS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every row as ``row`` (its columns ``keep``, all by default), its measures, its group's fences, ``base_failed`` and ``kept``."""
    measured = materialize(
        measures(
            packed_rows(
                docs, keep, lang_key=_key(docs[lang]), source_key=_key(docs[source]), body=docs[text]
            ),
            "body",
        ).drop("body")
    )
    limits = fences(sketches(measured.where("not base_failed")), prior_rows)
    fine = ~F.col("base_failed")
    for f in FENCES:
        fine = fine & (F.col(f.measure) <= F.col(f"max_{f.measure}"))
    return measured.join(limits, ["lang_key", "source_key"], "left").withColumn(
        "kept", F.coalesce(fine, F.lit(False))
    )


def keep_good(docs: DataFrame, **names: str) -> DataFrame:
    """The documents that pass, with their own columns only."""
    return judge(docs, **names).where("kept").select("row.*")


def oracle(documents: str = "documents", prior_rows: int = PRIOR_ROWS) -> str:
    """The same verdicts in DuckDB SQL, as CTEs ending in ``judged``."""
    ws = r"[\x20\x09-\x0D]"
    names = [f.measure for f in FENCES]
    drop = "greatest(length(bin(v)) - %d, 0)" % SKETCH_BITS
    pairs = " UNION ALL ".join(
        f"SELECT lk, sk, '{n}' AS measure, {n} AS v FROM measured WHERE NOT base_failed" for n in names
    )
    low, high = _per_measure("low"), _per_measure("high")
    wide = ", ".join(
        f"max(CASE WHEN measure = '{n}' THEN high END) AS h_{n}, max(CASE WHEN measure = '{n}' THEN high - low END) AS r_{n}"
        for n in names
    )

    def said(f: Fence) -> str:
        n = f.measure
        high, spread = f"a.h_{n}", f"a.r_{n}"
        for t in "lo":
            high = f"((({t}.rows * {t}.h_{n}) + {prior_rows} * {high}) // ({t}.rows + {prior_rows}))"
            mixed = f"((({t}.rows * {t}.r_{n}) + {prior_rows} * {spread}) // ({t}.rows + {prior_rows}))"
            spread = f"(CASE WHEN {t}.r_{n} = 0 THEN {spread} ELSE {mixed} END)" if f.tail else mixed
        return f"{high} + {f.reach} * greatest({spread}, {LEAST_RANGE}) // 10 AS max_{n}"

    pick = ", ".join(map(said, FENCES))
    fine = " AND ".join(f"m.{n} <= f.max_{n}" for n in names)
    return rf"""
    WITH base AS (
      SELECT *, coalesce(text, '') AS t, coalesce('=' || lang, '~') AS lk, coalesce('=' || source, '~') AS sk,
        list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}+'), lambda x: x <> '') AS w
      FROM {documents}
    ), lined AS (
      SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ll FROM base
    ), grams AS (
      SELECT d.doc_id, d.text, g.i, w[g.i] || ' ' || w[g.i+1] || ' ' || w[g.i+2] || ' ' || w[g.i+3] || ' ' || w[g.i+4] AS gram
      FROM base d, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW} + 2)) AS i) g
    ), again AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams) WHERE c > 1
    ), cover AS (
      SELECT doc_id, CAST(sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS BIGINT) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM again) GROUP BY doc_id
    ), counted AS (
      SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ll) - len(list_distinct(ll)) AS BIGINT) AS n_dup_lines,
        coalesce(c.n_repeat_words, 0) AS n_repeat_words, CAST(len(ll) AS BIGINT) AS n_lines,
        CAST(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
        CAST(length(t) - length(regexp_replace(t, '[\p{{P}}\p{{S}}]', '', 'g')) AS BIGINT) AS n_marks
      FROM lined d LEFT JOIN cover c ON d.doc_id = c.doc_id
    ), measured AS (
      SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_rate, 1000 * n_upper // greatest(word_chars, 1) AS upper_rate,
        1000 * n_marks // greatest(word_chars, 1) AS mark_rate, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate,
        1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
        (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed
      FROM counted
    ), vals AS ({pairs}),
    buckets AS (SELECT lk, sk, measure, (v >> {drop}) << {drop} AS bucket FROM vals),
    leveled AS (
      SELECT 0 AS level, lk, sk, measure, bucket FROM buckets UNION ALL
      SELECT 1, lk, '', measure, bucket FROM buckets UNION ALL SELECT 2, '', '', measure, bucket FROM buckets
    ), sketch AS (SELECT level, lk, sk, measure, bucket, count(*) AS n FROM leveled GROUP BY ALL),
    upto AS (SELECT *, sum(n) OVER (PARTITION BY level, lk, sk, measure ORDER BY bucket) AS u,
        sum(n) OVER (PARTITION BY level, lk, sk, measure) AS total FROM sketch),
    quant AS (SELECT level, lk, sk, measure, min(CASE WHEN 100 * u >= ({low}) * total THEN bucket END) AS low,
        min(CASE WHEN 100 * u >= ({high}) * total THEN bucket END) AS high, max(total) AS rows FROM upto GROUP BY ALL),
    wide AS (SELECT level, lk, sk, max(rows) AS rows, {wide} FROM quant GROUP BY ALL),
    limits AS (SELECT o.lk, o.sk, {pick} FROM wide o JOIN wide l ON l.level = 1 AND l.lk = o.lk
        JOIN wide a ON a.level = 2 WHERE o.level = 0),
    judged AS (SELECT m.*, coalesce(NOT m.base_failed AND {fine}, false) AS kept FROM measured m LEFT JOIN limits f ON m.lk = f.lk AND m.sk = f.sk)
    """
