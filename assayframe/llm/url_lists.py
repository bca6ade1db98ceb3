"""URL filters against dated lists: every capture meets the entries in force when it was fetched.

A list is a log: a key, a time, an action (``block``, ``allow`` or ``remove``). Each
entry holds until the next one of its key, which turns the log into validity
intervals. A key is a host (it covers all hosts below it) or a host with leading
path segments. A capture looks up its host's suffixes and its path's prefixes; the
most specific key in force decides.

Intervals are cut at borders of fixed time buckets, so the join is an equality on
(key, bucket) with one comparison left. A key with a long history spreads over its
buckets; no task sorts a whole key. Suffixes such as ``com`` are looked up by much of
the corpus: look-ups are counted first, hot ones that the list lacks go no further,
and the others are dealt over slices beside copies of their intervals.

Defined cases: null and empty URLs and null times match nothing and get the
verdict ``none``; entries with null key, time or action are ignored; entries of
one key at one time: block before allow before remove; repeated captures get
equal verdicts; other columns pass through untouched; an empty list lets all
pass; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import HOT_SHARE, join_unique, materialize, packed_rows

BUCKET_SECONDS = 30 * 86_400
STRENGTH = {"remove": 0, "allow": 1, "block": 2}


def bare_url(url: Column) -> Column:
    """Host and path in lower-case host form: no scheme, user, port, query or fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.concat(F.regexp_replace(host, r"\.+$", ""), F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(.*)$", 1), "/+$", ""))


def _depth(key: Column) -> Column:
    """Path segments of a key."""
    return F.size(F.split(key, "/")) - 1


def url_keys(bare: Column, depths: list[int]) -> Column:
    """The keys that may cover a bare URL; paths of the listed depths only."""
    pieces = F.split(bare, "/")
    labels = F.split(pieces[0], r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    paths = [
        F.when(F.size(pieces) > d, F.array_join(F.slice(pieces, 1, d + 1), "/")) for d in depths if d > 0
    ]
    return F.array_distinct(F.array_compact(F.concat(hosts, F.array(*paths).cast("array<string>"))))


def validity(entries: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``key, strength, since, until`` per entry in force; ``until`` is null while it still holds."""
    strength = F.coalesce(*[F.when(F.col("action") == a, F.lit(s)) for a, s in STRENGTH.items()])
    log = (
        entries.where("key is not null and listed_at is not null")
        .select("key", F.col("listed_at").cast("bigint").alias("since"), strength.alias("strength"))
        .where("strength is not null")
        .groupBy("key", "since")
        .agg(F.max("strength").alias("strength"))
        .withColumn("bucket", F.floor(F.col("since") / bucket_seconds))
    )
    # The next entry is in the same bucket, or it is the first of the next bucket that has one.
    starts = log.groupBy("key", "bucket").agg(F.min("since").alias("first"))
    after = starts.select(
        "key", "bucket", F.lead("first").over(Window.partitionBy("key").orderBy("bucket")).alias("later")
    )
    near = F.lead("since").over(Window.partitionBy("key", "bucket").orderBy("since"))
    return (
        log.withColumn("near", near)
        .join(after, ["key", "bucket"])
        .select("key", "strength", "since", F.coalesce("near", "later").alias("until"))
        .where("strength > 0")
    )


def hot_cells(looked: DataFrame, cells: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """``key, bucket, slices`` of look-ups with more than one in ``share`` of all; 0 slices: not in the list.

    There are fewer than ``share`` such rows, a bound that does not grow with the data.
    """
    counts = looked.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    whole = F.lit(looked.count())
    hot = materialize(counts.where(F.col("n") * share > whole).coalesce(1))
    listed = cells.join(F.broadcast(hot.select("key", "bucket")), ["key", "bucket"], "left_semi")
    listed = listed.select("key", "bucket", F.lit(True).alias("listed")).distinct()
    slices = F.ceil(F.col("n") * share / whole).cast("int")
    return hot.join(listed, ["key", "bucket"], "left").select(
        "key", "bucket", F.when(F.col("listed"), slices).otherwise(0).alias("slices")
    )


def active_entries(looked: DataFrame, cells: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """Look-ups (``bare, at, key, bucket``) beside the intervals of their key in force then."""
    hot = F.broadcast(materialize(hot_cells(looked, cells, share)))
    dealt = (
        looked.join(hot, ["key", "bucket"], "left")
        .where("slices is null or slices > 0")
        .withColumn("slice", F.pmod(F.xxhash64("bare", "at"), F.coalesce("slices", F.lit(1))).cast("int"))
        .drop("slices")
    )
    copied = (
        cells.join(hot, ["key", "bucket"], "left")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
        .drop("slices")
    )
    return dealt.join(copied, ["key", "bucket", "slice"]).where("since <= at and (until is null or at < until)")


def filter_captures(
    captures: DataFrame,
    entries: DataFrame,
    url: str = "url",
    fetched_at: str = "fetched_at",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Every capture as ``row`` with ``verdict`` (block, allow, none), ``matched_key`` and ``listed_at``.

    ``entries`` has ``key`` (a bare URL), ``listed_at`` (seconds) and ``action``.
    """
    packed = packed_rows(
        captures, bare=bare_url(captures[url]), at=captures[fetched_at].cast("bigint")
    )
    known = F.col("bare").isNotNull() & F.col("at").isNotNull()
    asked = materialize(packed.where(known).groupBy("bare", "at").agg(F.count("*").alias("n")))
    span = asked.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    held = materialize(validity(entries, bucket_seconds))
    # Depths are small whole numbers: as many as the list's longest path has segments.
    depths = [r[0] for r in held.select(_depth(F.col("key")).alias("d")).distinct().orderBy("d").collect()]

    def bucket(c: Column) -> Column:
        return F.floor(c / bucket_seconds)

    first = F.greatest(F.col("since"), F.lit(low))
    last = F.least(F.coalesce(F.col("until") - 1, F.lit(high)), F.lit(high))
    cells = (
        held.withColumn("first", first)
        .withColumn("last", last)
        .where("first <= last")
        .select("*", F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("last")))).alias("bucket"))
    )
    looked = asked.select(
        "bare", "at", bucket(F.col("at")).alias("bucket"),
        F.explode(url_keys(F.col("bare"), depths)).alias("key"),
    )
    best = active_entries(looked, cells).groupBy("bare", "at").agg(
        F.max(
            F.struct(_depth(F.col("key")).alias("depth"), F.length("key").alias("size"), "key", "strength", "since")
        ).alias("best")
    )
    # One row per different capture, so that a capture repeated by a third of all rows is no hot join key.
    decided = materialize(asked.join(best, ["bare", "at"], "left"))
    answered = join_unique(packed.where(known), decided, ["bare", "at"], "n").unionByName(
        packed.where(~known).withColumn("best", F.lit(None).cast(decided.schema["best"].dataType))
    )
    return answered.select(
        "row",
        F.when(F.col("best.strength") == STRENGTH["block"], F.lit("block"))
        .when(F.col("best.strength") == STRENGTH["allow"], F.lit("allow"))
        .otherwise(F.lit("none"))
        .alias("verdict"),
        F.col("best.key").alias("matched_key"),
        F.col("best.since").alias("listed_at"),
    )


# -- a dated list and fetch times derived from the pages themselves, for the query ----------

YEAR = 365 * 86_400


def _draw(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def dated_pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", "url", (_draw(F.concat(F.lit("at"), F.col("page_id").cast("string"))) % YEAR).alias("fetched_at")
    )


def dated_list(pages: DataFrame) -> DataFrame:
    """Entries for hosts, their parent domains and first path segments, several times over a year."""
    bare = pages.select(bare_url(F.col("url")).alias("bare")).where("bare is not null")
    keys = bare.select(
        F.explode(
            F.array(
                F.split("bare", "/")[0],
                F.regexp_replace(F.split("bare", "/")[0], r"^[^.]*\.", ""),
                F.array_join(F.slice(F.split("bare", "/"), 1, 2), "/"),
            )
        ).alias("key")
    ).distinct()
    d = _draw(F.col("key"))
    logged = keys.where(d % 3 > 0).select(
        "key", F.explode(F.sequence(F.lit(0), (d % 7).cast("int"))).alias("k")
    )
    e = _draw(F.concat("key", F.lit("#"), F.col("k").cast("string")))
    return logged.select(
        "key",
        (e % YEAR).alias("listed_at"),
        F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), (F.expr("k % 3") + 1).cast("int")).alias("action"),
    )


def oracle(pages: str = "pages") -> str:
    """The same verdicts in DuckDB SQL."""

    def draw(x: str) -> str:
        return f"CAST(('0x' || substr(sha256({x}), 1, 8)) AS BIGINT)"

    rest = r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '[?#].*$', '')"
    host = rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^([^/]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')"
    path = f"regexp_replace(regexp_extract({rest}, '^[^/]*(.*)$', 1), '/+$', '')"
    return rf"""
    WITH cap AS (SELECT page_id, url, {host} || {path} AS bare, {draw("'at' || CAST(page_id AS VARCHAR)")} % {YEAR} AS fetched_at FROM {pages}),
    ks AS (SELECT DISTINCT unnest([string_split(bare, '/')[1], regexp_replace(string_split(bare, '/')[1], '^[^.]*\.', ''),
        array_to_string(string_split(bare, '/')[1:2], '/')]) AS key FROM cap WHERE bare IS NOT NULL),
    kk AS (SELECT key, unnest(range(0, {draw('key')} % 7 + 1)) AS k FROM ks WHERE {draw('key')} % 3 > 0),
    lg AS (SELECT key, {draw("key || '#' || CAST(k AS VARCHAR)")} % {YEAR} AS since, CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS strength FROM kk),
    lm AS (SELECT key, since, max(strength) AS strength FROM lg GROUP BY ALL),
    iv AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM lm),
    ck AS (SELECT DISTINCT page_id, url, bare, fetched_at, unnest(list_distinct(list_concat(
        list_transform(range(1, len(string_split(string_split(bare, '/')[1], '.')) + 1), lambda i: array_to_string(string_split(string_split(bare, '/')[1], '.')[i:], '.')),
        list_transform(range(2, len(string_split(bare, '/')) + 1), lambda i: array_to_string(string_split(bare, '/')[1:i], '/'))))) AS key FROM cap),
    hit AS (SELECT c.page_id, c.url, c.fetched_at, i.key, i.since, i.strength, row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched_at
        ORDER BY len(string_split(i.key, '/')) DESC, length(i.key) DESC, i.key DESC) AS r
        FROM ck c JOIN iv i ON c.key = i.key AND i.since <= c.fetched_at AND (i.until IS NULL OR c.fetched_at < i.until) WHERE i.strength > 0)
    SELECT c.page_id, c.url, c.fetched_at, CASE h.strength WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict,
      h.key AS matched_key, h.since AS listed_at, coalesce(h.strength, 0) <> 2 AS kept
    FROM cap c LEFT JOIN hit h ON c.page_id = h.page_id AND c.url = h.url AND c.fetched_at = h.fetched_at AND h.r = 1
    """
