"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A text's lines are its paragraphs; a paragraph's sentences (and stretches of 120
characters where no sentence ends) are the leaves. A paragraph whose digest starts
with 0 to 3 closes a section, so section borders follow content and an edit moves
none but its own. Every node is the SHA-256 of its children's digests, written out
in hexadecimal; the root tells whether two texts are equal.

A fingerprint is the root, then the codes (leading digits) of sections,
paragraphs and leaves: enough to say how alike two texts are without the texts.
Where two texts differ is found by going down from differing roots. ``with_edit`` needs
only the fingerprints: it passes equal sections at both ends, then equal paragraphs of the
first and the last section that differ, and names the paragraphs between. ``changes`` needs
the texts and tells every paragraph's fate: sections that both have are paired, then
paragraphs of the others, one to one.

Trees, fingerprints and ``with_edit`` are column functions; the pairing of ``changes`` is a
Python function. A text is one row and never leaves it.

Codes have 32 bits. Likeness compares sets of leaf codes: repeats count once, and of n
leaves that differ some n / 2^32 meet an equal code.

Defined cases: a null text is the empty text, which has one empty paragraph and no
leaf; two texts without leaves are alike (1), one without is unlike (0); repeated
rows get equal results; documents of one id follow each other by a hash of their
text; null ids come first; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import clean_text, materialize, packed_rows
from assayframe.operators.ordering import with_global_rank

LEAF = r"[^.!?]{0,120}[.!?]+|[^.!?]{1,120}"
ROOT_DIGITS = 32
NODE_DIGITS = 8
LEAF_DIGITS = 8


def _sha(c: Column) -> Column:
    return F.sha2(c, 256)


def paragraph_leaves(text: Column) -> Column:
    """Per paragraph the digests of its leaves."""
    return F.transform(
        F.split(text, "\n"),
        lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), 0), _sha),
    )


def with_tree(df: DataFrame, text: Column, prefix: str) -> DataFrame:
    """Append ``<prefix>leaves`` (per paragraph), ``paragraphs``, ``sections`` (digests) and ``root``."""
    leaves, paragraphs, sections = (prefix + n for n in ("leaves", "paragraphs", "sections"))
    joined = F.array_join(
        F.transform(
            F.col(paragraphs), lambda h: F.when(F.substring(h, 1, 1) < "4", F.concat(h, F.lit("/"))).otherwise(h)
        ),
        "",
    )
    return (
        df.withColumn(leaves, paragraph_leaves(text))
        .withColumn(paragraphs, F.transform(leaves, lambda x: _sha(F.array_join(x, ""))))
        .withColumn(
            sections, F.transform(F.array_remove(F.split(joined, "/"), ""), _sha)
        )
        .withColumn(prefix + "root", _sha(F.array_join(sections, "")))
    )


def _codes(digests: Column, digits: int) -> Column:
    return F.transform(digests, lambda h: F.substring(h, 1, digits))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Append the fingerprint string as ``name`` and its set of leaf codes as ``<name>_leaves``."""
    tree = with_tree(df, text, "_t_").withColumn(
        "_t_codes", _codes(F.flatten("_t_leaves"), LEAF_DIGITS)
    )
    return (
        tree.withColumn(
            name,
            F.concat_ws(
                "|",
                F.substring("_t_root", 1, ROOT_DIGITS),
                F.array_join(_codes(F.col("_t_sections"), NODE_DIGITS), ","),
                F.array_join(_codes(F.col("_t_paragraphs"), NODE_DIGITS), ","),
                F.array_join("_t_codes", ","),
            ),
        )
        .withColumn(name + "_leaves", F.array_distinct("_t_codes"))
        .drop("_t_leaves", "_t_paragraphs", "_t_sections", "_t_root", "_t_codes")
    )


def leaf_codes(fingerprint: Column) -> Column:
    """The set of leaf codes that a fingerprint holds."""
    return F.array_distinct(F.array_remove(F.split(F.split(fingerprint, r"\|")[3], ","), ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared leaves of two leaf-code sets, 0 to 1 (Dice)."""
    whole = F.size(a) + F.size(b)
    return F.when(whole == 0, F.lit(1.0)).otherwise(
        2.0 * F.size(F.array_intersect(a, b)) / whole
    )


def _leading(a: Column, b: Column) -> Column:
    """How many members two arrays have in common from the start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def _rest(nodes: Column, start: Column) -> Column:
    return F.slice(nodes, start + 1, F.greatest(F.size(nodes) - start, F.lit(0)))


def _head(nodes: Column, n: Column) -> Column:
    return F.slice(nodes, F.lit(1), F.greatest(n, F.lit(0)))


def with_edit(df: DataFrame, old: str, new: str) -> DataFrame:
    """Append ``edited_from`` and ``edited_to``: the paragraphs of ``new`` (from 0, end excluded) that differ.

    ``old`` and ``new`` name fingerprints. Paragraphs before and after that stretch are
    those of ``old``, by their codes; an empty stretch is a place where ``old`` had more.
    Both are null where the roots are equal.
    """
    parts = {"_os": (old, 1), "_ns": (new, 1), "_op": (old, 2), "_np": (new, 2)}
    nodes = df.withColumns({name: F.split(F.split(fp, r"\|")[at], ",") for name, (fp, at) in parts.items()})
    # Where each section that a paragraph closes ends.
    ends = F.filter(F.transform("_op", lambda h, i: F.when(F.substring(h, 1, 1) < "4", i + 1)), lambda e: e.isNotNull())
    alike = nodes.withColumns(
        {"_ends": ends, "_ahead": _leading(F.col("_os"), F.col("_ns")), "_behind": _leading(F.reverse("_os"), F.reverse("_ns"))}
    )

    def end_of(sections: Column) -> Column:
        inside = F.coalesce(F.get("_ends", sections - 1), F.size("_op"))
        return F.when(sections <= 0, F.lit(0)).otherwise(inside)

    down = alike.withColumns(
        {"_skip": end_of(F.col("_ahead")), "_tail": F.size("_op") - end_of(F.size("_os") - F.col("_behind"))}
    )
    n_old, n_new, skip, tail = F.size("_op"), F.size("_np"), F.col("_skip"), F.col("_tail")
    leading = skip + _leading(_rest(F.col("_op"), skip), _rest(F.col("_np"), skip))
    trailing = tail + _leading(F.reverse(_head(F.col("_op"), n_old - tail)), F.reverse(_head(F.col("_np"), n_new - tail)))
    differ = F.substring(old, 1, ROOT_DIGITS) != F.substring(new, 1, ROOT_DIGITS)
    found = down.withColumns({"_lead": leading, "_trail": trailing})
    kept = F.least(F.col("_trail"), F.least(n_old, n_new) - F.col("_lead"))
    return found.withColumns(
        {"edited_from": F.when(differ, F.col("_lead")), "edited_to": F.when(differ, n_new - kept)}
    ).drop(*parts, "_ends", "_ahead", "_behind", "_skip", "_tail", "_lead", "_trail")


def _ranges(paragraphs: list[str]) -> list[tuple[int, int]]:
    """First and end of every section."""
    ends = [i + 1 for i, h in enumerate(paragraphs) if h < "4"]
    if paragraphs and (not ends or ends[-1] < len(paragraphs)):
        ends.append(len(paragraphs))
    return list(zip([0, *ends], ends))


def _same_ends(a: list[str], b: list[str]) -> tuple[int, int]:
    """How many nodes agree from the start, and then from the end."""
    short = min(len(a), len(b))
    start = next((i for i in range(short) if a[i] != b[i]), short)
    short -= start
    return start, next((i for i in range(short) if a[-1 - i] != b[-1 - i]), short)


def _met(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """Places of equal nodes: the first of a digest with the first, the second with the second."""
    places = defaultdict(deque)
    for digest, j in b:
        places[digest].append(j)
    return [(i, places[digest].popleft()) for digest, i in a if places[digest]]


def _in_order(places: list[int]) -> set[int]:
    """The members of a longest rising run (not of neighbours only)."""
    tops: list[int] = []
    before: dict[int, int | None] = {}
    for x in places:
        at = bisect_left(tops, x)
        before[x] = tops[at - 1] if at else None
        tops[at : at + 1] = [x]
    kept, x = set(), tops[-1] if tops else None
    while x is not None:
        kept.add(x)
        x = before[x]
    return kept


def compared(old: list[str], new: list[str], old_sections: list[str], new_sections: list[str]) -> list[dict]:
    """What became of every paragraph that is not in place, by the digests of two trees.

    Sections that both trees have are paired first and not looked into; what is left
    is paired by paragraphs. Equal nodes pair one to one, so counts matter.
    """
    a, b = _ranges(old), _ranges(new)
    start, end = _same_ends(old_sections, new_sections)
    pairs = [(i, i) for i in range(a[start - 1][1])] if start else []
    left = [list(enumerate(x))[start : len(x) - end] for x in (old_sections, new_sections)]
    tail = a[len(a) - end :], b[len(b) - end :]
    sections = _met(*([(h, k) for k, h in x] for x in left))
    for (i, i_end), (j, _) in [*zip(*tail), *((a[k], b[m]) for k, m in sections)]:
        pairs += [(i + n, j + n) for n in range(i_end - i)]
    seen = {i for i, _ in pairs}, {j for _, j in pairs}
    rest = [[(h, i) for i, h in enumerate(x) if i not in s] for x, s in zip((old, new), seen)]
    start, end = _same_ends(*([h for h, _ in x] for x in rest))
    pairs += [(x[1], y[1]) for x, y in zip(rest[0][:start], rest[1][:start])]
    pairs += [(x[1], y[1]) for x, y in zip(rest[0][len(rest[0]) - end :], rest[1][len(rest[1]) - end :])]
    pairs += _met(*(x[start : len(x) - end] for x in rest))
    pairs.sort()
    still = _in_order([j for _, j in pairs])
    found = [{"change": "moved", "old_paragraph": i, "new_paragraph": j} for i, j in pairs if j not in still]
    seen = {i for i, _ in pairs}, {j for _, j in pairs}
    found += [{"change": "removed", "old_paragraph": i, "new_paragraph": None} for i in range(len(old)) if i not in seen[0]]
    found += [{"change": "added", "old_paragraph": None, "new_paragraph": j} for j in range(len(new)) if j not in seen[1]]
    return found


_CHANGES = "array<struct<change: string, old_paragraph: int, new_paragraph: int>>"


def changes(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Where two texts differ: ``row`` (the input), ``change``, ``old_paragraph``, ``new_paragraph``, ``text``.

    A paragraph is ``removed`` (its place in ``old`` only), ``added`` (in ``new`` only)
    or ``moved`` (both; as few as the pairing allows); places count from 0. Without
    these paragraphs both texts are the same sequence. Pairs with equal roots give no
    row.
    """

    @F.arrow_udf(_CHANGES)
    def compare(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        kind = pa.struct([("change", pa.string()), ("old_paragraph", pa.int32()), ("new_paragraph", pa.int32())])
        found = [compared(*x) for x in zip(*(y.to_pylist() for y in (a, b, c, d)))]
        return pa.array(found, pa.list_(kind))

    packed = packed_rows(pairs, _old=clean_text(pairs[old]), _new=clean_text(pairs[new]))
    trees = with_tree(with_tree(packed, F.col("_old"), "_a_"), F.col("_new"), "_b_")
    differing = trees.where("_a_root <> _b_root").select(
        "row", "_old", "_new", compare("_a_paragraphs", "_b_paragraphs", "_a_sections", "_b_sections").alias("_found")
    )
    each = differing.select(
        "row", F.split("_old", "\n").alias("_old"), F.split("_new", "\n").alias("_new"), F.explode("_found").alias("_c")
    )
    return each.select(
        "row",
        "_c.*",
        F.coalesce(F.get("_old", F.col("_c.old_paragraph")), F.get("_new", F.col("_c.new_paragraph"))).alias("text"),
    )


def edits(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """The new side of ``changes``: ``row``, ``paragraph`` (from 0) and ``text`` of what was added or moved."""
    return changes(pairs, old, new).where("new_paragraph is not null").select(
        "row", F.col("new_paragraph").alias("paragraph"), "text"
    )


def neighbours(keyed: DataFrame) -> DataFrame:
    """Who follows whom by ascending id: ``doc_id, h`` of each document, and of the one before it.

    ``keyed`` holds distinct ``doc_id, h, n_chars``. Ranks come from a sort over all
    tasks; after the last document comes the first. ``need`` is how many characters
    the document before takes from this one.
    """
    ranked = materialize(
        with_global_rank(keyed, [F.col("doc_id").asc_nulls_first(), F.col("h")], "rank")
    )
    total = max(1, ranked.count())
    before = ranked.select(
        F.col("doc_id").alias("before_id"),
        F.col("h").alias("before_h"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("need"),
        (F.pmod("rank", F.lit(total)) + 1).alias("rank"),
    )
    return ranked.join(before, "rank").select("doc_id", "h", "before_id", "before_h", "need")


def half_edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprint every document and its edited text: its last half replaced by the next one's start.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edited_from, edited_to``, one row per row; the last two are
    the paragraphs of the edited text that differ (``with_edit``). Texts are shuffled once, to meet
    their place in the order; from there only the characters that the document
    before needs move on.
    """
    keyed = docs.select(docs[doc_id].alias("doc_id"), clean_text(docs[text]).alias("body")).select(
        "doc_id", "body", F.xxhash64("body").alias("h")
    )
    narrow = materialize(
        keyed.groupBy("doc_id", "h", F.length("body").cast("bigint").alias("n_chars")).agg(
            F.count("*").alias("rows")
        )
    )
    repeated = not narrow.where("rows > 1").isEmpty()
    order = materialize(neighbours(narrow.drop("rows")))
    order = order.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    placed = keyed.join(
        order, keyed["doc_id"].eqNullSafe(order["_id"]) & (keyed["h"] == order["_h"])
    ).drop("_id", "_h")
    given = with_fingerprint(placed, F.col("body"), "next_fp").select(
        "before_id", "before_h", F.expr("substring(body, 1, need)").alias("start"), "next_fp_leaves"
    )
    if repeated:
        given = given.dropDuplicates(["before_id", "before_h"])
    # Both uses of ``placed`` read the same columns, so that Spark shuffles the texts once.
    own = with_fingerprint(
        placed.select("doc_id", "h", "body", F.length("body").cast("bigint").alias("n_chars")),
        F.col("body"), "fingerprint",
    )
    both = own.join(
        given, own["doc_id"].eqNullSafe(given["before_id"]) & (own["h"] == given["before_h"])
    ).withColumn(
        "edited", F.expr("concat(substring(body, 1, cast(n_chars - n_chars div 2 as int)), start)")
    )
    printed = with_fingerprint(both, F.col("edited"), "edited_fingerprint")
    return with_edit(printed, "fingerprint", "edited_fingerprint").select(
        "doc_id",
        "n_chars",
        _sha(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint_leaves"), F.col("edited_fingerprint_leaves")).alias("near_edited"),
        likeness(F.col("fingerprint_leaves"), F.col("next_fp_leaves")).alias("near_next"),
        "edited_from",
        "edited_to",
    )


def oracle(documents: str = "documents") -> str:
    """The same rows in DuckDB SQL."""

    def tree(t: str, p: str) -> str:
        return f"""
        {p}_l AS (SELECT *, list_transform(string_split({t}, chr(10)),
            lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: sha256(x))) AS {p}l FROM {p}_in),
        {p}_p AS (SELECT *, list_transform({p}l, lambda x: sha256(array_to_string(x, ''))) AS {p}p FROM {p}_l),
        {p}_s AS (SELECT *, list_transform(list_filter(string_split(array_to_string(list_transform({p}p,
            lambda h: CASE WHEN h[1] < '4' THEN h || '/' ELSE h END), ''), '/'), lambda x: x <> ''), lambda x: sha256(x)) AS {p}s FROM {p}_p),
        {p}_f AS (SELECT *, list_transform(flatten({p}l), lambda x: x[1:{LEAF_DIGITS}]) AS {p}c,
            substr(sha256(array_to_string({p}s, '')), 1, {ROOT_DIGITS}) || '|' ||
            array_to_string(list_transform({p}s, lambda x: x[1:{NODE_DIGITS}]), ',') || '|' ||
            array_to_string(list_transform({p}p, lambda x: x[1:{NODE_DIGITS}]), ',') || '|' ||
            array_to_string(list_transform(flatten({p}l), lambda x: x[1:{LEAF_DIGITS}]), ',') AS {p}fp FROM {p}_s)"""

    def near(a: str, b: str) -> str:
        whole = f"(len(list_distinct({a})) + len(list_distinct({b})))"
        return (
            f"CASE WHEN {whole} = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(list_distinct({a}), list_distinct({b})))"
            f" / {whole} END"
        )

    def leading(a: str, b: str) -> str:
        same = f"list_transform(list_zip({a}, {b}), lambda x: x[1] IS NOT DISTINCT FROM x[2])"
        return f"(coalesce(nullif(list_position({same}, false), 0), len({same}) + 1) - 1)"

    def codes(p: str) -> str:
        return f"list_transform({p}, lambda x: x[1:{NODE_DIGITS}])"

    return f"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM {documents}),
    o_in AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM base),
    {tree('t', 'o')},
    e_in AS (SELECT *, coalesce(lead(oc) OVER (ORDER BY doc_id), first_value(oc) OVER (ORDER BY doc_id)) AS nc,
        left(t, n - n // 2) || left(nt, n // 2) AS edited FROM o_f),
    {tree('edited', 'e')},
    d AS (SELECT *, {leading(codes('op'), codes('ep'))} AS ahead,
        {leading(f"list_reverse({codes('op')})", f"list_reverse({codes('ep')})")} AS behind FROM e_f)
    SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, ofp AS fingerprint, efp AS edited_fingerprint,
      CAST({near('oc', 'ec')} AS DOUBLE) AS near_edited, CAST({near('oc', 'nc')} AS DOUBLE) AS near_next,
      CASE WHEN left(ofp, {ROOT_DIGITS}) <> left(efp, {ROOT_DIGITS}) THEN CAST(ahead AS INTEGER) END AS edited_from,
      CASE WHEN left(ofp, {ROOT_DIGITS}) <> left(efp, {ROOT_DIGITS})
        THEN CAST(len(ep) - least(behind, least(len(op), len(ep)) - ahead) AS INTEGER) END AS edited_to FROM d
    """
