"""Shards of near-equal bytes by a k-d tree over document metadata.

The tree splits a node at the weighted median (bytes) along its widest dimension
until every leaf is one shard's share. Dimensions are integers; ties along one are
broken by a hash of the document, so a value that a third of all rows share can
be split as well. Medians are found from histograms that Spark adds up: a first
pass over the leading bits of the split key, then passes inside the bin that holds
the median, until what is left undecided is a small part of a shard. All nodes of
a level share each pass. The driver sees only bins and the spans of nodes, whose
numbers follow the number of shards.

Defined cases: a null text has no bytes (and size 1); a null dimension counts as
0; rows equal in everything stay together; a shard may be empty where there are
fewer documents than shards; other columns pass through untouched; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import clean_text, materialize, packed_rows, rank_in_groups

# At most so many leading bits of a value make a split key, and so many of the hash: 62 together.
VALUE_BITS = 32
HASH_BITS = 30
PASS_BITS = 12
# A split may be off by this part of the node's bytes, besides one document.
TOLERANCE = 1e-4


@dataclass
class Node:
    """A set of rows: the first shard it holds and how many."""

    first: int
    shards: int
    dimension: int = -1
    cut: int = -1


def _key(dimension: Column, tie: Column) -> Column:
    """Order along a dimension as one long: leading bits of its place in 0..2**32, then the hash."""
    return F.shiftleft(dimension, HASH_BITS).bitwiseOR(tie)


def _case(node_column: str, values: dict[int, Column], default: Column) -> Column:
    chosen = default
    for node, value in values.items():
        chosen = F.when(F.col(node_column) == node, value).otherwise(chosen)
    return chosen


def _medians(
    rows: DataFrame, nodes: dict[int, Node], keys: Sequence[str], key_bits: int
) -> dict[int, int]:
    """Per node the key from which rows go to its right half, at the byte share of its left shards."""
    key = _case("_node", {i: F.col(keys[n.dimension]) for i, n in nodes.items()}, F.lit(0).cast("bigint"))
    keyed = rows.where(F.col("_node").isin(list(nodes))).select("_node", "_size", key.alias("_key"))
    low = {i: 0 for i in nodes}
    width = key_bits
    wanted: dict[int, float] = {}
    total: dict[int, int] = {}
    done: dict[int, int] = {}
    while len(done) < len(nodes):
        width = max(0, width - PASS_BITS)
        left = {i: low[i] for i in nodes if i not in done}
        span = 1 << min(62, width + PASS_BITS)
        start = _case("_node", {i: F.lit(x).cast("bigint") for i, x in left.items()}, F.lit(0).cast("bigint"))
        inside = keyed.where(F.col("_node").isin(list(left))).withColumn("_from", F.col("_key") - start)
        if wanted:
            inside = inside.where((F.col("_from") >= 0) & (F.col("_from") < span))
        bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for r in (
            inside.groupBy("_node", F.shiftright("_from", width).alias("bin"))
            .agg(F.sum("_size").alias("size"))
            .collect()
        ):
            bins[r["_node"]].append((r["bin"], r["size"]))
        for i in left:
            found = sorted(bins[i])
            if i not in wanted:
                total[i] = sum(size for _, size in found)
                wanted[i] = total[i] * (nodes[i].shards // 2) / nodes[i].shards
            at, size = 0, 0
            for at, size in found:
                if wanted[i] - size < 0:
                    break
                wanted[i] -= size
            else:
                at, size = at + 1, 0
            low[i] += at << width
            if width == 0 or size <= TOLERANCE * total[i]:
                # Cut before the bin or after it, whichever is nearer.
                done[i] = low[i] + ((1 << width) if wanted[i] > size / 2 else 0)
    return done


def shards(
    docs: DataFrame,
    count: int,
    dimensions: dict[str, Column],
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> tuple[DataFrame, list[Node]]:
    """Every row as ``row`` with ``size``, ``text_crc32`` and ``shard``; and the tree's inner nodes.

    ``dimensions`` are non-negative integer columns over ``docs``.
    """
    body = clean_text(docs[text])
    names = list(dimensions)
    packed = packed_rows(
        docs,
        keep,
        size=(F.octet_length(body) + 1).cast("bigint"),
        text_crc32=F.crc32(body.cast("binary")).cast("bigint"),
        _tie=F.shiftrightunsigned(F.xxhash64(body, *dimensions.values()), 64 - HASH_BITS),
        **{f"_d{k}": F.coalesce(c, F.lit(0)).cast("bigint") for k, c in enumerate(dimensions.values())},
    )
    first = materialize(packed)
    extent = first.agg(*[F.max(f"_d{k}").alias(f"_d{k}") for k in range(len(names))]).first()
    keys = []
    bits = min(VALUE_BITS, max(int(x or 0) for x in extent).bit_length())
    rows = first.withColumnRenamed("size", "_size").withColumn("_node", F.lit(0))
    for k in range(len(names)):
        drop = max(0, int(extent[k] or 0).bit_length() - bits)
        rows = rows.withColumn(f"_k{k}", _key(F.shiftright(f"_d{k}", drop), F.col("_tie")))
        keys.append(f"_k{k}")
    nodes = {0: Node(0, count)}
    inner: list[Node] = []
    while any(n.shards > 1 for n in nodes.values()):
        parts = {i: n for i, n in nodes.items() if n.shards > 1}
        spans = (
            rows.where(F.col("_node").isin(list(parts)))
            .groupBy("_node")
            .agg(
                *[
                    (F.max(f"_d{k}") - F.min(f"_d{k}")).alias(f"_d{k}")
                    for k in range(len(names))
                ]
            )
            .collect()
        )
        for r in spans:
            wide = [(r[f"_d{k}"] or 0) / max(1, extent[k] or 1) for k in range(len(names))]
            parts[r["_node"]].dimension = wide.index(max(wide))
        cuts = _medians(rows, parts, keys, bits + HASH_BITS)
        children: dict[int, Node] = {}
        moved = F.col("_node")
        for i, n in nodes.items():
            if i not in parts:
                children[i] = n
                continue
            n.cut = cuts[i]
            inner.append(n)
            half = n.shards // 2
            left, right = 2 * i + 1, 2 * i + 2
            children[left] = Node(n.first, half)
            children[right] = Node(n.first + half, n.shards - half)
            goes_right = F.col(keys[n.dimension]) >= n.cut
            moved = F.when(
                F.col("_node") == i, F.when(goes_right, right).otherwise(left)
            ).otherwise(moved)
        rows = rows.withColumn("_node", moved)
        nodes = children
    shard = _case("_node", {i: F.lit(n.first) for i, n in nodes.items()}, F.lit(0))
    out = rows.select(
        "row", F.col("_size").alias("size"), "text_crc32", shard.cast("int").alias("shard")
    )
    return out, inner


def with_slots(sharded: DataFrame, order: Sequence[str]) -> DataFrame:
    """Append each row's place ``slot`` in its shard, gapless from 0."""
    return rank_in_groups(sharded, "shard", order, "slot")
