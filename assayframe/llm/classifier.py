"""Quality classifier: random-indexing word vectors, pooled, under a small calibrated network.

Every token has two names: its form (letters in lower case, as a 64-bit hash) and its
shape (kind of characters, case, length, whether it repeats the token before; 128
shapes in all). Each name owns a sparse index vector of +1 and -1, drawn from its
hash. A name's word vector is the direction of the sum of the index vectors around
its every occurrence in the corpus; sums of whole numbers, so they are the same in
any order. Every name has its own vector, however many there are.

Tokens are runs of letters, of digits or of marks by Unicode's categories. In scripts
that are written without spaces every base character is a token.

A document is the mean of its forms' vectors beside the mean of its shapes' vectors.
Texts are read once: documents are cut in portions, and a portion sends the sums of
its contexts, packed and by ranges of names, to one task per range. That task adds
the sums of all portions and answers every portion with the vectors of the names it
sent, in the order it sent them. The answers meet the portion's own counts of
(document, name) in one task per portion. No text is shuffled: a pooled vector finds
its rows by two hashes of the text. Ranges of names are as many as the corpus has
``RANGE_BYTES``, so that a task's share does not grow with it. A portion holds at
most ``PORTION_BYTES`` of text, or one longer text.

A two-layer network in numpy turns the means into a logit, and a temperature fitted on
rows the network has not seen turns the logit into a probability. The network is
fitted on at most ``FIT_ROWS`` labelled documents, those of least hash; word vectors
come from all documents.

Defined cases: null and empty texts pool to zero vectors and are scored like any
other; a form that the corpus lacks counts as a zero vector; labels without a
document, null labels and null ids are ignored, an id labelled twice counts by its
lowest label and one with several texts by the text of least hash; with no labels, or
labels of one kind, every score is the smoothed share of label 1; other columns pass
through untouched; an empty table gives an empty table. The documents must read the
same twice (files, or a checkpoint).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import join_unique, materialize, once_per_worker, packed_rows

SHAPES = 1 << 7
DIMENSIONS = 24
ONES = 2
REACH = 2
FIT_ROWS = 20_000
HIDDEN = 32
EPOCHS = 40
BATCH = 128
RATE = 2e-3
DECAY = 1e-4
THRESHOLD = 0.7
SLICE_CHARS = 1 << 20
TOKENS_AT_ONCE = 1 << 18
BYTES_AT_ONCE = 4 << 20
# A portion of documents ends at so many bytes or rows; its row numbers are 16 bits.
PORTION_BYTES = 12 << 20
PORTION_ROWS = 1 << 16
# The names of so much text go to one range.
RANGE_BYTES = 16 << 20
# Directions have so many steps to either side of zero in every dimension.
STEPS = 7
# Unit vectors are whole numbers of this part, so that sums are exact.
UNIT = 1 << 14

BLANK, SMALL, CAPITAL, DIGIT, MARK, SINGLE, SINGLE_BASE = range(7)
# Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = (
    (0x0E01, 0x0EDF), (0x1000, 0x109F), (0x1780, 0x17D3), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x30FF),
    (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF),
)
LAST_NAMED = 0x323B0


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of every character."""
    kinds = np.full(0x110000, SMALL, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(LAST_NAMED):
        category = unicodedata.category(chr(c))
        if category[0] == "Z" or c in (0, 9, 10, 11, 12, 13):
            kinds[c] = BLANK
        elif category in ("Lu", "Lt"):
            kinds[c] = CAPITAL
        elif category[0] == "N":
            kinds[c] = DIGIT
        elif category[0] in "PS" or category == "Cc":
            kinds[c] = MARK
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    for first, last in UNSPACED:
        for c in range(first, last + 1):
            if kinds[c] == SMALL:
                kinds[c] = SINGLE_BASE if unicodedata.category(chr(c))[0] == "L" else SINGLE
    return kinds, lower


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every number."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def index_vectors(names: np.ndarray) -> np.ndarray:
    """The sparse index vector of every 64-bit name: ``ONES`` different places, half of them -1."""
    draw = _mixed(names)
    table = np.zeros((len(names), DIMENSIONS), np.int8)
    rows = np.arange(len(names))
    taken = np.empty((len(names), 0), np.int64)
    for k in range(ONES):
        at = (draw >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) % (DIMENSIONS - k)
        for earlier in np.sort(taken, axis=1).T:
            at += at >= earlier
        taken = np.column_stack((taken, at))
        table[rows, at] = 1 if k < ONES // 2 else -1
    return table


def shape_names(shapes: np.ndarray) -> np.ndarray:
    """The names of shapes, hashed apart from those of forms."""
    return _mixed(shapes.astype(np.uint64) + np.uint64(1 << 63))


class Tokens:
    """Cuts texts into forms and shapes, many texts at once."""

    def __init__(self) -> None:
        self.kinds, self.lower = once_per_worker("classifier-characters", _characters)

    def _slice(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, form hash and shape of every token of one slice."""
        kind = self.kinds[data]
        letters = np.where(kind == CAPITAL, SMALL, np.where(kind == SINGLE_BASE, SINGLE, kind))
        change = np.flatnonzero((letters[1:] != letters[:-1]) | (kind[1:] == SINGLE_BASE)) + 1
        edges = np.concatenate(([0], change, [len(data)]))
        full = letters[edges[:-1]] != BLANK
        starts, sizes = edges[:-1][full], np.diff(edges)[full]
        if not len(starts):
            none = np.empty(0, np.int64)
            return none, none.astype(np.uint64), none.astype(np.uint8)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        at = place + np.repeat(starts, sizes)
        # Every place hashes its own way, so the sum knows the order.
        spelled = _mixed(self.lower[data[at]].astype(np.uint64) | place.astype(np.uint64) << np.uint64(21))
        form = np.add.reduceat(spelled, first)
        capitals = np.add.reduceat((kind[at] == CAPITAL).astype(np.int64), first)
        own = letters[starts]
        case = np.where(capitals == 0, 0, np.where(capitals == sizes, 2, 1))
        length = np.minimum(np.log2(sizes).astype(np.int64), 3)
        words = np.where(own == DIGIT, 12 + length, case * 4 + length)
        # Marks are told apart: 16 sets of marks by 2 lengths.
        marks = 16 + (data[starts] & 15).astype(np.int64) * 2 + (sizes > 1)
        return starts, form, np.where(own == MARK, marks, words).astype(np.uint8)

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Form hash, shape and text number of every token."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        joined = "\n".join(plain)
        first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        forms, shapes, owner = [], [], []
        at = 0
        while at < len(joined):
            end = min(at + SLICE_CHARS, len(joined))
            if end < len(joined):
                back = max(joined.rfind(" ", at, end), joined.rfind("\n", at, end))
                if back > at:
                    end = back + 1
                else:
                    ahead = [x for x in (joined.find(" ", end), joined.find("\n", end)) if x >= 0]
                    end = min(ahead, default=len(joined) - 1) + 1
            starts, form, shape = self._slice(np.frombuffer(joined[at:end].encode("utf-32-le"), "<u4"))
            forms.append(form)
            shapes.append(shape)
            owner.append(np.searchsorted(first, starts + at, "right") - 1)
            at = end
        if not forms:
            none = np.empty(0, np.int64)
            return none.astype(np.uint64), none, none
        form, shape, own = np.concatenate(forms), np.concatenate(shapes), np.concatenate(owner)
        same = np.zeros(len(form), np.int64)
        same[1:] = (form[1:] == form[:-1]) & (own[1:] == own[:-1])
        return form, shape.astype(np.int64) + 64 * same, own


def _portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """First and end of portions of some megabytes, or of one longer text, to bound memory."""
    first = size = 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > BYTES_AT_ONCE:
            yield first, k
            first, size = k, 0
        size += len(text)
    if len(texts) > first:
        yield first, len(texts)


def _binary(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), F.lit(b""))


def _hashes(body: Column) -> dict[str, Column]:
    return {"h1": F.xxhash64(body), "h2": F.xxhash64(F.lit(1), body)}


def _runs(ranked: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.concatenate(([0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1))[: len(ranked)]


# -- numbers in few bytes -------------------------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    """The bytes of whole numbers, low bytes first and high ones last, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes, kind: str, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data, decompressed_size=size * count, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(size, count)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_signed(x: np.ndarray) -> bytes:
    """Signed 32-bit numbers, small ones of either sign in few bytes."""
    return _pack((x << 1 ^ x >> 31).astype("<i4").view("<u4"))


def _unpack_signed(data: bytes, count: int) -> np.ndarray:
    x = _unpack(data, "<u4", count)
    return (x >> 1).astype(np.int32) ^ -(x & 1).astype(np.int32)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=x[:1] * 0).astype("<u8"))


def _unpack_sorted(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8", count), dtype=np.uint64)


# -- portions, ranges and back --------------------------------------------------------------

_DOC = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("tokens", "<i8")])
# Rows between the stages. ``part``: the range of names, or below 0 for what only the portion itself needs.
_SENT = pa.schema(
    [("part", pa.int64()), ("portion", pa.int64()), ("n", pa.int64())]
    + [(c, pa.binary()) for c in ("names", "sums", "docs", "places", "counts")]
)
_SENT_DDL = (
    "part bigint, portion bigint, n bigint, names binary, sums binary, docs binary, places binary, counts binary"
)


def _contexts(which: np.ndarray, kind: np.ndarray, owner: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The sum of index vectors around every name: ``which`` and ``kind`` number each token's two names."""
    total = np.zeros((len(index), DIMENSIONS), np.int32)
    for at in range(0, len(which), TOKENS_AT_ONCE):
        # A halo on both sides, so that slices do not show.
        x, y = max(0, at - REACH), min(len(which), at + TOKENS_AT_ONCE + REACH)
        own = owner[x:y]
        named = index[which[x:y]] + index[kind[x:y]]
        around = np.zeros_like(named)
        for step in range(1, REACH + 1):
            near = (own[step:] == own[:-step])[:, None]
            around[step:] += named[:-step] * near
            around[:-step] += named[step:] * near
        inner = slice(at - x, min(at + TOKENS_AT_ONCE, len(which)) - x)
        for names in (which, kind):
            order = np.argsort(names[x:y][inner], kind="stable")
            ranked = names[x:y][inner][order]
            cuts = _runs(ranked)
            total[ranked[cuts]] += np.add.reduceat(around[inner][order], cuts, axis=0, dtype=np.int32)
    return total


def _counted(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of name and document, as one number each, and how often they occur."""
    pair = names.astype(np.int64)
    pair <<= 16
    pair |= owner
    pair.sort()
    cuts = _runs(pair)
    return pair[cuts], np.diff(np.append(cuts, len(pair)))


def _by_size(size: np.ndarray) -> np.ndarray:
    """The turn of every name when those of most documents come first."""
    turn = np.empty(len(size), np.int64)
    turn[np.argsort(-size, kind="stable")] = np.arange(len(size))
    return turn


def _told(ranges: int, learn: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per portion one row of its documents and counts, and a row of names (and sums) per range."""

    def rows(nth: int, docs: list[np.ndarray], tokens: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        about = np.concatenate(docs)
        form, shape, owner = (np.concatenate(part) for part in zip(*tokens))
        tokens.clear()
        forms, which = np.unique(form, return_inverse=True)
        which = which.astype(np.int32)
        used, kind = np.unique(shape, return_inverse=True)
        del form, shape
        names = np.concatenate((forms, shape_names(used)))
        order = np.argsort(names, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        names, which, kind = names[order], rank[which], rank[len(forms) + kind]
        sums = _contexts(which, kind, owner, index_vectors(names)) if learn else None
        pair, n = _counted(which, owner)
        del which
        pair, n = (np.concatenate(part) for part in zip((pair, n), _counted(kind, owner)))
        del kind, owner
        size = np.bincount(pair >> 16, minlength=len(names))
        # Names of alike numbers of documents stand together, which packs best.
        by = np.argsort(_by_size(size)[pair >> 16] << 16 | pair & 0xFFFF)
        pair, n = pair[by], n[by]
        # Named by its place, so a task that runs again gives the same rows and no two portions meet.
        portion = TaskContext.get().partitionId() << 32 | nth
        places = size << 1 | (order >= len(forms))
        row = dict.fromkeys(_SENT.names)
        row |= {
            "part": -1 - portion, "portion": portion, "n": len(names), "docs": about.tobytes(),
            "places": _pack(places.astype("<u4")), "counts": _pack(n.astype("<u4")),
            "names": _pack(np.diff(pair & 0xFFFF, prepend=0).astype("<u2")),
            "sums": np.array([len(pair)], "<i8").tobytes(),
        }
        yield pa.RecordBatch.from_pylist([row], _SENT)
        part = range_of(names, ranges)
        cuts = np.append(_runs(part), len(part))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            row = dict.fromkeys(_SENT.names)
            row |= {"part": int(part[x]), "portion": portion, "n": int(y - x), "names": _pack_sorted(names[x:y])}
            if learn:
                row["sums"] = _pack_signed(sums[x:y].reshape(-1))
            yield pa.RecordBatch.from_pylist([row], _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Tokens()
        docs, tokens, size, count, nth = [], [], 0, 0, 0
        for batch in batches:
            h1, h2 = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
            bodies = batch.column(2).to_pylist()
            for x, y in _portions(bodies):
                texts = bodies[x:y]
                more = sum(map(len, texts))
                if docs and (count + len(texts) > PORTION_ROWS or size + more > PORTION_BYTES):
                    yield from rows(nth, docs, tokens)
                    docs, tokens, size, count, nth = [], [], 0, 0, nth + 1
                form, shape, owner = cutter.cut(texts)
                about = np.zeros(len(texts), _DOC)
                about["h1"], about["h2"] = h1[x:y], h2[x:y]
                about["tokens"] = np.bincount(owner, minlength=len(texts))
                docs.append(about)
                tokens.append((form, shape.astype(np.uint8), (owner + count).astype(np.int32)))
                size += more
                count += len(texts)
        if docs:
            yield from rows(nth, docs, tokens)

    return run


def range_of(names: np.ndarray, ranges: int) -> np.ndarray:
    """The range of every name, in the order of names."""
    return ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The different names of a range, their directions, and each sent name's place, with the rows' sizes."""
    sizes = table["n"].to_pylist()
    names = [_unpack_sorted(d, n) for d, n in zip(table["names"].to_pylist(), sizes, strict=True)]
    sums = [
        np.zeros((n, DIMENSIONS), np.int32) if d is None else _unpack_signed(d, n * DIMENSIONS).reshape(n, -1)
        for d, n in zip(table["sums"].to_pylist(), sizes, strict=True)
    ]
    names, sums = np.concatenate(names), np.concatenate(sums)
    order = np.argsort(names, kind="stable")
    cuts = _runs(names[order])
    total = np.add.reduceat(sums[order], cuts, axis=0, dtype=np.int64)
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(order))))
    peak = np.abs(total).max(axis=1, keepdims=True)
    direction = np.rint(total * (STEPS / np.maximum(peak, STEPS))).astype(np.int8)
    return names[order][cuts], direction, which, sizes


def _answered(table: pa.Table) -> pa.Table:
    """For every portion the directions of the names it sent; what a portion sent itself passes through."""
    if table["part"][0].as_py() < 0:
        return table
    _, direction, which, sizes = _added(table)
    ends = np.cumsum(sizes)
    rows = []
    for k, (portion, size) in enumerate(zip(table["portion"].to_pylist(), sizes, strict=True)):
        if portion is not None:
            found = direction[which[ends[k] - size : ends[k]]]
            row = dict.fromkeys(_SENT.names)
            row |= {"part": table["part"][0].as_py(), "portion": portion, "n": size, "sums": _pack(found.reshape(-1))}
            rows.append(row)
    return pa.Table.from_pylist(rows, _SENT)


def _kept(table: pa.Table) -> pa.Table:
    """The names of a range with their directions, as a row that asks for no answer."""
    if table["part"][0].as_py() < 0:
        return _SENT.empty_table()
    names, direction, _, _ = _added(table)
    row = dict.fromkeys(_SENT.names)
    row |= {
        "part": table["part"][0].as_py(), "n": len(names), "names": _pack_sorted(names),
        "sums": _pack_signed(direction.astype(np.int32).reshape(-1)),
    }
    return pa.Table.from_pylist([row], _SENT)


def units(direction: np.ndarray) -> np.ndarray:
    """Directions as unit vectors in parts of ``UNIT``; names without any context have none."""
    length = np.sqrt(np.square(direction.astype(np.int32)).sum(axis=1))
    return np.rint(direction * (UNIT / np.maximum(length, 1))[:, None]).astype(np.int32)


def _pooled(table: pa.Table) -> pa.Table:
    """The documents of a portion and their pooled vectors."""
    table = table.sort_by("part")
    own = {c: table[c][0].as_py() for c in _SENT.names}
    about = np.frombuffer(own["docs"], _DOC)
    places = _unpack(own["places"], "<u4", own["n"])
    count = int(np.frombuffer(own["sums"], "<i8")[0])
    doc = np.cumsum(_unpack(own["names"], "<u2", count), dtype=np.uint16).astype(np.int64)
    times = _unpack(own["counts"], "<u4", count).astype(np.int64)
    found = [_unpack(d, "i1", n * DIMENSIONS) for d, n in zip(table["sums"].to_pylist()[1:], table["n"].to_pylist()[1:], strict=True)]
    vectors = units(np.concatenate([np.empty(0, np.int8), *found]).reshape(-1, DIMENSIONS))
    size = (places >> 1).astype(np.int64)
    by = np.argsort(_by_size(size))
    name = np.repeat(by, size[by])
    order = np.argsort(doc * 2 + (places & 1)[name], kind="stable")
    total = np.zeros((2 * len(about), DIMENSIONS), np.int64)
    for k in range(0, len(order), TOKENS_AT_ONCE):
        part = order[k : k + TOKENS_AT_ONCE]
        row = doc[part] * 2 + (places & 1)[name[part]]
        cuts = _runs(row)
        total[row[cuts]] += np.add.reduceat(vectors[name[part]] * times[part, None], cuts, axis=0)
    x = total.reshape(len(about), -1) / UNIT / np.maximum(about["tokens"], 1)[:, None]
    ends = pa.py_buffer(np.arange(len(about) + 1, dtype=np.int32) * (2 * 2 * DIMENSIONS))
    flat = pa.Array.from_buffers(pa.binary(), len(about), [None, ends, pa.py_buffer(x.astype("<f2").tobytes())])
    return pa.table({"h1": about["h1"].copy(), "h2": about["h2"].copy(), "x": flat})


def opened(x: list[bytes]) -> np.ndarray:
    """Pooled vectors, one a row, from their bytes."""
    return np.frombuffer(b"".join(x), "<f2").reshape(-1, 2 * DIMENSIONS).astype(np.float64)


def ranges_for(docs: DataFrame, text: str = "text") -> int:
    """How many ranges of names suit these texts."""
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-size // RANGE_BYTES))


def _sent(docs: DataFrame, text: str, ranges: int, learn: bool) -> DataFrame:
    body = docs.select(_binary(docs[text]).alias("body"))
    return body.select(*[c.alias(n) for n, c in _hashes(F.col("body")).items()], "body").mapInArrow(
        _told(ranges, learn), _SENT_DDL
    )


def word_table(docs: DataFrame, text: str = "text", ranges: int | None = None) -> DataFrame:
    """The vectors of all names of ``docs``: a row per range, with its names and directions packed."""
    ranges = ranges or ranges_for(docs, text)
    return _sent(docs, text, ranges, learn=True).groupBy("part").applyInArrow(_kept, _SENT_DDL)


def word_vectors(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(name, vector)`` of every name of ``docs``; vectors are directions in whole numbers."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = _unpack_sorted(row["names"], row["n"]).view(np.int64)
                flat = pa.array(_unpack_signed(row["sums"], row["n"] * DIMENSIONS))
                vectors = pa.FixedSizeListArray.from_arrays(flat, DIMENSIONS).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(names), vectors], ["name", "vector"])

    return word_table(docs, text).mapInArrow(listed, "name bigint, vector array<int>")


def pooled(docs: DataFrame, text: str = "text", words: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """``(h1, h2, x, n)``: the pooled vector of every different text (see ``opened``) and its number of rows.

    Word vectors come from ``docs`` themselves, or from ``words``, a ``word_table``
    with as many ``ranges``.
    """
    sent = _sent(docs, text, ranges or ranges_for(docs, text), learn=words is None)
    if words is not None:
        sent = sent.unionByName(words)
    return (
        sent.groupBy("part")
        .applyInArrow(_answered, _SENT_DDL)
        .groupBy("portion")
        .applyInArrow(_pooled, "h1 bigint, h2 bigint, x binary")
        .groupBy("h1", "h2")
        .agg(F.min("x").alias("x"), F.count("*").alias("n"))
    )


@dataclass(frozen=True)
class Network:
    """Two layers over standardized pooled vectors, and the temperature of its logits."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on log loss over four fifths of the rows; temperature on the last fifth."""
    draw = np.random.default_rng(11)
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(y) < 10 or y.min() == y.max():
        width = x.shape[1]
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), prior)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    order = draw.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - mean) / spread
    w = [
        draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(prior),
    ]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        mixed = draw.permutation(used)
        for at in range(0, len(mixed), BATCH):
            rows = mixed[at : at + BATCH]
            a = np.tanh(z[rows] @ w[0] + w[1])
            error = (_sigmoid(a @ w[2] + w[3]) - y[rows]) / len(rows)
            back = np.outer(error, w[2]) * (1 - a * a)
            grads = [z[rows].T @ back, back.sum(axis=0), a.T @ error, error.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                move = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                w[k] = w[k] - RATE * (move + DECAY * w[k])
    net = Network(mean, spread, w[0], w[1], w[2], float(w[3]))
    logits, truth = net.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    losses = [
        -np.mean(np.log(np.clip(np.where(truth > 0, p, 1 - p), 1e-12, 1)))
        for p in (_sigmoid(logits / t) for t in grid)
    ]
    return Network(mean, spread, *w[:3], float(w[3]), float(grid[int(np.argmin(losses))]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must never be learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """The network, and what its corpus gave: pooled vectors of its texts, and where words are looked up."""

    network: Network
    texts: DataFrame
    corpus: DataFrame
    ranges: int


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = FIT_ROWS
) -> Model:
    """Word vectors from all of ``docs``; the network from at most ``rows`` labels that may be learned."""
    ranges = ranges_for(docs, text)
    texts = materialize(pooled(docs, text, ranges=ranges))
    chosen = materialize(
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .where(~held_out(F.col("doc_id")))
        .join(docs.select(docs[doc_id].alias("doc_id")).distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # At most ``rows`` pairs of numbers: a proven bound.
    hashed = docs.select(docs[doc_id].alias("doc_id"), F.struct(*[c.alias(n) for n, c in _hashes(_binary(docs[text])).items()]).alias("h"))
    known = (
        hashed.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min("h").alias("h"))
        .select("doc_id", "quality", "h.h1", "h.h2")
        .join(texts, ["h1", "h2"])
        .select("doc_id", "quality", "x")
        .collect()
    )
    known.sort(key=lambda r: r["doc_id"])
    x = opened([r["x"] for r in known])
    network = fit_network(x, np.array([r["quality"] for r in known], np.float64))
    return Model(network, texts, docs.select(docs[text].alias("text")), ranges)


def scored(
    docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None, of_corpus: bool = False
) -> DataFrame:
    """Every row as ``row`` (its columns ``keep``, all by default) with ``score``.

    ``of_corpus`` says that every text of ``docs`` is one of those the model was
    fitted on, whose pooled vectors it already holds. Other texts look up their words.
    """
    texts = model.texts if of_corpus else materialize(pooled(docs, text, word_table(model.corpus, "text", model.ranges), model.ranges))
    network = model.network

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(network.scores(opened(x.to_pylist())))

    return join_unique(
        packed_rows(docs, keep, **_hashes(_binary(docs[text]))),
        texts.select("h1", "h2", "n", score("x").alias("score")), ["h1", "h2"], "n",
    ).select("row", "score")


def keep_good(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", of_corpus: bool = False
) -> DataFrame:
    """The documents at or above the threshold, with their own columns only."""
    return scored(docs, model, text, of_corpus=of_corpus).where(F.col("score") >= threshold).select("row.*")
