"""Byte-level BPE with a rank queue over a hierarchical bitmap.

A pre-token's bytes form a linked list. Every adjacent pair that may merge lies in
the bucket of its merge rank; a two-level bitmap marks the buckets in use, and
find-first-set yields the next rank at once. Entries are never searched for and
removed: one whose pair has changed is skipped when it comes up. A pre-token of n
bytes takes on the order of n log n steps, however long it is.

Defined cases: null is the empty text, which has no tokens; any bytes that UTF-8
can hold are encoded, special strings being ordinary text; repeated rows and
extra columns are untouched; an empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from assayframe.llm.common import once_per_worker

# Ids of short pre-tokens are remembered, up to so many in a worker.
REMEMBERED = 1_200_000
LONGEST_REMEMBERED = 48


class ByteBpe:
    """Encoder and decoder for a table of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.size = size
        self.pairs = {
            left * size + right: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None
            and (right := ranks.get(token[cut:])) is not None
        }
        # Word w of the bitmap holds the ranks from w << shift on; bit w of the
        # summary says that the word is not empty.
        self.shift = max(1, (size.bit_length() + 1) // 2)
        self.words = [0] * ((size >> self.shift) + 1)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pair_rank, size, words, shift = self.pairs.get, self.size, self.words, self.shift
        mask = (1 << shift) - 1
        single = self.single
        ids = [single[b] for b in piece]
        n = len(ids)
        before = list(range(-1, n - 1))
        after = list(range(1, n + 1))
        pair = [pair_rank(x * size + y, -1) for x, y in zip(ids, ids[1:], strict=False)]
        pair.append(-1)
        buckets: dict[int, list[int]] = {}
        summary = 0
        for i, rank in enumerate(pair):
            if rank in buckets:
                buckets[rank].append(i)
            elif rank >= 0:
                buckets[rank] = [i]
                word = rank >> shift
                words[word] |= 1 << (rank & mask)
                summary |= 1 << word
        while summary:
            # Find first set: the lowest word in use, and the lowest rank in it.
            word = (summary & -summary).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << shift | low.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[word] = bits ^ low
                if bits == low:
                    summary ^= 1 << word
            if pair[i] != rank:
                continue
            gone = after[i]
            follow = after[gone]
            ids[i], ids[gone], pair[gone], after[i] = rank, -1, -1, follow
            lead = before[i]
            joined = -1
            if follow < n:
                before[follow] = i
                joined = pair_rank(rank * size + ids[follow], -1)
            pair[i] = joined
            if joined >= 0:
                if joined in buckets:
                    heappush(buckets[joined], i)
                else:
                    buckets[joined] = [i]
                    word = joined >> shift
                    words[word] |= 1 << (joined & mask)
                    summary |= 1 << word
            if lead >= 0:
                pair[lead] = joined = pair_rank(ids[lead] * size + rank, -1)
                if joined >= 0:
                    if joined in buckets:
                        heappush(buckets[joined], lead)
                    else:
                        buckets[joined] = [lead]
                        word = joined >> shift
                        words[word] |= 1 << (joined & mask)
                        summary |= 1 << word
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known = self.known
        pieces = self.find(text)
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = array("I", self.merge(piece.encode())).tobytes()
                if len(piece) <= LONGEST_REMEMBERED:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _loader(path: str, pattern: str) -> Callable[[], ByteBpe]:
    return lambda: once_per_worker(("byte_bpe", path, pattern), lambda: ByteBpe.load(path, pattern))


def encoder(path: str, pattern: str) -> Callable[[Column], Column]:
    """A function from a text column to its array of ids."""
    load = _loader(path, pattern)

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        bpe = load()
        ids = [bpe.encode(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
        flat = np.frombuffer(b"".join(ids), np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return encode


def decoder(path: str, pattern: str) -> Callable[[Column], Column]:
    """A function from an array of ids to the bytes they stand for."""
    load = _loader(path, pattern)

    @F.arrow_udf(BinaryType())
    def decode(ids: pa.Array) -> pa.Array:
        bpe = load()
        return pa.array([bpe.decode(x or ()) for x in ids.to_pylist()], pa.binary())

    return decode


ROUND_TRIP = StructType(
    [
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    ]
)


def digester(path: str, pattern: str) -> Callable[[Column], Column]:
    """A function from a text to its token count, the digest of its ids and of their decoding.

    For checks of a whole table, where the ids themselves need not travel.
    """
    load = _loader(path, pattern)

    @F.arrow_udf(ROUND_TRIP)
    def digest(texts: pa.Array) -> pa.Array:
        bpe = load()
        counts, encoded, decoded = [], [], []
        for text in texts.to_pylist():
            ids = bpe.encode(text or "")
            counts.append(len(ids) // 4)
            encoded.append(hashlib.sha256(ids).hexdigest())
            back = bpe.decode(np.frombuffer(ids, "<u4").tolist())
            decoded.append(hashlib.sha256(back).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return digest


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """Append the array of ids."""
    return docs.withColumn(ids, encoder(path, pattern)(docs[text]))


def decode_documents(
    docs: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Append the bytes that the ids stand for."""
    return docs.withColumn(decoded, decoder(path, pattern)(docs[ids]))
