"""Token counts of documents of any length, by overlap resynchronisation.

Short documents are encoded whole. A huge one is cut into chunks that overlap, the
chunks become rows of their own and are dealt over the cluster, and every chunk
is encoded with offsets. Neighbouring chunks are spliced at a boundary that both
report inside their overlap and that is proven stable: the two characters around
it stand side by side in no piece of the vocabulary, so no merge of the model can
ever reach over it, whatever stands around. Each chunk then counts its tokens
between its two splices. Where a pair of chunks shares no such boundary, the
document is done again with a wider overlap, until the overlap spans the text.

Defined cases: null and empty texts have no tokens; repeated rows are counted
alike; other columns pass through untouched; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from assayframe.llm.common import clean_text, materialize, once_per_worker, packed_rows

# Characters: texts beyond CHUNK are cut; OVERLAP is where neighbours first try to meet.
CHUNK = 32_768
OVERLAP = 256
WIDER = 8
TEXTS_AT_ONCE = 256


class PieceModel:
    """A sentence piece model and the places where its tokens can never span."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (
            self.model.id_to_piece(i)
            for i in range(self.model.get_piece_size())
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))
        )
        self.touching = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            out.extend(map(len, self.model.encode(texts[at : at + TEXTS_AT_ONCE], num_threads=1)))
        return out

    def stable(self, text: str, at: int) -> bool:
        """No token can span the place before character ``at``.

        A character spelled out in bytes is several tokens, and the last of them
        bears the offsets, so such places are left out by the caller's test that
        tokens adjoin. A blank is the model's own mark for it; the mark itself, written out in a
        text, is never trusted.
        """
        left, right = text[at - 1], text[at]
        if "▁" in (left, right):
            return False
        mark = {" ": "▁"}
        return (mark.get(left, left), mark.get(right, right)) not in self.touching

    def boundaries(self, text: str, head: int, tail: int) -> tuple[int, list[int], list[int], list[int], list[int]]:
        """Tokens of a chunk, and its stable boundaries in the first ``head`` and last ``tail`` characters.

        Boundaries come as offsets and as the number of tokens before them.
        """
        pieces = self.model.encode(text, out_type="proto").pieces
        data = np.frombuffer(text.encode(), np.uint8)
        # The model tells bytes; a character begins at every byte that does not continue one.
        char_at = np.cumsum((data & 0xC0) != 0x80) - 1
        starts: list[tuple[int, int]] = []
        ended = 0
        for k, piece in enumerate(pieces):
            if piece.begin == ended and 0 < piece.begin < piece.end:
                starts.append((int(char_at[piece.begin]), k))
            ended = piece.end
        ok = [(at, k) for at, k in starts if self.stable(text, at)]
        first = [x for x in ok if x[0] < head]
        final = [x for x in ok if x[0] > len(text) - tail]
        return (
            len(pieces),
            [x[0] for x in first], [x[1] for x in first],
            [x[0] for x in final], [x[1] for x in final],
        )


def _loader(path: str) -> Callable[[], PieceModel]:
    return lambda: once_per_worker(("pieces", path), lambda: PieceModel(path))


def whole_counter(path: str) -> Callable[[Column], Column]:
    """A function from a text to its token count, each text encoded whole."""
    load = _loader(path)

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(load().counts([t or "" for t in texts.to_pylist()]), pa.int64())

    return count


_ENDS = StructType(
    [
        StructField("tokens", IntegerType()),
        *[
            StructField(name, ArrayType(IntegerType()))
            for name in ("head_at", "head_tokens", "tail_at", "tail_tokens")
        ],
    ]
)
CHUNKS = "key string, chunk int, first bigint, body string, head int, tail int"


def _chunks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (key, overlap, text) to rows of overlapping chunks."""
    names = ["key", "chunk", "first", "body", "head", "tail"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32()]

    def rows(key: str, overlap: int, text: str) -> Iterator[tuple]:
        starts = range(0, max(1, len(text) - overlap), size)
        for k, at in enumerate(starts):
            last = k == len(starts) - 1
            body = text[at:] if last else text[at : at + size + overlap]
            yield key, k, at, body, overlap if k else 0, 0 if last else overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = list(rows(r["key"], r["overlap"], r["body"]))
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names
                )

    return run


def _spliced(huge: DataFrame, path: str, size: int, tasks: int) -> DataFrame:
    """``(key, n_tokens)`` of rows ``(key, overlap, body)``; null where two chunks did not meet."""
    load = _loader(path)

    @F.arrow_udf(_ENDS)
    def ends(body: pa.Array, head: pa.Array, tail: pa.Array) -> pa.Array:
        model = load()
        rows = zip(body.to_pylist(), head.to_pylist(), tail.to_pylist(), strict=True)
        columns = list(zip(*(model.boundaries(*r) for r in rows), strict=True)) or [[]] * 5
        kinds = [pa.int32(), *[pa.list_(pa.int32())] * 4]
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_ENDS.names
        )

    counted = (
        huge.mapInArrow(_chunks(size), CHUNKS)
        .repartition(tasks, "key", "chunk")
        .select("key", "chunk", "first", ends("body", "head", "tail").alias("e"))
        .select("key", "chunk", "first", "e.*")
    )
    # A chunk's offsets move by its own start to become the document's.
    placed = counted.select(
        "key", "chunk", "tokens",
        F.transform("head_at", lambda x: x + F.col("first")).alias("head_at"), "head_tokens",
        F.transform("tail_at", lambda x: x + F.col("first")).alias("tail_at"), "tail_tokens",
    )
    by_chunk = Window.partitionBy("key").orderBy("chunk")
    met = placed.withColumn("next_head", F.lead("head_at").over(by_chunk)).withColumn(
        "cut", F.array_max(F.array_intersect("tail_at", "next_head"))
    )
    joined = met.withColumn("from", F.lag("cut").over(by_chunk)).withColumn(
        "last", F.lead("chunk").over(by_chunk).isNull()
    )

    def before(offsets: str, tokens: str, at: str) -> Column:
        return F.try_element_at(F.col(tokens), F.array_position(offsets, F.col(at)).cast("int"))

    end = F.when(F.col("last"), F.col("tokens")).when(
        F.col("cut").isNotNull(), before("tail_at", "tail_tokens", "cut")
    )
    begin = F.when(F.col("chunk") == 0, F.lit(0)).when(
        F.col("from").isNotNull(), before("head_at", "head_tokens", "from")
    )
    part = (end - begin).cast("bigint")
    return joined.groupBy("key").agg(
        F.when(F.count(part) == F.count("*"), F.sum(part)).alias("n_tokens")
    )


def huge_counts(
    huge: DataFrame, path: str, size: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``(key, n_tokens)`` for rows ``(key, n_chars, body)``, each key once, by overlapping chunks."""
    tasks = 2 * huge.sparkSession.sparkContext.defaultParallelism
    left = huge.withColumn("overlap", F.lit(overlap))
    done = None
    while True:
        found = materialize(_spliced(left.select("key", "overlap", "body"), path, size, tasks))
        part = found.where("n_tokens is not null")
        done = part if done is None else done.unionAll(part)
        failed = found.where("n_tokens is null").select("key")
        if failed.isEmpty():
            return done
        left = materialize(
            left.join(failed, "key", "left_semi").withColumn(
                "overlap", F.least(F.col("overlap").cast("bigint") * WIDER, F.col("n_chars")).cast("int")
            )
        )


def with_token_counts(
    docs: DataFrame,
    path: str,
    text: str = "text",
    out: str = "n_tokens",
    keep: Sequence[str] | None = None,
    size: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Every row as ``row`` (its columns ``keep``, all by default) with its token count as ``out``.

    Huge texts go by the digest of their content, so equal texts are counted once.
    """
    packed = packed_rows(docs, keep, body=clean_text(docs[text])).withColumn("n_chars", F.length("body"))
    large = F.col("n_chars") > size + overlap
    short = packed.where(~large).select("row", whole_counter(path)(F.col("body")).alias(out))
    keyed = packed.where(large).withColumn("key", F.sha2("body", 256))
    counts = huge_counts(keyed.select("key", "n_chars", "body").dropDuplicates(["key"]), path, size, overlap)
    huge = keyed.select("row", "key").join(counts, "key").select("row", F.col("n_tokens").alias(out))
    return short.unionAll(huge)
