"""Language identification by a string kernel with Nyström landmarks and ridge regression.

A text is the set of its n-grams of one to three characters over letters in lower
case, where everything between words is one blank (the blended spectrum; presence, not
counts). The kernel of two texts is the number of n-grams they share over the geometric
mean of their numbers of n-grams. Only n-grams that some landmark holds count.

Landmarks are documents of every language, spread over small and large sets. A text's
kernel values to the landmarks, times the inverse root of the landmarks' own kernel
matrix, are its Nyström features; per language a ridge regression tells it from the
rest. A text is scored as presence matrix * landmark matrix * weights; as products
associate, the last two are multiplied once, and a batch of texts costs one product
with a matrix of (n-grams, languages). A softmax with a temperature fitted on rows the
regression has not seen turns the values into a score.

The model is fitted on at most ``FIT_ROWS`` different texts per language, those of
least hash among the texts that may be learned; tasks cut them into n-grams, so the
driver sees sets, not texts. Every text is read whole, ``CHARS_AT_ONCE`` at a time.

Defined cases: a null text and one without a letter are ``und`` with score 0; null
languages and null ids are never learned; a text with two languages is learned for
both; with nothing to learn every text is ``und`` with score 0, with one language
every text with a letter is of it with score 1; ties go to the language that sorts
first; repeated rows are told alike; other columns pass through untouched; an empty
table gives an empty table.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from assayframe.llm.common import clean_text, once_per_worker, packed_rows

GRAM = 3
FIT_ROWS = 400
LANDMARKS = 32
RIDGE = 1e-3
UNKNOWN = "und"
CHARS_AT_ONCE = 1 << 19
TEXTS_AT_ONCE = 128
LONGEST_WORD = 256
# Slots of the first lookup; n-grams that share one are looked up by bisection.
SLOTS = 1 << 21


def _letters() -> np.ndarray:
    """Which characters are letters, and which are marks on letters (2)."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))[0]
        kind[c] = 1 if category == "L" else 2 if category == "M" else 0
    return kind


class Grams:
    """The n-grams of texts as whole numbers: up to three characters of 21 bits."""

    def __init__(self) -> None:
        self.kind = once_per_worker("langid-letters", _letters)

    def of(self, text: str) -> np.ndarray:
        """All n-grams of a piece of text, repeats included; none without a letter.

        A character that is no letter is a blank (its number is 1), and runs of them are one.
        """
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        kind = self.kind[c]
        if not (kind == 1).any():
            return np.empty(0, np.int64)
        c[kind == 0] = 1
        c = np.concatenate(([1], c, [1]))
        blank = c == 1
        c = c[~(blank & np.concatenate(([False], blank[:-1])))]
        pair = c[:-1] << 21 | c[1:]
        triple = (pair[:-1] << 21 | c[2:])[c[1:-1] != 1]
        return np.concatenate((c[c != 1], pair, triple))

    def present(self, text: str) -> np.ndarray:
        """The different n-grams of a whole text."""
        found = [np.empty(0, np.int64)]
        for k in range(0, len(text), CHARS_AT_ONCE):
            found.append(np.unique(self.cut(text, k)))
        return np.unique(np.concatenate(found))

    def cut(self, text: str, at: int) -> np.ndarray:
        """The n-grams of the piece of a text that begins at a place, with the whole words at its edges.

        Words of more than ``LONGEST_WORD`` characters at an edge stay cut there.
        """
        start, stop = at, min(at + CHARS_AT_ONCE, len(text))
        while start > max(0, at - LONGEST_WORD) and self.kind[ord(text[start - 1])]:
            start -= 1
        while stop < min(len(text), at + CHARS_AT_ONCE + LONGEST_WORD) and self.kind[ord(text[stop])]:
            stop += 1
        return self.of(text[start:stop])


@dataclass(frozen=True)
class Model:
    """Languages, the landmarks' n-grams in order, and their weights: (n-grams, languages)."""

    languages: tuple[str, ...]
    grams: np.ndarray
    weights: np.ndarray
    temperature: float

    def values(self, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Regression values from the number of known n-grams and the sums of their weights."""
        return sums / np.sqrt(np.maximum(counts, 1))[:, None]

    def told(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = values / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = values.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


class Lookup:
    """Numbers of the known n-grams: a table by hash, and bisection where slots are shared."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        slot = self._slot(grams)
        times = np.bincount(slot, minlength=SLOTS)
        self.table = np.full(SLOTS, -1, np.int32)
        self.table[slot] = np.arange(len(grams))
        self.table[times > 1] = -2

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of those n-grams that are known."""
        at = self.table[self._slot(grams)]
        shared = at == -2
        if shared.any():
            at = at.copy()
            at[shared] = np.searchsorted(self.grams, grams[shared]).clip(max=len(self.grams) - 1)
        keep = at >= 0
        at, grams = at[keep], grams[keep]
        return at[self.grams[at] == grams]


def _kernel(sets: list[np.ndarray], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Presence of the known n-grams in each set, and the roots of their numbers."""
    presence = np.zeros((len(sets), len(grams)), np.float32)
    for row, s in zip(presence, sets, strict=True):
        at = np.searchsorted(grams, s).clip(max=len(grams) - 1)
        row[at[grams[at] == s]] = 1
    return presence, np.sqrt(np.maximum(presence.sum(axis=1), 1))


def fit_sets(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features over landmarks of every language, one ridge regression per language."""
    names = tuple(sorted({x for x, s in zip(langs, sets, strict=True) if len(s)}))
    used = [(s, names.index(x)) for s, x in zip(sets, langs, strict=True) if len(s)]
    if not used:
        return Model((), np.empty(0, np.int64), np.empty((0, 0)), 1.0)
    chosen: list[int] = []
    for k in range(len(names)):
        own = sorted((i for i, (_, x) in enumerate(used) if x == k), key=lambda i: (len(used[i][0]), i))
        chosen += [own[i] for i in np.unique(np.linspace(0, len(own) - 1, min(landmarks, len(own))).astype(int))]
    grams = np.unique(np.concatenate([used[i][0] for i in chosen]))
    presence, root = _kernel([s for s, _ in used], grams)
    marks = presence[chosen] / root[chosen, None]
    own = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(own)
    some = value > value.max() * 1e-8
    inverse_root = vector[:, some] / np.sqrt(value[some])
    features = (presence @ marks.T / root[:, None]).astype(np.float64) @ inverse_root
    target = np.full((len(used), len(names)), -1.0)
    target[np.arange(len(used)), [x for _, x in used]] = 1.0
    held = np.arange(len(used)) % 5 == 0 if len(used) >= 10 else np.zeros(len(used), bool)

    def regression(rows: np.ndarray) -> np.ndarray:
        z = features[rows]
        return np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ target[rows])

    temperature = 1.0
    if held.any() and len(names) > 1:
        values, truth = features[held] @ regression(~held), target[held].argmax(axis=1)
        losses = []
        grid = np.exp(np.linspace(np.log(0.02), np.log(4), 60))
        for t in grid:
            z = values / t
            z -= z.max(axis=1, keepdims=True)
            losses.append(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))
        temperature = float(grid[int(np.argmin(losses))])
    # Landmark side first: presence @ (marks.T @ inverse_root @ regression).
    weights = marks.T.astype(np.float64) @ inverse_root @ regression(np.ones(len(used), bool))
    return Model(names, grams, weights, temperature)


def held_out(doc_id: Column) -> Column:
    """Rows that must never be learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = FIT_ROWS
) -> Model:
    """The model from at most ``rows`` different texts per language."""

    @F.arrow_udf("binary")
    def present(texts: pa.Array) -> pa.Array:
        grams = Grams()
        return pa.array([grams.present(t).tobytes() for t in texts.to_pylist()], pa.binary())

    known = docs.where(
        docs[doc_id].isNotNull() & ~held_out(docs[doc_id]) & docs[lang].isNotNull() & docs[text].isNotNull()
    ).select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("h"))
    # Some three times as many rows as needed, by hash, before any row is shuffled.
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 3 * rows / n))).otherwise(share)
    draw = (F.pmod("h", F.lit(1 << 30)) + 1) / float(1 << 30)
    few = known.where(draw <= share).groupBy("lang", "h").agg(F.min("text").alias("text"))
    # Copies may hold most rows and be drawn or not as one; then the least hashes of all texts are taken.
    if any(r["n"] < min(rows, counts[r["lang"]]) for r in few.groupBy("lang").agg(F.count("*").alias("n")).collect()):
        few = known.groupBy("lang", "h").agg(F.min("text").alias("text"))
    turn = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("h"))
    again = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = (
        few.withColumn("slice", F.pmod("h", F.lit(64)))
        .withColumn("turn", turn)
        .where(F.col("turn") <= rows)
        .withColumn("turn", again)
        .where(F.col("turn") <= rows)
        .select("lang", "h", present("text").alias("grams"))
    )
    found = sorted(chosen.collect(), key=lambda r: (r["h"], r["lang"]))
    return fit_sets([np.frombuffer(r["grams"], np.int64) for r in found], [r["lang"] for r in found])


_TOLD = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def with_language(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Every row as ``row`` (its columns ``keep``, all by default) with ``lang_pred`` and ``score``."""
    # A few thousand n-grams per landmark, of at most LANDMARKS per language.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_TOLD)
    def tell(texts: pa.Array) -> pa.Array:
        m: Model = shared.value
        grams, lookup = Grams(), Lookup(m.grams)
        names, scores = [], []
        for first in range(0, len(texts), TEXTS_AT_ONCE):
            part = [t or "" for t in texts.slice(first, TEXTS_AT_ONCE).to_pylist()]
            presence = np.zeros((len(part), len(m.grams)), np.float32)
            lettered = np.zeros(len(part), bool)
            for k, t in enumerate(part):
                for at in range(0, len(t), CHARS_AT_ONCE):
                    found = grams.cut(t, at)
                    if len(found):
                        lettered[k] = True
                        if m.languages:
                            presence[k, lookup.known(found)] = 1
            if m.languages:
                values = m.values(presence.sum(axis=1), presence @ m.weights.astype(np.float32)).astype(np.float64)
                best, score = m.told(values)
            for k, some in enumerate(lettered):
                sure = bool(some and m.languages)
                names.append(m.languages[best[k]] if sure else UNKNOWN)
                scores.append(float(score[k]) if sure else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=_TOLD.names)

    packed = packed_rows(docs, keep, body=clean_text(docs[text]))
    return packed.select("row", tell("body").alias("t")).select("row", "t.*")
