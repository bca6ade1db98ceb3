"""Each operator on small tables: edge rows, brute force, and the SQL twins."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayframe.llm import (
    bpe,
    classifier,
    kdshards,
    merkle,
    neardup,
    packing,
    perspectives,
    quality_rules,
    token_counts,
    url_lists,
)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, kept int, row string, size int"


def edge_rows():
    """Nulls everywhere, empty and long texts, repeated rows, ids that repeat, clashing extra columns."""
    long = " ".join(f"word{i % 977} and{i}." for i in range(9000))
    texts = [
        (1, "One two three four five six seven eight nine ten eleven.\nSecond line here.", "en", "a"),
        (1, "One two three four five six seven eight nine ten eleven.\nSecond line here.", "en", "a"),
        (2, None, None, None), (3, "", "en", None), (4, " \n\t ", None, "a"), (5, long, "en", "a"),
        (6, "日本語 𓀀 é ̈ ﬁ", "fr", "b"), (None, "a text without any id, of some ten words or more", "en", "a"),
        (None, None, "en", "a"), (7, "x" * 5000, "en", "b"), (5, "another text with the same id", "de", "b"),
    ]
    return [(*t, "theirs", 9, "r", 3) for t in texts]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return Counter(map(str, df.collect()))


def test_quality_rules_edges(edge, none):
    judged = quality_rules.judge(edge)
    assert judged.count() == len(edge_rows())
    kept = quality_rules.keep_good(edge)
    assert kept.columns == edge.columns
    assert not kept.where("text is null or text = ''").count()
    assert not plain(kept) - plain(edge)
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).columns == none.columns


def test_quality_fences_follow_their_group(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(600):
        marked = i % 2 == 0
        words = [word() + ("#" if marked and rng.random() < 0.5 else "") for _ in range(60)]
        if i == 1:
            words = [w + "#" for w in words]
        rows.append((i, " ".join(words), "en", "forum" if marked else "news"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.keep_good(df).collect()}
    assert set(range(0, 600, 2)) <= kept and 1 not in kept and set(range(3, 600, 2)) <= kept


def test_each_fence_rejects_by_itself(spark):
    """Per measure a document that passes the base rule and all other fences."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows = []
    for i in range(500):
        lines = [line(20) for _ in range(10)]
        if i % 40 == 0:
            lines[3] = lines[2][:-1].rsplit(" ", 12)[0] + "."
        rows.append("\n".join(lines))
    clean = "\n".join(line(20) for _ in range(10))
    phrase = " ".join(word() for _ in range(19))
    planted = {
        "symbol_rate": clean.replace(" ", " # ", 20).replace("#", "|"),
        "upper_rate": clean.title(),
        "mark_rate": clean.replace(" ", "- "),
        "repeat_rate": "\n".join([*[line(20) for _ in range(8)], f"{word()} {phrase}.", f"{word()} {phrase}."]),
        "dup_line_rate": "\n".join(x for _ in range(20) for x in (line(12), "Menu here.")),
    }
    docs = [(i, t) for i, t in enumerate(rows)] + [(1000 + k, planted[f.measure]) for k, f in enumerate(quality_rules.FENCES)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    out = {r["row"]["doc_id"]: r for r in quality_rules.judge(df).collect()}
    for k, f in enumerate(quality_rules.FENCES):
        r = out[1000 + k]
        over = {g.measure for g in quality_rules.FENCES if r[g.measure] > r[f"max_{g.measure}"]}
        assert not r["base_failed"] and over == {f.measure} and not r["kept"], (f.measure, over, r)
    assert sum(out[i]["kept"] for i in range(500)) >= 480


def test_merkle_edges(edge, none):
    got = merkle.half_edited(edge)
    assert got.count() == len(edge_rows())
    rows = got.collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == 0}) == 1
    assert merkle.half_edited(none).count() == 0


def test_merkle_edits_are_found(spark):
    old = "First line here.\nThe second one.\nA third."
    new = "First line here.\nThe second two.\nA third.\nMore."
    df = spark.createDataFrame([(1, old, new), (2, old, old), (3, None, "x")], "k int, old string, new string")
    found = sorted((r["row"]["k"], r["paragraph"], r["text"]) for r in merkle.edits(df).collect())
    assert found == [(1, 1, "The second two."), (1, 3, "More."), (3, 0, "x")]
    fp = merkle.with_fingerprint(df, F.coalesce("old", F.lit("")), "fp").orderBy("k").collect()
    assert fp[0]["fp"] == fp[1]["fp"] != fp[2]["fp"]


def test_merkle_edit_is_found_from_fingerprints(spark):
    rng = random.Random(8)
    rows = [("A\nB\nC", "A\nB\nC"), ("", "x"), ("A\nA", "A\nA\nA"), ("A\nB\nC", "A\nC"), ("A", "A\nB"), ("A\nB\nA\nB", "A\nB")]
    for _ in range(300):
        old = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))]
        new, i = list(old), rng.randrange(len(old))
        new[i : i + rng.randint(0, 4)] = [rng.choice("abcxyz") for _ in range(rng.randint(0, 4))]
        rows.append(("\n".join(old), "\n".join(new)))
    df = spark.createDataFrame(rows, "old string, new string")
    printed = merkle.with_fingerprint(merkle.with_fingerprint(df, F.col("old"), "a"), F.col("new"), "b")
    for r in merkle.with_edit(printed, "a", "b").collect():
        old, new = r["old"].split("\n"), r["new"].split("\n")
        short = min(len(old), len(new))
        ahead = next((i for i in range(short) if old[i] != new[i]), short)
        behind = next((i for i in range(short - ahead) if old[-1 - i] != new[-1 - i]), short - ahead)
        want = (None, None) if old == new else (ahead, len(new) - behind)
        assert (r["edited_from"], r["edited_to"]) == want, (old, new)


def test_merkle_changes_cover_both_sides(spark):
    pairs = [("A\nB\nC", "A\nC"), ("A\nB\nC", "C\nA\nB"), ("A\nB", "A\nB\nB"), ("A\nB\nA", "B\nA"), ("A", "A"), (None, "x")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, old string, new string")
    got = {(r["row"]["k"], r["change"], r["old_paragraph"], r["new_paragraph"], r["text"]) for r in merkle.changes(df).collect()}
    assert got == {
        (0, "removed", 1, None, "B"), (1, "moved", 2, 0, "C"), (2, "added", None, 2, "B"), (3, "removed", 0, None, "A"),
        (5, "removed", 0, None, ""), (5, "added", None, 0, "x"),
    }


def test_merkle_changes_leave_the_same_sequence(spark):
    rng = random.Random(12)
    rows = []
    for k in range(150):
        old = [f"line {rng.randint(0, 12)}" for _ in range(rng.randint(0, 25))]
        new = [x for x in old if rng.random() < 0.8]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), f"line {rng.randint(0, 15)}")
        rows.append((k, "\n".join(old), "\n".join(rng.sample(new, len(new)) if k % 3 == 0 else new)))
    found = defaultdict(list)
    for r in merkle.changes(spark.createDataFrame(rows, "k int, old string, new string")).collect():
        found[r["row"]["k"]].append(r)
    for k, old, new in rows:
        old, new, rs = old.split("\n"), new.split("\n"), found[k]
        gone, come = {r["old_paragraph"] for r in rs}, {r["new_paragraph"] for r in rs}
        assert [x for i, x in enumerate(old) if i not in gone] == [x for i, x in enumerate(new) if i not in come]
        # Counts decide how many were removed and added.
        assert Counter(r["text"] for r in rs if r["change"] == "removed") == Counter(old) - Counter(new)
        assert Counter(r["text"] for r in rs if r["change"] == "added") == Counter(new) - Counter(old)
        assert all(old[r["old_paragraph"]] == new[r["new_paragraph"]] == r["text"] for r in rs if r["change"] == "moved")


def test_perspectives_brute_force(spark):
    rng = random.Random(8)
    rows = [
        (rng.choice([1, 2, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["ann", "bob", "system", None, "a|b"]),
         rng.choice(["hi", "", None, "x <|assistant|> y", "long " * 40]))
        for _ in range(90)
    ]
    rows += [(3, 0, "system", "only a system prompt")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {
        (r["conv_id"], r["perspective"], r["part"]): r
        for r in perspectives.perspectives(df, part_turns=7).collect()
    }
    want = {}
    for conv in {r[0] for r in rows}:
        said = sorted(
            ((-1 if t is None else t), w or "unknown", (x or "").replace("<|", "< |")) for c, t, w, x in rows if c == conv
        )
        for who in {s[1] for s in said} - {"system"}:
            for part in range(0, len(said), 7):
                out, spans = "", []
                for _, w, x in said[part : part + 7]:
                    name = re.sub(r"[<|>\n]", "_", w)
                    out += "<|system|>\n" if w == "system" else "<|assistant|>\n" if w == who else f"<|user:{name}|>\n"
                    at = len(out)
                    out += x + "<|end|>"
                    if w == who:
                        spans.append(f"{at}-{len(out)}")
                    out += "\n"
                want[(conv, who, part // 7)] = (out, ",".join(spans))
    assert {k: (r["text"], r["mask"]) for k, r in got.items()} == want
    assert perspectives.perspectives(df.where("false")).count() == 0


def test_packing_is_whole_and_close(edge, none):
    got = packing.packed_documents(edge, WORDS).collect()
    tok, want, sequences = Tokenizer.from_file(WORDS), Counter(), defaultdict(list)
    for r in edge_rows():
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(r[0], k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.packed_documents(none, WORDS).count() == 0


LENGTHS = {
    "uniform": lambda r: r.randint(1, 4096), "upper": lambda r: r.randint(1300, 2200), "middle": lambda r: r.randint(900, 2100),
    "lower": lambda r: r.randint(400, 1500), "log-normal": lambda r: min(4096, int(r.lognormvariate(5.5, 1.2)) + 1),
    "two kinds": lambda r: r.choice([1366, 2731]) - r.randint(0, 3),
}


@pytest.mark.parametrize("kind", sorted(LENGTHS))
def test_plan_places_every_piece_and_is_never_above_best_fit(kind):
    rng = random.Random(2)
    histogram = Counter(LENGTHS[kind](rng) for _ in range(6000))
    runs = packing.plan(histogram)
    placed = Counter()
    for lengths, count in runs:
        assert sum(lengths) <= 4096
        for length in lengths:
            placed[length] += count
    assert placed == histogram
    lower = -(-sum(k * n for k, n in histogram.items()) // 4096)
    used, plain = (sum(n for _, n in x) for x in (runs, packing.best_fit(histogram)))
    assert lower <= used <= plain
    if kind in ("uniform", "log-normal"):
        assert used <= 1.01 * lower
    if kind in ("upper", "middle"):
        assert used < plain
    rows = packing.places(runs)
    assert sum(rows[:, 2] > 0) == len(rows)


@pytest.mark.parametrize("capacity", [4096, 32768, 1 << 20])
def test_pieces_of_any_capacity_fill_sequences(spark, capacity):
    rng = random.Random(15)
    lengths = [rng.choice([capacity, capacity - 1, capacity // 2, rng.randint(1, capacity)]) for _ in range(300)]
    table = packing.materialize(spark.createDataFrame(list(enumerate(lengths)), "piece long, length long"))
    sequences = defaultdict(list)
    for r in packing.pack(table, ["piece"], capacity).collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter(n for s in sequences.values() for _, n in s) == Counter(lengths)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


def test_word_coder_equals_the_library():
    coder, tok, rng = packing.WordCoder(WORDS), Tokenizer.from_file(WORDS), random.Random(4)
    letters = "aB é́ñ\n\t<|endoftext|>中1!'sſİΣς\x1c\x85 ﬁ̈ a"
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == want


def test_word_coder_knows_every_character_it_remembers():
    coder, tok = packing.WordCoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [t for c in range(0x250) for t in (f"a{chr(c)}b", chr(c), f"x {chr(c)}li", f"1{chr(c)}'s")]
    rng = random.Random(14)
    texts += ["".join(chr(rng.randrange(0x20, 0x250)) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += ["\u212aelvin \u212b", "a\u0130b", "o\u0308\u00f6"]
    got = coder.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_classifier_learns_and_takes_edges(spark, edge, none):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        words = [word() for _ in range(40)]
        docs.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good), 0))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit(d, lab)
    rows = classifier.scored(d, model, keep=["doc_id"]).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if zlib.crc32(str(r["row"]["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(r["score"] >= 0.5) == truth[r["row"]["doc_id"]] for r in held]) > 0.95
    scores = [r["score"] for r in classifier.scored(edge, model).collect()]
    assert len(scores) == len(edge_rows()) and all(0 <= s <= 1 for s in scores)
    assert classifier.keep_good(edge, model).columns == edge.columns
    assert classifier.scored(none, model).count() == 0
    plainly = classifier.fit(d, lab.where("false"))
    assert {round(r["score"], 6) for r in classifier.scored(d, plainly).collect()} == {0.5}
    assert classifier.scored(edge, classifier.fit(none, lab.where("false"))).count() == len(edge_rows())
    own = [(r["row"]["doc_id"], r["score"]) for r in classifier.scored(d, model, of_corpus=True).collect()]
    assert Counter(own) == Counter((r["row"]["doc_id"], r["score"]) for r in rows)


def named(df):
    return {r["name"]: tuple(r["vector"]) for r in classifier.word_vectors(df).collect()}


def test_word_vectors_do_not_depend_on_the_deal(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} next{i % 5} Third! again again") for i in range(200)], "doc_id long, text string")
    one = named(docs.repartition(1))
    monkeypatch.setattr(classifier, "RANGE_BYTES", 500)
    assert one == named(docs.repartition(5)) and len(one) > 12


def test_every_word_has_its_own_vector(spark):
    """More words than any fixed number of buckets, and a vector for each, whatever the deal."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(12_000)]
    rows = [(i, " ".join(words[i : i + 60])) for i in range(0, 12_000, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [named(docs.repartition(n)) for n in (1, 5)]
    # One shape beside the words: all are small and of one length class.
    assert len(found[0]) == 12_001 and found[0] == found[1]


def test_sums_of_contexts_equal_a_loop(spark):
    text = "One two, two THREE! 12 two one " * 50
    form, shape, _ = classifier.Tokens().cut([text.encode()])
    kinds = classifier.shape_names(shape)
    index = {int(n): v.astype(int) for names in (form, kinds) for n, v in zip(names, classifier.index_vectors(names))}
    want = {n: np.zeros(classifier.DIMENSIONS, int) for n in index}
    for k in range(len(form)):
        for j in range(max(0, k - 2), min(len(form), k + 3)):
            if j != k:
                for own in (int(form[k]), int(kinds[k])):
                    want[own] += index[int(form[j])] + index[int(kinds[j])]
    got = named(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    for n, v in want.items():
        peak = max(classifier.STEPS, np.abs(v).max())
        assert got[n - (1 << 64) if n >> 63 else n] == tuple(np.rint(v * (classifier.STEPS / peak)).astype(int))


@pytest.mark.parametrize("portion", [24 << 20, 100])
def test_pooling_equals_a_loop(spark, monkeypatch, portion):
    monkeypatch.setattr(classifier, "PORTION_BYTES", portion)
    monkeypatch.setattr(classifier, "RANGE_BYTES", 50_000)
    texts = ["One two, two THREE! 12", "日本語。猫と犬", None, "", "two one. " * 70_000, "x", "One two, two THREE! 12"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    vector = {n: classifier.units(np.array([v], np.int8))[0] / classifier.UNIT for n, v in named(docs).items()}
    bodies = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    hashed = {(r["h1"], r["h2"]): bytes(r["body"]) for r in bodies.select("body", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2")).collect()}
    table = classifier.word_table(docs)
    for found in (classifier.pooled(docs), classifier.pooled(docs, words=table)):
        rows = {(r["h1"], r["h2"]): r for r in found.collect()}
        assert set(rows) == set(hashed) and sum(r["n"] for r in rows.values()) == len(texts)
        for h, body in hashed.items():
            form, shape, _ = classifier.Tokens().cut([body])
            want = np.zeros(2 * classifier.DIMENSIONS)
            for f, s in zip(form.view(np.int64).tolist(), classifier.shape_names(shape).view(np.int64).tolist()):
                want += np.concatenate((vector[f], vector[s]))
            assert np.allclose(classifier.opened([rows[h]["x"]])[0], want / max(1, len(form)), atol=1e-3)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        x = rng.integers(-(1 << 31), 1 << 31, n).astype(np.int32)
        assert (classifier._unpack_signed(classifier._pack_signed(x), n) == x).all()
        y = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (classifier._unpack_sorted(classifier._pack_sorted(y), n) == y).all()


def test_words_end_at_marks_of_every_script():
    cut = lambda t: classifier.Tokens().cut([t.encode()])[0].tolist()
    assert len(cut("猫。犬")) == 3 and cut("猫。犬")[0] == cut("犬 猫")[1]
    assert cut("été, “Été”")[0] == cut("été, “Été”")[3]


def test_bpe_equals_the_library(edge, none):
    coder = bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(6)
    letters = [*"aabbcde  \n\t ABé'ß.,!1 23\x1c\x85\xa0​😀ñ中文", "'s", "'ll", " the ", "  ", "\r\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 4000, "ab" * 2000, "<|endoftext|>", "".join(rng.choice("abcdefgh") for _ in range(9000))]
    for text in texts:
        ids = array("I", coder.encode(text)).tolist()
        assert ids == want.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    both = bpe.decode_documents(
        bpe.encode_documents(edge, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN
    )
    for r in both.collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["ids"] == want.encode_ordinary(r["text"] or "")
    assert bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize(("size", "overlap"), [(200, 8), (1000, 64), (32768, 256)])
def test_token_counts_equal_the_library(edge, none, size, overlap):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.with_token_counts(edge, PIECES, size=size, overlap=overlap)
    assert Counter((r["row"]["doc_id"], r["row"]["text"], r["n_tokens"]) for r in got.collect()) == Counter(
        (r[0], r[1], len(model.encode(r[1] or ""))) for r in edge_rows()
    )
    assert token_counts.with_token_counts(none, PIECES, size=size, overlap=overlap).count() == 0


def test_url_filters_brute_force(spark):
    rng = random.Random(7)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "x.other.org"]
    log = [(rng.choice([*hosts, "example.com/p", "a.example.com/p/q", None]), rng.randint(0, 900), rng.choice(["block", "allow", "remove", None])) for _ in range(120)]
    urls = ["http://u:p@B.A.example.com:80/p/q/r?x#y", "https://example.com/p", "other.org", "", None, "http://x.other.org./", "https://a.example.com/p/q"]
    asked = [(i, rng.choice(urls), rng.choice([*range(0, 1000, 37), None])) for i in range(200)]
    asked += asked[:5]
    captures = spark.createDataFrame(asked, "row int, url string, fetched_at long")
    entries = spark.createDataFrame(log, "key string, listed_at long, action string")
    got = url_lists.filter_captures(captures, entries, bucket_seconds=100)
    power = {"remove": 0, "allow": 1, "block": 2}

    def verdict(url, at):
        if url is None or at is None:
            return "none"
        bare = re.sub(r"[?#].*$", "", re.sub(r"^[a-z]+://", "", url))
        host, _, path = bare.partition("/")
        host = re.sub(r":\d+$", "", host.split("@")[-1].lower()).rstrip(".")
        labels, parts = host.split("."), [p for p in path.split("/") if p]
        keys = [".".join(labels[i:]) for i in range(len(labels))]
        keys += ["/".join([host, *parts[: i + 1]]) for i in range(len(parts))]
        best = None
        for key in keys:
            seen = [(t, power[a]) for k, t, a in log if k == key and a and t <= at]
            if seen and max(seen)[1]:
                best = max(best or (-1,), (key.count("/"), len(key), key, max(seen)[1]))
        return "none" if best is None else ["none", "allow", "block"][best[3]]

    assert Counter((r["row"]["row"], r["verdict"]) for r in got.collect()) == Counter(
        (i, verdict(u, t)) for i, u, t in asked
    )
    assert {r["verdict"] for r in url_lists.filter_captures(captures, entries.where("false")).collect()} == {"none"}
    assert url_lists.filter_captures(captures.where("false"), entries).count() == 0


def brute_components(texts):
    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fp(t) for t in texts]
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return fps, group


def test_near_groups_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(150)) for _ in range(12)]
    texts = [None, "", "  ", "One", "one"]
    for b in base:
        words = b.split()
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "zz"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps, group = brute_components(texts)
    first = {g: group.index(g) for g in set(group)}
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in neardup.near_groups(df).collect()}
    assert got == {i: (fps[i], first[group[i]]) for i in range(len(texts))}
    kept = neardup.one_of_each(df)
    assert {r["doc_id"] for r in kept.collect()} == set(first.values())


def test_links_of_dense_and_split_cells(spark):
    rng = random.Random(10)
    centre = rng.getrandbits(63)
    values = {centre} | {centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(300)}
    values |= {rng.getrandbits(63) for _ in range(300)}
    values = sorted(values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    group = {v: v for v in values}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, x in enumerate(values):
        for y in values[:i]:
            if (x ^ y).bit_count() <= 4:
                group[max(find(x), find(y))] = min(find(x), find(y))
    for rows in (16, 4096):
        links = neardup.near_links(fps, block_rows=rows)
        from assayframe.llm.components import components

        got = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
        assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_near_groups_edges(edge, none):
    assert neardup.near_groups(edge).count() == len(edge_rows())
    kept = neardup.one_of_each(edge)
    assert kept.columns == edge.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 1 and ids[3] == ids[4] == 0 and ids[5] == 2
    assert neardup.near_groups(none).count() == 0 and neardup.one_of_each(none).count() == 0


def test_an_id_on_a_representative_and_on_a_near_copy(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    own, other = text(), text()
    df = spark.createDataFrame([(5, own), (5, other), (2, other), (7, text())], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in neardup.one_of_each(df).collect()}
    assert len(kept) == 3 and {(5, own), (2, other)} <= kept


def test_shards(spark, edge, none):
    rng = random.Random(12)
    rows = [(i, "x" * rng.randint(0, 400), rng.choice(["a", "a", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dims = {"n": F.length("text"), "s": F.pmod(F.xxhash64("source"), F.lit(1000)), "id": F.col("doc_id")}
    for count in (1, 5, 8):
        out, tree = kdshards.shards(df, count, dims)
        flat = kdshards.with_slots(out.select("row.doc_id", "size", "shard"), ["doc_id"]).collect()
        sizes, slots = Counter(), defaultdict(list)
        for r in flat:
            sizes[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert set(sizes) == set(range(count)) and len(tree) == count - 1
        assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / count + 1200
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    out, _ = kdshards.shards(edge, 8, {"id": F.greatest("doc_id", F.lit(0))})
    assert out.count() == len(edge_rows()) and out.where("shard < 0 or shard > 7").count() == 0
    assert kdshards.shards(none, 8, {"id": F.col("doc_id")})[0].count() == 0


def test_digest_query_shape(edge):
    digest = bpe.digester(RANKS, public_tokenizers.PATTERN)
    for r in edge.select("text", digest("text").alias("d")).collect():
        assert r["d"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
