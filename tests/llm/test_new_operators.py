"""Clusters, filter audit and language ID: brute force, held-out rows, and edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.llm import centroids, filter_audit, langid
from assayframe.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def brute_clusters(rows, k, rounds):
    kept = [
        (i, [int(np.floor(256 * float(x))) for x in e])
        for i, e in rows
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)
    ]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in by_hash[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for j, vs in own.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs)]
    told = [(i, *near(v)) for i, v in kept]
    whole, within = sum(d for _, d, _ in told), Counter()
    for _, d, j in told:
        within[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, j, d, within[j], whole, names[j]) for i, d, j in told)


def test_clusters_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(centroids, "PORTION", 50)
    rng = random.Random(3)
    hot = [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(i, [rng.choice([-0.5, 0.1, 0.3, rng.uniform(-2, 2)]) for _ in range(64)]) for i in range(150)]
    rows += [(200 + i, hot) for i in range(80)] + [(5, rows[5][1])] * 3 + [(None, hot), (None, [0.25] * 64)]
    rows += [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, [])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, cluster string, distance int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for k in (7, 400):
        got, cents = centroids.clusters(df.repartition(3), k=k)
        assert Counter(map(tuple, got.collect())) == brute_clusters(rows, k, centroids.ROUNDS)
        assert len(cents) == min(k, 235)
    assert centroids.clusters(df.where("false"))[0].count() == 0


def test_portions_keep_their_vectors():
    rng = np.random.default_rng(5)
    for values in ((-3, 3), (-(1 << 26), 1 << 26), (0, 1)):
        v = rng.integers(*values, (300, 64)).astype(np.int32)
        v[::3] = v[0]
        made = centroids.Portion.of(v)
        assert (made.vectors() == v).all()
        cents = rng.integers(*values, (9, 64)).astype(np.int64)
        cluster, distance = made.nearest(cents)
        want = ((v[:, None, :].astype(object) - cents[None]) ** 2).sum(axis=2)
        assert (want.argmin(axis=1) == cluster[made.which]).all() and (want.min(axis=1) == distance[made.which]).all()
        rows, sums = made.sums(cluster, 9)
        assert all((sums[j] == v[cluster[made.which] == j].sum(axis=0)).all() for j in range(9)) and rows.sum() == 300


def test_components_beyond_64_bit_distances_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large for distances"):
        centroids.clusters(df)


def brute_audit(docs, labels):
    texts = defaultdict(list)
    for i, t, _ in docs:
        texts[t or ""].append(i)
    sets = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i for j in texts[t]):
            fails.add("E")
        good = any(j == i and q == 1 for j, q, _ in labels if i is not None)
        toxic = any(j == i and x == 1 for j, _, x in labels if i is not None)
        sets.append((source or "", fails, good, toxic))
    out = {}
    for part in {s[0] for s in sets}:
        own = [s for s in sets if s[0] == part]
        removals = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [s for s in left if f in s[1]]
                rest = [s for s in left if f not in s[1]]
                removals[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(rest), len(gone), sum(f in s[1] for s in own) - len(gone), sum(s[1] == {f} for s in own),
                    sum(s[2] for s in gone), sum(s[3] for s in gone), f,
                ]
                left = rest
        for key, row in out.items():
            if key[0] == part:
                row[-1] = removals[row[-1]] if isinstance(row[-1], str) else row[-1]
    return Counter((*k, *v) for k, v in out.items())


def test_audit_equals_walking_every_order(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [None, "", " \n", "A B C", "x " * 300, "Zz#"]
    for _ in range(25):
        words = [word() for _ in range(rng.choice([50, 190, 200, 260]))]
        if rng.random() < 0.3:
            words = [w if k % 3 else "the" for k, w in enumerate(words)] + ["the"] * 200
        text = " ".join(words)
        texts.append(text.upper() if rng.random() < 0.2 else text + rng.choice(["", "", " |", " A"]))
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["a", "a", "b", "", None])) for _ in range(160)]
    docs += docs[:10]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, source string, n int, mask string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Counter(map(tuple, filter_audit.audited(d, lab).collect()))
    assert got == brute_audit(docs, labels)
    assert filter_audit.audited(d.where("false"), lab).count() == 0
    assert filter_audit.audited(d, lab.where("false")).agg({"good_lost": "sum"}).first()[0] == 0


def test_lattice_counts_paths():
    lattice = filter_audit.Lattice("ABCDE")
    assert sum(n for s, _, n in lattice.edges() if s == 0) == 120 and lattice.forward[lattice.full] == 120 == lattice.backward[0]
    shared = Counter((s, f) for s, f, _, _ in lattice.steps())
    assert all(shared[s, f] == n for s, f, n in lattice.edges())


def brute_grams(text):
    letters = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    padded = f" {' '.join(letters.split())} "
    return {padded[k : k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1)} - {" "} - {
        padded[k : k + 3] for k in range(len(padded) - 2) if padded[k + 1] == " "
    }


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


@pytest.mark.parametrize("size", [1 << 19, 7, 60])
def test_grams_equal_a_loop_however_the_text_is_cut(monkeypatch, size):
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", size)
    rng = random.Random(9)
    texts = ["a", "Été, l'île; 12 NAÏVE!", "日本語 テキスト", "x" * 200, "हिन्दी भाषा", "İstanbul ß"]
    texts += ["".join(rng.choice("abÉ ñ.\n1") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    for text in texts:
        want = {code(g) for g in brute_grams(text)} if any(c.isalpha() for c in text) else set()
        assert set(langid.Grams().present(text).tolist()) == want, text


def test_lookup_finds_exactly_the_known_grams(monkeypatch):
    rng = np.random.default_rng(8)
    grams = np.unique(rng.integers(1, 1 << 62, 5000))
    asked = np.concatenate((grams[::7], rng.integers(1, 1 << 62, 3000)))
    found = langid.Lookup(grams).known(asked)
    assert set(grams[found].tolist()) == set(asked.tolist()) & set(grams.tolist())


def test_values_equal_the_kernel_written_out():
    """Nyström and ridge by plain loops over sets, without the products' shortcuts."""
    rng = random.Random(2)
    texts = [("".join(rng.choice("abcde" if k % 2 else "cdefg") for _ in range(30)), "xy"[k % 2]) for k in range(24)]
    sets = [langid.Grams().present(t) for t, _ in texts]
    model = langid.fit_sets(sets, [x for _, x in texts], landmarks=4)
    known = set(model.grams.tolist())
    chosen = []
    for k, name in enumerate(model.languages):
        own = sorted((i for i in range(24) if texts[i][1] == name), key=lambda i: (len(sets[i]), i))
        chosen += [own[i] for i in np.unique(np.linspace(0, len(own) - 1, 4).astype(int))]
    limited = [set(s.tolist()) & known for s in sets]
    kernel = np.array([[len(a & limited[j]) / np.sqrt(len(a) * len(limited[j])) for j in chosen] for a in limited])
    value, vector = np.linalg.eigh(kernel[chosen])
    z = kernel @ vector / np.sqrt(value)
    target = np.array([[1.0 if x == name else -1.0 for name in model.languages] for _, x in texts])
    want = z @ np.linalg.solve(z.T @ z + langid.RIDGE * 24 * np.eye(8), z.T @ target)
    presence = np.array([[g in s for g in model.grams.tolist()] for s in limited], float)
    assert np.allclose(model.values(presence.sum(axis=1), presence @ model.weights), want, atol=1e-3)


def language_rows(rng, n):
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    kinds = {"aa": "abcdeé", "bb": "efghiñ", "cc": "ijklmß"}
    return [(i, " ".join(word(kinds[x]) for _ in range(rng.randint(3, 60))), x) for i in range(n) for x in [rng.choice(list(kinds))]]


def test_language_id_learns_and_takes_edges(spark):
    rng = random.Random(6)
    rows = language_rows(rng, 600)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(300)]
    rows += [(None, "zzzz", "dd"), (2000, None, "aa"), (2001, "", None), (2002, "12 !?", "bb"), (2003, "abcdeé " * 90_000, "aa"), (2004, "abc", None)]
    df = spark.createDataFrame([(*r, "x", 2.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit(df, rows=100)
    assert model.languages == ("aa", "bb", "cc")
    got = langid.with_language(df, model).collect()
    assert Counter(r["row"]["doc_id"] for r in got) == Counter(r[0] for r in rows)
    truth = {i: x for i, _, x in rows}
    held = [r for r in got if r["row"]["doc_id"] and zlib.crc32(str(r["row"]["doc_id"]).encode()) % 4 == 2 and r["row"]["doc_id"] < 1000]
    assert np.mean([r["lang_pred"] == truth[r["row"]["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["row"]["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (2000, 2001, 2002))
    assert by_id[2003]["lang_pred"] == "aa"
    assert langid.with_language(df.where("false"), model).count() == 0
    nothing = langid.fit(df.where("lang is null"))
    assert {(r["lang_pred"], r["score"]) for r in langid.with_language(df, nothing).collect()} == {("und", 0.0)}
    one = langid.with_language(df, langid.fit(df.where("lang = 'aa'"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("und", 0.0), ("aa", 1.0)}
    # What may not be learned is not: other labels of held-out rows change nothing.
    again = langid.fit(df.withColumn("lang", F.when(langid.held_out(df.doc_id), "zz").otherwise(df.lang)), rows=100)
    assert again.languages == model.languages and np.array_equal(again.weights, model.weights)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_language_query_over_the_whole_table(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}
    got = QUERIES["op13_language_id"](spark, str(DATA)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(docs.keys())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95
