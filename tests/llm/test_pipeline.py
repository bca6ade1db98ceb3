"""The pipeline's stages, and the queries of this subpackage beside their SQL."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from assayframe.llm import classifier, neardup, quality_rules
from assayframe.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


def brute_components(texts):
    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fp(t) for t in texts]
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= neardup.REACH:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return fps, group


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, str(DATA))
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    want = Counter(tuple(row[i] for i in at) for row in cursor.fetchall())
    assert Counter(tuple(r[c] for c in order) for r in df.collect()) == want


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns, rows = docs.columns, docs.count()
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(DATA))
    assert first.columns == columns and 0 < first.count() < rows
    third = corpus_pipeline.STAGES[2][1](spark, docs, str(DATA))
    assert third.columns == columns and 0 < third.count() < rows


def test_run_equals_a_pipeline_by_hand(spark):
    """Rules by SQL, the model's scores, near-duplicates by all pairs, pieces by the library."""
    docs, labels = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(texts) == docs.count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    kept = {d for d, k in con.execute(quality_rules.oracle() + " SELECT doc_id, kept FROM judged").fetchall() if k}
    model = classifier.fit(docs, labels)
    score = {r["row"]["doc_id"]: r["score"] for r in classifier.scored(docs, model, keep=["doc_id"]).collect()}
    good = sorted(d for d in kept if score[d] >= classifier.THRESHOLD)
    fps, group = brute_components([texts[d] for d in good])
    del fps
    last = {g: {good[i] for i in range(len(good)) if group[i] == g} for g in set(group)}
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    left = {r["doc_id"] for r in got}
    assert len(left) == len(last) and all(len(left & members) == 1 for members in last.values())
    tok, want, sequences = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter(), defaultdict(list)
    for doc in left:
        ids = np.array([*tok.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[doc, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(places)]])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 4096


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"
    odd = [(None, None, None, None, None, None), (1, "", "en", None, 0, 1.0), (1, "x " * 50_000, None, "a", 5, None), (1, "", "en", None, 0, 1.0)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        model = classifier.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
        assert quality_rules.keep_good(docs).columns == docs.columns
        assert classifier.keep_good(docs, model, of_corpus=True).columns == docs.columns
        assert neardup.one_of_each(docs).columns == docs.columns
        packed = corpus_pipeline.STAGES[3][1](spark, docs, str(DATA))
        assert {r["doc_id"] for r in packed.collect()} == {r[0] for r in rows}


def test_classifier_query_equals_the_operator_and_holds_out(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in QUERIES["op5_quality_classifier"](spark, str(DATA)).collect()}
    # Other labels of held-out rows change no score.
    changed = labels.withColumn("quality", F.when(classifier.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    score = {r["row"]["doc_id"]: r["score"] for r in classifier.scored(docs, classifier.fit(docs, changed), keep=["doc_id"]).collect()}
    assert set(got) == set(score)
    for doc, r in got.items():
        assert r["score"] == score[doc] and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2)


def test_byte_bpe_query_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for doc, text in _texts(spark):
        ids = coder.encode_ordinary(text)
        want.add((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = QUERIES["op6_byte_bpe"](spark, str(DATA)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_shard_query_keeps_its_law(spark):
    got = QUERIES["op10_kd_tree_shards"](spark, str(DATA)).collect()
    texts = dict(_texts(spark))
    assert Counter(r["doc_id"] for r in got) == Counter(texts.keys())
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)


def _texts(spark):
    rows = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"] or "") for r in rows]


def test_packing_query_holds_every_piece(spark):
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for doc, text in _texts(spark):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = QUERIES["op4_best_fit_packing"](spark, str(DATA)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_token_count_query_equals_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for doc, text in _texts(spark):
        n = len(model.encode(text))
        want[doc, len(text.encode()), n, n > 4096] += 1
    got = QUERIES["op7_token_counts"](spark, str(DATA)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_near_dedup_query_groups_like_all_pairs(spark):
    got = QUERIES["op9_simhash_near_dedup"](spark, str(DATA)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(doc for doc, _ in _texts(spark))
    fps = sorted({int(r["fingerprint"], 16) for r in got})
    root = {fp: fp for fp in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= neardup.REACH:
                root[top(a)] = top(b)
    least = {}
    for r in got:
        at = top(int(r["fingerprint"], 16))
        least[at] = min(least.get(at, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least[top(int(r["fingerprint"], 16))] for r in got)
