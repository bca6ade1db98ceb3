"""The as-of join of URL lists when most captures look up the same keys."""

from __future__ import annotations

import random

import pytest

from assayframe.llm import url_lists
from assayframe.llm.url_lists import STRENGTH, filter_captures

DAY = 86_400


def verdict(bare, at, entries):
    """Plain loop: the deepest, then longest key in force."""
    host, *path = bare.split("/")
    labels = host.split(".")
    keys = {".".join(labels[i:]) for i in range(len(labels))} | {"/".join([host, *path[:d]]) for d in range(1, len(path) + 1)}
    best = None
    for key in keys:
        log = {}
        for k, since, action in entries:
            if k == key and since is not None and action in STRENGTH and since <= at:
                log[since] = max(log.get(since, -1), STRENGTH[action])
        if log and log[max(log)] > 0:
            found = (key.count("/"), len(key), key, log[max(log)], max(log))
            best = max(best or found, found)
    return ("none", None, None) if best is None else ({2: "block", 1: "allow"}[best[3]], best[2], best[4])


@pytest.mark.parametrize("share", [3, 1000])
def test_hot_suffixes_and_repeated_captures(spark, monkeypatch, share):
    rng = random.Random(5)
    actions = ["block", "allow", "remove", None]
    keys = ["com", "hot.com", "a.hot.com", "hot.com/x", "hot.com/x/y", "net", None]
    entries = [(rng.choice(keys), rng.choice([None, rng.randrange(0, 200 * DAY), 30 * DAY]), rng.choice(actions)) for _ in range(90)]
    hosts = ["hot.com"] * 6 + ["a.hot.com", "b.org", "c.net", "d.e.com"]
    borders = [30 * DAY - 1, 30 * DAY, 30 * DAY + 1, 60 * DAY]
    captures = [
        (i, f"http://{rng.choice(hosts)}{rng.choice(['', '/x', '/x/y', '/z'])}", rng.choice([*borders, rng.randrange(0, 200 * DAY)]))
        for i in range(160)
    ]
    captures += [(1000 + i, "https://hot.com/x/y", 45 * DAY) for i in range(120)]
    captures += [(2000, None, 5), (2001, "http://hot.com", None), (2002, "", 45 * DAY)]
    monkeypatch.setattr(url_lists.hot_cells, "__defaults__", (share,))
    monkeypatch.setattr(url_lists.active_entries, "__defaults__", (share,))
    # Names that the operator uses itself are a caller's own columns here.
    asked = spark.createDataFrame(captures, "n long, url string, at long").selectExpr("n", "url", "at", "n as slices", "'k' as key", "at as fetched_at")
    listed = spark.createDataFrame(entries, "key string, listed_at long, action string")
    got = filter_captures(asked, listed).select("row.n", "verdict", "matched_key", "listed_at").collect()
    clean = [e for e in entries if e[0] is not None]
    want = {
        n: ("none", None, None) if url is None or at is None else verdict(url.split("://")[-1], at, clean)
        for n, url, at in captures
    }
    assert len(got) == len(captures)
    assert {r["n"]: tuple(r)[1:] for r in got} == want


def test_hot_look_ups_are_few_and_unlisted_ones_go_no_further(spark):
    looked = spark.range(1000).selectExpr(
        "cast(id as string) as bare", "id as at", "0L as bucket",
        "case when id % 2 = 0 then 'com' when id % 4 = 1 then 'org' else concat('k', id) end as key",
    )
    cells = spark.createDataFrame([("com", 0, 2, 0, None), ("k3", 0, 2, 0, None)], "key string, bucket long, strength int, since long, until long")
    hot = {r["key"]: r["slices"] for r in url_lists.hot_cells(looked, cells, 10).collect()}
    assert hot == {"com": 5, "org": 0}
    active = url_lists.active_entries(looked, cells, 10)
    assert active.count() == 501
    assert active.where("key = 'com'").select("slice").distinct().count() == 5


def test_an_empty_list_and_an_empty_table(spark):
    asked = spark.createDataFrame([(1, "http://a.com", 5)], "n long, url string, fetched_at long")
    listed = spark.createDataFrame([("a.com", 1, "block")], "key string, listed_at long, action string")
    assert [r["verdict"] for r in filter_captures(asked, listed.limit(0)).collect()] == ["none"]
    assert filter_captures(asked.limit(0), listed).count() == 0
