"""Exact deduplication against a brute-force version, at several numbers of counters."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from airflux.llm import exact

KIND = "doc_id long, text string, row string, h string, first string"


def brute(rows):
    by = defaultdict(list)
    for k, (i, text, *_) in enumerate(rows):
        by[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), i is None, i or 0, k))
    out = {}
    for key, members in by.items():
        best = min(members)
        for _, _, _, k in members:
            out[k] = (rows[k][0], rows[best[3]][0], len(members), hashlib.sha256(key.encode()).hexdigest())
    return Counter(out.values()), len(by)


def some(n, seed):
    rng = random.Random(seed)
    texts = ["a b c", "abc", "ab c\n", "a\x0bbc", "a b c", "", None, " \t", "é é", "éé", "a bc", "x" * 50_000, "x " * 50_000]
    rows = [(k, rng.choice(texts[:6] if rng.random() < 0.5 else texts), "r", "h", "f") for k in range(n)]
    rows += [(k, f"text {k % 40}", "r", "h", "f") for k in range(n, 2 * n)]
    return rows + [(None, "abc", "r", None, None), (None, "only here", None, None, None), (3, rows[3][1], "r", "h", "f"), (None, "only here", None, None, None)]


@pytest.mark.parametrize("counters", [1, 2, 7, 512])
def test_groups(spark, counters):
    rows = some(120, counters)
    want, n = brute(rows)
    got = exact.exact_groups(spark.createDataFrame(rows, KIND).repartition(5), counters).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == n
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("counters", [1, 512])
def test_rows_that_stay(spark, counters):
    rows = some(120, 5)
    docs = spark.createDataFrame(rows, KIND)
    left = exact.without_copies(docs, counters)
    assert left.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    keys = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in got]
    assert len(keys) == len(set(keys)) == brute(rows)[1]
    longest = defaultdict(lambda: (1, True, 0))
    for i, t, *_ in rows:
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        longest[key] = min(longest[key], (-len(t or ""), i is None, i or 0))
    assert all((-len(t or ""), i is None, i or 0) == longest[k] for (i, t), k in zip(got, keys))


def test_frequent_digests_are_found(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"cold {k}", "", "", "") for k in range(3000)]
    table = exact.digests(spark.createDataFrame(rows, KIND).repartition(7))
    heavy = exact.frequent(table, 4).collect()
    assert any(r["group_size"] == 1000 and r["first"]["doc_id"] == 0 for r in heavy)
    plan = exact.settled(table, exact.frequent(table, 4))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    assert exact.exact_groups(none).count() == 0 and exact.without_copies(none).count() == 0
