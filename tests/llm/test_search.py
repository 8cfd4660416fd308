"""Ranked search against scores of all pairs, and the branch and bound's own promises."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from airflux.llm import search

DOCS, ASKED = "doc_id long, text string, item_id string, score string, n string", "item_id long, text string, doc_id string, term string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, asked, top=10):
    held = [(i, Counter(terms_of(t))) for i, t, *_ in docs]
    held = [(i, c) for i, c in held if c]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    want = {}
    for item, text, *_ in asked:
        want.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in want.items():
        scored = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Été", "漢字", "ABC", "x1y", "a_b", "don't"]
    text = lambda k: rng.choice([" ", ", ", "\n", "_"]).join(rng.choice(words) for _ in range(k))
    docs = [(k * 7 % n, text(rng.choice([0, 1, 3, 20, 80])), "i", "s", "n") for k in range(n)]
    docs += [(docs[3][0], docs[3][1], "", "", ""), (None, "w1 w2 Été", "", "", ""), (n + 1, None, "", "", ""), (n + 2, " .,", "", "", ""), (n + 3, text(9000), "", "", "")]
    docs += [(n + 10 + k, "same words here w5", "", "", "") for k in range(30)]
    asked = [(k, text(12), "", "") for k in range(12)] + [(50, "same words", "", ""), (51, "nowhere", "", ""), (52, None, "", ""), (53, "", "", ""), (None, "w3 été", "", ""), (0, "w7", "", "")]
    return docs, asked


@pytest.mark.parametrize("n, parts, most_terms, local", [(300, 3, 1 << 18, 1 << 13), (300, 2, 40, 20), (5000, 1, 1 << 18, 64)])
def test_against_all_pairs(spark, monkeypatch, n, parts, most_terms, local):
    monkeypatch.setattr(search, "LOCAL_TERMS", local)
    docs, asked = corpus(n, n)
    got = search.ranked_search(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(asked, ASKED), most_terms=most_terms)
    assert dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, asked)


def test_empty(spark):
    none, asked = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "", "")], ASKED)
    assert search.ranked_search(none, asked).count() == 0
    assert search.ranked_search(spark.createDataFrame([(1, "a", "", "", "")], DOCS), asked.limit(0)).count() == 0


def test_nodes_are_opened_best_first_and_equals_too(spark):
    """Bounds never rise while nodes are opened, cover what lies below, and what equals the last of the best is opened."""
    rng = np.random.default_rng(3)
    rows = [(k, 5, sorted(rng.choice(40, 4, replace=False).tolist()), [1, 2, 1, 1]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n long, terms array<int>, tfs array<int>").coalesce(1)
    weight = np.arange(1, 41, dtype=np.int64)
    out = search.index(df, 3000, 15000).toArrow().combine_chunks().to_batches()[0]
    shard = search.Shard(out, 0, weight)
    shard.dense(np.arange(40))
    for tree, upper in zip(shard.trees, shard.trees[1:]):
        assert (tree.reshape(40, -1, 8).max(axis=2) == upper).all()
    terms, found, seen = np.array([1, 7, 30]), [], []
    shard.best(terms, found, 0, 10, seen)
    bounds = [b for b, _, _ in seen]
    assert bounds == sorted(bounds, reverse=True) and bounds[-1] >= min(found)[0]
    total = np.zeros(512, np.int64)
    used = np.isin(shard.terms, terms)
    np.add.at(total, np.repeat(np.arange(512), np.diff(shard.at))[used], (weight[shard.terms] * shard.gains)[used])
    want = sorted(((int(s), -i, 0) for i, s in enumerate(total) if s > 0), reverse=True)[:10]
    assert sorted(found, reverse=True) == want
    opened = {n for _, level, n in seen if level == 0}
    assert {int(i) // 8 for i in np.flatnonzero(total >= want[-1][0])} <= opened
    assert len(opened) < 512 // 8
