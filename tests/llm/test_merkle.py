"""The Merkle manifest against a plain version of the tree, at several sizes of block."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from airflux.llm import merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, pos string, hash string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[a : a + 8]) for a in range(0, len(last), 8)])
    return levels


def way(levels, p):
    out = []
    for last in levels[:-1]:
        a = p - p % 8
        out.append(("".join(last[a:p]), "".join(last[p + 1 : a + 8])))
        p //= 8
    return out


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    by = defaultdict(list)
    for i, text, lang, source, n, *_ in rows:
        third = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        by[lang].append((i is not None, i or 0, enc(i, source, lang, n, text), enc(i, source, lang, n, lower(text) if third else text), i))
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(by[k])]) for k in order}
    top = tree([trees[k][-1][0] for k in order])
    root, out = top[-1][0] if order else None, []
    for g, k in enumerate(order):
        for p, (_, _, own, given, i) in enumerate(sorted(by[k])):
            steps = way(trees[k], p) + way(top, g)
            folded = given
            for left, right in steps:
                folded = H(left, folded, right)
            out.append((i, own, trees[k][-1][0], root, H(*(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=str)


def some(n, langs, seed):
    rng = random.Random(seed)
    texts = ["Aa bB", "plain", "ÀÉ Z", "", None, "x" * 3000, "漢字 A", "a\nB"]
    pick = lambda: rng.choice(langs) if rng.random() < 0.6 else langs[0]
    return [(k * 3 - 7, rng.choice(texts), pick(), rng.choice(["web", None, "é"]), rng.choice([None, k]), "k", "p", "h") for k in range(n)]


@pytest.mark.parametrize("n, langs, tier", [(700, ["en", None, "", "=", "zz", "é", "de"], 1), (700, ["en", "de"], 2), (90, [f"l{k}" for k in range(30)], 5), (9, ["en"], 5), (1, ["en"], 5), (65, ["en", "x"], 1)])
def test_against_plain_tree(spark, n, langs, tier):
    rows = some(n, langs, n)
    rng = random.Random(1)
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    third = merkle.F.crc32(merkle.F.col("doc_id").cast("string")) % 3 == 0
    got = merkle.merkle_manifest(docs, merkle.F.when(third, merkle.lowered(merkle.F.col("text"))).otherwise(merkle.F.col("text")), tier).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [*some(20, ["en", None], 2), (None, "A", "en", "s", 1, "", "", ""), (None, None, "en", None, None, "", "", "")]
    rows += [rows[4], rows[4]]
    got = merkle.manifest_check(spark.createDataFrame(rows, KIND))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert merkle.manifest_check(spark.createDataFrame([], KIND)).count() == 0


def test_unchanged_rows_verify(spark):
    docs = spark.createDataFrame(some(300, ["en", "de", None], 4), KIND)
    assert merkle.merkle_manifest(docs).where("not verified").count() == 0


def test_ragged_ends_meet(spark):
    """Runs that end anywhere give the same levels as one run."""
    rows = [("k", p, 100, H(str(p))) for p in range(100)]
    whole = tree([r[3] for r in rows])
    for parts in (1, 7):
        nodes = spark.createDataFrame(rows, "key string, pos long, total long, hash string").repartition(parts)
        got = {r["pos"]: r["hash"] for r in merkle.next_level(nodes, 0).collect()}
        assert [got[p] for p in sorted(got)] == whole[1]
