"""The pipeline, stage by stage, against brute force on each stage's own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from airflux.llm import langid, quality  # noqa: E402

from .test_text_operators import base_figures, cut, groups, reference_ids, removed, texts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k, t, "fr" if k % 4 == 1 else "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts())]
    rows += [rows[20], (None, "words of a row that has no key at all but is long enough to stay", "en", None, 60)]
    # Rows that share a doc_id, or have none, with texts of their own: clean ones stay beside bad ones.
    rows += [(None, "too short", "en", None, 9), (7, rows[12][1], "en", "s", 1), (12, "a quite different text under a key that another row has already, long enough", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{root}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, len(rows), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """(rows in, rows out) of each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def key(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_columns(stages):
    for name, (_, _, before, after) in stages.items():
        assert set(before) == set(SCHEMA.replace(",", "").split()[::2])
        assert name == "best_fit_packing" or set(after) == set(before)


def test_quality(stages):
    before, after, *_ = stages["quality_rules"]
    gone = key(before) - key(after)
    assert not key(after) - key(before)
    failed = [(r["doc_id"], r["text"]) for r in before if (lambda f: f[0] < 10 or 100 * f[4] > 20 * f[0])(base_figures(r["text"]))]
    assert all(gone[r] == n for r, n in Counter(failed).items())
    # The other verdicts: log-likelihood ratios from the definitions.
    xxhash, buckets = pytest.importorskip("xxhash"), quality.BUCKETS
    h = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed=seed)

    def grams(t):
        hs = [h(x.encode()) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        pairs = [h(b.to_bytes(8, "little"), seed=h(a.to_bytes(8, "little"))) for a, b in zip(hs, hs[1:])]
        return [(x - (1 << 64) * (x >> 63)) % buckets for x in hs + pairs]

    raw, target = Counter(), Counter()
    for r in before:
        raw.update(grams(r["text"]))
        if r["doc_id"] is not None and r["doc_id"] % 2 == 0:
            target.update(grams(r["text"]))
    mass, n_raw, n_target = quality.PRIOR * buckets, sum(raw.values()), sum(target.values())
    for r in before:
        g = grams(r["text"])
        if (r["doc_id"], r["text"]) not in failed:
            score = np.mean([np.log((target[b] / raw[b] * n_raw + mass) / (n_target + mass)) for b in g])
            assert abs(score - quality.THRESHOLD) > 1e-9 and ((r["doc_id"], r["text"]) in gone) == (score < quality.THRESHOLD)


def test_language(stages):
    before, after, *_ = stages["language_id"]
    for r in before:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert letters or r not in after
    assert not key(after) - key(before) and len(after) >= 0.9 * len(before)
    assert corpus_pipeline.LEAST_SHARE < 0.5 and langid.UNDETERMINED == "und"


def test_near_duplicates(stages):
    before, after, *_ = stages["near_duplicates"]
    numbered = [(k, r["text"]) for k, r in enumerate(before)]
    members = {}
    for k, (_, root) in groups([(*n, "", "", 0) for n in numbered], 5, 80).items():
        members.setdefault(root, []).append(k)
    left = key(after)
    assert not left - key(before) and sum(left.values()) == len(members)
    for ks in members.values():
        ids = [before[k]["doc_id"] for k in ks]
        least = min((d for d in ids if d is not None), default=None)
        assert any(left[(least, before[k]["text"])] for k in ks if before[k]["doc_id"] == least)


def test_repeated_strings(stages):
    before, after, *_ = stages["suffix_array_dedup"]
    rows = [tuple(r) for r in before]
    if all(r[0] is not None for r in rows):
        rows.append((None, ""))
    want = removed(rows, 50)
    assert len(after) == len(before)
    for r in after:
        assert r["text"] == want[r["doc_id"]][4].decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])


def test_packing(stages):
    before, after, *_ = stages["best_fit_packing"]
    want = Counter()
    for doc, ids in reference_ids([tuple(r) for r in before]):
        for k, (s, part) in enumerate(cut(ids, 2048)):
            want[(doc, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want


def test_run(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages["best_fit_packing"][1])


def test_no_rows_and_other_columns(spark, folder, stages):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.withColumns({c: docs["doc_id"] for c in ("row", "vertex", "root", "__id", "__hash", "kept", "n", "text_hash", "score")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, more.limit(0), folder).count() == 0, name
        assert stage(spark, more, folder).columns == docs.columns, name
    assert corpus_pipeline.best_fit_packing(spark, more.limit(0), folder).count() == 0
    assert key(corpus_pipeline.near_duplicates(spark, more, folder).collect()) == key(corpus_pipeline.near_duplicates(spark, docs, folder).collect())


def test_near_pairs_without_own_ids(spark, folder):
    """Near texts of rows with null doc_ids, with one doc_id, and repeated: one of each group stays."""
    base = lambda k: " ".join(f"{k}w{j}" for j in range(200))
    rows = [(None, base(1)), (None, base(1) + " more"), (7, base(2)), (7, base(2) + " more"), (7, base(2) + " else"), (None, base(3)), (4, base(3) + " more"), (9, "alone here"), (None, base(4)), (None, base(4)), (None, base(4) + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()]
    groups = sorted(t.split()[0] for _, t in got)
    assert groups == ["1w0", "2w0", "3w0", "4w0", "alone"]
    assert (4, base(3) + " more") in got and (9, "alone here") in got
