"""Operators over documents against brute force, on small tables with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from airflux.llm import hilbert, hyperminhash, langid, ogg, packing, pieces, quality, repeats, urls  # noqa: E402
from airflux.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, vertex long, text_crc32 int, hub int"


def words(rng, n, size=4):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, size))) for _ in range(n)]


def texts():
    """Nulls, empties, blanks, ties, copies, near copies, shared passages, repeated lines, odd characters, one long text."""
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(40)]
    out = [None, "", " \n\t ", "one", "one two three", "a b c d", "a b c d", " 　 x y", "<|endoftext|> hi", "a  <|endoftext|>  b\n\n c<|endoftext|>d \n", " \x85\u3000 x\u00a0 y \u2028\n z", "né 東京 שלום \U0001f600  end ", "▁ under"]
    out += base
    out += base[:5] + [base[7], base[7]]
    for b in base[5:25]:
        w = b.split(" ")
        for _ in range(2):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    passage = " ".join(words(rng, 30))
    out += [f"{a} {passage} {b}" for a, b in zip(base[:12], base[12:24])]
    out += ["\n".join([base[3]] * 3 + ["", base[4], base[3]]), "ab " * 300, "x" * 700, "é" * 120, "é" * 119 + "z"]
    out.append(" ".join(words(rng, 9000)))
    out += [passage[:49], passage[:50], passage[5:60], "A  B\x0bC\x0cD\rE  F G"]
    return out


@pytest.fixture(scope="module")
def table():
    rng = random.Random(2)
    rows = []
    for k, t in enumerate(texts()):
        rows.append((k * 3 + 1, t, rng.choice(["en", "fr", None]), rng.choice(["s0", None, "s1"]), 0, "r", 7, 1, 2))
    rows.append(rows[20])  # the same row again
    rows.append((None, "a row without a key " * 5, None, None, None, None, None, None, None))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


# --- 1 ---------------------------------------------------------------------------------------------


def base_figures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark, docs, table):
    xxhash = pytest.importorskip("xxhash")
    ids = sorted({r[0] for r in table if r[0] is not None})
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 5 == 0), 1) for i in ids] + [(None, 1, 0, 1)], "doc_id long, quality int, toxic int, extra int")
    buckets, trusted = 64, 20
    got = quality.quality_rules(docs, labels, buckets, trusted, -0.05)

    def h(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed=seed)

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        hs = [h(x.encode()) for x in w]
        ones = [signed(x) % buckets for x in hs]
        # a second column is hashed with the hash of the first as its seed
        pairs = [signed(h(b.to_bytes(8, "little"), seed=h(a.to_bytes(8, "little")))) % buckets for a, b in zip(hs, hs[1:])]
        return ones + pairs

    chosen = sorted((i for i in ids if i % 2 and i % 5), key=lambda i: (signed(h((i % (1 << 64)).to_bytes(8, "little"))), i))[:trusted]
    raw, target = Counter(), Counter()
    for r in table:
        g = grams(r[1])
        raw.update(g)
        if r[0] in chosen:
            target.update(g)
    total_raw, total_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    weight = [np.log((target[b] + 1) / total_target) - np.log((raw[b] + 1) / total_raw) for b in range(buckets)]
    found = by_id(got)
    assert sum(map(len, found.values())) == len(table)
    for r in table:
        row = next(x for x in found[r[0]])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == base_figures(r[1]), r[0]
        g = grams(r[1])
        score = np.mean([weight[b] for b in g]) if g else 0.0
        assert row["score"] == pytest.approx(score, abs=1e-9)
        failed = row["n_words"] < 10 or 100 * row["n_repeat_words"] > 20 * row["n_words"]
        assert row["base_failed"] == failed
        if abs(score + 0.05) > 1e-9:
            assert row["kept"] == (not failed and score >= -0.05)


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(none, labels, 16).count() == 0
    assert {r["score"] for r in quality.quality_rules(docs, labels, 16).collect()} == {0.0}


# --- 2, 8 ------------------------------------------------------------------------------------------


def reference_ids(table, ordinary=False):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.encode_special_tokens = ordinary
    return [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in table]


def cut(ids, capacity):
    head = len(ids) % capacity or capacity
    if len(ids) <= capacity:
        return [(0, ids)]
    return [(0, ids[:head])] + [(s, ids[s : s + capacity]) for s in range(head, len(ids), capacity)]


@pytest.mark.parametrize("capacity", [256, 2048])
def test_vector_packing(docs, none, table, capacity):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.best_fit_packing(docs, path, capacity).collect()
    want = Counter()
    for doc, ids in reference_ids(table):
        for k, (s, part) in enumerate(cut(ids, capacity)):
            want[(doc, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(seqs) <= -(-total // capacity) + 1
    assert packing.best_fit_packing(none, path, capacity).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(0)
    n = rng.integers(1, 100, 500).astype(float)
    demand = np.column_stack([n, np.ones(500), n * n])
    cap = np.array([100.0, 5.0, 6000.0])
    demand[:, 2] = np.minimum(demand[:, 2], 6000)
    put, opened = packing.vector_best_fit(demand, cap, np.array([1.0, 0.1, 0.1]), rule)
    sums = np.zeros((opened, 3))
    np.add.at(sums, put, demand)
    assert (sums <= cap + 1e-6).all() and set(put) == set(range(opened))
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([[101.0, 1, 1]]), cap, np.ones(3))


def test_segment_tree_is_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, 80)
        put, opened = packing.best_fit_decreasing(lengths, capacity)
        rooms = []
        for i in np.lexsort((np.arange(80), -lengths)):
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= lengths[i]
            else:
                rooms.append(capacity - lengths[i])
        got = sorted(capacity - np.bincount(put, weights=lengths, minlength=opened).astype(int))
        assert got == sorted(rooms)


@pytest.mark.parametrize("capacity, window", [(128, 16), (2048, 8192)])
def test_packed_matrices_round_trip(docs, none, table, capacity, window):
    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    packed = packing.packed_matrices(docs, path, capacity, window)
    rows = packed.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        ids, pos = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        cum = r["cu_seqlens"]
        assert len(ids) == len(pos) == capacity and cum[0] == 0 and cum[-1] == r["n_tokens"] <= capacity
        assert len(cum) == len(r["doc_ids"]) + 1 and not ids[cum[-1] :].any()
        for a, b in zip(cum, cum[1:]):
            assert (pos[a:b] == np.arange(b - a)).all()
        assert (pos[cum[-1] :] == np.arange(capacity - cum[-1])).all()
    want = Counter((doc, k, s, np.array(part, "<u2").tobytes()) for doc, ids in reference_ids(table, ordinary=True) for k, (s, part) in enumerate(cut(ids, capacity)))
    back = packing.unpacked(packed).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in back) == want
    assert packing.packed_matrices(none, path).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)])


def groups(table, width, percent):
    sets = [(r[0], shingles(r[1], width)) for r in table if r[0] is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("width, percent, block", [(4, 80, 256), (5, 80, 2), (2, 85, 3)])
def test_near_duplicates(docs, none, table, width, percent, block):
    got = hyperminhash.near_duplicates(docs, width, percent, block).collect()
    want = groups(table, width, percent)
    assert len(got) == len(table)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert hyperminhash.near_duplicates(none).count() == 0


def test_links_in_block_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 14, rng.integers(1, 12))).astype(np.uint64) for _ in range(12)]
        roots = rng.integers(0, 6, 12)
        got = hyperminhash.links_in_block(sets, roots, 60, step=5)
        py = [set(x.tolist()) for x in sets]
        near = [(i, j) for i in range(12) for j in range(i + 1, 12) if 100 * len(py[i] & py[j]) >= 60 * len(py[i] | py[j])]
        assert set(got) <= set(near)

        def classes(pairs):
            label = list(roots)
            for _ in range(12):
                for i, j in pairs:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
            return label

        assert classes(got) == classes(near)


def test_registers_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for share in (0.3, 0.6, 0.9):
        k = int(2000 * 2 * share / (1 + share))
        a, b = np.sort(pool[:2000]), np.sort(np.append(pool[2000 - k : 2000], pool[2000 : 4000 - k]))
        b = np.sort(np.append(pool[2000 - k : 2000], rng.integers(0, 1 << 63, 2000 - k).astype(np.uint64)))
        regs = hyperminhash.registers_of(np.append(a, b), np.array([0, len(a), len(a) + len(b)]))
        j, error = hyperminhash.estimate(regs[:1], regs[1:], np.array([2000]), np.array([len(b)]))
        true = k / (4000 - k)
        assert abs(j[0] - true) < 5 * error[0]


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 3)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {v: got[v] for v in (1, 2, 3, 7, 8)} == dict.fromkeys((1, 2, 3, 7, 8), 1)
    assert got[5] == got[4] == 4 and {got[v] for v in range(100, 141)} == {100} and 9 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------


def test_pieces_against_plain_viterbi(docs, none, table):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    listed, by_byte, _ = pieces.read_pieces(path)
    score = {p: (s, i) for p, s, i in listed}
    longest = max(map(len, score))
    unknown = min(s for _, s, _ in listed) - 10

    def plain(text):
        s = ("▁" + text.replace(" ", "▁")) if text else ""
        best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
        for e in range(1, len(s) + 1):
            for n in range(min(longest, e), 0, -1):
                p = score.get(s[e - n : e])
                if p and best[e - n] + p[0] > best[e]:
                    best[e], back[e] = best[e - n] + p[0], (n, [p[1]])
            if s[e - 1] not in score and best[e - 1] + unknown > best[e]:
                best[e], back[e] = best[e - 1] + unknown, (1, [by_byte[b] for b in s[e - 1].encode()])
        out, e = [], len(s)
        while e:
            n, ids = back[e]
            out[:0] = ids
            e -= n
        return out

    got = pieces.round_trip(docs, path).collect()
    want = {r[0]: r[1] or "" for r in table}
    for r in got:
        text = want[r["doc_id"]]
        assert r["exact"] == ("▁" not in text)
        assert r["n_ids"] == len(r["ids"])
        if len(text) < 3000:
            assert list(r["ids"]) == plain(text), text[:50]
    assert pieces.round_trip(none, path).count() == 0
    again = pieces.decoded(pieces.encoded(docs, path), path)
    assert {(r["doc_id"], r["text"]) for r in again.collect()} == {(d, t.replace("▁", " ")) for d, t in want.items()}


# --- 6 ---------------------------------------------------------------------------------------------


def test_hilbert_curve_is_continuous(spark):
    for n, bits in ((2, 3), (3, 2), (3, 4), (2, 1)):
        side = 1 << bits
        df = spark.range(side**n).select(*(F.expr(f"(id div {side**k}) % {side}").alias(f"d{k}") for k in range(n)))
        rows = df.withColumn("h", hilbert.hilbert_index([F.col(f"d{k}") for k in range(n)], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(side**n))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[k] - b[k]) for k in range(n)) == 1


def test_shards(docs, none, table):
    rows = hilbert.hilbert_shards(docs, 16).collect()
    assert len(rows) == len(table)
    count = Counter(r["shard"] for r in rows)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(count[s]))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in table)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in rows)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    assert hilbert.hilbert_shards(none).count() == 0


def test_shards_are_pruned(spark):
    rng = random.Random(8)
    rows = [(k, "x" * int(2 ** rng.uniform(0, 12)), f"s{min(int(rng.expovariate(0.2)), 29):02d}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {r[0]: r[2] for r in rows}
    got = hilbert.hilbert_shards(df).collect()
    dims = [lambda r: source[r["doc_id"]], lambda r: r["size"], lambda r: r["doc_id"]]
    skipped = []
    for value in dims:
        ends = {}
        for r in got:
            low, high = ends.get(r["shard"], (value(r), value(r)))
            ends[r["shard"]] = (min(low, value(r)), max(high, value(r)))
        wanted = sorted(map(value, got))[:: len(got) // 40]  # equality with common and rare values
        skipped.append(np.mean([not low <= w <= high for w in wanted for low, high in ends.values()]))
    assert min(skipped) > 0.25 and np.mean(skipped) > 0.4, skipped
    few = hilbert.hilbert_shards(df.limit(3).withColumn("source", F.lit(None).cast("string")))
    assert sorted(r["slot"] for r in few.collect()) == [0, 0, 0]


# --- 7 ---------------------------------------------------------------------------------------------


def removed(table, width):
    ids = sorted({r[0] for r in table if r[0] is not None})
    text = {r[0]: (r[1] or "").encode() for r in table}
    seen, out = set(), {}
    for d in [*ids, None]:
        b = text[d]
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                cover[i : i + width] = True
        seen |= {b[i : i + width] for i in range(len(b) - width + 1)}
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = int((cover & ~np.append(False, cover[:-1])).sum())
        out[d] = (len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("width, chunk, common", [(50, 1 << 20, 4096), (50, 1500, 4096), (50, 1500, 1), (50, 1500, 3), (30, 4000, 2)])
def test_repeats(docs, none, table, width, chunk, common):
    got = repeats.removed_repeats(docs, width, keep_text=True, carry=True, common=common, chunk_bytes=chunk).collect()
    want = removed(table, width)
    source = {r[0]: r[3] for r in table}
    assert len(got) == len(table)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == w[:4], r["doc_id"]
        assert r["text"] == w[4].decode("utf-8", "ignore") and r["row"]["source"] == source[r["doc_id"]]
    assert repeats.removed_repeats(none).count() == 0


def test_maximal_repeats_by_brute_force():
    rng = random.Random(9)
    for trial in range(25):
        segments = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 25))) for _ in range(5)]
        codes = np.frombuffer(b"".join(s.encode() + b"\xff" for s in segments), np.uint8)
        last = np.cumsum([len(s) + 1 for s in segments]) - 1
        left_in = np.repeat(last, [len(s) + 1 for s in segments]) - np.arange(len(codes))
        length, count, place = repeats.maximal_repeats(codes, left_in, 3)
        got, at = set(), 0
        for n, k in zip(length, count):
            got.add((int(n), tuple(sorted(place[at : at + k].tolist()))))
            at += k
        where = {}
        for p in range(len(codes)):
            for n in range(3, int(left_in[p]) + 1):
                where.setdefault(codes[p : p + n].tobytes(), []).append(p)
        want = set()
        for s, ps in where.items():
            before = {codes[p - 1] if p and codes[p - 1] != 255 else ("start", p) for p in ps}
            after = {codes[p + len(s)] if codes[p + len(s)] != 255 else ("end", p) for p in ps}
            if len(ps) > 1 and len(before) > 1 and len(after) > 1:
                want.add((len(s), tuple(ps)))
        assert got == want, trial


# --- 9 ---------------------------------------------------------------------------------------------


def plain_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_round_trip(docs, none, table):
    assert ogg.checksum(b"OggS123") == plain_checksum(b"OggS123") and ogg.checksum(b"") == 0
    got = ogg.ogg_features(ogg.with_ogg(docs)).collect()
    text = {r[0]: (r[1] or "").encode() for r in table}
    assert len(got) == len(table)
    by_text = {}
    for r in got:
        data = text[r["doc_id"]]
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        media = ogg.encode(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(data, tuple(r)[1:]) == tuple(r)[1:]
    assert ogg.ogg_features(ogg.with_ogg(none)).count() == 0


def test_ogg_reading_of_damaged_bytes():
    data = bytes(range(32, 127)) * 300
    media = ogg.encode(data)
    box = ogg.read(media)
    assert box.bad == 0 and box.joined > 0 and len(box.streams) == 2 and all(s.ended for s in box.streams.values())
    assert box.pages < sum(len(s.packets) for s in box.streams.values())  # pages on which several packets end
    assert ogg.decode(media)[0] == ogg.padded(data)
    at = media.index(b"OggS", 4000)
    broken = bytearray(media)
    broken[at + 60] ^= 1
    hurt = ogg.read(bytes(broken))
    assert hurt.bad == 1 and sum(s.lost for s in hurt.streams.values()) >= 1
    assert ogg.read(b"noise" + media[:-10]).bad == 1 and ogg.read(b"").pages == 0
    assert ogg.decode(b"")[0] == b""
    # The last page is missing: a packet that had begun before it is lost.
    cut = ogg.read(media[: media.rindex(b"OggS")])
    assert cut.bad == 0 and sum(s.lost for s in cut.streams.values()) == 1


def test_ogg_times_of_packets():
    ident = ogg.IDENT.pack(ogg.MAGIC, ogg.RATE, 400)
    first = ogg.page(ogg.FIRST, 0, 9, 0, bytes([len(ident)]), ident)
    a, b, c = b"a" * 192, b"b" * 192, b"c" * 100
    two = ogg.page(0, 384, 9, 1, bytes([192, 192]), a + b)
    box = ogg.read(first + two + ogg.page(ogg.LAST, 484, 9, 2, bytes([100]), c))
    assert box.streams[9].packets[1:] == [(192, a), (384, b), (484, c)]
    payload, size, feature = ogg.decode(first + two)
    assert payload == a + b and size == 400 and "lost=0" in feature and "times=9:0-48000us" in feature
    # A page without a position goes on from the one before it.
    box = ogg.read(first + two + ogg.page(ogg.LAST, -1, 9, 2, bytes([100]), c))
    assert box.streams[9].packets[-1] == (484, c)
    for n in (0, 1, 191, 192, 193, 959, 960, 961, 4590, 4800, 9600, 33333):
        data = bytes(k % 251 for k in range(n))
        assert ogg.decode(ogg.encode(data))[0] == ogg.padded(data), n
        assert ogg.decode(ogg.encode(data, streams=3))[:2] == (ogg.padded(data), n)


# --- 10 --------------------------------------------------------------------------------------------


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(0)
    from itertools import product

    for _ in range(20):
        n = rng.integers(0, 6, 4)
        first = np.append(0, np.cumsum(n))
        scores = rng.normal(size=(first[-1], 3)).astype(np.float32)
        got = langid.viterbi(scores, first, 0.7)
        for a, b in zip(first, first[1:]):
            value = lambda p: sum(scores[a + k, x] for k, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))
            best = max(value(p) for p in product(range(3), repeat=b - a))
            assert value(got[a:b]) == pytest.approx(best, abs=1e-5)


def test_single_labels_are_those_of_viterbi():
    rng = np.random.default_rng(1)
    single = 0
    for _ in range(300):
        n = rng.integers(0, 12, 5)
        first = np.append(0, np.cumsum(n))
        scores = rng.normal(size=(first[-1], 3)).astype(np.float32) + np.float32([0.5, 0, 0])
        single += sum(langid.settled(scores[a:b], 2.0) >= 0 for a, b in zip(first, first[1:]) if b > a)
        assert (langid.best_labels(scores, first, 2.0) == langid.viterbi(scores, first, 2.0)).all()
    assert 100 < single < 1400
    assert langid.settled(np.zeros((4, 2), np.float32), 2.0) == -1  # a tie is left to Viterbi
    assert langid.settled(np.ones((4, 1), np.float32), 2.0) == 0
    assert len(langid.best_labels(np.zeros((0, 3), np.float32), np.zeros(3, np.int64), 2.0)) == 0


def test_stretches_of_long_documents_are_labelled_as_the_whole():
    rng = np.random.default_rng(2)
    parts = 0
    for n in (0, 1, 511, 513, 3000, 9001):
        lead = np.eye(4)[np.repeat(rng.integers(0, 4, n // 40 + 1), 40)[:n]]  # 40 words of one language, then of another
        for strength in (0.0, 0.7, 3.0):
            scores = (rng.normal(size=(n, 4)) + strength * lead).astype(np.float32)
            first = np.array([0, n // 3, n // 3, n])
            assert (langid.best_labels(scores, first, 2.0) == langid.viterbi(scores, first, 2.0)).all()
            cut = langid.stretches(scores, 2.0)
            assert [own for _, own, _ in cut] == [0, *(to for _, _, to in cut[:-1])] and cut[-1][2] == n
            parts += len(cut)
    assert parts > 40
    assert langid.stretches(np.zeros((5000, 3), np.float32), 2.0) == [(0, 0, 5000)]  # nothing is sure: one stretch


def test_language_spans(spark):
    rng = random.Random(3)
    kinds = {"en": ["the", "ing", "tion", "wh", "ea"], "fr": ["eau", "que", "oi", "ment", "ai"], "ru": ["про", "ста", "ени", "ого", "ва"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(n))

    rows = [(k, text(lang, 40), lang, "s") for k, lang in enumerate(["en", "fr", "ru"] * 60)]
    rows += [(1000, None, "en", "s"), (1001, "123 !?", "en", "s"), (1002, text("en", 60) + " " + text("fr", 30), None, "s"), (1003, "שלום עולם", None, "s"), (None, text("fr", 20), "fr", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string")
    got = by_id(langid.language_id(docs, carry=True))
    for k, _, lang, _ in rows[:180]:
        r = got[k][0]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert r["lang_pred"] == lang and r["score"] == 1.0 and r["row"]["row"] == "s"
    assert (got[1000][0]["lang_pred"], got[1001][0]["lang_pred"], got[1000][0]["score"]) == ("und", "und", 0.0)
    mixed = got[1002][0]
    assert mixed["lang_pred"] == "en" and [s["lang"] for s in mixed["spans"]] == ["en", "fr"] and 0.5 < mixed["score"] < 0.8
    assert abs(mixed["spans"][0]["words"] - 60) <= 1
    assert got[None][0]["lang_pred"] == "fr" and got[None][0]["held_out"] is False
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.language_id(unlabelled).collect()} == {"und"}
    assert langid.language_id(docs.limit(0)).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------


def test_words_and_scores_by_brute_force():
    assert langid.words_of_piece("a\tb\r\nc\u00a0d\u3000e don't 12x") == ["a", "b", "c", "d", "e", "dont", "x"]
    assert langid.words_of_piece(" abc東京タワーdef") == ["abc", "東京", "タワー", "def"]
    assert langid.words_of_pieces([b" 12", b" a b", b""])[1].tolist() == [0, 2, 0]
    rng = np.random.default_rng(4)
    counts, scripts = rng.integers(0, 50, (64, 3)), np.zeros((len(langid.NAMES), 3), int)
    latin, greek = langid.NAMES.index("Latin"), langid.NAMES.index("Greek")
    scripts[latin, :2], scripts[greek, 2] = 1, 1
    model = langid.Model(["aa", "bb", "gr"], counts, scripts)
    total = counts.sum(axis=0)
    logp = np.log(counts + 0.5) - np.log(total + 32)

    def buckets(word):
        mul, out, text = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], [], "  " + word + " "
        for k in range(2, len(text)):
            h = ord(text[k]) * mul[0]
            for n in range(3):
                if n:
                    h += ord(text[k - n]) * mul[n] + 1
                g = h % 2**64
                out.append((((g ^ (g >> 31)) * mul[1] % 2**64) >> 40) % 64)
        return out

    for word, allowed in (("hello", [0, 1]), ("é", [0, 1]), ("λόγος", [2]), ("東", [])):
        got = model.scores([word])[0]
        want = 0.5 * logp[buckets(word)].sum(axis=0)
        want -= want.max()
        for k in range(3):
            assert np.isclose(got[k], 0 if not allowed else want[k] if k in allowed else -1e3, atol=1e-3), (word, k)


def test_held_out_accuracy(spark):
    rng = random.Random(21)
    own = {"aa": "abcdefg", "bb": "cdefghi", "cc": "αβγδε"}
    rows = []
    for k in range(240):
        lang = rng.choice(list(own)) if k % 40 else "dd"  # a rare language
        letters = own.get(lang, "xyzw")
        rows.append((k, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30)), lang))
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20).collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in held]) >= 0.95


def test_url_list(spark):
    from datetime import date

    caps = spark.createDataFrame(
        [
            (1, "http://a.b.example.com/x", date(2024, 1, 5), "e"),
            (1, "http://a.b.example.com/x", date(2024, 1, 5), "e"),
            (2, "HTTPS://u@A.b.Example.com.:80/", date(2024, 1, 10), "e"),
            (3, "http://example.com", date(2024, 1, 20), "e"),
            (4, None, date(2024, 1, 5), "e"),
            (5, "not a url", date(2024, 1, 5), "e"),
            (6, "http://notexample.com", date(2024, 1, 5), "e"),
            (7, "http://a.b.example.com", None, "e"),
            (None, "http://b.example.com", date(2024, 1, 5), "e"),
        ],
        "page_id long, url string, day date, entry string",
    )
    events = spark.createDataFrame(
        [
            ("example.com", "add", date(2024, 1, 1), "wide"),
            ("example.com", "remove", date(2024, 1, 10), "wide"),
            ("B.example.com", "add", date(2024, 1, 5), "near"),
            ("b.example.com", "add", None, "void"),
            ("x.com", "add", date(2024, 1, 2), "c"),
            ("x.com", "remove", date(2024, 1, 2), "c"),
        ],
        urls.EVENTS,
    )
    got = urls.temporal_list_join(caps, events).collect()
    assert len(got) == 9
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["blocked"], r["n_active"], r["entry"], r["category"]))
    assert by[1] == [(True, 2, "b.example.com", "near")] * 2
    assert by[2] == [(True, 1, "b.example.com", "near")]
    assert by[None] == [(True, 2, "b.example.com", "near")]
    assert all(by[k] == [(False, 0, None, None)] for k in (3, 4, 5, 6, 7))
    assert urls.intervals(events).where("entry = 'x.com'").count() == 0
    assert urls.temporal_list_join(caps, events.limit(0)).where("blocked").count() == 0
    assert urls.temporal_list_join(caps.limit(0), events).count() == 0


def test_url_list_by_brute_force(spark):
    from datetime import date, timedelta

    rng, day = random.Random(12), lambda k: date(2024, 1, 1) + timedelta(days=k)
    names = ["a.com", "A.com", "b.a.com", "B.A.com.", "c.org", "x.c.org"]
    events = [(rng.choice(names), rng.choice(["add", "remove"]), day(rng.randint(0, 30)), rng.choice(["p", "q", None])) for _ in range(60)]
    caps = [(k, f"http://{rng.choice(['a.com', 'b.a.com', 'z.b.a.com', 'c.org', 'y.x.c.org', 'd.net'])}/", day(rng.randint(0, 35))) for k in range(200)]
    got = urls.temporal_list_join(
        spark.createDataFrame(caps, "page_id long, url string, day date"), spark.createDataFrame(events, urls.EVENTS)
    )
    got = {r["page_id"]: (r["n_active"], r["entry"], r["category"], r["active_since"]) for r in got.collect()}
    for k, url, when in caps:
        labels, active = url[7:-1].split("."), []
        for entry in (".".join(labels[i:]) for i in range(len(labels))):
            past = [e for e in events if e[0].lower().rstrip(".") == entry and e[2] <= when]
            last = max(past, key=lambda e: (e[2], e[1], e[3] is not None, e[3] or ""), default=None)
            if last and last[1] == "add":
                active.append((entry, last[3], last[2]))
        want = (len(active), *active[0]) if active else (0, None, None, None)
        assert got[k] == want, (k, url, when)


def test_arrow_helpers():
    from airflux.llm.arrow_text import buffer_of, ranges, slices, space_cuts

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a b", None, "", "  c\nd é f"])], names=["doc_id", "text"])
    assert [s.num_rows for s in slices(batch.slice(1), max_bytes=1)] == [2, 1]
    raw, offs = buffer_of(batch.slice(1))
    assert raw.tobytes().decode() == "  c\nd é f" and offs.tolist() == [0, 0, 0, len(raw)]
    cuts, first = space_cuts(*buffer_of(batch))
    data = buffer_of(batch)[0].tobytes()
    assert [data[a:b].decode() for a, b in zip(cuts, cuts[1:])] == ["a", " b", "  c", "\nd", " é", " f"]
    assert first.tolist() == [0, 2, 2, 2, 6]
    assert ranges(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]
