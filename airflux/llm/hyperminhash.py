"""Near-duplicate detection with HyperMinHash registers (operator 3).

1. ``signatures``: the distinct word shingles of a text are hashed to 64 bits.  The top 8 bits
   choose one of 256 buckets; of the least remaining hash of a bucket its number of leading
   zeros and the next 10 bits are kept (Yu & Weber, 2017): 16 bits a bucket.
2. Banding: an empty bucket borrows the register of a non-empty one, in an order that is fixed
   for the slot (after Shrivastava, 2017), so that slots agree with probability J for small sets
   too.  40 bands of 6 registers: a pair with J = 0.8 is missed with probability
   (1 - 0.8^6)^40 = 5e-6, and chains of links make up for most misses.
3. Sets that are equal are one vertex.  In each band group every other vertex is paired with its
   hub, the vertex that meets most others (never all pairs).  The collision-corrected Jaccard
   estimate of the registers drops pairs more than five standard errors below the threshold; the
   rest are compared on their full shingle sets.
4. Vertices that share a hub but are not one component yet are compared in full, by blocks of
   similar size; only links that join components leave a block.  Components of all links are the
   result.

Only groups' minima and counts are shuffled for a hot group (summed before the shuffle); the
joins can be split.  Texts travel compressed, and only those in surviving pairs go on.

Edge cases: null and blank texts have no shingles and are linked with nothing; texts with fewer
words than a shingle are one shingle; texts of any length are read whole; repeated rows each get
a row (and one component); an empty table gives an empty result; a row with doc_id null is linked like any
other, has the least doc_id of its component (null if that has none) and is kept by ``near_duplicates``, which
knows rows by doc_id (``one_of_each`` keeps one row of each group whatever the doc_ids); rows that share a doc_id
are compared by their own texts; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import buffer_of, given_back, slices
from .common import written
from .components import components

BUCKETS, MANTISSA, EMPTY = 256, 10, 0
BANDS, ROWS = 40, 6
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64
SIGNED_BYTES = 1 << 18  # of text at a time in ``signatures``, which takes some sixty bytes for each
PAIRS = 1024  # whose registers are compared at a time


_TABLES: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0..n (or more) of the base of the polynomial hash, and of its inverse; kept by the process."""
    if not _TABLES or len(_TABLES[0]) <= n:
        one = lambda b: np.append(U(1), np.cumprod(np.full(n, b, U)))
        _TABLES[:] = [one(BASE), one(pow(BASE, -1, 1 << 64))]
    return _TABLES


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z lowered), and the texts' offsets in them."""
    if not len(raw):
        return np.zeros(0, U), np.zeros(len(offs), np.int64)
    upper = (raw >= 65) & (raw <= 90)
    low = raw + (upper.astype(np.uint8) << 5)
    black = ~((raw == 0x20) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True  # a text begins or ends
    start = black & np.append(True, ~black[:-1] | edge[1:-1])
    stop = black & (np.append(~black[1:], True) | edge[1:])
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power, inverse = _powers(1 << max(20, int(len(raw)).bit_length()))
    sums = np.append(U(0), np.cumsum((low.astype(U) + U(1)) * power[: len(low)]))
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U)), np.searchsorted(a, offs)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the ``width``-word shingles of each text, in rising order, and the texts' offsets."""
    words, first = word_hashes(raw, offs)
    n = np.diff(first)
    docs = len(n)
    full = len(words) - width + 1
    row = np.repeat(np.arange(docs), n)
    if full > 0:
        h = np.full(full, U(width))
        for j in range(width):
            h = mix(h * U(BASE) + words[j : j + full])
        own = row[:full] == row[width - 1 : width - 1 + full]
        h, row = h[own], row[:full][own]
    else:
        h, row = np.zeros(0, U), row[:0]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        g = n[short].astype(U)
        for j in range(width - 1):
            more = n[short] > j
            g = np.where(more, mix(g * U(BASE) + words[np.where(more, first[:-1][short] + j, 0)]), g)
        h, row = np.append(h, g), np.append(row, short)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(docs + 1))


def registers_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[text, bucket] registers, 0 where the bucket is empty; ``h`` rises within each text."""
    docs = len(at) - 1
    out = np.zeros((docs, BUCKETS), np.uint16)
    row, bucket = np.repeat(np.arange(docs), np.diff(at)), (h >> U(56)).astype(np.int64)
    least = np.ones(len(h), bool)
    least[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    value = h[least] << U(8)
    zeros = np.clip(64 - np.frexp(value.astype(np.float64))[1], 0, 62).astype(U)
    tail = (value << np.minimum(zeros + U(1), U(63))) >> U(64 - MANTISSA)
    out[row[least], bucket[least]] = (zeros * U(1 << MANTISSA) + tail).astype(np.uint16) + np.uint16(1)
    return out


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that the registers of two unrelated sets of n and m shingles are equal in a used bucket."""
    i = np.arange(63, dtype=np.float64)
    upper, lower = 2.0 ** -i, np.append(2.0 ** -(i[:-1] + 1), 0.0)

    def law(size: np.ndarray) -> np.ndarray:
        rate = (np.asarray(size, float) / BUCKETS)[:, None]
        return np.exp(-rate * lower) - np.exp(-rate * upper)

    used = 1 - np.exp(-(np.asarray(n, float) + np.asarray(m, float)) / BUCKETS)
    return (law(n) * law(m)).sum(axis=1) / (1 << MANTISSA) / np.maximum(used, 1e-12)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of pairs of register rows, and their standard errors at J = 0.8."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    by_chance = collision_rate(n, m)
    raw = same / np.maximum(used, 1)
    return np.clip((raw - by_chance) / (1 - by_chance), 0, 1), np.sqrt(0.16 / np.maximum(used, 1))


@lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    """[slot, place] buckets in the order in which a slot tries them, its own first."""
    order = np.argsort(np.random.default_rng(20240601).random((BANDS * ROWS, BUCKETS)), axis=1)
    own = np.arange(BANDS * ROWS) % BUCKETS
    at = np.argmax(order == own[:, None], axis=1)
    order[np.arange(len(order)), at] = order[:, 0]
    order[:, 0] = own
    return order


def band_keys(registers: np.ndarray) -> np.ndarray:
    """[text, band] 64-bit keys; every text has at least one register."""
    order, docs = _donors(), len(registers)
    slots = registers[:, order[:, 0]]
    for t in range(1, BUCKETS):
        empty = slots == EMPTY
        rows = np.flatnonzero(empty.any(axis=1))
        if not len(rows):
            break
        if t == 32:  # few registers: the non-empty bucket that each slot would come to first
            rank = np.argsort(order, axis=1)
            for r in rows:
                some = np.flatnonzero(registers[r])
                slots[r] = registers[r, some[rank[:, some].argmin(axis=1)]]
            break
        slots[rows] = np.where(empty[rows], registers[rows][:, order[:, t]], slots[rows])
    slots = slots.reshape(docs, BANDS, ROWS).astype(U)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (docs, BANDS))
    for k in range(ROWS):
        key = mix(key * U(BASE) + slots[:, :, k])
    return key


def signed_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``signatures`` of batches (doc_id, text, text_hash), some ``SIGNED_BYTES`` of text at a time."""
    for batch in batches:
        for part in slices(batch, max_bytes=SIGNED_BYTES):
            h, at = shingle_sets(*buffer_of(part), width)
            sums = np.append(U(0), np.cumsum(mix(h + U(BASE))))
            vertex, n = mix(sums[at[1:]] - sums[at[:-1]]).view(np.int64), np.diff(at)
            regs = registers_of(h, at)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(vertex, pa.int64(), mask=n == 0), pa.array([r.tobytes() if k else None for r, k in zip(regs, n)], pa.binary()), part.column(2)],
                names=["doc_id", "n_shingles", "vertex", "registers", "text_hash"],
            )
    given_back()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, vertex (a 64-bit hash of the set; null without shingles), registers, text_hash."""
    taken = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    run = lambda batches: signed_batches(batches, width)
    return taken.mapInArrow(run, "doc_id long, n_shingles long, vertex long, registers binary, text_hash long")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def band_rows(signed: DataFrame) -> DataFrame:
    """(key, vertex) of each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                keys = band_keys(_matrix(part.column(1)))
                vertex = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), pa.array(vertex)], names=["key", "vertex"]
                )
        given_back()

    some = signed.where("vertex is not null").select("vertex", "registers")
    return some.mapInArrow(run, "key long, vertex long")


def near_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the ``likely`` rows of batches (a, b, na, nb, ra, rb), ``PAIRS`` compared at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PAIRS):
            part = batch.slice(lo, PAIRS)
            n, m = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            j, error = estimate(_matrix(part.column(4)), _matrix(part.column(5)), n, m)
            near = (j + 5 * error >= percent / 100) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield part.select([0, 1]).filter(pa.array(near))
    given_back()


def likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose estimated similarity reaches ``percent`` less five standard errors."""
    one = signed.where("vertex is not null").groupBy("vertex").agg(
        F.any_value("n_shingles").alias("n"), F.any_value("registers").alias("r")
    )
    side = lambda s: one.select(F.col("vertex").alias(s), F.col("n").alias(f"n{s}"), F.col("r").alias(f"r{s}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ra", "rb")
    return joined.mapInArrow(lambda batches: near_batches(batches, percent), "a long, b long")


def checked_set(raw: bytes, vertex: int, width: int) -> np.ndarray | None:
    """The text's shingle set, if it is that of ``vertex``."""
    h, _ = shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), width)
    return h if mix(mix(h + U(BASE)).sum(dtype=U)[None]).view(np.int64)[0] == vertex else None


def needed_texts(needed: DataFrame, docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(vertex, z): a compressed text of each of the vertices, from the first of its rows by doc_id (null last)
    and text hash; so a vertex has a text whatever its rows' doc_ids are."""
    import zstandard

    name = lambda i, h: F.xxhash64(i.isNull(), i, h).alias("at")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r")
    where = signed.where("vertex is not null").groupBy("vertex").agg(first).join(needed, "vertex")
    where = where.select("vertex", name(F.col("r.doc_id"), F.col("r.text_hash")))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            _, once = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(once))  # repeated rows leave a batch once
            for part in slices(batch):
                raw, offs = buffer_of(part)
                data, at = memoryview(raw), offs.tolist()
                packed = [pack(data[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["at", "z"])
        given_back()

    texts = docs.where("text is not null").select(name(F.col("doc_id").cast("long"), F.xxhash64("text")), "text")
    texts = texts.mapInArrow(squeeze, "at long, z binary")
    # The rows of a name are together after the join: what is left of repeated rows goes without a shuffle.
    found = where.hint("shuffle_hash").join(texts, "at").groupBy("at").agg(F.any_value("vertex").alias("vertex"), F.any_value("z").alias("z"))
    return written(found.select("vertex", "z"), "texts")


def confirmed(pairs: DataFrame, docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union."""
    import zstandard

    kept = needed_texts(pairs.select("a").union(pairs.select("b")).toDF("vertex").distinct(), docs, signed)
    one = lambda s: kept.select(F.col("vertex").alias(s), F.col("z").alias(f"z{s}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            za, zb = batch.column(2), batch.column(3)
            good = []
            for k in range(batch.num_rows):
                if a[k] != last:
                    last, held = a[k], checked_set(unpack(za[k].as_py()), a[k], width)
                other = checked_set(unpack(zb[k].as_py()), b[k], width)
                if held is None or other is None:
                    last = None
                    good.append(False)
                    continue
                both = len(np.intersect1d(held, other, assume_unique=True))
                good.append(100 * both >= percent * (len(held) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "za", "zb")
    return joined.mapInArrow(compare, "a long, b long").distinct()


def _spanning(roots: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (places) of ``near`` that join different roots, as a forest."""
    parent = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    out = []
    for i, j in near.tolist():
        a, b = find(int(roots[i])), find(int(roots[j]))
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def links_in_block(sets: list[np.ndarray], roots: np.ndarray, percent: int, step: int = 4096) -> list[tuple[int, int]]:
    """Links (100 * intersection >= percent * union) that join the roots of a block, as a forest."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        used = np.zeros((len(sets), step), np.float32)
        used[row[a:b], column[a:b] - lo] = 1
        both += used @ used.T
    both = both.astype(np.int64)
    near = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (roots[:, None] != roots[None, :])
    return _spanning(roots, np.argwhere(np.triu(near, 1)))


def open_links(stars: DataFrame, part: DataFrame, docs: DataFrame, signed: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links between different components among the vertices that share a hub.

    ``stars`` has (hub, vertex) of all that share a band with the hub, the hub included.  Where they
    are one component there is nothing to do.  Others are dealt by size class (sizes of a link differ
    by 100 / percent at most, so by one class) into blocks of about ``block`` vertices; every pair of
    blocks that can hold a link is one small group, and only links leave it.
    """
    import zstandard

    rows = stars.join(part, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    split = rows.groupBy("hub").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("hub")
    one = signed.where("vertex is not null").groupBy("vertex").agg(F.any_value("n_shingles").alias("n"))
    rows = rows.join(split, "hub", "left_semi").join(one, "vertex")
    rows = rows.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9))
    rows = written(rows.select("hub", "vertex", "root", "c"), "open")
    if rows.isEmpty():
        return rows.select(F.col("vertex").alias("a"), F.col("root").alias("b"))
    count = rows.groupBy("hub", "c").agg(F.ceil(F.count("*") / block).alias("k"))
    at = lambda by, name: count.select("hub", (F.col("c") + by).alias("c"), F.col("k").alias(name))
    dealt = rows.join(at(0, "k"), ["hub", "c"]).join(at(-1, "above"), ["hub", "c"], "left").join(at(1, "below"), ["hub", "c"], "left")
    own = F.pmod(F.xxhash64("vertex"), F.col("k"))
    each = lambda k, f: F.transform(F.sequence(F.lit(0), F.coalesce(k, F.lit(0)) - 1), f)
    group = lambda c, same, i, j: F.struct(
        c.cast("long").alias("c"), F.lit(same).alias("same"), i.cast("long").alias("i"), j.cast("long").alias("j")
    )
    some = lambda k, f: F.when(F.coalesce(k, F.lit(0)) > 0, each(k, f)).otherwise(F.array())
    dealt = dealt.withColumn("o", own).withColumn(
        "g",
        F.explode(
            F.concat(
                each(F.col("k"), lambda j: group(F.col("c"), True, F.least("o", j), F.greatest("o", j))),
                some(F.col("above"), lambda j: group(F.col("c"), False, F.col("o"), j)),
                some(F.col("below"), lambda j: group(F.col("c") - 1, False, j, F.col("o"))),
            )
        ),
    )
    texts = needed_texts(rows.select("vertex").distinct(), docs, signed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        roots = pdf["root"].to_numpy(np.int64)
        found: list[tuple[int, int]] = []
        if len(roots) and (roots != roots[0]).any():
            sets = [checked_set(unpack(z), v, width) for z, v in zip(pdf["z"], pdf["vertex"])]
            good = [k for k, h in enumerate(sets) if h is not None]
            found = [(good[i], good[j]) for i, j in links_in_block([sets[k] for k in good], roots[good], percent)] if good else []
        v = pdf["vertex"].to_numpy(np.int64)
        return pd.DataFrame({"a": [v[i] for i, _ in found], "b": [v[j] for _, j in found]}, dtype=np.int64)

    return dealt.select("hub", "g", "vertex", "root").join(texts, "vertex").groupBy("hub", "g").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) and kept of every document."""
    rows = grouped_rows(docs, width, percent, block)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """One row of each group of near-duplicates, with all columns: that of the least doc_id (null last),
    then of the least text hash; of equal ones, any.  Texts without words are in no group and all stay.

    Rows are known by doc_id and text hash, so rows that share a doc_id but not a text are judged apart.
    """
    rows = written(grouped_rows(docs, width, percent, block).select("doc_id", "text_hash", "root"), "rows")
    name, by = F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    group = rows.where("root is not null")
    first = group.groupBy("root").agg(F.min_by(name, by).alias("r")).select("r.doc_id", "r.text_hash")
    times = group.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    first = first.join(times, same(first, times)).select(first["doc_id"].alias("__id"), first["text_hash"].alias("__hash"), "n")
    blank = rows.where("root is null").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    first = written(first.unionByName(blank.withColumn("n", F.lit(1).cast("long"))), "first")

    def taken(some: DataFrame) -> DataFrame:
        on = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__hash"))
        return docs.join(some, on, "left_semi")

    again = first.where("n > 1")
    if again.isEmpty():
        return taken(first)
    # Rows that occur more than once: the only ones whose copies have to meet.
    once = taken(again).withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "__hash"])
    return taken(first.where("n = 1")).unionByName(once.drop("__hash"))


def grouped_rows(docs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """doc_id, n_shingles, text_hash and root (the same for all rows that links reach; null without shingles)."""
    signed = written(signatures(docs, width), "signatures")
    groups = (
        band_rows(signed)
        .groupBy("key")
        .agg(F.min("vertex").alias("low"), F.max("vertex").alias("high"), F.count("*").alias("size"))
        .where("low < high")
        .select("key", "size")
    )
    # A group is one row, so partitions of groups are even and small: hashed, they spare the sort of all band rows.
    members = written(band_rows(signed).join(groups.hint("shuffle_hash"), "key").distinct(), "members")
    # The vertex that meets most others is the hub of a group: the one with fewest changes of its own.
    degree = members.groupBy("vertex").agg(F.sum("size").alias("degree"))
    hubs = members.join(degree, "vertex").groupBy("key").agg(F.max_by("vertex", F.struct("degree", "vertex")).alias("hub"))
    stars = written(members.join(hubs, "key").select("hub", "vertex").distinct(), "stars")
    pairs = stars.where("vertex <> hub").select(F.least("hub", "vertex").alias("a"), F.greatest("hub", "vertex").alias("b")).distinct()
    links = confirmed(written(likely(pairs, signed, percent), "pairs"), docs, signed, width, percent)
    links = written(links, "links")
    part = components(links)
    more = written(open_links(stars, part, docs, signed, width, percent, block), "links")
    if not more.isEmpty():
        part = components(links.unionByName(more))

    rows = signed.select("doc_id", "n_shingles", "text_hash", "vertex").join(part, "vertex", "left")
    return rows.select("doc_id", "n_shingles", "text_hash", F.coalesce("root", "vertex").alias("root"))
