"""Removal of byte strings that repeat across documents (operator 7).

A byte goes if a ``width``-byte string over it also starts in a document with a smaller doc_id.
Each such string has an anchor: in a window of ``width`` bytes, the 24-byte grams of least hash
(winnowing, Schleimer et al., 2003).  Equal strings have equal anchors, so all that can match
meets under an anchor's hash:

1. ``chunks``: the texts, compressed, about a megabyte to a row, in a table bucketed by chunk.
2. Each chunk sends its distinct anchor hashes, sorted and compressed, to ranges of the hash
   space; back comes one bit each: found in another chunk.  (Repeats within the chunk it knows.)
3. Of shared anchors the chunk sends each distinct context (anchor and 26 bytes on both sides,
   as far as the document goes) with its least doc_id.  Equal contexts are settled at once.
   Over the different contexts of an anchor an enhanced suffix array is built; a stack scan of
   its longest common prefixes yields the tree of common-prefix intervals, and those whose left
   extensions differ are the maximal repeats, each with all its occurrences.  An occurrence is
   covered if the group has one in a smaller document.
4. The covered bytes return to the chunk, which puts them together and hashes what is left.

An anchor of more than ``common`` distinct contexts is dealt by what lies next to it: the 27
windows over it fall into ``SHARES`` ranges of their offset, all windows of a range share the
anchor and some neighbouring bytes (44 or more in all), and under the hash of those meet the
stretches that the range's windows reach (57 bytes at most).  They go through the same interval
tree; a stretch is one entry of a chunk, whatever the number of documents that have it.  So an
occurrence is sent ``SHARES`` times at most, and a group holds what follows 44 common bytes.

Edge cases: null and short texts have no strings and stay whole; equal doc_ids never cover each
other; texts of any length are read whole (a chunk holds one text at least); null doc_id counts
as larger than all others; repeated rows get equal results; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import buffer_of, ranges, slices
from .common import bucketed, written
from .hyperminhash import BASE, U, _powers, mix

WIDTH, GRAM = 50, 24
CHUNK_BYTES = 1 << 20
COMMON, SHARES = 4096, 4
BUCKET_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max
SEPARATOR = 0xFF  # in no UTF-8 text


# --- enhanced suffix array -------------------------------------------------------------------


def suffix_array(codes: np.ndarray, left_in: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes with at least ``least`` bytes left in their segment, sorted, and the longest common
    prefix of each with the one before it (the first: 0).

    ``codes`` holds segments that each end with ``SEPARATOR``; ``left_in`` is the number of bytes
    left in the segment.  Ranks of 8 bytes are doubled until they span the longest segment.
    """
    n = len(codes)
    wide = np.concatenate([codes, np.full(8, SEPARATOR, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << U(8)) | wide[k : k + n]
    longest, span, levels = int(left_in.max(initial=0)), 8, []
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    levels.append((8, rank))
    while span < longest:
        far = np.full(n, 0, np.int64)
        far[: n - span] = rank[span:] + 1
        rank = np.unique(rank * (n + 1) + far, return_inverse=True)[1].astype(np.int64)
        span *= 2
        levels.append((span, rank))
    pos = np.flatnonzero(left_in >= least)
    pos = pos[np.argsort(rank[pos], kind="stable")]
    lcp = np.zeros(len(pos), np.int64)
    if len(pos) > 1:
        a, b = pos[:-1], pos[1:]
        same = np.zeros(len(a), np.int64)
        at = lambda x: np.minimum(x + same, n - 1)
        for size, r in reversed(levels):
            same += size * (r[at(a)] == r[at(b)])
        alive = np.ones(len(a), bool)
        for _ in range(7):
            alive &= codes[at(a)] == codes[at(b)]
            same += alive
        lcp[1:] = np.minimum(same, np.minimum(left_in[a], left_in[b]))
    return pos, lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, first and last place of every common-prefix interval of length ``least`` or more."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    last = -2
    for i, value in ((i, int(lcp[i])) for i in np.flatnonzero(lcp >= least).tolist()):
        if i != last + 1:
            while stack:
                out.append((*stack.pop(), last))
        begin = i - 1
        while stack and stack[-1][0] > value:
            length, begin = stack.pop()
            out.append((length, begin, i - 1))
        if not stack or stack[-1][0] < value:
            stack.append((value, begin))
        last = i
    while stack:
        out.append((*stack.pop(), last))
    table = np.array(out, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def maximal_repeats(codes: np.ndarray, left_in: np.ndarray, least: int):
    """Maximal repeats of length ``least`` or more: lengths, and the occurrences of all of them.

    Returns ``(length, count, place)``: ``place`` has the positions of all occurrences, group after
    group, ``count`` of them each.  An interval whose suffixes are all preceded by the same byte is
    not maximal; a segment's beginning differs from everything.
    """
    pos, lcp = suffix_array(codes, left_in, least)
    length, first, last = lcp_intervals(lcp, least)
    before = np.where(pos > 0, codes[pos - 1], SEPARATOR) if len(pos) else np.zeros(0, np.uint8)
    differs = np.zeros(len(pos), np.int64)
    differs[1:] = (before[1:] != before[:-1]) | (before[1:] == SEPARATOR)
    total = np.cumsum(differs)
    diverse = total[last] > total[first]
    length, first, last = length[diverse], first[diverse], last[diverse]
    count = last - first + 1
    return length, count, pos[ranges(first, count)]


# --- chunks and anchors ----------------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays compressed together, bytes of equal weight next to each other."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.ndim == 1 else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpacked(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        if isinstance(kind, int):  # a byte matrix of so many columns
            out.append(np.frombuffer(data, np.uint8, n * kind, at).reshape(n, kind))
            at += n * kind
        else:
            size = np.dtype(kind).itemsize
            flat = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
            out.append(np.ascontiguousarray(flat.T).view(kind).reshape(n))
            at += n * size
    return out


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, carry: bool = False) -> DataFrame:
    """chunk, n, ids (64-bit doc_ids; null: the largest), ends (cumulative lengths) and z (texts);
    with ``carry`` the rows but for their texts, too."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    taken = docs.select(F.col("doc_id").cast("long"), "text", *[F.struct(F.lit(0).alias("_"), *others).alias("row")] * carry)
    kind = f", rest array<{taken.schema['row'].dataType.simpleString()}>" if carry else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, max_bytes=chunk_bytes):
                raw, offs = buffer_of(part)
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                row = [[part.num_rows], [part.column(0).null_count], [ids.tobytes()], [offs[1:].tobytes()], [pack(raw.tobytes())]]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=["n", "nulls", "ids", "ends", "z"])
                if carry:
                    out = out.append_column("rest", pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), part.column(2)))
                yield out

    out = taken.mapInArrow(run, "n long, nulls long, ids binary, ends binary, z binary" + kind)
    return out.withColumn("chunk", F.monotonically_increasing_id())


def anchors(raw: np.ndarray, offs: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows of ``width`` bytes within a text, and the
    running sums of the polynomial hash."""
    n, span = len(raw), width - gram + 1
    power, inverse = _powers(1 << max(20, int(n).bit_length()))
    sums = np.append(U(0), np.cumsum((raw.astype(U) + U(1)) * power[:n]))
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U), sums
    h = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    windows = n - width + 1

    def slide(values: np.ndarray, best, out: int) -> np.ndarray:
        size = 1
        while 2 * size <= span:
            values = best(values[:-size], values[size:])
            size *= 2
        return best(values[:out], values[span - size : span - size + out])

    least = slide(h, np.minimum, windows)
    room = np.diff(offs)
    fits = np.zeros(n + 1, np.int32)
    np.add.at(fits, offs[:-1], room >= width)
    np.add.at(fits, np.maximum(offs[:-1], offs[1:] - width + 1), -(room >= width).astype(np.int32))
    least[np.cumsum(fits[:windows]) == 0] = 0
    edge = np.zeros(span - 1, U)
    most = slide(np.concatenate([edge, least, edge]), np.maximum, len(h))
    chosen = np.flatnonzero((most == h) & (h != 0))
    return chosen, mix(h[chosen]), sums  # the least of many hashes are small; mixed again, they spread


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


class Chunk:
    """A chunk's texts, its anchors in the order of their hashes and contexts, and which hashes are distinct."""

    def __init__(self, ids: bytes, ends: bytes, z: bytes, width: int):
        self.ids, self.width = np.frombuffer(ids, np.int64), width
        self.offs = np.append(0, np.frombuffer(ends, np.int64))
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8) if self.offs[-1] else np.zeros(0, np.uint8)
        at, h, self.sums = anchors(self.raw, self.offs, width, GRAM)
        row = np.searchsorted(self.offs, at, side="right") - 1
        left, right = np.minimum(at - self.offs[row], width - GRAM), np.minimum(self.offs[row + 1] - at - GRAM, width - GRAM)
        code = self.codes(at - left, at + GRAM + right, left, right)
        doc = self.ids[row]
        order = np.lexsort((doc, code, h))
        self.at, self.h, self.doc, self.left, self.right, self.code = (x[order] for x in (at, h, doc, left, right, code))
        new = _changes(self.h)
        self.number = np.cumsum(new) - 1
        self.distinct = self.h[new]
        starts = np.flatnonzero(new)
        some = len(starts) > 0
        #: Distinct contexts of each distinct hash, and whether it occurs in several documents.
        self.contexts_of = np.add.reduceat(_changes(self.h, self.code), starts, dtype=np.uint32) if some else np.zeros(0, np.uint32)
        self.several = np.maximum.reduceat(self.doc, starts) != np.minimum.reduceat(self.doc, starts) if some else np.zeros(0, bool)

    def codes(self, lo: np.ndarray, hi: np.ndarray, left: np.ndarray | int = 0, right: np.ndarray | int = 0) -> np.ndarray:
        """Hashes of the byte strings [lo, hi), told apart by ``left`` and ``right``, too."""
        inverse = _powers(1 << max(20, int(len(self.raw)).bit_length()))[1]
        more = np.asarray(left).astype(U) * U(31 * 257) + np.asarray(right).astype(U)
        return mix((self.sums[hi] - self.sums[lo]) * inverse[lo] + mix(more + U(1)))

    def entries(self, flag: np.ndarray):
        """What the chunk sends of its anchors (``flag``: 0 nothing, 1 contexts, 2 stretches of ranges of offsets).

        (key, doc_id, left, right, bytes) of each distinct stretch with its least doc_id; and for each
        occurrence of one its number, whether its doc_id is larger than that, its anchor's position, left
        and right."""
        side = self.width - GRAM
        of = flag[self.number] if len(self.number) else np.zeros(0, np.uint8)
        one = of == 1
        parts = [(self.h[one], self.code[one], self.at[one], self.doc[one], self.left[one], self.right[one])]
        many = np.flatnonzero(of == 2)
        for low, high in _offset_ranges(side) if len(many) else []:
            k = many[(self.left[many] >= low) & (self.right[many] >= side - high)]
            at, left, right = self.at[k], np.minimum(self.left[k], high), np.minimum(self.right[k], side - low)
            key = self.codes(at - low, at + self.width - high)
            parts.append((key, self.codes(at - left, at + GRAM + right, left, right), at, self.doc[k], left, right))
        key, code, at, doc, left, right = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, code, key))
        key, code, at, doc, left, right = (x[order] for x in (key, code, at, doc, left, right))
        new = _changes(key, code)
        number, first = np.cumsum(new) - 1, np.flatnonzero(new)
        padded = np.concatenate([np.zeros(side, np.uint8), self.raw, np.zeros(side + GRAM, np.uint8)])
        size = 2 * side + GRAM
        text = np.lib.stride_tricks.sliding_window_view(padded, size)[at[first]]
        span = np.arange(size)
        l8, r8 = left[first].astype(np.uint8), right[first].astype(np.uint8)
        text = np.where((span < side - left[first, None]) | (span >= side + GRAM + right[first, None]), np.uint8(0), text)
        return (key[first], doc[first], l8, r8, text), (number, doc > doc[first][number], at, left, right)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _offset_ranges(side: int) -> list[tuple[int, int]]:
    """The offsets 0..side of a window's beginning before its anchor, in ``SHARES`` ranges."""
    cut = [k * (side + 1) // SHARES for k in range(SHARES + 1)]
    return [(a, b - 1) for a, b in zip(cut, cut[1:]) if a < b]


# --- what meets under an anchor's hash ---------------------------------------------------------


def covered_contexts(h, doc, left, right, text, width: int = WIDTH, block: int = 4_000) -> np.ndarray:
    """[context, byte] booleans: covered by a ``width``-byte string that a smaller doc_id has, too."""
    side = width - GRAM
    size = text.shape[1]
    code = np.zeros(len(h), U)
    words = np.pad(text, ((0, 0), (0, -size % 8)))
    for k in range(0, words.shape[1], 8):
        code = mix(code * U(BASE) + np.ascontiguousarray(words[:, k : k + 8]).view(U)[:, 0])
    del words
    order = np.lexsort((doc, right, left, code, h))
    h, doc, left, right, text, code = (x[order] for x in (h, doc, left, right, text, code))
    left, right = left.astype(np.int64), right.astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (code[1:] != code[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    kind, first = np.cumsum(new) - 1, np.flatnonzero(new)
    span = np.arange(size)
    inside = lambda k: (span >= side - left[k, None]) & (span < side + GRAM + right[k, None])
    out = np.zeros((len(h), size), bool)
    whole = (doc > doc[first][kind]) & (left + GRAM + right >= width)
    out[whole] = inside(whole)
    # Different contexts of one anchor, some anchors at a time.
    rep_h = h[first]
    group = np.append(0, np.cumsum(rep_h[1:] != rep_h[:-1])) if len(first) else np.zeros(0, np.int64)
    many = np.bincount(group, minlength=1)[group] > 1 if len(first) else np.zeros(0, bool)
    reps = first[many & (left[first] + GRAM + right[first] >= width)]
    rep_cover = np.zeros((len(first), size), bool)
    lo = 0
    while lo < len(reps):
        hi = min(len(reps), lo + block)
        while hi < len(reps) and h[reps[hi]] == h[reps[hi - 1]]:
            hi += 1
        part = reps[lo:hi]
        start, n = side - left[part], left[part] + GRAM + right[part]
        owner = np.repeat(np.arange(len(part)), n + 1)
        column = ranges(start, n + 1)
        last = np.cumsum(n + 1) - 1
        codes = text[part[owner], np.minimum(column, size - 1)]
        codes[last] = SEPARATOR
        left_in = np.repeat(last, n + 1) - np.arange(len(codes))
        length, count, place = maximal_repeats(codes, left_in, width)
        if len(length):
            which = owner[place]
            begin = np.cumsum(count) - count
            smallest = np.repeat(np.minimum.reduceat(doc[part[which]], begin), count)
            hit = doc[part[which]] > smallest
            cells = np.repeat(length, count)[hit]
            cover = np.zeros((len(part), size), bool)
            cover.reshape(-1)[ranges(which[hit] * size + column[place[hit]], cells)] = True
            rep_cover[kind[part]] |= cover
        lo = hi
    out |= rep_cover[kind] & ~whole[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the rising hashes ``h`` by bucket, and the buckets that have some."""
    cut = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
    return cut, np.flatnonzero(np.diff(cut))


def shared_flags(parts: DataFrame, width: int, buckets: int, common: int) -> DataFrame:
    """chunk, flags: for each chunk its (bucket, codes): 0 in this chunk only, 1 in others, 2 in others
    and with more than ``common`` contexts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, ids, ends, z = (c[k].as_py() for c in batch.columns)
                own = Chunk(ids, ends, z, width)
                h, n = own.distinct, own.contexts_of
                cut, some = _by_bucket(h, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int64()),
                        pa.array([chunk] * len(some), pa.int64()),
                        pa.array(cut[some + 1] - cut[some], pa.int64()),
                        pa.array([_packed(h[cut[b] : cut[b + 1]], n[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
                    ],
                    names=["bucket", "chunk", "n", "blob"],
                )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        found, n = zip(*(_unpacked(b, n, U, np.uint32) for b, n in zip(pdf["blob"], pdf["n"])))
        _, inverse, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=np.concatenate(n))
        codes = ((count > 1) * np.where(total > common, 2, 1)).astype(np.uint8)[inverse]
        cut = np.append(0, np.cumsum(pdf["n"].to_numpy()))
        packed = [_packed(codes[a:b]) for a, b in zip(cut, cut[1:])]
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "n": pdf["n"], "codes": packed})

    sent = parts.select("chunk", "ids", "ends", "z").mapInArrow(send, "bucket long, chunk long, n long, blob binary")
    back = sent.groupBy("bucket").applyInPandas(meet, "chunk long, bucket long, n long, codes binary")
    return back.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "codes"))).alias("flags"))


def _shared(chunk: Chunk, flags) -> np.ndarray:
    """What is sent of each distinct hash: see ``Chunk.entries``."""
    codes = [_unpacked(f["codes"], f["n"], np.uint8)[0] for f in flags or []]
    codes = np.concatenate(codes) if codes else np.zeros(len(chunk.distinct), np.uint8)
    return np.where((codes == 0) & chunk.several, np.uint8(1), codes)


def removed_repeats(
    docs: DataFrame, width: int = WIDTH, keep_text: bool = False, carry: bool = False, common: int = COMMON, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with ``keep_text`` the text
    that is left, too (a character that lost some of its bytes is dropped), with ``carry`` a struct
    ``row`` of the input's other columns."""
    if width <= GRAM:
        raise ValueError(f"width must be over {GRAM}")
    size = docs.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # Chunks are met three times by what comes back to them; bucketed, they are moved once.
    parts = bucketed(chunks(docs, chunk_bytes, carry), "chunk", 1 + size // BUCKET_BYTES, "chunks")
    buckets, fine = 1 + size // 4_000_000, 1 + size // 3_500_000  # of some 300 000 anchors
    side = width - GRAM
    span = 2 * side + GRAM
    flags = written(shared_flags(parts, width, buckets, common), "flags")
    rows = parts.join(flags, "chunk", "left").select("chunk", "ids", "ends", "z", "flags", "nulls", *["rest"] * carry)

    slim = [c for c in rows.columns if c != "rest"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, ids, ends, z, flag = (c[k].as_py() for c in batch.columns[:5])
                own = Chunk(ids, ends, z, width)
                (h, doc, left, right, text), _ = own.entries(_shared(own, flag))
                cut, some = _by_bucket(h, fine)
                blobs = [_packed(*(x[cut[b] : cut[b + 1]] for x in (h, doc, left, right, text))) for b in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int64()),
                        pa.array([chunk] * len(some), pa.int64()),
                        pa.array(cut[some], pa.int64()),
                        pa.array(cut[some + 1] - cut[some], pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["bucket", "chunk", "start", "n", "blob"],
                )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [_unpacked(b, n, U, np.int64, np.uint8, np.uint8, span) for b, n in zip(pdf["blob"], pdf["n"])]
        cover = covered_contexts(*(np.concatenate(x) for x in zip(*found)), width)
        cut = np.append(0, np.cumsum(pdf["n"].to_numpy()))
        out = []
        for chunk, start, a, b in zip(pdf["chunk"], pdf["start"], cut, cut[1:]):
            some = np.flatnonzero(cover[a:b].any(axis=1))
            bits = np.packbits(cover[a:b][some], axis=1)
            out.append((chunk, len(some), _packed((some + start).astype(np.int64), bits)))
        return pd.DataFrame(out, columns=["chunk", "n", "blob"])

    sent = rows.select(*slim).mapInArrow(send, "bucket long, chunk long, start long, n long, blob binary")
    back = sent.groupBy("bucket").applyInPandas(meet, "chunk long, n long, blob binary")
    cover = back.where("n > 0").groupBy("chunk").agg(F.collect_list(F.struct("n", "blob")).alias("cover"))
    cover = written(cover, "cover")  # short; read back without a partitioning, so that it goes to the chunks

    whole = rows.join(cover, "chunk", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, ends, z, flag, marks, nulls = (c[k].as_py() for c in batch.columns[:6])
                own = Chunk(ids, ends, z, width)
                entries, (number, larger, at, left, right) = own.entries(_shared(own, flag))
                gone = np.zeros(len(own.raw) + 1, np.int32)  # +1 where a covered stretch begins, -1 behind it

                def mark(a: np.ndarray, b: np.ndarray) -> None:
                    np.add.at(gone, a, 1)
                    np.add.at(gone, b, -1)

                whole = larger & (left + GRAM + right >= width)
                mark((at - left)[whole], (at + GRAM + right)[whole])
                masks = np.zeros((len(entries[0]), span), bool)
                for m in marks or []:
                    n = m["n"]
                    which, bits = _unpacked(m["blob"], n, np.int64, -(-span // 8))
                    masks[which] = np.unpackbits(bits, axis=1, count=span).astype(bool)
                rest = np.flatnonzero(~whole & masks.any(axis=1)[number]) if len(number) else np.zeros(0, np.int64)
                if len(rest):
                    edge = np.diff(np.pad(masks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                    for sign in (1, -1):
                        r, c = np.nonzero(edge == sign)
                        count = np.bincount(r, minlength=len(masks))
                        begin = np.cumsum(count) - count
                        own_n = number[rest]
                        pos = np.repeat(at[rest] - side, count[own_n]) + c[ranges(begin[own_n], count[own_n])]
                        np.add.at(gone, pos, sign)
                covered = np.cumsum(gone[:-1]) > 0
                out = _result(own, covered, nulls, keep_text)
                yield out.append_column("row", batch.column(6)[k].values) if carry else out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text
    if carry:
        schema += f", row {parts.schema['rest'].dataType.elementType.simpleString()}"
    last = whole.select("ids", "ends", "z", "flags", "cover", "nulls", *["rest"] * carry)
    return last.mapInArrow(finish, schema)


def _result(own: Chunk, covered: np.ndarray, nulls: int, keep_text: bool) -> pa.RecordBatch:
    n = np.diff(own.offs)
    total = np.append(0, np.cumsum(covered))[own.offs]
    head = covered.copy()
    head[1:] &= ~covered[:-1]
    firsts = own.offs[:-1][n > 0]
    head[firsts] = covered[firsts]
    spans = np.append(0, np.cumsum(head))[own.offs]
    left = own.raw[~covered].tobytes()
    at = (own.offs - total).tolist()
    kept = [left[a:b] for a, b in zip(at, at[1:])]
    cols = [
        pa.array(own.ids, pa.int64(), mask=own.ids == NO_ID if nulls else None),
        pa.array(n, pa.int64()),
        pa.array(np.diff(total), pa.int64()),
        pa.array(np.diff(spans), pa.int64()),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    ]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if keep_text:
        cols.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
        names.append("text")
    return pa.RecordBatch.from_arrays(cols, names=names)
