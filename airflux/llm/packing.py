"""Token ids of whole documents, and packing them into sequences of a fixed capacity.

``tokenised`` cuts documents into pieces of at most ``capacity`` tokens.  Two packers:

* ``best_fit_decreasing`` (operator 2): pieces in falling length go to the open sequence with
  the least room that still holds them.  A segment tree over the residual capacities
  ``0..capacity`` answers "smallest residual >= length" in ``log2(capacity)`` steps.
* ``vector_best_fit`` (operator 8): a sequence has capacities for tokens, documents and
  attention cost (sum of squared piece lengths); of the sequences with room in every
  dimension the one with the least weighted residual norm (or the largest weighted dot
  product of residual and demand) takes the piece.

Edge cases, both operators: null text counts as the empty text (its piece is the end token
alone); texts longer than the capacity are cut losslessly, the first piece being the shorter
one; ties go to the earlier piece and the lower sequence; repeated rows are packed as often as
they occur; an empty table gives an empty result; other columns of the input, whatever their
names, are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import buffer_of, distinct_pieces, ranges, slices, space_cuts
from .common import written

END = 0


JOINED = 64  # pieces to a call of the tokenizer


class PieceEncoder:
    """Ids of byte strings, each distinct string being encoded once while it is remembered.

    With ``sizes``, the bytes that each id stands for, new strings go to the tokenizer some at a time,
    end to end, and the ids are dealt to the strings again by their bytes.  Strings are joined only
    where such a tokenizer cuts anyway: before a blank or line feed that follows no white space.
    All is forgotten at a call that finds over ``most`` strings, or over ``most_bytes`` of strings and ids, remembered:
    texts without blanks, whose strings are whole lines, reach the second bound first.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], sizes: np.ndarray | None = None, most: int = 400_000, most_bytes: int = 64 << 20):
        self.encode_many, self.sizes, self.most, self.most_bytes = encode_many, sizes, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encoded(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each string, and all ids end to end."""
        texts = [p.decode("utf-8", "replace") for p in new]
        if self.sizes is None:
            ids = [np.array(x, np.uint32) for x in self.encode_many(texts)]
            return np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids)
        groups, closed = [0], True
        for k, t in enumerate(texts):
            if k and (closed or t[0] not in " \n" or k - groups[-1] >= JOINED):
                groups.append(k)
            closed = t[-1].isspace()
        joined = ["".join(texts[a:b]) for a, b in zip(groups, [*groups[1:], len(texts)])]
        ids = [np.array(x, np.uint32) for x in self.encode_many(joined)]
        flat = np.concatenate(ids)
        ends = np.append(0, np.cumsum(self.sizes[flat]))
        cut = np.searchsorted(ends, np.append(0, np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))))
        return np.diff(cut), flat

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in ``pool`` of each piece's ids."""
        if len(self.number) > self.most or self.held + self.pool.nbytes > self.most_bytes:
            self.clear()
        new = [p for p in pieces if p not in self.number]
        if new:
            self.held += sum(map(len, new))
            lengths, flat = self.encoded(new)
            base = len(self.number)
            self.number.update(zip(new, range(base, base + len(new))))
            self.starts = np.append(self.starts, len(self.pool) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.pool = np.append(self.pool, flat)
        at = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        return self.starts[at], self.lengths[at]


@lru_cache(maxsize=4)
def bpe_encoder(path: str) -> PieceEncoder:
    """Encoder of a byte-level ``tokenizers`` file; its special tokens are found in texts as it finds them."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    sizes = np.zeros(tok.get_vocab_size(), np.int64)
    for token, number in tok.get_vocab().items():
        sizes[number] = len(token)  # a character stands for a byte
    for number, token in tok.get_added_tokens_decoder().items():
        sizes[number] = len(token.content.encode())
    return PieceEncoder(lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)], sizes)


@lru_cache(maxsize=4)
def rank_encoder(path: str) -> PieceEncoder:
    """Encoder of a ``tiktoken`` rank file of a byte-level vocabulary; it knows no special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, number in ranks.items():
        sizes[number] = len(token)
    return PieceEncoder(lambda texts: [enc.encode_ordinary(t) for t in texts], sizes)


def token_arrays(batch: pa.RecordBatch, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a batch end to end, each followed by ``END``, and the rows' offsets in them.

    Byte-level pre-tokenisation never joins a character to white space after it, so pieces cut
    before white space are encoded on their own and yield the ids of the whole text.
    """
    raw, offs = buffer_of(batch)
    cuts, first = space_cuts(raw, offs)
    pieces, which = distinct_pieces(raw, cuts)
    starts, lengths = encoder(pieces)
    per = lengths[which] if len(which) else np.zeros(0, np.int64)
    ends = np.append(0, np.cumsum(per))
    flat = encoder.pool[ranges(starts[which], per)] if len(which) else np.zeros(0, np.uint32)
    doc = ends[first]
    n = len(offs) - 1
    out = np.full(len(flat) + n, END, np.uint32)
    out[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(doc))] = flat
    return out, doc + np.arange(n + 1)


def piece_table(offs: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of the pieces of documents with these offsets."""
    total = np.diff(offs)
    count = np.maximum(1, -(-total // capacity))
    row = np.repeat(np.arange(len(total)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    head = total - (count - 1) * capacity
    start = np.where(number == 0, 0, head[row] + (number - 1) * capacity)
    return row, number, start, np.where(number == 0, head[row], capacity)


def tokenised(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of little-endian 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe_encoder(path)
        for batch in batches:
            for part in slices(batch):
                ids, offs = token_arrays(part, encoder)
                row, number, start, length = piece_table(offs, capacity)
                view = memoryview(ids.astype("<u4")).cast("B")
                at = (offs[row] + start) * 4
                crc = [zlib.crc32(view[a : a + 4 * b]) for a, b in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (number, start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece long, start long, length long, ids_crc32 long"
    )


def vector_best_fit(
    demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm"
) -> tuple[np.ndarray, int]:
    """Bin of each item (row of ``demand``), items taken in falling order of the first dimension; number of bins."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    if len(demand) and (demand > capacity).any():
        raise ValueError("an item exceeds a capacity")
    order = np.lexsort((np.arange(len(demand)), -demand[:, 0]))
    share, room, name = demand / capacity, np.empty((64, demand.shape[1])), np.empty(64, np.int64)
    put, opened, n = np.empty(len(demand), np.int64), 0, 0
    eps = 1e-9
    smallest = demand.min(axis=0) / capacity if len(demand) else None
    for done, i in enumerate(order):
        d = share[i]
        if done % 256 == 255:  # sequences that nothing fits into any more are closed
            keep = (room[:n] >= smallest - eps).all(axis=1)
            n = int(keep.sum())
            room[:n], name[:n] = room[: len(keep)][keep], name[: len(keep)][keep]
        fits = np.flatnonzero((room[:n] >= d - eps).all(axis=1))
        if len(fits):
            if rule == "norm":
                b = fits[np.argmin(((room[fits] - d) ** 2 * weights).sum(axis=1))]
            else:
                b = fits[np.argmax((room[fits] * d * weights).sum(axis=1))]
        else:
            if n == len(room):
                room, name = np.vstack([room, np.empty_like(room)]), np.append(name, np.empty_like(name))
            room[n], name[n], b = 1.0, opened, n
            opened, n = opened + 1, n + 1
        room[b] -= d
        put[i] = name[b]
    return put, opened


def pack_vector(
    pieces: DataFrame,
    capacity: int,
    max_docs: int,
    max_cost: float,
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001),
    rule: str = "norm",
    group_rows: int = 4096,
) -> DataFrame:
    """``pieces`` plus sequence_id and offset, packed by ``vector_best_fit``.

    The pieces are dealt at random into groups of about ``group_rows`` (a group leaves about one
    sequence partly filled), so no task holds more than a group, whatever the size of the table.
    Only lengths move; the token ids stay where they were made.
    """
    rows = written(pieces.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_rows))
    cap = np.array([capacity, max_docs, max_cost], float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no", ignore_index=True)
        n = pdf["length"].to_numpy(np.float64)
        put, _ = vector_best_fit(np.column_stack([n, np.ones(len(n)), n * n]), cap, np.array(weights), rule)
        pdf["sequence_id"] = (pdf["grp"].to_numpy(np.int64) << 32) + put
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns=["grp", "row_no"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return (
        rows.withColumn("grp", F.pmod(F.xxhash64("row_no"), F.lit(groups)))
        .groupBy("grp")
        .applyInPandas(run, f"{schema}, sequence_id long, offset long")
    )


def best_fit_packing(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    max_docs: int = 2048,
    max_cost: float | None = None,
    rule: str = "norm",
) -> DataFrame:
    """Operator 8: documents to pieces, packed under token, document-count and attention-cost capacities."""
    cost = float(capacity) ** 2 if max_cost is None else max_cost
    return pack_vector(tokenised(docs, path, capacity), capacity, max_docs, cost, rule=rule)


class CapacityTree:
    """Segment tree over residual capacities: how many open sequences have residual r, for r in 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, residual: int, by: int) -> None:
        at = residual + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, need: int) -> int:
        """The smallest residual >= need that an open sequence has, or -1."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Sequence of each piece by best-fit decreasing; number of sequences."""
    tree, open_at = CapacityTree(capacity), {}
    put, opened = np.empty(len(lengths), np.int64), 0
    for i in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        need = int(lengths[i])
        room = tree.least(need)
        if room < 0:
            seq, room, opened = opened, capacity, opened + 1
        else:
            seq = open_at[room].pop()
            tree.add(room, -1)
        put[i] = seq
        if room > need:
            open_at.setdefault(room - need, []).append(seq)
            tree.add(room - need, 1)
    return put, opened


PACKED = (
    "sequence_id long, n_tokens int, doc_ids array<bigint>, pieces array<bigint>, starts array<bigint>,"
    " ids binary, cu_seqlens array<int>, position_ids binary"
)


def packed_matrices(docs: DataFrame, path: str, capacity: int = 2048, window: int = 8192) -> DataFrame:
    """Operator 2: packed rows of an id matrix, one per sequence.

    ids: ``capacity`` little-endian 16-bit ids, padded with 0; cu_seqlens: cumulative lengths of the
    segments, from 0; position_ids: 16-bit positions that begin again at 0 with each segment (and
    with the padding).  ``doc_ids``, ``pieces`` and ``starts`` name the segments, so documents can
    be put together again without loss.  Every task packs windows of ``window`` pieces as it reads
    them: nothing is shuffled, and a window is all that a task holds.
    """
    if not 0 < capacity <= 1 << 16:
        raise ValueError("capacity must be between 1 and 65536")

    def emit(doc, number, start, length, parts) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(parts)
        put, n = best_fit_decreasing(length, capacity)
        order = np.argsort(put, kind="stable")
        begin = np.cumsum(length) - length
        size = np.bincount(put, weights=length, minlength=n).astype(np.int64)
        count = np.bincount(put, minlength=n)
        in_order = length[order]
        offset = np.cumsum(in_order) - in_order - np.repeat(np.cumsum(size) - size, count)
        for lo in range(0, n, 512):
            hi = min(n, lo + 512)
            a, b = int(count[:lo].sum()), int(count[:hi].sum())
            sel, off = order[a:b], offset[a:b]
            matrix, place = np.zeros((hi - lo, capacity), "<u2"), np.zeros((hi - lo, capacity), "<u2")
            pad = np.arange(capacity) - size[lo:hi, None]
            place[pad >= 0] = pad[pad >= 0]
            to = ranges((put[sel] - lo) * capacity + off, length[sel])
            matrix.reshape(-1)[to] = ids[ranges(begin[sel], length[sel])]
            place.reshape(-1)[to] = ranges(np.zeros(len(sel), np.int64), length[sel])
            cut = np.append(0, np.cumsum(count[lo:hi])).astype(np.int32)
            seg = lambda x, kind: pa.ListArray.from_arrays(pa.array(cut), pa.array(x, kind))
            cum = np.insert(off + length[sel], cut[:-1], 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(lo, hi), pa.int64()),
                    pa.array(size[lo:hi], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(cut), doc.take(pa.array(sel))),
                    seg(number[sel], pa.int64()),
                    seg(start[sel], pa.int64()),
                    pa.array([m.tobytes() for m in matrix], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cut + np.arange(len(cut), dtype=np.int32)), pa.array(cum, pa.int32())),
                    pa.array([m.tobytes() for m in place], pa.binary()),
                ],
                names=["sequence_id", "n_tokens", "doc_ids", "pieces", "starts", "ids", "cu_seqlens", "position_ids"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, rows = rank_encoder(path), [], 0
        if len(encoder.sizes) > 65536:
            raise ValueError("ids of 16 bits need a vocabulary of at most 65536")

        def flush() -> Iterator[pa.RecordBatch]:
            docs_, number, start, length, ids = zip(*held)
            yield from emit(pa.concat_arrays(docs_), *map(np.concatenate, (number, start, length)), ids)

        for batch in batches:
            for part in slices(batch):
                ids, offs = token_arrays(part, encoder)
                row, number, start, length = piece_table(offs, capacity)
                held.append((part.column(0).take(pa.array(row)), number, start, length, ids.astype(np.uint16)))
                rows += len(row)
                if rows >= window:
                    yield from flush()
                    held, rows = [], 0
        if held:
            yield from flush()

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACKED)
    return out.withColumn("sequence_id", F.monotonically_increasing_id())


def unpacked(packed: DataFrame) -> DataFrame:
    """The segments of packed rows again: doc_id, piece, start, ids (little-endian 16-bit)."""
    seg = F.explode(
        F.arrays_zip("doc_ids", "pieces", "starts", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("b"))
    )
    return packed.select("ids", seg.alias("s")).select(
        F.col("s.doc_ids").alias("doc_id"),
        F.col("s.pieces").alias("piece"),
        F.col("s.starts").alias("start"),
        F.expr("substring(ids, 2 * s.a + 1, 2 * (s.b - s.a))").alias("ids"),
    )
