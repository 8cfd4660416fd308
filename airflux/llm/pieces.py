"""Subword encoding and decoding of whole texts (operator 4).

The pieces and scores of a SentencePiece model file are taken as given.  A text gets a leading
blank, blanks become U+2581, and the segmentation with the greatest sum of scores is found: an
Aho-Corasick automaton over all pieces reads the text once, every match (found by the
automaton's output links, longest first) relaxes the best score at its end, and a character
that is no piece of its own may be written as its bytes, at the lowest score less 10.

No piece has U+2581 behind another character, so no match crosses the start of a run of blanks:
texts are cut there, and each distinct stretch is segmented once while it is remembered.

Edge cases: null and empty texts have no ids and decode to the empty text; of equal sums the
longest last piece wins; U+2581 itself decodes to a blank (``exact`` is false then); other
texts, of any length and with any characters, decode to themselves; repeated rows get equal
ids; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import buffer_of, distinct_pieces, ranges, slices, space_cuts
from .packing import PieceEncoder

BLANK = "▁"
LONG = 4096  # characters of a stretch without blanks from which its best scores lie in arrays


class PieceModel:
    """Pieces with scores, the ids of the byte pieces, and the automaton over the pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]], bytes_: dict[int, int]):
        import ahocorasick

        if any(BLANK in p.lstrip(BLANK) for p, _, _ in pieces):
            raise ValueError("a piece has a blank behind another character")
        self.bytes = bytes_
        self.single = {p for p, _, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s, _ in pieces) - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, score, number in pieces:
            self.automaton.add_word(piece, (number, len(piece), score))
        self.automaton.make_automaton()

    def segment(self, text: str) -> list[int]:
        if len(text) <= LONG and self.single.issuperset(text):
            return self._of_pieces(text)
        n, unknown, single = len(text), self.unknown, self.single
        best, ids, sizes = [0.0] + [-math.inf] * n, [0] * (n + 1), [0] * (n + 1)
        if n > LONG:  # sixteen bytes a character instead of an object each
            best, ids, sizes = array("d", best), array("i", ids), array("i", sizes)
        done = 0

        def fallback(upto: int) -> None:
            for i in range(done, upto):
                if text[i] not in single and best[i] + unknown > best[i + 1]:
                    best[i + 1], ids[i + 1], sizes[i + 1] = best[i] + unknown, -1, 1

        for end, (number, length, score) in self.automaton.iter(text):
            if end > done:
                fallback(end)
                done = end
            reached = best[end + 1 - length] + score
            if reached > best[end + 1]:
                best[end + 1], ids[end + 1], sizes[end + 1] = reached, number, length
        fallback(n)
        out, at = [], n
        while at:
            number, length = ids[at], sizes[at]
            if number < 0:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode("utf-8"))]
            else:
                out.append(number)
            at -= length
        return out[::-1]

    def _of_pieces(self, text: str) -> list[int]:
        """``segment`` of a short text whose characters are all pieces, so that none can be written as its bytes."""
        n = len(text)
        best, last = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for end, piece in self.automaton.iter(text):
            _, length, score = piece
            end += 1
            reached = best[end - length] + score
            if reached > best[end]:
                best[end], last[end] = reached, piece
        out = []
        while n:
            number, length, _ = last[n]
            out.append(number)
            n -= length
        out.reverse()
        return out


def read_pieces(path: str) -> tuple[list[tuple[str, float, int]], dict[int, int], list[bytes]]:
    """Ordinary pieces (piece, score, id), ids of byte pieces, and the bytes that each id stands for."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, by_byte, table = [], {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            by_byte[int(piece[3:5], 16)] = i
            table.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            table.append(b"")
        else:
            pieces.append((piece, sp.get_score(i), i))
            table.append(piece.replace(BLANK, " ").encode("utf-8"))
    return pieces, by_byte, table


@lru_cache(maxsize=2)
def viterbi_encoder(path: str) -> PieceEncoder:
    pieces, by_byte, _ = read_pieces(path)
    model = PieceModel(pieces, by_byte)
    return PieceEncoder(lambda texts: [model.segment(t.replace(" ", BLANK)) for t in texts], most=200_000)


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and pool of the bytes of each id."""
    table = read_pieces(path)[2]
    n = np.fromiter(map(len, table), np.int64, len(table))
    return np.cumsum(n) - n, n, np.frombuffer(b"".join(table), np.uint8)


def encode_part(part: pa.RecordBatch, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice end to end, and the rows' offsets in them."""
    raw, offs = buffer_of(part)
    some = offs[1:] > offs[:-1]
    lead = np.insert(raw, offs[:-1][some], 0x20)
    moved = offs + np.append(0, np.cumsum(some))
    cuts, first = space_cuts(lead, moved, only_space=True)
    stretches, which = distinct_pieces(lead, cuts)
    starts, lengths = encoder(stretches)
    per = lengths[which]
    return encoder.pool[ranges(starts[which], per)].astype(np.int32), np.append(0, np.cumsum(per))[first]


def decode_ids(ids: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """UTF-8 bytes of each row's text, without the leading blank."""
    start, length, pool = table
    out = pool[ranges(start[ids], length[ids])].tobytes()
    ends = np.append(0, np.cumsum(length[ids]))[at].tolist()
    return [out[a + 1 if b > a else a : b] for a, b in zip(ends, ends[1:])]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = viterbi_encoder(path)
        for batch in batches:
            for part in slices(batch):
                ids, at = encode_part(part, encoder)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=["doc_id", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that ``ids`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            col = batch.column(1)
            at = col.offsets.to_numpy().astype(np.int64)
            text = decode_ids(col.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0], table)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.decode("utf-8", "replace") for t in text], pa.string())], names=["doc_id", "text"]
            )

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, ids, CRC-32 of the text decoded from them, and whether that is the text.

    Encoding and decoding share a task, so one Python worker a core holds a model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = viterbi_encoder(path), byte_table(path)
        for batch in batches:
            for part in slices(batch):
                ids, at = encode_part(part, encoder)
                back = decode_ids(ids, at, table)
                raw, offs = buffer_of(part)
                data, cut = raw.tobytes(), offs.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(at), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
                        pa.array([zlib.crc32(t) for t in back], pa.int64()),
                        pa.array([t == data[a:b] for t, a, b in zip(back, cut, cut[1:])], pa.bool_()),
                    ],
                    names=["doc_id", "n_ids", "ids", "decoded_crc32", "exact"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_ids long, ids array<int>, decoded_crc32 long, exact boolean"
    )
