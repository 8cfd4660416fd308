"""Ogg media column (operator 9): payloads multiplexed into Ogg pages, and read back.

``with_ogg`` stores every text as 8-bit samples.  The UTF-8 bytes are padded with blanks to a
positive multiple of 192 and cut into packets of ``PACKET`` samples, dealt in turn to two
logical streams whose pages alternate.  A page carries at most ``LACES`` lacing values: several
packets may end on it, and a packet may run over several pages.  The granule position of a page is
the number of its stream's samples up to the end of the last packet that ends on it, or -1 where
none does.

``ogg_features`` reads any Ogg bytes: it finds pages by their capture pattern, verifies their
checksums, puts packets together from lacing values (over page ends), keeps logical streams
apart by serial number, and derives times from granule positions.  A packet that ends before the
last one of its page ends where the packet behind it begins; on a page without a position, where
the one before it ends and its length lead.  The payload is in the order of beginnings, then of serial
numbers.

Edge cases: null text is the empty text (192 blanks); texts of any length are stored whole;
equal texts give equal bytes; pages with a wrong checksum or length are counted and skipped,
as are packets that lost a part, or whose end the bytes do not reach; a null or empty media value has no pages, an empty payload
and the feature string of no streams; an empty table gives an empty one; further columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import buffer_of, slices

RATE, UNIT, PACKET, LACES = 8000, 192, 960, 18
#: Fixed values of the page format: flags of a page, its header, and the identification packet's magic.
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
IDENT = struct.Struct("<8sIQ")
MAGIC = b"\x7fSAMPLE8"

REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """The page checksum: polynomial 04C11DB7, highest bit first, no inversion.

    It is the mirror image of the common CRC-32 register over bit-reversed bytes.
    """
    mirrored = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(laces)) + laces
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages_of(packets: list[bytes], serial: int) -> list[bytes]:
    """The pages of a stream's packets, behind its first page."""
    laces = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body, out, at, samples, begun = b"".join(packets), [], 0, 0, 0
    for k in range(0, len(laces), LACES):
        part = laces[k : k + LACES]
        end = at + sum(part)
        whole = max((i for i, lace in enumerate(part) if lace < 255), default=-1)
        flags = CONTINUED * (begun < at) | LAST * (k + LACES >= len(laces))
        if whole >= 0:
            samples = begun = end - sum(part[whole + 1 :])
        out.append(page(flags, samples if whole >= 0 else -1, serial, len(out) + 1, part, body[at:end]))
        at = end
    return out


def padded(data: bytes) -> bytes:
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode(data: bytes, streams: int = 2) -> bytes:
    """Ogg bytes of the padded payload of ``data``, dealt to ``streams`` logical streams."""
    payload = padded(data)
    ident = IDENT.pack(MAGIC, RATE, len(data))
    packets = [payload[at : at + PACKET] for at in range(0, len(payload), PACKET)]
    pages = [pages_of(packets[s::streams], s + 1) for s in range(streams)]
    out = [page(FIRST | LAST * (not pages[s]), 0, s + 1, 0, bytes([len(ident)]), ident) for s in range(streams)]
    for turn in zip_longest(*pages, fillvalue=b""):
        out += turn
    return b"".join(out)


@dataclass
class Stream:
    packets: list[tuple[int, bytes]] = field(default_factory=list)  # (granule position at its end, packet)
    part: list[bytes] = field(default_factory=list)
    broken: bool = False  # the packet under way lost its beginning or a page
    next_page: int | None = None
    end: int = 0  # granule position at the end of the last packet
    lost: int = 0
    ended: bool = False


@dataclass
class Container:
    streams: dict[int, Stream] = field(default_factory=dict)
    pages: int = 0
    bad: int = 0
    joined: int = 0  # pages that go on with a packet


def read(data: bytes) -> Container:
    """Pages, checksums, logical streams and packets of Ogg bytes."""
    out, at = Container(), data.find(b"OggS")
    while at >= 0:
        if at + HEAD.size > len(data):
            out.bad += 1
            break
        _, version, flags, granule, serial, number, crc, count = HEAD.unpack_from(data, at)
        laces = data[at + HEAD.size : at + HEAD.size + count]
        body = at + HEAD.size + count
        end = body + sum(laces)
        raw = data[at:end]
        if version or len(laces) < count or end > len(data) or checksum(raw[:22] + b"\0\0\0\0" + raw[26:]) != crc:
            out.bad += 1
            at = data.find(b"OggS", at + 4)
            continue
        out.pages += 1
        stream = out.streams.setdefault(serial, Stream())
        gap = stream.next_page is not None and number != stream.next_page
        stream.next_page = number + 1
        if flags & CONTINUED:
            out.joined += 1
            if gap or not (stream.part or stream.broken):
                stream.part, stream.broken = [], True
        elif stream.part or stream.broken:
            stream.lost += 1
            stream.part, stream.broken = [], False
        whole = []
        for lace in laces:
            stream.part.append(data[body : body + lace])
            body += lace
            if lace < 255:
                if stream.broken:
                    stream.lost += 1
                else:
                    whole.append(b"".join(stream.part))
                stream.part, stream.broken = [], False
        at = granule - sum(map(len, whole)) if granule >= 0 else stream.end
        for packet in whole:
            at += len(packet)
            stream.packets.append((at, packet))
        stream.end = at if whole else stream.end
        stream.ended |= bool(flags & LAST)
        at = data.find(b"OggS", end)
    for stream in out.streams.values():
        stream.lost += bool(stream.part or stream.broken)  # cut off by the end of the bytes
    return out


def decode(data: bytes) -> tuple[bytes, int, str]:
    """Payload in the order of time, length before padding, and the feature string."""
    box = read(data)
    size, rate, timed, count, spans = 0, RATE, [], 0, []
    for serial, stream in sorted(box.streams.items()):
        ends = []
        for granule, packet in stream.packets:
            if len(packet) == IDENT.size and packet.startswith(MAGIC):
                _, rate, size = IDENT.unpack(packet)
            else:
                timed.append((granule - len(packet), serial, packet))
                ends.append((granule - len(packet), granule))
        count += len(stream.packets)
        if ends:
            spans.append(f"{serial}:{ends[0][0] * 1000000 // rate}-{ends[-1][1] * 1000000 // rate}us")
    timed.sort(key=lambda x: x[:2])
    payload = b"".join(p for _, _, p in timed)
    lost = sum(s.lost for s in box.streams.values())
    feature = (
        f"streams={len(box.streams)};pages={box.pages};bad={box.bad};joined={box.joined};packets={count};lost={lost};"
        f"ended={sum(s.ended for s in box.streams.values())};duration_us={len(payload) * 1000000 // rate};times={','.join(spans)}"
    )
    return payload, size, feature


def with_ogg(docs: DataFrame) -> DataFrame:
    """doc_id and media, the Ogg bytes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, offs = buffer_of(part)
                data, at = raw.tobytes(), offs.tolist()
                media = [encode(data[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string"
)


def ogg_features(media: DataFrame) -> DataFrame:
    """Digests and features of what is read back from a column ``media`` of Ogg bytes."""

    def digest(data: bytes) -> tuple:
        payload, size, feature = decode(data)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return size, len(payload), sha(payload), zlib.crc32(payload[-16:]), len(data), sha(data), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(m.as_py() or b"") for m in batch.column(1)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=[x.split()[0] for x in FEATURES.split(",")],
            )

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)
