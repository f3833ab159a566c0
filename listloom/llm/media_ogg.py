"""Media columns in Ogg: pages, lacing, logical streams and granule positions.

``store_payloads`` keeps a payload per row as 8-bit samples in one logical stream, beside a second logical stream with
the payload's description; ``read_media`` reads such bytes back. The reader takes any Ogg bytes: it finds page starts,
verifies page checksums, reassembles packets from lacing values (also across pages), separates logical streams by serial
number, and derives times from granule positions. Damaged pages are counted and left out; a packet that lost a part is
dropped and counted as a hole.

Defined cases: null text is empty text, whose payload is one block of filler; a null or foreign media value reads back
as no streams and an empty payload; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.session import ship

from .common import returning_memory, text_of

BLOCK = 576
PACKET_BLOCKS = 8
RATE = 8000
SAMPLES = b"u8samples"
NOTES = b"u8notes"

CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, start and final value 0.

    The mirrored CRC-32 of zlib over mirrored bytes, without its inversions, is the mirror of this one.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Page:
    serial: int
    number: int
    flags: int
    granule: int
    lacing: bytes
    body: bytes


def write_page(page: Page) -> bytes:
    head = _HEAD.pack(b"OggS", 0, page.flags, page.granule, page.serial, page.number, 0, len(page.lacing))
    raw = head + page.lacing + page.body
    return raw[:22] + page_checksum(raw).to_bytes(4, "little") + raw[26:]


def paginate(serial: int, header: bytes, packets: list[bytes], granules: list[int], segments: int = 255) -> list[Page]:
    """Pages of one logical stream. The header packet has the first page for itself; a page's granule position is that
    of the last packet that ends on it, and -1 where none does."""
    pages = [Page(serial, 0, FIRST, 0, _laces(header), header)]
    lacing = b"".join(map(_laces, packets))
    body = b"".join(packets)
    at = done = 0
    for low in range(0, len(lacing), segments):
        laces = lacing[low : low + segments]
        size = sum(laces)
        ended = len(laces) - laces.count(255)
        done += ended
        flags = CONTINUED if low and lacing[low - 1] == 255 else 0
        pages.append(Page(serial, len(pages), flags, granules[done - 1] if ended else -1, laces, body[at : at + size]))
        at += size
    pages[-1].flags |= LAST
    return pages


def _laces(packet: bytes) -> bytes:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def multiplex(streams: list[list[Page]]) -> bytes:
    """First pages of all streams, then their other pages in turn."""
    out = [write_page(pages[0]) for pages in streams]
    for k in range(1, max(map(len, streams))):
        out += [write_page(pages[k]) for pages in streams if k < len(pages)]
    return b"".join(out)


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position that the page states for the packet, or None: more packets ended on that page after it.
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    holes: int = 0
    ended: bool = False
    _part: list[bytes] = field(default_factory=list)
    _open: bool = False
    _next: int | None = None

    def add(self, page: Page) -> None:
        self.pages += 1
        if self._next is not None and page.number != self._next:
            self.holes += 1
            self._part, self._open = [], False
        self._next = page.number + 1
        skip = False
        if page.flags & CONTINUED:
            skip = not self._open  # the start of this packet is lost
        elif self._open:
            self.holes += 1
            self._part, self._open = [], False
        at, begin = 0, 0
        stated = None
        for lace in page.lacing:
            at += lace
            if lace < 255:
                if skip:
                    skip = False
                    self.holes += 1
                else:
                    self._part.append(page.body[begin:at])
                    self.packets.append(b"".join(self._part))
                    self.granules.append(None)
                    stated = len(self.granules) - 1
                self._part, self._open = [], False
                begin = at
        if begin < at or (page.lacing and page.lacing[-1] == 255):
            if not skip:
                self._part.append(page.body[begin:at])
                self._open = True
        if stated is not None and page.granule >= 0:
            self.granules[stated] = page.granule
        self.ended |= bool(page.flags & LAST)


def read_pages(media: bytes) -> Iterator[Page | None]:
    """Pages in order; None for each stretch that is no page or fails its checksum."""
    at, end = 0, len(media)
    while at < end:
        ok = media[at : at + 4] == b"OggS" and at + 27 <= end
        if ok:
            _, version, flags, granule, serial, number, checksum, count = _HEAD.unpack_from(media, at)
            lacing = media[at + 27 : at + 27 + count]
            begin = at + 27 + count
            stop = begin + sum(lacing)
            ok = version == 0 and len(lacing) == count and stop <= end
        if ok:
            raw = media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : stop]
            ok = page_checksum(raw) == checksum
        if ok:
            yield Page(serial, number, flags, granule, lacing, media[begin:stop])
            at = stop
        else:
            yield None
            found = media.find(b"OggS", at + 1)
            at = end if found < 0 else found


def demultiplex(media: bytes | None) -> tuple[dict[int, LogicalStream], int]:
    """Logical streams by serial number, in order of appearance, and the number of damaged stretches."""
    streams: dict[int, LogicalStream] = {}
    damaged = 0
    for page in read_pages(media or b""):
        if page is None:
            damaged += 1
        else:
            if page.serial not in streams:
                streams[page.serial] = LogicalStream(page.serial)
            streams[page.serial].add(page)
    return streams, damaged


def packet_times(stream: LogicalStream, rate: int) -> list[tuple[float, float] | None]:
    """Start and end second of each data packet of one sample a byte, counted back from the stated granule positions;
    None where no later packet of its page has one."""
    out: list[tuple[float, float] | None] = [None] * len(stream.packets)
    end: int | None = None
    for k in range(len(stream.packets) - 1, 0, -1):
        end = stream.granules[k] if stream.granules[k] is not None else end
        if end is not None:
            start = end - len(stream.packets[k])
            out[k] = (start / rate, end / rate)
            end = start
    return out[1:]


def padded(text: bytes, block: int = BLOCK) -> bytes:
    size = max(1, -(-len(text) // block)) * block
    return text + b"\xff" * (size - len(text))


def encode_payload(payload: bytes, notes: bytes, rate: int = RATE) -> bytes:
    """One Ogg file: the payload as 8-bit samples and a stream of notes. Serial numbers follow from the payload."""
    step = BLOCK * PACKET_BLOCKS
    packets = [payload[k : k + step] for k in range(0, len(payload), step)]
    granules = np.cumsum([len(p) for p in packets]).tolist()
    serial = zlib.crc32(payload)
    head = SAMPLES + struct.pack("<IB", rate, 1)
    return multiplex(
        [paginate(serial, head, packets, granules), paginate((serial + 1) & 0xFFFFFFFF, NOTES, [notes], [len(payload)])]
    )


def decode_media(media: bytes | None) -> tuple[bytes, bytes, str]:
    """(payload, notes, features) of the first sample stream; features describe the container and the samples."""
    streams, damaged = demultiplex(media)
    payload, notes, rate, times = b"", b"", RATE, []
    pages = holes = packets = 0
    for s in streams.values():
        pages, holes = pages + s.pages, holes + s.holes
        if s.packets and s.packets[0].startswith(SAMPLES) and not payload:
            rate = struct.unpack_from("<I", s.packets[0], len(SAMPLES))[0]
            payload = b"".join(s.packets[1:])
            packets, times = len(s.packets) - 1, packet_times(s, rate)
        elif s.packets and s.packets[0] == NOTES:
            notes = b"".join(s.packets[1:])
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    n = max(1, len(x))
    high = x >= 0
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    last = times[-1] if times and times[-1] else (0.0, 0.0)
    features = (
        f"streams={len(streams)};pages={pages};packets={packets};damaged={damaged};holes={holes};rate={rate};"
        f"seconds={last[1]:.6f};last_packet_at={last[0]:.6f};mean={x.sum() / n:.6f};"
        f"rms={float(np.sqrt((x * x).sum() / n)):.6f};peak={int(np.abs(x).max(initial=0))};crossings={crossings}"
    )
    return payload, notes, features


def store_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the whole text of each row as an Ogg value."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                media = [
                    encode_payload(padded(raw), b"bytes=%d" % len(raw)) for raw in part.column("raw").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], F.encode(text_of(docs), "UTF-8").alias("raw")).mapInArrow(
        returning_memory(run), f"doc_id {kind}, media binary"
    )


def read_media(stored: DataFrame) -> DataFrame:
    """``stored(doc_id, media)`` with payload (padded), n_bytes (from the notes, null without) and feature added."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                got = [decode_media(m) for m in part.column("media").to_pylist()]
                sizes = [int(notes[6:]) if notes.startswith(b"bytes=") else None for _, notes, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("media"),
                        pa.array([p for p, _, _ in got], pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array([f for _, _, f in got], pa.string()),
                    ],
                    names=["doc_id", "media", "payload", "n_bytes", "feature"],
                )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "media").mapInArrow(
        returning_memory(run), f"doc_id {kind}, media binary, payload binary, n_bytes long, feature string"
    )
