"""Media columns in Ogg: pages with checksums, packets by lacing values, two multiplexed
logical streams, and times from granule positions.

write() stores 8-bit samples as packets of PACKET samples, dealt in turn to two logical
streams. Each stream begins with a page that holds its header packet (magic, rate, its
place among the streams, samples in all); data pages take PAGE_SEGMENTS lacing values, so packets go on across them, and bear the granule position of
the last packet that they complete, counted in samples of the whole. read() verifies
the checksum and the sequence number of every page and the marks of a stream's beginning and end, reassembles the packets of each
serial number, gives each packet the sample at which it starts from
the granule positions, and puts the samples in the order of these times.

Defined results: null text counts as empty; any text is padded with spaces to a positive
multiple of FRAME bytes; equal texts give equal bytes, as serial numbers come from the
payload; a damaged stream raises ValueError; an empty table gives no rows; repeated rows
get a row each; other columns are ignored. A text of any length is a chain of pages of
64 KB at most.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship

FRAME = 192
PACKET = FRAME * 10
PAGE_SEGMENTS = 100
RATE = 8_000
MAGIC = b"OggU8PCM"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04c11db7, not reflected, from 0), by way of zlib's, which reflects."""
    r = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing_of(packet: bytes) -> bytes:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    if len(lacing) > 255:
        raise ValueError("a page has 255 segments at most")
    page = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + checksum(page).to_bytes(4, "little") + page[26:]


def write(samples: bytes, rate: int = RATE) -> bytes:
    """An Ogg file with the samples in two logical streams."""
    first = zlib.crc32(samples)
    serials = (first, first ^ 0x5A5A5A5A)
    heads = [struct.pack("<8sIBBQ", MAGIC, rate, i, len(serials), len(samples)) for i in range(len(serials))]
    out = [_page(s, 0, 2, 0, lacing_of(h), h) for s, h in zip(serials, heads)]
    packets = [samples[i : i + PACKET] for i in range(0, len(samples), PACKET)]
    made = []  # (last packet that ends in it, stream, page) of the data pages
    for i, serial in enumerate(serials):
        own = range(i, len(packets), len(serials))
        lacing, body = b"".join(lacing_of(packets[k]) for k in own), b"".join(packets[k] for k in own)
        at = done = 0
        for number, begin in enumerate(range(0, max(len(lacing), 1), PAGE_SEGMENTS), 1):
            values = lacing[begin : begin + PAGE_SEGMENTS]
            size, going = sum(values), begin > 0 and lacing[begin - 1] == 255
            done += sum(v < 255 for v in values)
            last = own[done - 1] if done else -1
            granule = min((last + 1) * PACKET, len(samples)) if any(v < 255 for v in values) or not values else -1
            made.append((last, i, _page(serial, number, going + 4 * (begin + PAGE_SEGMENTS >= len(lacing)), granule, values, body[at : at + size])))
            at += size
    out += [page for _, _, page in sorted(made, key=lambda x: x[:2])]
    return b"".join(out)


def pages(data: bytes):
    """(flags, granule, serial, number, lacing, body) of each page; raises ValueError where one is damaged."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) < at + 27:
            raise ValueError(f"no page at {at}")
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if version or len(page) != end - at or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError(f"damaged page at {at}")
        yield flags, granule, serial, number, lacing, page[27 + n :]
        at = end


def demultiplex(data: bytes) -> tuple[dict[int, list[tuple[int, bytes]]], int]:
    """serial: [(end of the packet's page in samples, or -1 if not the last of its page, packet)], and the number of pages."""
    streams: dict[int, list] = {}
    partial: dict[int, bytes] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    n_pages = 0
    for flags, granule, serial, number, lacing, body in pages(data):
        n_pages += 1
        if serial in ended or number != expected.get(serial, 0) or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(partial.get(serial)):
            raise ValueError("a page is missing or out of order")
        if flags & 4:
            ended.add(serial)
        expected[serial] = number + 1
        own = streams.setdefault(serial, [])
        at = size = 0
        for v in lacing:
            size += v
            if v < 255:
                own.append((-1, partial.pop(serial, b"") + body[at : at + size]))
                at, size = at + size, 0
                last = len(own) - 1
        if size:
            partial[serial] = partial.get(serial, b"") + body[at : at + size]
        if any(v < 255 for v in lacing):
            own[last] = (granule, own[last][1])
    if any(partial.values()) or ended != set(streams):
        raise ValueError("a packet or a stream has no end")
    return streams, n_pages


def read(data: bytes) -> tuple[bytes, dict]:
    """The samples, and what the file says about itself."""
    streams, n_pages = demultiplex(data)
    timed: list[tuple[int, bytes]] = []
    rate = total = n = 0
    for own in streams.values():
        magic, rate, _, n, total = struct.unpack("<8sIBBQ", own[0][1])
        if magic != MAGIC:
            raise ValueError("not a stream of 8-bit samples")
        run: list[bytes] = []
        for granule, packet in own[1:]:
            run.append(packet)
            if granule >= 0:  # packets before it in its page end a packet of each stream earlier
                end = granule
                for k, p in enumerate(reversed(run)):
                    timed.append((end - len(p), p))
                    end -= len(p) + (n - 1) * PACKET
                run = []
    timed.sort(key=lambda x: x[0])
    samples = b"".join(p for _, p in timed)
    if len(streams) != n or len(samples) != total or any(b[0] != a[0] + len(a[1]) for a, b in zip(timed, timed[1:])):
        raise ValueError("samples are missing")
    return samples, {"streams": n, "pages": n_pages, "packets": len(timed), "rate": rate, "duration_us": total * 1_000_000 // rate, "last_start_us": timed[-1][0] * 1_000_000 // rate}


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME)), len(raw)


def _features(samples: bytes, info: dict) -> str:
    mean = int(np.frombuffer(samples, np.uint8).sum(dtype=np.int64)) // len(samples)
    return ";".join(f"{k}={v}" for k, v in info.items()) + f";level={mean};peak={max(samples)}"


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored file of each row."""
    ship(docs.sparkSession)

    def store(batches):
        for b in batches:
            made = [payload(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array([n for _, n in made], pa.int64()), "media": pa.array([write(p) for p, _ in made], pa.binary())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What can be read from the column `media`: sizes, digests and features."""

    def features(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for m in b.column(2).to_pylist():
                samples, info = read(m)
                row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(m), hashlib.sha256(m).hexdigest(), _features(samples, info))
                for k, v in zip(out, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": b.column(1)} | {k: pa.array(v, pa.string() if k.endswith("256") or k == "feature" else pa.int64()) for k, v in out.items()})

    return media.select("doc_id", "n_bytes", "media").mapInArrow(features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(media_columns(documents(spark, sf_dir)))
