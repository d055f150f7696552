"""The segment codec: varints, records, compressed segments, and the file that holds several of them.

Format, fixed: integers are zigzag or plain varints; a record is key length (-1: no key), key, value length,
value; a segment is the zstd (level 3) of its records with a CRC-32 of the compressed bytes; a file is its
segments, a footer, the footer's length (4 bytes, big-endian) and the magic FLRN.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import zstandard

MAGIC = b"FLRN"
ZSTD = 0
LEVEL = 3

Record = tuple[bytes | None, bytes]


class CodecError(Exception):
    pass


class Truncated(CodecError):
    pass


class Overflow(CodecError):
    pass


class CrcMismatch(CodecError):
    pass


def zigzag(n: int) -> int:
    return (n << 1) if n >= 0 else ((-n << 1) - 1)


def unzigzag(n: int) -> int:
    return n >> 1 if n % 2 == 0 else -((n + 1) >> 1)


def put_uvarint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n % 128 + 128)
        n //= 128
    out.append(n)


def put_varint(out: bytearray, n: int) -> None:
    put_uvarint(out, zigzag(n))


class Cursor:
    """Reads a buffer from the front."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.data, self.at = memoryview(data), at

    def __bool__(self) -> bool:
        return self.at < len(self.data)

    def take(self, n: int) -> memoryview:
        if n < 0 or self.at + n > len(self.data):
            raise Truncated(f"{n} bytes asked for, {len(self.data) - self.at} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def uvarint(self, bits: int = 64) -> int:
        n, place = 0, 0
        while True:
            b = self.take(1)[0]
            n += (b % 128) << place
            if n >> bits or place > 63:
                raise Overflow(f"more than {bits} bits")
            if b < 128:
                return n
            place += 7

    def varint(self, bits: int = 64) -> int:
        return unzigzag(self.uvarint(bits))


def encode_records(records: list[Record]) -> bytes:
    out = bytearray()
    for key, value in records:
        put_varint(out, -1 if key is None else len(key))
        out += key or b""
        put_varint(out, len(value))
        out += value
    return bytes(out)


def decode_records(data: bytes) -> Iterator[Record]:
    c = Cursor(data)
    while c:
        n = c.varint()
        key = None if n == -1 else bytes(c.take(n))
        yield key, bytes(c.take(c.varint()))


def encode_segment(records: list[Record], level: int = LEVEL) -> tuple[bytes, int]:
    """Compressed bytes and their CRC-32."""
    payload = zstandard.ZstdCompressor(level=level).compress(encode_records(records))
    return payload, zlib.crc32(payload)


def decode_segment(payload: bytes, crc32: int | None = None) -> list[Record]:
    if crc32 is not None and zlib.crc32(payload) != crc32:
        raise CrcMismatch(f"{zlib.crc32(payload):08x} instead of {crc32:08x}")
    if not payload:
        return []
    try:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
    except zstandard.ZstdError as e:
        raise CodecError(f"not a zstd frame: {e}") from e
    return list(decode_records(data))


@dataclass(frozen=True)
class Entry:
    """What the footer says of a segment. Offsets are provisional: the index table has the true ones."""

    topic_id: int
    schema_id: int
    start_offset: int
    end_offset: int
    record_count: int
    byte_offset: int
    byte_length: int
    ingest_time: int
    crc32: int
    codec: int = ZSTD


def encode_footer(entries: list[Entry]) -> bytes:
    out = bytearray()
    put_varint(out, len(entries))
    for e in entries:
        put_varint(out, e.topic_id)
        put_varint(out, e.schema_id)
        put_uvarint(out, e.start_offset)
        put_uvarint(out, e.end_offset)
        put_varint(out, e.record_count)
        for n in (e.byte_offset, e.byte_length, e.ingest_time):
            put_uvarint(out, n)
        out.append(e.codec)
        out += struct.pack(">I", e.crc32)
    return bytes(out)


def decode_footer(data: bytes) -> list[Entry]:
    c = Cursor(data)
    out = []
    for _ in range(c.varint()):
        ids = c.varint(), c.varint()
        start, end, count = c.uvarint(), c.uvarint(), c.varint()
        place = c.uvarint(), c.uvarint(), c.uvarint()
        codec = c.take(1)[0]
        out.append(Entry(*ids, start, end, count, *place, struct.unpack(">I", c.take(4))[0], codec))
    return out


def encode_file(segments: list[tuple[int, int, int, list[Record]]]) -> bytes:
    """segments: (topic_id, schema_id, ingest time in ms, records)."""
    body, entries = bytearray(), []
    for topic, schema, at, records in segments:
        payload, crc = encode_segment(records)
        entries.append(Entry(topic, schema, 0, 0, len(records), len(body), len(payload), at, crc))
        body += payload
    footer = encode_footer(entries)
    return bytes(body) + footer + struct.pack(">I", len(footer)) + MAGIC


def read_footer(tail: bytes) -> list[Entry]:
    """The entries of a file, from its last bytes (all of the footer at least)."""
    if len(tail) < 8 or tail[-4:] != MAGIC:
        raise CodecError("no magic at the end")
    n = struct.unpack(">I", tail[-8:-4])[0]
    if n > len(tail) - 8:
        raise Truncated(f"footer of {n} bytes")
    return decode_footer(tail[-8 - n : -8])
