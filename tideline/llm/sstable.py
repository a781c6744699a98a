"""A sorted-string-table file of documents' token ids.

    file   = magic "TLSST1\\n\\0", data blocks, index, Bloom filter, footer
    block  = u32 raw length, u32 stored length, u32 crc32 of the stored bytes, zstd of the raw bytes
    raw    = entries, u32 offset of each restart entry, u32 number of restarts
    entry  = varint bytes shared with the key before, varint further key bytes, varint value bytes, key, value
    value  = token ids, little endian, of the width (2 or 4 bytes) that the footer names
    index  = for each block: varint key length, first key, u64 offset; sorted by key
    Bloom  = u32 hashes, then bits
    footer = u64 index offset, u64 index length, u32 blocks, u64 Bloom offset, u64 Bloom length,
             u64 documents, u64 tokens, u32 id width, u32 crc32 of index and Bloom, magic

Keys sort as identifiers do: a null identifier is one byte 0; others a byte 1 and eight bytes, big
endian, with the sign flipped. Keys may repeat. Every sixteenth entry of a block is a restart, which
shares nothing, so that a lookup bisects the index, then the restarts, then reads at most 16 entries.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

MAGIC = b"TLSST1\n\0"
FOOTER = struct.Struct("<QQIQQQQII8s")
RESTART = 16


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 0x7F) << shift
        if x < 0x80:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Writes entries, given in key order, to a binary file object."""

    def __init__(self, out, width: int = 2, block_bytes: int = 256 << 10, bits_per_key: int = 10):
        self.out, self.width, self.block_bytes, self.bits_per_key = out, width, block_bytes, bits_per_key
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.offset, self.docs, self.tokens = 0, 0, 0
        self.index: list[tuple[bytes, int]] = []
        self.keys: list[bytes] = []
        self._write(MAGIC)
        self._begin()

    def _write(self, b: bytes) -> None:
        self.out.write(b)
        self.offset += len(b)

    def _begin(self) -> None:
        self.block, self.size, self.restarts, self.n, self.last, self.first = [], 0, [], 0, b"", b""

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(self.size)
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        if not self.n:
            self.first = key
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.n, self.last = self.n + 1, key
        self.docs, self.tokens = self.docs + 1, self.tokens + len(ids)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.n:
            return
        raw = b"".join(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        stored = self.pack(raw)
        self.index.append((self.first, self.offset))
        self._write(struct.pack("<III", len(raw), len(stored), zlib.crc32(stored)) + stored)
        self._begin()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<Q", at) for k, at in self.index)
        bits, hashes = max(64, len(self.keys) * self.bits_per_key), 7
        bloom = bytearray(-(-bits // 8))
        bits = len(bloom) * 8
        for k in self.keys:
            for p in _probes(k, bits, hashes):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = struct.pack("<I", hashes) + bytes(bloom)
        at = self.offset
        self._write(index)
        bloom_at = self.offset
        self._write(tail)
        self._write(FOOTER.pack(at, len(index), len(self.index), bloom_at, len(tail), self.docs, self.tokens, self.width, zlib.crc32(index + tail), MAGIC))


class Reader:
    """Looks up and scans a file written by Writer; holds the index, the filter and one block."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        at, n, blocks, bloom_at, bloom_n, self.docs, self.tokens, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        file.seek(at)
        index = file.read(n)
        file.seek(bloom_at)
        tail = file.read(bloom_n)
        if magic != MAGIC or zlib.crc32(index + tail) != crc:
            raise ValueError("not a complete table file")
        self.hashes, self.bloom = struct.unpack_from("<I", tail)[0], tail[4:]
        self.first: list[bytes] = []
        self.offsets: list[int] = []
        p = 0
        for _ in range(blocks):
            k, p = _read_varint(index, p)
            self.first.append(index[p : p + k])
            self.offsets.append(struct.unpack_from("<Q", index, p + k)[0])
            p += k + 8

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        self.file.seek(self.offsets[i])
        raw_n, n, crc = struct.unpack("<III", self.file.read(12))
        stored = self.file.read(n)
        if zlib.crc32(stored) != crc:
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(stored, max_output_size=raw_n)
        k = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        return raw[: len(raw) - 4 * (k + 1)], list(struct.unpack_from(f"<{k}I", raw, len(raw) - 4 * (k + 1)))

    def _entries(self, raw: bytes, at: int) -> Iterator[tuple[bytes, np.ndarray]]:
        last = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            more, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            last = last[:shared] + raw[at : at + more]
            yield last, np.frombuffer(raw, f"<u{self.width}", n // self.width, at + more)
            at += more + n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.offsets)):
            for key, ids in self._entries(self._block(i)[0], 0):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), len(self.bloom) * 8, self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of that key."""
        key = key_of(doc_id)
        if not self.offsets or not self.may_hold(doc_id):
            return []
        found = []
        for i in range(max(0, bisect_left(self.first, key) - 1), bisect_right(self.first, key)):
            raw, restarts = self._block(i)
            heads = [next(self._entries(raw, r))[0] for r in restarts]
            for k, ids in self._entries(raw, restarts[max(0, bisect_left(heads, key) - 1)]):
                if k > key:
                    break
                if k == key:
                    found.append(ids)
        return found
