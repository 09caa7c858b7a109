"""Compressed blocks: a nine-byte header (tag, method, two 24-bit sizes) before each run of data."""

from __future__ import annotations

import lzma
import zlib

import xxhash
import zstandard

#: Fixed values of the format: the two-letter tags, the method byte, and the largest block.
TAGS = {"zlib": b"ZL", "lzma": b"XZ", "lz4": b"L4", "zstd": b"ZS"}
METHOD = {"zlib": 8, "lzma": 0, "lz4": 1, "zstd": 1}
LARGEST = (1 << 24) - 1


def lz4_decode(data: bytes, size: int) -> bytes:
    """One LZ4 block."""
    out, i = bytearray(), 0

    def length(n: int, i: int) -> tuple[int, int]:
        if n == 15:
            while True:
                n += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        return n, i

    while i < len(data):
        token = data[i]
        n, i = length(token >> 4, i + 1)
        out += data[i : i + n]
        i += n
        if i >= len(data):
            break
        back = data[i] | data[i + 1] << 8
        n, i = length(token & 15, i + 2)
        if not 0 < back <= len(out):
            raise ValueError("a match points before the data")
        for _ in range(n + 4):
            out.append(out[-back])
        if len(out) > size:
            break
    if len(out) != size:
        raise ValueError("the block does not have the size stated")
    return bytes(out)


def lz4_encode(data: bytes) -> bytes:
    """An LZ4 block of literals only."""
    n, head = len(data), bytearray()
    head.append(min(n, 15) << 4)
    if n >= 15:
        rest = n - 15
        head += b"\xff" * (rest // 255) + bytes([rest % 255])
    return bytes(head) + data


def decompress(data: bytes, size: int) -> bytes:
    """Undo ``compress``; data of the stated size is taken as stored."""
    if len(data) == size:
        return data
    out, i = [], 0
    while i < len(data):
        tag, packed, plain = data[i : i + 2], int.from_bytes(data[i + 3 : i + 6], "little"), int.from_bytes(data[i + 6 : i + 9], "little")
        body = data[i + 9 : i + 9 + packed]
        if len(body) != packed:
            raise ValueError("a block ends early")
        if tag == b"ZL":
            piece = zlib.decompress(body)
        elif tag == b"XZ":
            piece = lzma.decompress(body)
        elif tag == b"ZS":
            piece = zstandard.ZstdDecompressor().decompress(body, max_output_size=plain)
        elif tag == b"L4":
            if xxhash.xxh64_digest(body[8:]) != body[:8]:
                raise ValueError("the checksum of a block is wrong")
            piece = lz4_decode(body[8:], plain)
        else:
            raise ValueError(f"unknown block tag {tag!r}")
        if len(piece) != plain:
            raise ValueError("a block does not have the size stated")
        out.append(piece)
        i += 9 + packed
    whole = b"".join(out)
    if len(whole) != size:
        raise ValueError("the data do not have the size stated")
    return whole


def compress(data: bytes, codec: str = "zstd", level: int = 5) -> bytes:
    """Blocks of at most 16 MiB - 1; data that do not shrink stay as they are."""
    out = []
    for k in range(0, len(data), LARGEST):
        piece = data[k : k + LARGEST]
        if codec == "zlib":
            body = zlib.compress(piece, level)
        elif codec == "lzma":
            body = lzma.compress(piece, preset=level)
        elif codec == "zstd":
            body = zstandard.ZstdCompressor(level=level).compress(piece)
        else:
            block = lz4_encode(piece)
            body = xxhash.xxh64_digest(block) + block
        if len(body) > LARGEST:
            return data
        out.append(TAGS[codec] + bytes([METHOD[codec]]) + len(body).to_bytes(3, "little") + len(piece).to_bytes(3, "little") + body)
    whole = b"".join(out)
    return whole if len(whole) < len(data) else data
