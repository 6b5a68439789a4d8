"""Bytes of TIFF images: where blocks lie, decoding one of them, and encoding.

Readers get a function ``get(offset, size)``, so only what is asked for is fetched: the directory of a
file, then single strips or tiles. Classic and BigTIFF; strips and tiles; interleaved bands or one
after the other; plain, LZW, deflate and PackBits; horizontal and floating-point prediction.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

Get = Callable[[int, int], bytes]

#: Codes of value types, tags and compressions (fixed values of the format).
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, PACKING, STRIP_AT, BANDS, ROWS, STRIP_SIZE, PLANES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT = 322, 323, 324, 325, 339
PIXEL_SIZE, TIE_POINT, KEYS, NODATA = 33550, 33922, 34735, 42113


@dataclass(frozen=True)
class Block:
    """A strip or tile: place and size in the image (cut at its border), where its bytes are, and which band it has (-1: all)."""

    row: int
    col: int
    rows: int
    cols: int
    at: int
    size: int
    band: int


class Image:
    """The first image of a file."""

    def __init__(self, get: Get):
        self.get = get
        head = get(0, 16)
        if head[:4] not in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
            raise ValueError("not a TIFF")
        self.order = "<" if head[:2] == b"II" else ">"
        big = head[2:4] in (b"+\0", b"\0+")
        self.tags: dict[int, tuple] = {}
        at = struct.unpack(self.order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        count, entry, slot = ("Q", 20, 8) if big else ("H", 12, 4)
        n = struct.unpack(self.order + count, get(at, 8 if big else 2))[0]
        table = get(at + (8 if big else 2), n * entry)
        for k in range(n):
            e = table[k * entry : (k + 1) * entry]
            tag, kind, many = struct.unpack(self.order + ("HHQ" if big else "HHI"), e[: entry - slot])
            code = TYPES.get(kind)
            if code is None:
                continue
            form = f"{many}s" if code == "s" else code * many
            size = struct.calcsize(self.order + form)
            raw = e[entry - slot :] if size <= slot else get(struct.unpack(self.order + ("Q" if big else "I"), e[entry - slot :])[0], size)
            self.tags[tag] = struct.unpack(self.order + form, raw[:size])

    def one(self, tag: int, default: int | None = None) -> int:
        return self.tags[tag][0] if default is None or tag in self.tags else default

    @property
    def width(self) -> int:
        return self.one(WIDTH)

    @property
    def height(self) -> int:
        return self.one(HEIGHT)

    @property
    def bands(self) -> int:
        return self.one(BANDS, 1)

    @property
    def kind(self) -> np.dtype:
        return np.dtype({1: "u", 2: "i", 3: "f"}[self.one(FORMAT, 1)] + str(self.one(BITS, 1) // 8)).newbyteorder(self.order)

    @property
    def tiled(self) -> bool:
        return TILE_AT in self.tags

    def block_shape(self) -> tuple[int, int]:
        return (self.one(TILE_HEIGHT), self.one(TILE_WIDTH)) if self.tiled else (self._rows(), self.width)

    def _rows(self) -> int:
        """Rows of a strip; where a file of several strips does not say, as many as its first one holds."""
        if ROWS not in self.tags and len(self.tags[STRIP_AT]) > (self.bands if self.one(PLANES, 1) == 2 else 1):
            line = self.width * self.kind.itemsize * (1 if self.one(PLANES, 1) == 2 else self.bands)
            first = unpacked(self.get(self.tags[STRIP_AT][0], self.tags[STRIP_SIZE][0]), self.one(PACKING, 1), line * self.height)
            self.tags[ROWS] = (max(1, len(first) // line),)
        return min(self.one(ROWS, self.height), self.height)

    def blocks(self) -> Iterator[Block]:
        n, m = self.block_shape()
        places, sizes = (self.tags[TILE_AT], self.tags[TILE_SIZE]) if self.tiled else (self.tags[STRIP_AT], self.tags[STRIP_SIZE])
        across, down = -(-self.width // m), -(-self.height // n)
        for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
            plane, i = divmod(k, across * down)
            r, c = i // across * n, i % across * m
            yield Block(r, c, min(n, self.height - r), min(m, self.width - c), at, size, plane if self.one(PLANES, 1) == 2 else -1)

    def decode(self, block: Block, raw: bytes) -> np.ndarray:
        """Rows, columns and bands of a block in the machine's byte order."""
        n, m = self.block_shape() if self.tiled else (block.rows, block.cols)
        bands, kind = self.bands if block.band < 0 else 1, self.kind
        plain = unpacked(raw, self.one(PACKING, 1), n * m * bands * kind.itemsize)
        guess = self.one(PREDICTOR, 1)
        if guess == 3:
            a = np.cumsum(np.frombuffer(plain, np.uint8).reshape(n, -1, bands), axis=1, dtype=np.uint8)
            # bytes of all values of a row by significance, the highest first
            a = a.reshape(n, kind.itemsize, m * bands).transpose(0, 2, 1)
            a = np.ascontiguousarray(a).view(kind.newbyteorder(">")).reshape(n, m, bands)
        else:
            a = np.frombuffer(plain, kind).reshape(n, m, bands)
            if guess == 2:
                a = np.cumsum(a, axis=1, dtype=a.dtype)
        return a[: block.rows, : block.cols].astype(kind.newbyteorder("="))

    def transform(self) -> tuple[float, ...] | None:
        """a, b, c, d, e, f of x = a * column + b * row + c and y = d * column + e * row + f."""
        size, tie = self.tags.get(PIXEL_SIZE), self.tags.get(TIE_POINT)
        return (size[0], 0.0, tie[3] - tie[0] * size[0], 0.0, -size[1], tie[4] + tie[1] * size[1]) if size and tie else None

    def srid(self) -> int | None:
        keys = self.tags.get(KEYS, ())
        return next((keys[i + 3] for want in (3072, 2048) for i in range(4, len(keys) - 3, 4) if keys[i] == want), None)


def unpacked(raw: bytes, packing: int, size: int) -> bytes:
    if packing == 1:
        return raw[:size]
    if packing in (8, 32946):
        return zlib.decompress(raw)[:size]
    if packing == 5:
        return _lzw(raw, size)
    if packing == 32773:
        return _runs(raw, size)
    raise ValueError(f"compression {packing}")


def _lzw(raw: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 clears the table, 257 ends."""
    bits, held, at = 0, 0, 0
    out, words, width, before = bytearray(), [], 9, b""
    while len(out) < size:
        while held < width:
            if at >= len(raw):
                return bytes(out)
            bits, held, at = (bits << 8 | raw[at]) & 0xFFFFFF, held + 8, at + 1
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            words, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = words[code] if code < len(words) else before + before[:1]
        if before:
            words.append(before + word[:1])
            # the writer is one entry ahead
            width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
        out += word
        before = word
    return bytes(out[:size])


def _runs(raw: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out[:size])


def encoded(a: np.ndarray, transform: tuple[float, ...] | None = None, srid: int | None = None, nodata: float | None = None, tile: int | None = None, rows: int = 64) -> bytes:
    """A deflated TIFF of rows, columns and bands, in strips of some rows or in square tiles, with its place if known."""
    if a.ndim == 2:
        a = a[:, :, None]
    h, w, bands = a.shape
    a = np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<"))
    if tile:
        full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, bands), a.dtype)
        full[:h, :w] = a
        parts = [full[r : r + tile, c : c + tile] for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        parts = [a[r : r + rows] for r in range(0, h, rows)]
    data = [zlib.compress(np.ascontiguousarray(p).tobytes(), 6) for p in parts]
    starts = np.cumsum([8, *map(len, data)])
    numbers = {"u": 1, "i": 2, "f": 3}
    tags: dict[int, tuple[str, tuple]] = {
        WIDTH: ("I", (w,)), HEIGHT: ("I", (h,)), BITS: ("H", (a.dtype.itemsize * 8,) * bands), PACKING: ("H", (8,)), 262: ("H", (2 if bands in (3, 4) and a.dtype.itemsize == 1 else 1,)),
        BANDS: ("H", (bands,)), PLANES: ("H", (1,)), FORMAT: ("H", (numbers[a.dtype.kind],) * bands),
    }
    places, sizes = tuple(map(int, starts[:-1])), tuple(map(len, data))
    tags |= {TILE_WIDTH: ("I", (tile,)), TILE_HEIGHT: ("I", (tile,)), TILE_AT: ("I", places), TILE_SIZE: ("I", sizes)} if tile else {STRIP_AT: ("I", places), ROWS: ("I", (rows,)), STRIP_SIZE: ("I", sizes)}
    if transform:
        ta, _, tc, _, te, tf = transform
        tags |= {PIXEL_SIZE: ("d", (ta, -te, 0.0)), TIE_POINT: ("d", (0.0, 0.0, 0.0, tc, tf, 0.0))}
    if srid:
        geographic = 4000 <= srid < 5000
        tags[KEYS] = ("H", (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, srid))
    if nodata is not None:
        text = f"{nodata:g}\0".encode()
        tags[NODATA] = ("s", (text,))
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    at = int(starts[-1]) + int(starts[-1]) % 2
    entries, more, free = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        code, values = tags[tag]
        raw = values[0] if code == "s" else struct.pack("<" + code * len(values), *values)
        entries += struct.pack("<HHI", tag, codes[code], len(raw) if code == "s" else len(values))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", free + len(more))
            more += raw + b"\0" * (len(raw) % 2)
    body = b"".join(data)
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (at - 8 - len(body)) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + more


def png(a: np.ndarray) -> bytes:
    """A PNG of 8 or 16 bit whole numbers: gray, gray and opacity, colours, or colours and opacity."""
    if a.ndim == 2:
        a = a[:, :, None]
    h, w, bands = a.shape
    bits = a.dtype.itemsize * 8
    if a.dtype.kind != "u" or bits not in (8, 16) or bands > 4:
        raise ValueError("a PNG has one to four bands of 8 or 16 bits")
    raw = a.astype(">u2" if bits == 16 else "u1").reshape(h, -1).view(np.uint8).reshape(h, -1)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), raw], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, bits, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")
