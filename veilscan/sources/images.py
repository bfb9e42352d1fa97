"""Pixels of PNG and BMP contents, for images that are rows of a table (directories: ``files.image_samples``).

Contents are decoded in bands of rows: what is inflated of a PNG at once, and what a reader holds, is bounded by a band
and two rows, whatever size its header claims. An interlaced PNG is read by seven readers, one for each pass, that go
down the image side by side. Reading stops where the caller stops.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a band and of what is inflated at once.
BAND = 1 << 20
#: Bytes that a row of pixels may take in its file: filters need two whole rows.
MOST_ROW = 1 << 28
#: Bytes that a binary value can hold.
MOST_VALUE = (1 << 31) - 1
#: Start and step (column, row) of each pass of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


@dataclass
class Image:
    """``bands`` gives arrays of rows x width x 3 bytes from top to bottom; alpha is dropped, grey stands three times."""

    width: int
    height: int
    bands: Iterator[np.ndarray]


class _Inflated:
    """Reads inflated bytes of a PNG's data chunks, a bounded piece at a time."""

    def __init__(self, parts: list[memoryview], skip: int = 0):
        self.parts, self.stream, self.held = iter(parts), zlib.decompressobj(), bytearray()
        while skip:
            skip -= len(self.read(min(skip, BAND)))

    def _more(self) -> bool:
        left = self.stream.unconsumed_tail
        while not left:
            left = next(self.parts, None)
            if left is None:
                return False
        self.held += self.stream.decompress(left, BAND)
        return True

    def read(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("cut short")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def ended(self) -> bool:
        while not self.held and self._more():
            pass
        return not self.held


def _unfiltered(source: _Inflated, height: int, stride: int, step: int) -> Iterator[np.ndarray]:
    """Rows of bytes after PNG's per-row filters; ``step`` is the distance to the pixel on the left."""
    above = np.zeros(stride, np.int64)
    for _ in range(height):
        data = source.read(stride + 1)
        kind, line = data[0], np.frombuffer(data, np.uint8, stride, 1).astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step])
        elif kind in (3, 4):
            up, out = above.tolist(), line.tolist()
            for x in range(stride):
                a, b, c = (out[x - step] if x >= step else 0), up[x], (up[x - step] if x >= step else 0)
                if kind == 3:
                    near = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if pa <= pb and pa <= pc else b if pb <= pc else c
                out[x] = (out[x] + near) & 255
            line = np.array(out, np.int64)
        elif kind:
            raise ValueError(f"unknown row filter {kind}")
        above = line & 255
        yield above.astype(np.uint8)


@dataclass
class _Format:
    depth: int
    kind: int
    palette: np.ndarray | None

    def stride(self, width: int) -> int:
        return (width * _CHANNELS[self.kind] * self.depth + 7) // 8

    def pixels(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Rows of bytes as rows x width x 3 bytes."""
        channels = _CHANNELS[self.kind]
        if self.depth == 16:
            values = rows.reshape(len(rows), -1, 2)[:, :, 0]  # the high byte
        elif self.depth == 8:
            values = rows
        else:
            bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, self.depth)
            values = bits @ (1 << np.arange(self.depth - 1, -1, -1))
            if self.kind == 0:
                values = values * (255 // ((1 << self.depth) - 1))
        values = values[:, : width * channels].reshape(len(rows), width, channels)
        if self.kind == 3:
            return self.palette[values[:, :, 0]]
        return (np.repeat(values[:, :, :1], 3, axis=2) if channels <= 2 else values[:, :, :3]).astype(np.uint8)


def _in_bands(rows: Iterator[np.ndarray], width: int) -> Iterator[np.ndarray]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) * max(len(row), 3 * width) >= BAND:
            yield np.stack(held)
            held = []
    if held:
        yield np.stack(held)


def _plain(form: _Format, parts: list[memoryview], width: int, height: int) -> Iterator[np.ndarray]:
    source, channels = _Inflated(parts), _CHANNELS[form.kind]
    for rows in _in_bands(_unfiltered(source, height, form.stride(width), max(1, channels * form.depth // 8)), width):
        yield form.pixels(rows, width)
    if not source.ended():
        raise ValueError("more data than its pixels take")


def _interlaced(form: _Format, parts: list[memoryview], width: int, height: int) -> Iterator[np.ndarray]:
    readers, place = [], 0
    for x, y, right, down in PASSES:
        w, h = len(range(x, width, right)), len(range(y, height, down))
        if w and h:
            source = _Inflated(parts, place)
            readers.append((x, y, right, down, w, _unfiltered(source, h, form.stride(w), max(1, _CHANNELS[form.kind] * form.depth // 8)), source))
            place += h * (form.stride(w) + 1)

    def rows() -> Iterator[np.ndarray]:
        for at in range(height):
            row = np.zeros((width, 3), np.uint8)
            for x, y, right, down, w, lines, _ in readers:
                if at >= y and (at - y) % down == 0:
                    row[x::right] = form.pixels(next(lines)[None, :], w)[0]
            yield row

    yield from _in_bands(rows(), width)
    if readers and not readers[-1][-1].ended():
        raise ValueError("more data than its pixels take")


def _png(raw: bytes) -> Image:
    at, body, palette, head, whole = 8, [], None, None, memoryview(raw)
    while at + 8 <= len(raw):
        size, name = struct.unpack_from(">I4s", raw, at)
        chunk = whole[at + 8 : at + 8 + size]
        if len(chunk) < size:
            raise ValueError("cut short")
        at += 12 + size
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(chunk)
        elif name == b"IEND":
            break
    if head is None or not body:
        raise ValueError("no image data")
    width, height, depth, kind, _, _, interlaced = head
    if kind not in _CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise ValueError(f"{depth} bits of kind {kind}")
    form = _Format(depth, kind, palette)
    if form.stride(width) > MOST_ROW:
        raise ValueError(f"rows of {form.stride(width)} bytes")
    if kind == 3 and palette is None:
        raise ValueError("no palette")
    return Image(width, height, (_interlaced if interlaced else _plain)(form, body, width, height))


def _bmp(raw: bytes) -> Image:
    (start,) = struct.unpack_from("<I", raw, 10)
    size, width, height, _, depth, packed = struct.unpack_from("<IiiHHI", raw, 14)
    stride, lines = (width * depth // 8 + 3) // 4 * 4, abs(height)
    if depth not in (8, 24, 32) or packed not in ((0, 3) if depth == 32 else (0,)) or width <= 0 or not height:
        raise ValueError(f"{width} x {height} pixels, {depth} bits, packing {packed}")
    if start + stride * lines > len(raw):
        raise ValueError("cut short")
    rows = np.frombuffer(raw, np.uint8, stride * lines, start).reshape(lines, stride)
    rows = rows[::-1] if height > 0 else rows
    palette = None
    if depth == 8:
        (colours,) = struct.unpack_from("<I", raw, 46)
        palette = np.frombuffer(raw, np.uint8, 4 * (colours or 256), 14 + size).reshape(-1, 4)

    def bands() -> Iterator[np.ndarray]:
        n = max(1, BAND // (3 * width))
        for a in range(0, lines, n):
            part = rows[a : a + n]
            pixels = palette[part[:, :width]] if depth == 8 else part[:, : width * depth // 8].reshape(len(part), width, depth // 8)
            yield pixels[:, :, 2::-1]

    return Image(width, lines, bands())


#: What broken contents raise.
BROKEN = (ValueError, struct.error, zlib.error, IndexError)


def read_image(raw: bytes) -> Image:
    """A PNG or BMP image. It raises one of BROKEN for what is no such image, or while broken bands are read."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("neither PNG nor BMP")


def rgb(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes of an image that a binary value can hold. ValueError for what is no such image."""
    try:
        image = read_image(raw)
        if 3 * image.width * image.height > MOST_VALUE:
            raise ValueError(f"{image.width} x {image.height} pixels do not fit into one value")
        return np.concatenate([np.zeros((0, image.width, 3), np.uint8), *image.bands])
    except BROKEN as error:
        raise ValueError(str(error)) from None


def image_samples(items: DataFrame, content: str = "content") -> DataFrame:
    """Adds width, height, data (one byte per RGB sample) and error to ``items``."""

    @F.pandas_udf("struct<width:int,height:int,data:binary,error:string>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch:
                try:
                    a = rgb(raw or b"")
                    rows.append((a.shape[1], a.shape[0], a.tobytes(), None))
                except ValueError as error:
                    rows.append((None, None, None, f"not an image: {error}"))
            yield pd.DataFrame(rows, columns=["width", "height", "data", "error"]).astype({"width": "Int32", "height": "Int32"})

    found = items.withColumn("_i", decode(content))
    return found.withColumns({c: F.col(f"_i.{c}") for c in ("width", "height", "data", "error")}).drop("_i")
