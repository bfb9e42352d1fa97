"""What detectors need to know of image, sound and comment carriers, measured once per row."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bits import unhex
from ..functions.detect import COMMENT_MARK
from .files import user_comment
from .images import BROKEN, read_image

# The extensions of each carrier.
IMAGE, SOUND, COMMENT = (".png", ".bmp"), (".wav",), (".jpg", ".jpeg", ".tiff")
MARK = bytes.fromhex(COMMENT_MARK)
FACTS = "struct<n:long,ones:long,pair_ratio:double,comment_bytes:long,marked:boolean,error:string>"
#: The same for Arrow.
_FACTS = (("n", pa.int64()), ("ones", pa.int64()), ("pair_ratio", pa.float64()), ("comment_bytes", pa.int64()), ("marked", pa.bool_()), ("error", pa.string()))


#: Frames of sound read at once.
FRAMES = 1 << 18


def statistics(blocks: Iterator[np.ndarray]) -> tuple[int, int, float | None]:
    """(samples, how many are odd, mean of 2 * min / max(sum, 1) over adjacent pairs; an odd last one is left out) of
    samples that come in blocks: only sums and a sample without its partner are kept between them."""
    n, ones, pairs, total, rest = 0, 0, 0, 0.0, np.zeros(0, np.int64)
    for block in blocks:
        n, ones = n + len(block), ones + int((block & 1).sum())
        samples = np.concatenate([rest, block]) if len(rest) else block
        half = len(samples) // 2
        even, odd = samples[: 2 * half : 2].astype(np.float64), samples[1 : 2 * half : 2].astype(np.float64)
        total, pairs, rest = total + float((2 * np.minimum(even, odd) / np.maximum(even + odd, 1)).sum()), pairs + half, samples[2 * half :]
    return n, ones, total / pairs if pairs else None


def image_blocks(raw: bytes) -> tuple[int, Iterator[np.ndarray]]:
    """How many samples an image has, and its samples in blocks."""
    image = read_image(raw)
    return 3 * image.width * image.height, (band.reshape(-1) for band in image.bands)


def sound_blocks(raw: bytes) -> tuple[int, Iterator[np.ndarray]]:
    """How many 16-bit samples (channels interleaved) a WAV file has, and its samples in blocks."""
    source = wave.open(io.BytesIO(raw))
    if source.getsampwidth() != 2:
        raise ValueError(f"{8 * source.getsampwidth()}-bit samples")

    def blocks() -> Iterator[np.ndarray]:
        while data := source.readframes(FRAMES):
            yield np.frombuffer(data, "<i2", len(data) // 2)

    return source.getnframes() * source.getnchannels(), blocks()


#: What broken carriers raise.
BAD = (*BROKEN, wave.Error, EOFError)


def _facts(ext: str, raw: bytes | memoryview) -> tuple:
    try:
        if ext in IMAGE:
            return *statistics(image_blocks(raw)[1]), None, None, None
        if ext in SOUND:
            n, ones, _ = statistics(sound_blocks(raw)[1])
            return n, ones, None, None, None, None
        comment = user_comment(raw)
        return None, None, None, len(comment), comment[: len(MARK)] == MARK, None
    except BAD as error:
        return None, None, None, None, None, f"{ext}: {error or type(error).__name__}"


def embedded(total: int, blocks: Iterator[np.ndarray]) -> tuple[bytes | None, str]:
    """(payload, status) of marked samples: 32 length bits are read first, then only the samples they declare. The
    status is that of ``marks.recover_samples``."""
    if total < 32:
        return None, "too_short"
    need, bits, size = 32, [], None
    held = 0
    while True:
        if held >= need:
            every = np.concatenate(bits)
            if size is not None:
                return np.packbits(every[32:need]).tobytes(), "ok"
            size = int.from_bytes(np.packbits(every[:32]).tobytes(), "big")
            need = 32 + 8 * size
            if need > total:
                return None, "declared_length_exceeds"
            continue
        block = next(blocks, None)
        if block is None:
            raise ValueError("cut short")
        bits.append((block[: need - held if size is not None else len(block)] & 1).astype(np.uint8))
        held += len(bits[-1])


def hidden(ext: Column, content: Column) -> Column:
    """struct(payload, status, error) of what image, sound and comment carriers hold; nulls for every other item, whose
    bytes never leave the JVM. Contents are decoded only as far as the payload goes."""

    def one(kind: str, raw: bytes) -> tuple:
        try:
            if kind in IMAGE:
                return *embedded(*image_blocks(raw)), None
            if kind in SOUND:
                return *embedded(*sound_blocks(raw)), None
            comment = user_comment(raw)
            marked = comment.startswith(MARK)
            return comment[len(MARK) :] if marked else None, "ok" if marked else "no_mark", None
        except BAD as error:
            return None, "broken", f"{kind}: {error or type(error).__name__}"

    @F.pandas_udf("struct<payload:binary,status:string,error:string>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, contents in batches:
            rows = [one(k, c) if c is not None else (None,) * 3 for k, c in zip(kinds, contents, strict=True)]
            yield pd.DataFrame(rows, columns=["payload", "status", "error"])

    return read(ext, F.when(ext.isin(*IMAGE, *SOUND, *COMMENT), content))


#: How contents that can be read start, and how many bytes of others tell their error.
STARTS = ((IMAGE, ("89504E470D0A1A0A", "424D"), 8), (SOUND, ("52494646",), 8), (COMMENT, ("FFD8", "4949", "4D4D"), 2))


def _readable(ext: Column, content: Column) -> Column:
    """The content of image, sound and comment carriers; of those that start like nothing that can be read, only the
    first bytes, from which ``_facts`` tells the same. Null for every other item."""
    found = F.lit(None).cast("binary")
    for extensions, starts, n in STARTS:
        known = F.lit(False)
        for start in starts:
            known = known | F.startswith(content, unhex(start))
        found = F.when(ext.isin(*extensions), F.when(known, content).otherwise(F.call_function("substring", content, F.lit(1), F.lit(n)))).otherwise(found)
    return found


def measured(kinds: pa.Array, contents: pa.Array) -> pa.StructArray:
    """FACTS of a batch. Contents are read where they lie in it, and only numbers and errors are made."""
    rows = [_facts(k, memoryview(c.as_buffer()).cast("B")) if c.is_valid else (None,) * len(_FACTS) for k, c in zip(kinds.to_pylist(), contents, strict=True)]
    columns = list(zip(*rows, strict=True)) or [()] * len(_FACTS)
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FACTS, strict=True)], [name for name, _ in _FACTS])


def facts(ext: Column, content: Column) -> Column:
    """FACTS of image, sound and comment carriers; nulls for every other item, whose bytes never leave the JVM. A worker
    holds the batch it reads and what one item's bands take, but no copies of a batch's contents."""

    @F.arrow_udf(FACTS)
    def measure(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield measured(*batch)

    return measure(ext, _readable(ext, content))
