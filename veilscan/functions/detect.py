"""Detectors: each turns a column into an array of signals (name, score, detail, metric).

They are expressions without joins or shuffles, so they run the same on batch and streaming input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SIGNALS
from .bits import END, LINE_END, ONE, ZERO, after_last, unhex

# Name, needle, score and detail of each known-tool signature.
SIGNATURES = (
    ("openstego", "OPENSTEGO", 90, "OpenStego marker"),
    ("steghide", "shsh", 70, "possible steghide artifact"),
    ("outguess", "OutGuess", 85, "OutGuess marker"),
    ("stegapp", "STEGAPP", 95, "JPEG trailer mark"),
    ("stegexif", "STEGEXIF", 95, "EXIF comment mark"),
)

# The end marker of each file type, in hexadecimal.
END_MARKERS = {".png": "49454E44AE426082", ".jpg": "FFD9", ".jpeg": "FFD9", ".gif": "3B", ".pdf": "2525454F46"}

# How embedded files start, in hexadecimal, in the order in which they are tried.
TRAILER_PREFIXES = (
    ("504B0304", "ZIP archive"),
    ("526172211A07", "RAR archive"),
    ("377ABCAF271C", "7z archive"),
    ("4D5A", "PE executable"),
    ("7F454C46", "ELF executable"),
)
JPEG_END = "FFD9"
TRAILER_MARK, COMMENT_MARK = b"STEGAPP".hex(), b"STEGEXIF".hex()


def signal(name: Column | str, score: Column | int, detail: Column | str, metric: Column | float | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(name).alias("name"), as_column(score).cast("int").alias("score"), as_column(detail).alias("detail"), as_column(metric).cast("double").alias("metric")
    )


def signals(*each: Column) -> Column:
    """An array of those signals that are not null."""
    return F.array_compact(F.array(*each)).cast(SIGNALS)


def suspicion(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda s: s["score"])), F.lit(0))


def zero_width(text: Column) -> Column:
    # marks are taken off by scans of bytes, where translate makes a string of each character; each mark has three bytes
    clean = text
    for mark in ZERO + ONE + END:
        clean = F.replace(clean, F.lit(mark), F.lit(""))
    n = ((F.octet_length(text) - F.octet_length(clean)) / 3).cast("int")
    score = F.least(F.lit(100), 70 + F.floor(n / 2))
    return signals(F.when(n > 0, signal("zero_width_chars", score, F.concat(n.cast("string"), F.lit(" zero-width chars")), n)))


#: Line ends and the other characters that str.strip() takes.
_ENDS = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
_BLANK = _ENDS + r" \t\x1F\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
#: A tab or space at the end of a line, and the same after nothing but blanks: the difference are lines that are not
#: blank. Both start at rare characters, so a text costs one look at each of its characters, and no blank is given back.
_TAIL = rf"[ \t](?=[{_ENDS}]|\z)"
_BLANK_TAIL = rf"(?:\A|[{_ENDS}])[{_BLANK}&&[^{_ENDS}]]++(?<=[ \t])(?=[{_ENDS}]|\z)"


def trailing_whitespace(text: Column) -> Column:
    """The share of lines that end in a tab or space and are not blank. Emitted at 0 too, but not without lines."""

    def found(counts: Column) -> Column:
        flagged, n = counts["flagged"], counts["n"]
        share = flagged / n
        detail = F.concat(flagged.cast("string"), F.lit("/"), n.cast("string"))
        return signals(F.when(n > 0, signal("trailing_whitespace_ratio", F.floor(F.least(F.lit(100.0), share * 100)), detail, share)))

    # the last line needs no end; both counts are taken once
    last = F.when(F.substring(text, -1, 1).rlike(rf"[^{_ENDS}]"), 1).otherwise(0)
    flagged = F.regexp_count(text, F.lit(_TAIL))
    # blank lines are looked for only where some line has such an end
    counts = F.struct(F.when(flagged == 0, 0).otherwise(flagged - F.regexp_count(text, F.lit(_BLANK_TAIL))).alias("flagged"), (F.regexp_count(text, F.lit(LINE_END)) + last).alias("n"))
    return F.get(F.transform(F.array(counts), found), 0)


def known_signatures(content: Column, rules=SIGNATURES) -> Column:
    """One signal per needle that occurs anywhere in the bytes."""
    return signals(*[F.when(F.contains(content, unhex(needle.encode().hex())), signal(name, score, detail)) for name, needle, score, detail in rules])


def end_marker(ext: Column, markers: dict[str, str] = END_MARKERS) -> Column:
    of_type = F.create_map(*[x for k, v in markers.items() for x in (F.lit(k), unhex(v))])
    return F.try_element_at(of_type, ext)


def trailer_of(ext: Column, content: Column) -> Column:
    """Bytes after the last end marker of the file's type; null without one."""
    return after_last(content, end_marker(ext))


def appended_data(ext: Column, content: Column, ignore_trailing_eol: bool = False) -> Column:
    """Bytes after the last end marker of the file's type, and what kind of file starts there."""
    return appended_signals(trailer_of(ext, content), ignore_trailing_eol)


def appended_signals(trailer: Column, ignore_trailing_eol: bool = False) -> Column:
    n = F.length(trailer)
    there = n > 0
    if ignore_trailing_eol:
        there = there & ~F.hex(trailer).isin("0A", "0D", "0D0A")
    kind = F.lit(None).cast("string")
    for prefix, label in reversed(TRAILER_PREFIXES):
        kind = F.when(F.startswith(trailer, unhex(prefix)), label).otherwise(kind)
    embedded = signal(F.concat(F.lit("embedded_"), F.replace(kind, F.lit(" "), F.lit("_"))), 95, kind)
    return signals(F.when(there, signal("appended_data", 70, F.concat(n.cast("string"), F.lit(" bytes after EOF marker")), n)), F.when(there & kind.isNotNull(), embedded))


def jpeg_trailer(content: Column) -> Column:
    """Bytes after the last JPEG end marker, scored by length, and the trailer mark anywhere in a file with one."""
    return jpeg_signals(content, after_last(content, unhex(JPEG_END)))


def jpeg_signals(content: Column, trailer: Column) -> Column:
    n = F.length(trailer)
    long = signal("appended_data", F.least(F.lit(100), 50 + F.floor(n / 32)), F.concat(n.cast("string"), F.lit(" bytes after JPEG EOI")), n)
    mark = signal("stegapp_marker", 95, "STEGAPP marker found")
    return signals(F.when(n > 0, long), F.when(n.isNotNull() & F.contains(content, unhex(TRAILER_MARK)), mark))


def exif_comment(comment: Column) -> Column:
    return comment_signals(F.length(comment), F.startswith(comment, unhex(COMMENT_MARK)))


def comment_signals(n: Column, marked: Column) -> Column:
    """The same from a comment's length and whether it starts with the mark."""
    return signals(F.when(marked, signal("stegexif_marker", 95, "STEGEXIF marker in UserComment", n)).when(n > 64, signal("large_usercomment", 60, F.concat(F.lit("UserComment len="), n.cast("string")), n)))


def _told(form: str, value: Column) -> Column:
    """Three decimals, ties to even: format_string alone would round them up."""
    return F.format_string(form, F.bround(value, 3))


def bias_signal(name: str, ones: Column, n: Column, form: str) -> Column:
    mean = ones / n
    bias = F.abs(mean - F.lit(0.5)) * 200
    return F.when(n > 0, signal(name, F.floor(F.least(F.lit(100.0), bias)), _told(form, mean), bias))


def pair_signal(ratio: Column) -> Column:
    return F.when(ratio.isNotNull(), signal("lsb_pair_ratio", F.floor(F.least(F.lit(100.0), ratio * 100)), _told("adjacent-pair LSB ratio = %.3f (~1.0 suggests embedding)", ratio), ratio))


def image_signals(n: Column, ones: Column, pair_ratio: Column) -> Column:
    """Pair ratio and bias of the lowest bit from an image's statistics."""
    return signals(pair_signal(pair_ratio), bias_signal("lsb_bit_bias", ones, n, "LSB mean = %.3f"))


def sound_signals(n: Column, ones: Column) -> Column:
    return signals(bias_signal("wav_lsb_bias", ones, n, "LSB mean=%.3f"))


def ones_of(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(1))


def pair_ratio_of(samples: Column) -> Column:
    """Mean over adjacent pairs of ``2 * min / max(sum, 1)``; an odd last sample is left out, no pair gives null."""
    half = F.floor(F.size(samples) / 2).cast("int")
    at = F.sequence(F.lit(0), half - 1)

    def one(i: Column) -> Column:
        a, b = F.get(samples, 2 * i).cast("double"), F.get(samples, 2 * i + 1).cast("double")
        return 2 * F.least(a, b) / F.greatest(a + b, F.lit(1.0))

    return F.when(half > 0, F.aggregate(F.transform(at, one), F.lit(0.0), lambda a, x: a + x) / half)


def pixel_signals(samples: Column) -> Column:
    """``image_signals`` of short sample arrays."""
    return image_signals(F.size(samples), ones_of(samples), pair_ratio_of(samples))


def audio_signals(samples: Column) -> Column:
    return sound_signals(F.size(samples), ones_of(samples))


def sample_statistics(content: Column) -> Column:
    """The same statistics of a binary column, one byte per sample, for long ones: struct(n, ones, pair_ratio)."""

    @F.pandas_udf("struct<n:long,ones:long,pair_ratio:double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch:
                a = np.frombuffer(raw or b"", np.uint8)
                half = len(a) // 2
                even, odd = a[: 2 * half : 2].astype(np.float64), a[1 : 2 * half : 2].astype(np.float64)
                ratio = float(np.mean(2 * np.minimum(even, odd) / np.maximum(even + odd, 1))) if half else None
                rows.append((len(a), int((a & 1).sum()), ratio))
            yield pd.DataFrame(rows, columns=["n", "ones", "pair_ratio"])

    return measure(content)
