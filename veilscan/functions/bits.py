"""Bits, byte strings and lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zero-width characters that stand for 0, for 1 and for the end of a mark.
ZERO, ONE, END = "\u200b", "\u200c", "\u200d"
#: All line ends that count, the longest first.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def unhex(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def to_bits(payload: Column) -> Column:
    """The bits of a binary column as a string of 0 and 1, most significant first."""
    each = F.regexp_extract_all(F.hex(payload), F.lit(".."), F.lit(0))
    return F.array_join(F.transform(each, lambda h: F.lpad(F.conv(h, 16, 2), 8, "0")), "")


def from_bits(bits: Column) -> Column:
    """The bytes of a string of 0 and 1; a last partial byte is dropped."""
    each = F.regexp_extract_all(bits, F.lit(".{8}"), F.lit(0))
    return F.unhex(F.array_join(F.transform(each, lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), ""))


def u32be(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0"))


def number(field: Column) -> Column:
    """A big-endian unsigned binary field as a long."""
    return F.conv(F.hex(field), 16, 10).cast("long")


def latin1(content: Column) -> Column:
    """Bytes as characters one to one, so that text functions can look for the last occurrence of a byte string."""
    return F.decode(content, "ISO-8859-1")


def before_last(content: Column, marker: Column) -> Column:
    """Bytes up to the end of the last ``marker``; null without one."""
    after = F.length(after_last(content, marker))
    return F.call_function("substring", content, F.lit(1), F.length(content) - after)


def after_last(content: Column, marker: Column) -> Column:
    """Bytes after the last ``marker``; null without one."""
    tail = F.call_function("substring_index", latin1(content), latin1(marker), F.lit(-1))
    return F.when(F.contains(content, marker), F.encode(tail, "ISO-8859-1"))


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a text that ends with a line end has no empty line after it. The text is
    split once."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    split = F.get(F.transform(F.array(F.split(text, LINE_END, -1)), whole), 0)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(split)


def line_count(text: Column) -> Column:
    """How many ``lines`` a text has, counted without making them."""
    last = F.when(F.substring(text, -1, 1).rlike(rf"^(?:{LINE_END})$"), 0).otherwise(1)
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit(LINE_END)) + last)
