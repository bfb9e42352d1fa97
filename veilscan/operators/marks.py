"""Capacity, admission, and bulk marking and recovery."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from ..functions.bits import END, ONE, ZERO, before_last, from_bits, latin1, line_count, lines, number, to_bits, u32be, unhex
from ..functions.detect import COMMENT_MARK, JPEG_END, TRAILER_MARK

#: Bytes of a payload from which an Arrow function packs its bits.
LONG = 1 << 10


def capacity_of_lines(text: Column) -> Column:
    return F.floor(line_count(text) / 8)


def capacity_of_samples(n: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(n / 8) - 4)


def admit(payloads: DataFrame, carriers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of ``payloads`` (carrier_id, payload) against ``carriers`` (carrier_id, capacity).
    Payloads without a carrier are rejected."""
    both = payloads.join(carriers, "carrier_id", "left")
    fits = F.coalesce(F.length("payload") <= F.col("capacity"), F.lit(False))
    return both.where(fits), both.where(~fits)


def mark_zero_width(text: Column, payload: Column) -> Column:
    return F.concat(text, F.translate(to_bits(payload), "01", ZERO + ONE), F.lit(END))


def recover_zero_width(text: Column) -> Column:
    """The bytes marked before the first end character."""
    marked = F.regexp_replace(F.substring_index(text, END, 1), f"[^{ZERO}{ONE}]", "")
    return from_bits(F.translate(marked, ZERO + ONE, "01"))


def mark_trailing(text: Column, payload: Column) -> Column:
    """The first lines end in a blank for 0 or a tab for 1. Lines and bits are paired once, each computed once."""
    payload = F.coalesce(payload, unhex(""))
    bits, n = F.split(to_bits(payload), ""), 8 * F.length(payload)

    def marked(every: Column) -> Column:
        first = F.least(n, F.size(every))
        ends = F.zip_with(F.slice(every, F.lit(1), first), F.slice(bits, F.lit(1), first), lambda line, bit: F.concat(F.regexp_replace(line, r"[ \t]+$", ""), F.when(bit == "1", "\t").otherwise(" ")))
        return F.concat(F.array_join(F.concat(ends, F.slice(every, first + 1, F.size(every))), "\n"), F.lit("\n"))

    return F.get(F.transform(F.array(lines(text)), marked), 0)


def recover_trailing(text: Column) -> Column:
    """The bytes of the leading run of marked lines."""
    bit = F.transform(lines(text), lambda line: F.when(F.endswith(line, F.lit("\t")), "1").when(F.endswith(line, F.lit(" ")), "0").otherwise("x"))
    return from_bits(F.regexp_extract(F.array_join(bit, ""), "^[01]*", 0))


def mark_trailer(content: Column, payload: Column) -> Column:
    """Cut after the last end marker, then mark, length and payload; null without a marker."""
    return F.concat(before_last(content, unhex(JPEG_END)), unhex(TRAILER_MARK), u32be(F.length(payload)), payload)


def recover_trailer(content: Column) -> Column:
    """What follows the first trailer mark, as long as it says (less if cut short); null without a mark."""
    at = F.call_function("instr", latin1(content), F.lit(bytes.fromhex(TRAILER_MARK).decode()))
    size = number(F.call_function("substring", content, at + 7, F.lit(4)))
    return F.when(at > 0, F.call_function("substring", content, at + 11, size.cast("int")))


def _sample_bits(payload: Column) -> Column:
    return F.concat(to_bits(u32be(F.length(payload))), to_bits(payload))


@F.pandas_udf(ArrayType(IntegerType()))
def _packed_in(samples: pd.Series, payload: pd.Series) -> pd.Series:
    def one(values: np.ndarray | None, raw: bytes | None) -> np.ndarray | None:
        if values is None or raw is None:
            return None
        bits = np.unpackbits(np.frombuffer(len(raw).to_bytes(4, "big") + raw, np.uint8))
        return (np.asarray(values, np.int32) & -2) | bits

    return pd.Series([one(v, r) for v, r in zip(samples, payload, strict=True)])


@F.pandas_udf(BinaryType())
def _packed_out(samples: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else np.packbits(np.asarray(v, np.int32) & 1).tobytes() for v in samples])


def mark_samples(samples: Column, payload: Column, kernel: bool = False) -> Column:
    """The lowest bits of the first samples become the payload's length (32 bits) and bits; null if it does not fit.

    Only the samples that carry bits are touched, each once. With ``kernel`` payloads of LONG bytes or more are packed
    by numpy in an Arrow function, which gets those samples and no others; shorter ones stay in the JVM.
    """
    n = 32 + 8 * F.length(payload)
    head, long = F.slice(samples, F.lit(1), n), F.length(payload) >= LONG
    native = F.zip_with(head, F.slice(F.split(_sample_bits(payload), ""), F.lit(1), n), lambda value, bit: value.bitwiseAND(-2).bitwiseOR(bit.cast("int")))
    fits = n <= F.size(samples)
    if kernel:
        packed = _packed_in(F.when(fits & long, head), F.when(fits & long, payload))
        native = F.when(long, packed).otherwise(native)
    return F.when(fits, F.concat(native, F.slice(samples, n + 1, F.size(samples))))


def _number_of(samples: Column) -> Column:
    """The lowest bits of samples as a number, the first one highest."""
    return F.aggregate(samples, F.lit(0).cast("long"), lambda n, v: 2 * n + v.bitwiseAND(1))


def recover_samples(samples: Column, kernel: bool = False) -> Column:
    """struct(payload, status): ``ok``, ``too_short`` or ``declared_length_exceeds``. The 32 length bits are read
    first, then only the samples they declare; ``kernel`` as in ``mark_samples``."""
    size = _number_of(F.slice(samples, 1, 32))
    status = F.when(F.size(samples) < 32, "too_short").when(32 + 8 * size > F.size(samples), "declared_length_exceeds").otherwise("ok")
    ok = status == "ok"
    body, long = F.slice(samples, F.lit(33), F.when(ok, 8 * size).otherwise(0).cast("int")), ok & (size >= LONG)

    def packed(bits: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.lpad(F.hex(_number_of(F.slice(bits, 8 * i + 1, F.lit(8)))), 2, "0"))
        return F.unhex(F.array_join(each, ""))

    payload = F.when(ok & (size > 0), F.get(F.transform(F.array(body), packed), 0)).otherwise(unhex(""))
    if kernel:
        payload = F.when(long, _packed_out(F.when(long, body))).otherwise(payload)
    return F.struct(F.when(ok, payload).alias("payload"), status.alias("status"))


def recover_comment(comment: Column) -> Column:
    marked = F.startswith(comment, unhex(COMMENT_MARK))
    payload = F.when(marked, F.call_function("substring", comment, F.lit(9)))
    return F.struct(payload.alias("payload"), F.when(marked, "ok").otherwise("no_mark").alias("status"))
