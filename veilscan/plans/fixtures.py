"""Items to screen, derived from the driver's tables: files, samples, payloads, comments and replies.

The tables hold almost nothing hidden, so marks are put in by rules that SQL can follow as well (``sql.py``).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.bits import lines, u32be, unhex
from ..operators.marks import capacity_of_lines, mark_zero_width
from ..sources.files import write_each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text):
    return F.encode(text, "UTF-8")


def text_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document carries its id as zero-width characters."""
    payload = utf8(F.concat(F.lit("id:"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, mark_zero_width(F.col("text"), payload)).otherwise(F.col("text")).alias("text"))


def text_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document has a tab after each sentence that ends a line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"(\.)\n", "$1\t\n")).otherwise(F.col("text")).alias("text"))


def text_ws_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at least eight lines with a one-byte payload."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.size(lines(F.col("text"))) >= 8).select("doc_id", "text", F.unhex(F.hex(65 + F.col("doc_id") % 26)).alias("payload"))


def _own(doc_id: Column) -> Column:
    """What a document's file hides in its trailer: up to nine bytes that name it."""
    return utf8(F.substring(F.concat(F.lit("#"), doc_id.cast("string"), F.lit("-hidden")), F.lit(1), (1 + doc_id % 9).cast("int")))


def file_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document: its text, an end marker by type, and a trailer."""
    kind, tail = F.col("doc_id") % 10, F.floor(F.col("doc_id") / 10) % 6
    ext = F.element_at(F.array(*[F.lit(x) for x in (".png", ".jpg", ".jpeg", ".gif", ".pdf", ".txt", ".md", ".bmp", ".wav", ".bin")]), (kind + 1).cast("int"))
    marker = F.element_at(F.array(*[unhex(x) for x in ("49454E44AE426082", "FFD9", "FFD9", "3B", "2525454F46", "", "", "", "", "")]), (kind + 1).cast("int"))
    trailer = F.element_at(F.array(*[unhex(x) for x in ("", "504B030400000000", "4D5A9000", "", "4F50454E535445474F", "0A")]), (tail + 1).cast("int"))
    trailer = F.when(tail == 3, F.concat(unhex("53544547415050"), u32be(F.length(_own(F.col("doc_id")))), _own(F.col("doc_id")))).otherwise(trailer)
    content = F.concat(utf8(F.col("text")), marker, trailer)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item_id"), ext.alias("ext"), content.alias("content")).withColumn("length", F.length("content").cast("long"))


def sample_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", samples.alias("samples"), F.unhex(F.lpad(F.hex(F.col("vec_id") % 65536), 4, "0")).alias("payload"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two payloads per benchmark item: its text and the first character."""
    items = table(spark, sf_dir, "benchmark")
    two = F.explode(F.array(F.struct(F.lit(1).alias("part"), F.col("text").alias("t")), F.struct(F.lit(2).alias("part"), F.substring("text", 1, 1).alias("t"))))
    return items.select(F.col("item_id").alias("carrier_id"), two.alias("p")).select("carrier_id", "p.part", utf8(F.col("p.t")).alias("payload"))


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("carrier_id"), "text", capacity_of_lines(F.col("text")).alias("capacity"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as comments: marked ones, plain ones and, for a quarter of the documents, none. A text that exceeds
    the carrier's 60,000 bytes is rejected: its comment is null."""
    k, text = F.col("doc_id") % 4, F.when(F.octet_length("text") <= 59_990, F.col("text"))
    comment = F.when(k == 0, F.concat(F.lit("STEGEXIF"), text)).when(k == 2, "").otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", utf8(comment).alias("user_comment"))


def jpeg_with_comment(comment: Column) -> Column:
    """A JPEG file's bytes around an EXIF user comment."""
    n = F.length(comment)
    ifd = unhex("4D4D002A00000008000187690004000000010000001A00000000000192860007")
    value = F.when(n <= 4, F.substring(F.concat(comment, unhex("00000000")), 1, 4)).otherwise(unhex("0000002C"))
    app1 = F.concat(unhex("457869660000"), ifd, u32be(n), value, unhex("00000000"), F.when(n > 4, comment).otherwise(unhex("")))
    size = F.unhex(F.lpad(F.hex((F.length(app1) + 2).cast("long")), 4, "0"))
    return F.concat(unhex("FFD8FFE1"), size, app1, unhex("FFD9"))


def le32(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def wav_with_samples(samples: Column, narrow: Column) -> Column:
    """A mono sound file's bytes; where ``narrow`` it says that its samples have 8 bits."""
    data = F.unhex(F.array_join(F.transform(samples, lambda v: F.concat(F.lpad(F.hex(v.cast("long")), 2, "0"), F.lit("00"))), ""))
    width = F.when(narrow, unhex("01000800")).otherwise(unhex("02001000"))
    head = F.concat(unhex("57415645666D74201000000001000100401F0000803E0000"), width, unhex("64617461"), le32(F.length(data)), data)
    return F.concat(unhex("52494646"), le32(F.length(head)), head)


@F.pandas_udf(BinaryType())
def image_with_samples(kinds: pd.Series, samples: pd.Series) -> pd.Series:
    """An image file's bytes: 0 grey PNG 8 x 8, 1 RGB PNG 7 x 3, 2 RGBA PNG 4 x 4, 3 BMP 7 x 3."""

    def one(kind: int, values: list[int]) -> bytes:
        a = np.asarray(values, np.uint8)
        if kind == 3:
            rows = b"".join(r[:, ::-1].tobytes() + b"\0" * 3 for r in a[:63].reshape(3, 7, 3)[::-1])
            return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 54, 40, 7, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
        width, height, channels, colour = ((8, 8, 1, 0), (7, 3, 3, 2), (4, 4, 4, 6))[kind]
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        body = b"".join(b"\0" + r.tobytes() for r in a[: width * height * channels].reshape(height, -1))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 0)) + chunk(b"IEND", b"")

    return pd.Series([one(k, v) for k, v in zip(kinds, samples, strict=True)])


def media_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and sound files made of the sample table, the lowest bit set in every second, and JPEG files with the
    comments; every seventh sound file has 8-bit samples, which are refused."""
    s = sample_items(spark, sf_dir).withColumn("s", F.when(F.col("vec_id") % 2 == 0, F.transform("samples", lambda v: v.bitwiseOR(1))).otherwise(F.col("samples")))
    kind = (F.col("vec_id") % 5).cast("int")
    images = s.where(kind < 4).select(F.concat(F.lit("m"), F.col("vec_id")).alias("item_id"), F.when(kind == 3, ".bmp").otherwise(".png").alias("ext"), image_with_samples(kind, F.col("s")).alias("content"))
    sound = s.where(kind == 4).select(F.concat(F.lit("m"), F.col("vec_id")).alias("item_id"), F.lit(".wav").alias("ext"), wav_with_samples(F.col("s"), F.col("vec_id") % 7 == 0).alias("content"))
    jpegs = comments(spark, sf_dir).where("user_comment IS NOT NULL").select(F.concat(F.lit("c"), F.col("doc_id")).alias("item_id"), F.lit(".jpg").alias("ext"), jpeg_with_comment(F.col("user_comment")).alias("content"))
    return images.union(sound).union(jpegs).withColumn("length", F.length("content").cast("long"))


def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_items(spark, sf_dir).union(media_items(spark, sf_dir))


def carrier_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every carrier with their own ids as payloads: texts of one word a line, samples twelve times over,
    comments; every third to be sealed, with a salt for each hundred ids and a nonce of its own."""
    none = {"text": "string", "samples": "array<int>", "user_comment": "binary"}

    def part(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select("item_id", "ext", *[given.get(c, F.lit(None).cast(t)).alias(c) for c, t in none.items()])

    docs, vectors = table(spark, sf_dir, "documents"), sample_items(spark, sf_dir)
    item = lambda prefix, of: F.concat(F.lit(prefix), F.col(of)).alias("item_id")
    ext = lambda of, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(of) % len(names) + 1).cast("int")).alias("ext")
    texts = docs.select(item("t", "doc_id"), ext("doc_id", ".txt", ".md", ".bin"), F.regexp_replace("text", "[ \n]+", "\n").alias("v"))
    samples = vectors.select(item("s", "vec_id"), ext("vec_id", ".png", ".wav"), F.flatten(F.array_repeat("samples", 12)).alias("v"))
    notes = comments(spark, sf_dir).select(item("c", "doc_id"), ext("doc_id", ".jpg", ".tiff"), F.col("user_comment").alias("v"))
    every = part(texts, text=F.col("v")).union(part(samples, samples=F.col("v"))).union(part(notes, user_comment=F.col("v")))
    number = F.substring("item_id", 2, 30).cast("long")
    sealed = number % 3 == 0
    salt = F.when(sealed, F.unhex(F.md5(F.concat(F.substring("item_id", 1, 1), F.floor(number / 100)))))
    nonce = F.when(sealed, F.unhex(F.substring(F.sha2("item_id", 256), 1, 24)))
    return every.select("*", utf8(F.concat(F.lit("id:"), F.col("item_id"))).alias("payload"), salt.alias("salt"), nonce.alias("nonce"))


@F.pandas_udf(BinaryType())
def picture(samples: pd.Series, bmp: pd.Series) -> pd.Series:
    """An RGB image file's bytes of 16 x 16 pixels."""

    def one(values: np.ndarray | None, as_bmp: bool) -> bytes | None:
        if values is None:
            return None
        a = np.asarray(values, np.uint8).reshape(16, 16, 3)
        if as_bmp:
            rows = a[::-1, :, ::-1].tobytes()
            return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 54, 40, 16, 16, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        body = zlib.compress(b"".join(b"\0" + r.tobytes() for r in a))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")

    return pd.Series([one(v, b) for v, b in zip(samples, bmp, strict=True)])


def write_files(items: DataFrame, place: str) -> None:
    """Marked items (item_id, ext, text, samples, user_comment) as files, one each, in a folder for each extension;
    every second .png is written as .bmp. Spark's text writer writes bytes as they are and ends them with a line end,
    which no reader of these formats minds."""
    number = F.substring("item_id", 2, 30).cast("long")
    bmp = (F.col("ext") == ".png") & (number % 4 == 0)
    jpeg = jpeg_with_comment(F.col("user_comment"))
    tiff = F.call_function("substring", jpeg, F.lit(13), F.length(jpeg) - 14)  # without the JPEG segment around it
    content = (
        F.when(F.col("ext") == ".png", picture(F.when(F.col("ext") == ".png", F.col("samples")), bmp))
        .when(F.col("ext") == ".wav", wav_with_samples(F.col("samples"), F.lit(False)))
        .when(F.col("ext") == ".jpg", jpeg)
        .when(F.col("ext") == ".tiff", tiff)
        .otherwise(utf8(F.col("text")))
    )
    write_each(items.select(content.cast("string").alias("value"), F.when(bmp, ".bmp").otherwise(F.col("ext")).alias("kind")), place, "kind")


def needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten patterns from each benchmark item, three to fourteen characters long, as rules."""
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct(k.alias("k"), F.substring(F.col("text"), (1 + 13 * k).cast("int"), (3 + (k + F.col("item_id")) % 12).cast("int")).alias("t"))))
    each = table(spark, sf_dir, "benchmark").select("item_id", cut.alias("c")).where("c.t <> ''")
    return each.select(F.concat_ws("-", "item_id", "c.k").alias("name"), utf8(F.col("c.t")).alias("needle"), (F.col("c.k") * 10).cast("int").alias("score"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("event_id"), lambda n: (F.col("event_id") % n).cast("string")
    reply = (
        F.when(i % 6 == 0, F.concat(F.lit('{"suspicion": '), s(150), F.lit(', "explanation": " e "}')))
        .when(i % 6 == 1, F.concat(F.lit('Sure! {"suspicion": '), s(150), F.lit("} done")))
        .when(i % 6 == 2, F.concat(F.lit('{"suspicion": "'), s(100), F.lit('"}')))
        .when(i % 6 == 3, F.concat(F.lit('{"suspicion": '), s(100), F.lit(".9}")))
        .when(i % 6 == 4, F.lit('{"explanation": "x"}'))
        .otherwise("no json")
    )
    return table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
