"""Files as tables: directories, images, sound and image comments. A bad file is a row with an error."""

from __future__ import annotations

import io
import re
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import extension

#: What Spark's source of binary files gives.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def any_case(extensions: tuple[str, ...]) -> str:
    """A glob for names with one of the extensions, in any letter case."""
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def scan_files(spark: SparkSession, root: str, pattern: str | None = None, extensions: tuple[str, ...] | None = None, most_bytes: int | None = None, stream: bool = False, tasks: int | None = None) -> DataFrame:
    """path, ext, length and content of every regular file below ``root``; as a stream of files if ``stream``.

    ``pattern``, or ``extensions`` (in any letter case; ``rules.extensions_of`` has those of chosen detectors), prunes
    by name before anything is read; ``most_bytes`` and other filters on length reach the source, so that longer files
    are not opened. ``content`` is read only where it is used. Spark puts at most 32 files into a task by default, however
    small they are; ``tasks`` bounds the tasks of a directory of very many small files.
    """
    if pattern and extensions:
        raise ValueError("pattern or extensions, not both")
    reader = (spark.readStream.schema(BINARY_FILE) if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    if pattern or extensions:
        reader = reader.option("pathGlobFilter", pattern or any_case(extensions))
    files = reader.load(root)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    found = files.select(F.col("path").alias("item_id"), extension(F.col("path")).alias("ext"), "length", "content")
    return found if tasks is None else found.coalesce(tasks)


#: Where Spark writes files, they are moved to their place by the tasks that wrote them, not one by one by the driver, and local
#: ones get no file of check sums beside them: each local file costs processes that set its permissions.
EACH = {
    "maxRecordsPerFile": "1",
    "mapreduce.fileoutputcommitter.algorithm.version": "2",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def many_tasks(spark: SparkSession) -> int:
    """Tasks for very many small files: a few for each core."""
    return 4 * spark.sparkContext.defaultParallelism


def _by_tasks(spark: SparkSession, place: str) -> bool:
    """Whether tasks can write below ``place`` by themselves: in a store that Arrow knows, and with one attempt at a time."""
    if spark.conf.get("spark.speculation", "false").lower() == "true":
        return False
    try:
        store, path = FileSystem.from_uri(place) if ":/" in place else (LocalFileSystem(), place)
        store.create_dir(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def write_each(texts: DataFrame, place: str, by: str | None = None) -> None:
    """Writes every row of ``texts`` (one string column, and ``by``) as a file of its own below ``place``, in a folder for
    each value of ``by``. The time goes into files, not bytes, so the rows are dealt out over all tasks first.

    Files are those of Spark's text writer, with its line end, but in a store that Arrow knows the tasks write them: Spark's local
    store starts a process for each file. A task that is repeated gets the same rows and writes the same names again.
    """
    spark, (value,) = texts.sparkSession, [c for c in texts.columns if c != by]
    dealt = texts.repartition(many_tasks(spark))
    if not _by_tasks(spark, place):
        writer = dealt.write.options(**EACH)
        (writer.partitionBy(by) if by else writer).text(place)
        return

    # Fixed value: what Spark escapes in the names of such folders.
    escaped = r"""[\x00-\x1F\x7F"#%'*/:=?\\{\[\]^]"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = FileSystem.from_uri(place) if ":/" in place else (LocalFileSystem(), place)
        task, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            kinds = batch.column(1).to_pylist() if by else [None] * batch.num_rows
            for raw, kind in zip(batch.column(0), kinds, strict=True):
                folder = path if not by else f"{path}/{by}={'__HIVE_DEFAULT_PARTITION__' if not kind else re.sub(escaped, lambda m: f'%{ord(m[0]):02X}', kind)}"
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/part-{task:05d}-{n:09d}.txt") as file:
                    file.write((raw.as_py() or b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["files"])

    columns = [F.col(value).cast("binary").alias("value"), *([F.col(by).cast("string").alias("kind")] if by else [])]
    dealt.select(*columns).mapInArrow(run, "files long").agg(F.sum("files")).first()


def strict_text(content: Column) -> Column:
    """struct(text, error): the text if the bytes are valid UTF-8."""
    text = content.cast("string")
    valid = F.call_function("is_valid_utf8", text)
    return F.struct(F.when(valid, text).alias("text"), F.when(~valid, "not valid UTF-8").alias("error"))


def lenient_text(content: Column) -> Column:
    """The text without bytes that are not UTF-8. A replacement character in the text itself goes too."""
    return F.replace(F.call_function("make_valid_utf8", content.cast("string")), F.lit("\ufffd"), F.lit(""))


def image_samples(spark: SparkSession, root: str, pattern: str = "*.{png,bmp,jpg,jpeg}") -> DataFrame:
    """item_id, width, height, data (one byte per RGB sample) and error of the images below ``root``.

    Spark's image source gives BGR, BGRA or grey bytes; they are put in RGB order, without alpha, grey three times.
    """
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(raw: bytes, n: int) -> bytes | None:
            if n not in (1, 3, 4):
                return None
            a = np.frombuffer(raw, np.uint8).reshape(-1, n)
            return (np.repeat(a, 3, axis=1) if n == 1 else a[:, 2::-1]).tobytes()

        return pd.Series([one(d, n) for d, n in zip(data, channels, strict=True)])

    bad = F.col("image.width") < 0
    return images.select(
        F.col("image.origin").alias("item_id"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.when(~bad, rgb("image.data", "image.nChannels")).alias("data"),
        F.when(bad, "not an image").alias("error"),
    )


def wav_samples(items: DataFrame, content: str = "content") -> DataFrame:
    """Adds samples (array<int>, channels interleaved) and error to ``items``: 16-bit PCM only."""

    @F.pandas_udf("struct<samples:array<int>,error:string>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch:
                try:
                    with wave.open(io.BytesIO(raw or b"")) as sound:
                        if sound.getsampwidth() != 2:
                            raise ValueError(f"{8 * sound.getsampwidth()}-bit samples")
                        rows.append((np.frombuffer(sound.readframes(sound.getnframes()), "<i2").astype(np.int32), None))
                except (wave.Error, EOFError, ValueError) as error:
                    rows.append((None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["samples", "error"])

    return items.withColumn("_w", decode(content)).withColumn("samples", F.col("_w.samples")).withColumn("error", F.col("_w.error")).drop("_w")


#: The TIFF tags that lead to a comment.
EXIF_IFD, USER_COMMENT = 0x8769, 0x9286


def _entry(tiff: bytes, order: str, at: int, tag: int) -> tuple[int, int, int] | None:
    """(kind, count, place of the value field) of a tag in the directory at ``at``."""
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(n):
        place = at + 2 + 12 * k
        found, kind, count = struct.unpack_from(order + "HHI", tiff, place)
        if found == tag:
            return kind, count, place + 8
    return None


def user_comment(raw: bytes) -> bytes:
    """The user comment of a JPEG or TIFF file; empty without one."""
    tiff = raw if raw[:2] in (b"II", b"MM") else None
    at = 2
    while tiff is None and raw[:2] == b"\xff\xd8" and at + 4 <= len(raw) and raw[at] == 0xFF:
        (size,) = struct.unpack_from(">H", raw, at + 2)
        if raw[at + 1] == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            tiff = raw[at + 10 : at + 2 + size]
        at += 2 + size
    if not tiff:
        return b""
    order = "<" if tiff[:2] == b"II" else ">"
    (first,) = struct.unpack_from(order + "I", tiff, 4)
    exif = _entry(tiff, order, first, EXIF_IFD)
    if exif is None:
        return b""
    (at,) = struct.unpack_from(order + "I", tiff, exif[2])
    found = _entry(tiff, order, at, USER_COMMENT)
    if found is None:
        return b""
    _, count, place = found
    start = place if count <= 4 else struct.unpack_from(order + "I", tiff, place)[0]
    return tiff[start : start + count]


def exif_comment(items: DataFrame, content: str = "content") -> DataFrame:
    """Adds user_comment (binary, empty without one) and error to ``items``."""

    @F.pandas_udf("struct<user_comment:binary,error:string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch:
                if raw is None:
                    rows.append((None, "no content"))
                    continue
                try:
                    rows.append((user_comment(raw), None))
                except struct.error as error:
                    rows.append((None, f"broken EXIF: {error}"))
            yield pd.DataFrame(rows, columns=["user_comment", "error"])

    return items.withColumn("_c", read(content)).withColumn("user_comment", F.col("_c.user_comment")).withColumn("error", F.col("_c.error")).drop("_c")
