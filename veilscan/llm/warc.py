"""WARC archives: writing, reading back, and a globally ordered capture index by external merging.

Writing: the smallest page_id of every payload digest becomes a response, the others become revisits that name it.
Spark's text writer stores one record per line with the record separator (two line ends) as line separator, so any
file system that Spark can write takes the archives, with its commit protocol for lost executors.

Reading goes through Spark's text source with the same separator, so an archive is a stream of chunks and no task
holds more of it than a record: records are cut by their Content-Length, and each response is checked against its
digest. The captures of one archive leave the task as one run, sorted by URL key and timestamp, and are stored. A range
partitioning by the same key deals the runs out, into so many partitions that each holds a bounded number of
captures, and in every partition a loser tree merges the k runs that reach it, one comparison per level for each row.
Partition after partition, the result is the ordered history of all captures.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, offsets, partitions, scratch, stored

END = "\r\n\r\n"
#: Seconds after which the timestamps made from page ids start again, so that years keep four digits.
CYCLE = 10**9
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = (
    "page_id long, url string, url_key string, captured string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, archive string, offset long, run string, seq long"
)
#: Captures that a partition of the index should hold at most: a merge keeps them in memory.
MERGED = 100_000


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels reversed, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}" if host else url.lower()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def _record(page_id: int | None, url: str | None, html: bytes, sha1: str, first: int | None, revisit: bool, captured: str) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}{END}".encode()
    if not revisit:
        block += html
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {captured}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(first)}", f"X-Refers-To-Page-Id: {first}"]
    return "\r\n".join(head).encode() + END.encode() + block


def write_archives(pages: DataFrame, path: str, start: int = 1_704_067_200, most_records: int = 20_000) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``path``, in gzip-compressed archives of at most
    ``most_records``. A page without a time of its own is captured ``page_id`` seconds after ``start``.

    The pages are dealt out once, by payload: copies meet the first of their payload there (Spark splits a payload
    with many copies), and each partition becomes archives. A payload is stored once however often it occurs.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    first = stored(rows.groupBy("sha1").agg(F.min("page_id").alias("first")), "payloads")
    revisit = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    marked = rows.join(first, "sha1").withColumn("revisit", F.col("first").isNotNull() & revisit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                records = [
                    _record(r["page_id"], r["url"], r["html"].encode(), r["sha1"], r["first"], r["revisit"], str(np.datetime64(start + (r["page_id"] or 0) % CYCLE, "s")) + "Z").decode()
                    for r in batch.slice(k, 256).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["value"])

    records = marked.mapInArrow(run, "value string")
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most_records).text(path)


def parse_archive(chunks: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive that comes in ``chunks``; offsets count the bytes of the
    archive without compression. At most a record and a chunk are held."""
    source, buffer, at, end = iter(chunks), bytearray(), 0, END.encode()

    def fill(size: int) -> None:
        while len(buffer) < size:
            if (more := next(source, None)) is None:
                raise ValueError("the archive ends inside a record")
            buffer.extend(more)

    while True:
        while (place := buffer.find(end)) < 0:
            if (more := next(source, None)) is None:
                if buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return
            buffer.extend(more)
        if not bytes(buffer[:place]).strip():  # blank lines between records, or a reader's line end after the last one
            at += place + len(end)
            del buffer[: place + len(end)]
            continue
        first, *lines = bytes(buffer[:place]).decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not the start of a record: {first[:40]!r}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start, size = place + len(end), int(headers["content-length"])
        fill(start + size + len(end))
        if buffer[start + size : start + size + len(end)] != end:
            raise ValueError(f"record {headers.get('warc-record-id')} does not end where it says")
        yield at, headers, bytes(buffer[start : start + size])
        at += start + size + len(end)
        del buffer[: start + size + len(end)]


def _capture(headers: dict[str, str], block: bytes, offset: int) -> tuple:
    http, _, payload = block.partition(END.encode())
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).partition(":")[2])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} does not match its digest")
    url = unquote(headers["warc-target-uri"]) if "warc-target-uri" in headers else None
    whole = {k: int(headers[k]) if k in headers else None for k in ("x-page-id", "x-refers-to-page-id")}
    return whole["x-page-id"], url, url_key(url), headers["warc-date"], headers["warc-type"], whole["x-refers-to-page-id"], size, digest, offset


def _order(row: tuple) -> tuple:
    return row[2], row[3], row[0] is not None, row[0] or 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures in the gzip-compressed archives below ``path`` (schema CAPTURES), those of one archive as a sorted
    run; ``offset`` is a record's place in its archive without compression. Without archives there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ((where, text) for batch in batches for where, text in zip(batch.column("path").to_pylist(), batch.column("value"), strict=True))
        for where, own in groupby(chunks, key=lambda x: x[0]):  # a compressed file is read by one task, in order
            name = where.rpartition("/")[2]
            captures = (_capture(headers, block, at) for at, headers, block in parse_archive(text.as_py().encode() + END.encode() for _, text in own))
            rows = sorted(captures, key=_order)
            for k in range(0, len(rows), 8192):
                part = [(*r[:-1], name, r[-1], name, k + i) for i, r in enumerate(rows[k : k + 8192])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _KINDS, strict=True)], _NAMES)

    lines = spark.read.schema("value string").option("lineSep", END).option("pathGlobFilter", "part-*.gz").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(run, CAPTURES)


_NAMES = [c.split()[0] for c in CAPTURES.split(", ")]
_KINDS = [pa.int64() if c.endswith("long") else pa.string() for c in CAPTURES.split(", ")]


class LoserTree:
    """Merges k sorted runs: inner nodes keep the run that lost there, so a new head meets one run per level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.loser = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or self.runs[a][self.at[a]] <= self.runs[b][self.at[b]]

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) of every row in order."""
        for _ in range(sum(map(len, self.runs))):
            best = self.winner
            yield best, self.at[best]
            self.at[best] += 1
            node = (best + self.k) // 2
            while node:
                if self._before(self.loser[node], best):
                    best, self.loser[node] = self.loser[node], best
                node //= 2
            self.winner = best


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    rows = pa.Table.from_batches(whole).combine_chunks()
    run = rows.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
    place = np.lexsort((rows.column("seq").to_numpy(), run))  # a run may arrive in several blocks
    starts = np.flatnonzero(np.diff(run[place], prepend=-1))
    key = list(zip(*[rows.column(c).to_pylist() for c in ("url_key", "captured", "page_id")], strict=True))
    key = [(u, t, p is not None, p or 0) for u, t, p in key]
    members = np.split(place, starts[1:])
    order = [members[r][i] for r, i in LoserTree([[key[i] for i in m.tolist()] for m in members])]
    for batch in rows.take(pa.array(np.array(order, np.int64))).combine_chunks().to_batches(8192):
        yield batch


def capture_index(captures: DataFrame) -> DataFrame:
    """``captures`` in global order of URL key, timestamp and page_id, with ``position`` (long, gapless from 0). Rows
    equal in all three stand next to each other."""
    runs = cut(captures)
    n = max(partitions(captures.sparkSession), -(-runs.count() // MERGED))
    # the run and a row's place in it tell rows apart that have the same key, so no range is left whole
    keys = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_first(), F.col("run"), F.col("seq")]
    merged = runs.repartitionByRange(n, *keys).mapInArrow(_merge, CAPTURES).withColumn("_id", F.monotonically_increasing_id())
    placed = cut(merged.withColumns({"_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"))
    before = F.broadcast(offsets(placed).select("_part", "_rows"))
    return placed.join(before, "_part").withColumn("position", F.col("_rows") + F.col("_pos")).drop("_part", "_pos", "_rows")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives (below ``path``, or a new place in the shared folder), reads them back and
    returns per record page_id, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to, and url_key,
    captured, archive, its ``offset`` there and its ``position`` in the ordered index.

    Null html counts as empty; a null url is left out of its record. Of equal payloads the smallest page_id is the
    response; rows that repeat that page_id are responses too, and rows without page_id are revisits unless no row
    of that payload has one. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path)
    index = capture_index(read_archives(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "offset", "position")
