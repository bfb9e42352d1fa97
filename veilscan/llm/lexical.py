"""Ranked lexical search in K2-treaps over grids of terms and documents.

The index deals documents into shards. A shard is a grid: a row per term, a column per document, and where a document
holds a term its impact, (1000000000 * tf) div (1000 * tf + 12 * m). The grid is a quadtree of which only cells that
are not empty exist; a cell keeps which of its four quarters exist and how far its impact maximum lies below that of
the cell around it. Rows are sorted by how often the term occurs, and columns by the documents' lengths, so that cells
hold like impacts.

An item descends along the paths of all its terms' rows at once: an entry of its frontier is a range of documents
with the cells of all its rows, and the weighted sum of their maxima bounds every score in the range. The ranges with
the best bounds are opened first; what cannot reach the k-th score found so far, in this shard or an earlier one of
the task, is dropped. At single documents the bound is the score.

Items pass in blocks of bounded size, each broadcast. A task keeps k documents per item, and only these are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, scratch, stored

#: Documents and bytes of text of a shard; the document that reaches the bytes is its last one.
DOCUMENTS, BYTES = 8192, 6 << 20
#: A row holds a shard of many MB, and Parquet looks at sizes only after a hundred rows: so each is a row group of its own.
EACH = {"parquet.block.row.count.limit": "1"}
#: Documents sent to Python at once.
SENT = 1000
#: Bytes of the items of a block.
BLOCK = 8 << 20
#: Cells opened at once, and cells of a frontier above which the smallest ranges are opened first, which keeps it short.
OPENED, WIDE = 1 << 14, 1 << 23
#: Separators become spaces and A-Z a-z; all bytes of other characters belong to terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Set bits of a cell's mask, and those before each quarter, -1 for a quarter that is not set.
_SET = np.array([bin(m).count("1") for m in range(16)], np.int64)
_BEFORE = np.array([bin(m & ((1 << q) - 1)).count("1") if m >> q & 1 else -1 for m in range(16) for q in range(4)], np.int32)
#: The largest impact, and what sums of doubles are exact below.
IMPACT, EXACT = 1_000_000, 2**53

GRID = "ids array<long>, lengths binary, words binary, holding binary, codes binary, tf binary, documents long, terms long"
TREAP = "ids array<long>, words binary, holding binary, bits int, sizes array<int>, top int, masks binary, drops binary"


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _gathered(x: np.ndarray) -> np.ndarray:
    """The bits at even places as 32-bit numbers."""
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


def _record(ids: list, texts: list[bytes]) -> dict | None:
    """The grid of some documents, None if they have no terms."""
    joined = b"".join(texts).translate(_TABLE)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(joined)))
    words, at = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    filled = pc.greater(pc.binary_length(words), 0)
    words, at = words.filter(filled).dictionary_encode(), at[filled.to_numpy(zero_copy_only=False)].astype(np.int32)
    del split, filled, joined
    if not len(at):
        return None
    term = words.indices.to_numpy()
    lengths = np.bincount(at, minlength=len(texts))
    by_length = np.argsort(lengths, kind="stable")[np.count_nonzero(lengths == 0) :]
    column = np.zeros(len(texts), np.int64)
    column[by_length] = np.arange(len(by_length))

    by_count = np.argsort(-np.bincount(term), kind="stable")
    row = np.empty(len(by_count), np.int64)
    row[by_count] = np.arange(len(by_count))
    code = np.sort((_spread(row)[term] << np.uint64(1)) | _spread(column)[at])
    starts = np.flatnonzero(np.diff(code, prepend=code[0] + np.uint64(1)))
    codes, tf = code[starts], np.diff(starts, append=len(code))
    holding = np.bincount(_gathered(codes >> np.uint64(1)))
    return {
        "ids": [ids[i] for i in by_length.tolist()],
        "lengths": lengths[by_length].tobytes(),
        "words": " ".join(words.dictionary.take(pa.array(by_count)).to_pylist()).encode(),
        "holding": holding.astype(np.int32).tobytes(),
        "codes": np.diff(codes, prepend=np.uint64(0)).tobytes(),
        "tf": tf.astype(np.int32).tobytes(),
        "documents": len(by_length),
        "terms": len(at),
    }


def _batch(rows: list[dict], kind: str) -> pa.RecordBatch:
    types = {"array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, types[t]) for n, t in (c.split() for c in kind.split(", "))]))


def _grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = (text.as_py() or b"") + b" "  # ends its last term
            ids.append(doc_id)
            texts.append(raw)
            size += len(raw)
            if size >= BYTES or len(ids) >= DOCUMENTS:
                if grid := _record(ids, texts):
                    yield _batch([grid], GRID)
                ids, texts, size = [], [], 0
    if ids and (grid := _record(ids, texts)):
        yield _batch([grid], GRID)


def _treap(documents: int, total: int):
    """Grids as treaps, by the corpus' numbers of documents with terms and of their terms."""

    def record(g: dict) -> dict:
        codes, lengths = np.cumsum(np.frombuffer(g["codes"], np.uint64), dtype=np.uint64), np.frombuffer(g["lengths"], np.int64)
        tf = np.frombuffer(g["tf"], np.int32).astype(np.int64)
        m = 100 - 25 + (25 * lengths * documents) // total
        best = (1_000_000_000 * tf) // (1000 * tf + 12 * m[_gathered(codes)])
        side = max(len(lengths), len(g["holding"]) // 4)
        bits, masks, drops, sizes = max(1, (side - 1).bit_length()), [], [], [len(codes)]
        for _ in range(bits):
            above = codes >> np.uint64(2)
            starts = np.flatnonzero(np.diff(above, prepend=above[0] + np.uint64(1)))
            most = np.maximum.reduceat(best, starts)
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (codes & np.uint64(3)).astype(np.uint8), starts))
            drops.append((np.repeat(most, np.diff(starts, append=len(codes))) - best).astype(np.int32))
            codes, best = above[starts], most
            sizes.append(len(codes))
        mask = np.concatenate(masks[::-1])
        mask = np.append(mask, np.zeros(len(mask) % 2, np.uint8))
        return {
            "ids": g["ids"], "words": g["words"], "holding": g["holding"], "bits": bits, "sizes": sizes[::-1], "top": int(best[0]),
            "masks": (mask[::2] | mask[1::2] << 4).tobytes(), "drops": np.concatenate(drops[::-1]).tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one shard at a time
                yield _batch([record(batch.slice(i, 1).to_pylist()[0])], TREAP)

    return run


class Index:
    """Shards of an index: ``rows`` (TREAP), and how many documents have terms."""

    def __init__(self, rows: DataFrame, documents: int):
        self.rows, self.documents = rows, documents


def build_index(docs: DataFrame) -> Index | None:
    """The index of all rows of ``docs`` (doc_id, text) that have a term; None if there are none. Rows without doc_id
    are indexed under null, rows that repeat one as often as they occur."""
    spark, texts = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with arrow_rows(spark, SENT):
        grids = stored(texts.mapInArrow(_grids, GRID), "grids", **EACH)
    documents, total = grids.agg(F.sum("documents"), F.sum("terms")).first()
    if not documents:
        return None
    with arrow_rows(spark, 1):
        return Index(stored(grids.mapInArrow(_treap(documents, total), TREAP), "treaps", **EACH), documents)


class Treap:
    """A shard's cells in breadth-first order; the last cell is the empty one."""

    def __init__(self, row: dict):
        raw, inner = np.frombuffer(row["masks"], np.uint8), sum(row["sizes"][:-1])
        self.ids, self.bits, cells = row["ids"], row["bits"], sum(row["sizes"])
        masks = np.stack([raw & 15, raw >> 4], axis=1).ravel()[:inner]
        children = _SET[masks]
        # of inner cells and, at the end, of the empty one
        self.masks, self.first, self.none = np.append(masks * 4, np.uint8(0)), np.ones(inner + 1, np.int32), cells
        self.first[:inner] += (np.cumsum(children) - children).astype(np.int32)
        drops = np.frombuffer(row["drops"], np.int32)
        self.best = np.zeros(cells + 1)
        self.best[0], at = row["top"], 0
        for size in row["sizes"][:-1]:
            given = np.repeat(self.best[at : at + size], children[at : at + size])
            self.best[at + size : at + size + len(given)] = given - drops[at + size - 1 : at + size - 1 + len(given)]
            at += size

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, columns): all documents that may be among the best k of those with at least ``floor``."""
        best = self.best if weights.sum() < EXACT // IMPACT else self.best.astype(np.int64)
        weights = weights.astype(best.dtype)
        bits = 2 * ((rows[None, :] >> np.arange(self.bits - 1, -1, -1)[:, None]) & 1).astype(np.uint8)
        level, column, cells = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros((1, len(rows)), np.int32)
        bound = best[cells] @ weights
        scores, found = np.zeros(0, best.dtype), np.zeros(0, np.int32)
        none, last = np.int32(self.none), len(self.first) - 1
        while len(level):
            n, rest = min(len(level), max(8, OPENED // len(rows))), None
            if n < len(level):
                key = -bound if len(level) * len(rows) < WIDE else -level
                order = np.argpartition(key, n - 1)
                pick, rest = order[:n], order[n:]
                rest = rest[bound[rest] >= floor]
                left = [x[rest] for x in (level, column, cells, bound)]
                level, column, cells = level[pick], column[pick], cells[pick]
            inner = np.minimum(cells, last)
            quarter, first = self.masks[inner] + bits[level], self.first[inner]
            opened = []
            for side in (0, 1):
                step = _BEFORE[quarter + np.uint8(side)]
                opened.append(np.where(step >= 0, first + step, none))
            cells = np.concatenate(opened)
            bound = best[cells] @ weights
            level, column = np.concatenate([level, level]) + 1, np.concatenate([2 * column, 2 * column + 1])
            on = bound >= floor
            single = on & (level == self.bits)
            if single.any():
                scores, found = np.concatenate([scores, bound[single]]), np.concatenate([found, column[single]])
                if len(scores) > k:
                    floor = max(floor, np.partition(scores, len(scores) - k)[len(scores) - k])
                    scores, found = scores[scores >= floor], found[scores >= floor]
                on &= ~single & (bound >= floor)
            level, column, cells, bound = level[on], column[on], cells[on], bound[on]
            if rest is not None:
                level, column, cells, bound = (np.concatenate([a, b]) for a, b in zip(left, (level, column, cells, bound), strict=True))
        return scores.astype(np.int64), found


def _best_first(hits: list[tuple[int, int | None]], k: int) -> list[tuple[int, int | None]]:
    """The k best (score, doc_id): higher scores, then smaller ids, none last."""
    return sorted(hits, key=lambda h: (-h[0], h[1] is None, h[1] or 0))[:k]


def _places(words: bytes, wanted: pa.Array) -> np.ndarray:
    """The row of each wanted term in a shard, -1 where it has none."""
    return pc.fill_null(pc.index_in(wanted, pa.array(words.split(b" "), pa.binary())), -1).to_numpy()


def _holding(sent):
    """How many documents hold each term of a block: (term, documents), summed up in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.binary())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for words, holding in zip(batch.column("words").to_pylist(), batch.column("holding").to_pylist(), strict=True):
                at = _places(words, wanted)
                total[at >= 0] += np.frombuffer(holding, np.int32)[at[at >= 0]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "documents"])

    return run


def _searched(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, items = pa.array(sent.value[0], pa.binary()), sent.value[1]
        best: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):  # one shard at a time
                row = batch.slice(i, 1).to_pylist()[0]
                at, treap = _places(row["words"], wanted), Treap(row)
                for q, (_, own, weights) in enumerate(items):
                    there = at[own] >= 0
                    if there.any():
                        floor = best[q][-1][0] if len(best[q]) == k else 1
                        scores, columns = treap.search(at[own][there], weights[there], k, floor)
                        best[q] = _best_first(best[q] + [(s, treap.ids[c]) for s, c in zip(scores.tolist(), columns.tolist(), strict=True)], k)
        out = [(q, items[q][0], doc_id, score) for q, hits in enumerate(best) for score, doc_id in hits]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q", "item_id", "doc_id", "score"])

    return run


def _weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def search(index: Index | None, items: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id and score (long) of the ``k`` documents of ``index`` with the highest scores
    above 0 for every row of ``items`` (item_id, text); all if there are fewer.

    A score sums weight * impact over the item's terms, repeats included; the weight is floor(1000 * ln((2N + 2) /
    (2df + 1))). Equal scores are ranked by ascending doc_id, null last. Items without terms, and empty tables, give
    no rows; items that repeat an item_id, null ones too, are ranked each for itself.
    """
    spark = items.sparkSession
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    size = named.agg(F.sum(F.length("text") + 16)).first()[0] if index else 0
    blocks = -(-(size or 0) // block)
    path = scratch(spark, "hits")
    for b in range(blocks):
        own = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else named
        asked = [(r["item_id"], Counter(terms(bytes(r["text"])))) for r in own.collect()]  # one block of items
        wanted = sorted({t for _, found in asked for t in found})
        if not wanted:
            continue
        context = spark.sparkContext
        sent = context.broadcast(wanted)
        with arrow_rows(spark, 1):
            counted = index.rows.select("words", "holding").mapInArrow(_holding(sent), "term long, documents long").groupBy("term").agg(F.sum("documents")).collect()
        sent.destroy()
        held = dict(map(tuple, counted))
        weight = [_weight(index.documents, held.get(i, 0)) for i in range(len(wanted))]
        number = {t: i for i, t in enumerate(wanted)}
        weighed = []
        for item_id, found in asked:
            if found:
                at = np.array([number[t] for t in found], np.int64)
                weighed.append((item_id, at, np.array([weight[number[t]] * n for t, n in found.items()], np.int64)))
        sent = context.broadcast((wanted, weighed))
        hits = index.rows.mapInArrow(_searched(sent, k), "q long, item_id long, doc_id long, score long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        with arrow_rows(spark, 1):
            ranked.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        sent.destroy()
    form = "item_id long, rank int, doc_id long, score long"
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
    return spark.read.schema(form).parquet(path) if there else spark.createDataFrame([], form)
