"""Exact top-k inner-product search with a vector-approximation file.

Every vector is stored as one byte per component that names its cell, and in full in a second file. The cells of a
component are bounded by quantiles of a bounded sample, the outer ones by the least and largest value of all rows, so
a few extreme values widen a few cells and not all. The first pass reads cells alone: a row's score lies within
``reach`` (half of each cell's width times the query's component) of the score of its cells' middles, which bounds it
from below and above. A row whose upper bound is under the k-th best lower bound cannot be among the best k. What is
left (``candidates``) is read in full in the order of its bounds: first the k best of each query, then only those
whose bound still reaches the k-th score found.

Queries pass over the cells in blocks of bounded number and bytes, each broadcast; blocks and rows are
compared in tiles, so a task holds one tile and k numbers per query. Only the ids of candidates are shuffled by
query, and of equal vectors only the k + 1 rows first in order can be among anyone's best k, so groups of copies,
however large, add no more than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch, stored

CELLS = 256
#: Queries broadcast at once, and bytes of their vectors.
BLOCK, BLOCK_BYTES = 65_536, 16 << 20
#: Rows that quantiles are taken from, bytes of their vectors, and bytes of all cells' bounds, at most.
SAMPLE, SAMPLE_BYTES, BOUNDS_BYTES = 4096, 16 << 20, 16 << 20
#: Rows and queries of a tile, and candidates that a task holds before it hands them on.
ROWS, QUERIES, HELD = 2048, 1024, 1 << 18
CANDIDATES = "q long, row long, lower double, upper double"


def integral(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """The columns of ``vectors`` but embedding, and v (array<double>): floor(scale * x) of each component.

    Vectors that are null or empty or hold null or non-finite components are left out.
    """
    others = [c for c in vectors.columns if c != "embedding"]
    wide = vectors.select(*others, F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.size("v") > 0)
    finite = wide.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return finite.select(*others, F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vectors the least and largest value of each component in a task's rows."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, _, v in _by_length(batch.column("v")):
            own = np.stack([v.min(axis=0), v.max(axis=0)])
            found[n] = own if n not in found else np.stack([np.minimum(found[n][0], own[0]), np.maximum(found[n][1], own[1])])
    rows = [(n, k, *x) for n, own in found.items() for k, x in enumerate(own.T.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], ["n", "k", "low", "high"])


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.values.to_numpy(), vectors.offsets.to_numpy()[:-1]
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield n, at, flat[starts[at][:, None] + np.arange(n)]


def fitted(exact: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the bounds of its components' cells (component x bound, ascending)."""
    rows = exact.select("v").mapInArrow(_ranges, "n long, k long, low double, high double").groupBy("n", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ranges: dict[int, list] = {}
    for r in rows.orderBy("n", "k").collect():  # one row per length and component
        ranges.setdefault(r["n"], []).append((r["low"], r["high"]))
    total = sum(ranges)
    if not total:
        return {}
    cells = int(min(CELLS, max(2, BOUNDS_BYTES // (8 * total))))
    count = exact.count()
    most = int(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(ranges)))))
    some = exact.select("v").sample(fraction=min(1.0, 1.5 * most / count), seed=7).limit(most).toArrow()
    sampled = {n: v for n, _, v in _by_length(some.column("v").combine_chunks())} if some.num_rows else {}
    out = {}
    for n, own in ranges.items():
        low, high = np.array(own).T
        inner = np.quantile(sampled[n], np.arange(1, cells) / cells, axis=0).T if n in sampled else low[:, None] + (high - low)[:, None] * np.arange(1, cells) / cells
        out[n] = np.concatenate([low[:, None], np.clip(inner, low[:, None], high[:, None]), high[:, None]], axis=1)
    return out


def _in_cells(sent):
    """The number of the cell that holds each component, one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b""] * batch.num_rows
            for n, at, v in _by_length(batch.column("v")):
                bounds = sent.value[n]
                cells = np.stack([np.searchsorted(bounds[k, 1:-1], v[:, k], side="right") for k in range(n)], axis=1).astype(np.uint8)
                for i, c in zip(at.tolist(), cells, strict=True):
                    out[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], ["row", "cells"])

    return run


def cell_file(rows: DataFrame, bounds: dict[int, np.ndarray]) -> DataFrame:
    """row and cells (one byte per component) of ``rows`` (row, v)."""
    return rows.select("row", "v").mapInArrow(_in_cells(rows.sparkSession.sparkContext.broadcast(bounds)), "row long, cells binary")


def without_hidden_copies(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (row, vec_id, v, ...) without those that have more than ``k`` equal vectors before them in order of
    (vec_id, row): as many rows with the same score come first for every query, its own row left aside. Ids and
    hashes are shuffled, not vectors, and no more than k + 1 rows per vector and task."""
    same = [F.xxhash64("v").alias("_a"), F.xxhash64(F.lit(1), "v").alias("_b")]
    order = Window.partitionBy("_a", "_b").orderBy("vec_id", "row")
    last = rows.select("row", "vec_id", *same).withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k + 1)
    last = last.select("_a", "_b", F.struct("vec_id", "row").alias("_last"))
    kept = F.col("_last").isNull() | (F.struct("vec_id", "row") <= F.col("_last"))
    return rows.withColumns({"_a": same[0], "_b": same[1]}).join(last, ["_a", "_b"], "left").where(kept).select(*rows.columns)


class _Block:
    """One block's queries of one length, and what their best lower bounds are so far."""

    def __init__(self, rows: np.ndarray, v: np.ndarray, bounds: np.ndarray, k: int):
        self.rows, self.k = rows, k
        self.weights, self.sizes = v.astype(np.float32), np.abs(v).astype(np.float32)
        self.middle, self.half = ((bounds[:, 1:] + bounds[:, :-1]) / 2).astype(np.float32), ((bounds[:, 1:] - bounds[:, :-1]) / 2).astype(np.float32)
        # what single precision may lose in sums of so many products
        self.lost = np.abs(v) @ np.abs(bounds).max(axis=1) * (v.shape[1] + 8) * 2.0**-22 + 1e-3
        self.best = np.full((len(rows), k), -np.inf)

    def tile(self, at: slice, rows: np.ndarray, middle: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, row, lower, upper) of the rows whose score may be among the best k."""
        estimate = (self.weights[at] @ middle.T).astype(np.float64)
        reach = (self.sizes[at] @ half.T).astype(np.float64) + self.lost[at][:, None]
        lower, upper = estimate - reach, estimate + reach
        own = np.searchsorted(rows, self.rows[at])
        there = np.flatnonzero((own < len(rows)) & (rows[np.minimum(own, len(rows) - 1)] == self.rows[at]))
        lower[there, own[there]] = upper[there, own[there]] = -np.inf
        n = min(self.k, len(rows))
        top = np.partition(lower, len(rows) - n, axis=1)[:, len(rows) - n :]
        self.best[at] = np.sort(np.hstack([self.best[at], top]), axis=1)[:, -self.k :]
        q, r = np.nonzero(upper >= np.maximum(self.best[at][:, 0], np.finfo(np.float64).min)[:, None])
        return q + at.start, rows[r], lower[q, r], upper[q, r]

    def still(self, q: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= self.best[q, 0]


def _scan(sent, k: int):
    """Candidates of one block's queries in a partition of the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, bounds = sent.value
        blocks = {v.shape[1]: _Block(rows, v, bounds[v.shape[1]], k) for rows, v in groups}
        held: dict[int, list[tuple]] = {n: [] for n in blocks}

        def handed(n: int) -> pa.RecordBatch:
            q, row, lower, upper = (np.concatenate(x) for x in zip(*held[n], strict=True))
            held[n] = []
            on = blocks[n].still(q, upper)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (blocks[n].rows[q[on]], row[on], lower[on], upper[on])], ["q", "row", "lower", "upper"])

        for batch in batches:
            ids, raw = batch.column("row").to_numpy(), batch.column("cells").to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            for n, block in blocks.items():
                own = np.flatnonzero(sizes == n)
                own = own[np.argsort(ids[own], kind="stable")]
                for a in range(0, len(own), ROWS):
                    part = own[a : a + ROWS]
                    cells = np.frombuffer(b"".join([raw[i] for i in part.tolist()]), np.uint8).reshape(-1, n)
                    middle, half = block.middle[np.arange(n), cells], block.half[np.arange(n), cells]
                    for b in range(0, len(block.rows), QUERIES):
                        held[n].append(block.tile(slice(b, min(b + QUERIES, len(block.rows))), ids[part], middle, half))
                        if sum(len(x[0]) for x in held[n]) > HELD:
                            yield handed(n)
        for n in held:
            if held[n]:
                yield handed(n)

    return run


def _scored(pairs: DataFrame, exact: DataFrame) -> DataFrame:
    """``pairs`` (q, row, ...) with query_id, vec_id and the score of their full vectors."""
    # ids tell rows apart, so no key is hot; the file's other columns are not read
    queries = exact.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("_q"))
    both = pairs.join(exact.select("row", "vec_id", "v"), "row").join(queries, "q")
    products = F.zip_with("_q", "v", lambda a, b: a * b)
    return both.withColumn("score", F.aggregate(products, F.lit(0.0), lambda s, x: s + x).cast("long")).drop("_q", "v")


def candidates(cells: DataFrame, exact: DataFrame, is_query, bounds: dict[int, np.ndarray], k: int, block: int = BLOCK) -> DataFrame:
    """q, row, lower, upper and place (from 1, by upper): for each query the rows that may be among its best ``k``."""
    spark = cells.sparkSession
    queries = exact.where(is_query).select("row", "v")
    count, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size("v")), F.lit(0))).first()
    blocks = max(-(-count // block), -(-size // BLOCK_BYTES))
    path = scratch(spark, "candidates")
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = own.toArrow()  # one block of queries
        if not rows.num_rows:
            continue
        number = rows.column("row").to_numpy()
        groups = [(number[at], v) for n, at, v in _by_length(rows.column("v").combine_chunks())]
        sent = spark.sparkContext.broadcast((groups, {v.shape[1]: bounds[v.shape[1]] for _, v in groups}))
        cells.mapInArrow(_scan(sent, k), CANDIDATES).write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema(CANDIDATES).parquet(path) if blocks else spark.createDataFrame([], CANDIDATES)
    best = Window.partitionBy("q").orderBy(F.desc("lower"), "row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = found.withColumn("_kth", F.nth_value("lower", k).over(best)).where(F.col("_kth").isNull() | (F.col("upper") >= F.col("_kth"))).drop("_kth")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("upper"), "row")))


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): the ``k`` highest inner products of each query, all if there
    are fewer; equal scores in order of vec_id.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Every row but the query's own is a
    candidate; rows that repeat a vec_id are queries and candidates of their own. Rows without vec_id or with a
    vector that ``integral`` leaves out take no part. No inner product is defined between vectors of different
    lengths, so each length is searched by itself. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    named = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    exact = stored(integral(named, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    bounds = fitted(exact)
    if not bounds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = stored(cell_file(without_hidden_copies(exact, k), bounds), "vector-cells")
    found = cut(candidates(cells, exact, is_query, bounds, k, block))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    first = cut(_scored(found.where(F.col("place") <= k), exact).select("q", "query_id", "row", "vec_id", "score"))
    # the k-th score so far decides which bounds are still open; equal ones count, a tie may have the smaller id
    kth = first.groupBy("q").agg(F.min("score").alias("_kth"))
    rest = found.where(F.col("place") > k).join(kth, "q").where(F.col("upper") >= F.col("_kth"))
    rest = _scored(rest.select("q", "row"), exact).select("q", "query_id", "row", "vec_id", "score")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
