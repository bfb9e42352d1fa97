"""Best-fit packing of tokenised documents into sequences of a fixed length, by exact-complement hashing.

Whether a piece fits depends on its length alone, so the plan is made on the histogram of lengths, which has at most
``length`` entries however many documents there are. Going down from the longest length, the plan looks for what
fills the gap exactly: one length (a lookup), two (lookups of each first length's complement) or three (an index that
counts the pairs of available lengths by their sum). A combination is used as often as the counts of its lengths
allow. What finds no exact complement is placed best-fit: into the open sequences with the smallest sufficient gap.

The plan is a table of runs (length, first rank, last rank, first sequence, offset) of a few thousand rows. Spark
ranks the pieces inside their length by the global order, so a length that holds a third of all pieces is spread
over many partitions, and a broadcast join with the runs places each piece.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut, in_order, offsets, stored, text_or_empty


class _Parts(dict):
    """Part of a text (without the space before it) -> its ids; see ``bpe.TextEncoder`` for why parts are independent.
    ``added`` tokens are cut out of a text first, wherever their strings stand, and what lies between is encoded by
    itself, as ``tokenizers`` does."""

    CACHED, CACHED_CHARS = 400_000, 48

    def __init__(self, encode, added: dict[str, int]):
        super().__init__()
        self.encode = encode
        self.added = {t: array("I", [i]).tobytes() for t, i in added.items()}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise KeyError(part)
        ids = array("I", self.encode(" " + part)).tobytes()
        if len(part) <= self.CACHED_CHARS:
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(self.added.get(t) or self.plain(t) for t in self.cut.split(text) if t)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not first[-1:].isspace():
            try:
                return array("I", self.encode(first)).tobytes() + b"".join(map(self.__getitem__, rest))
            except KeyError:
                pass
        return array("I", self.encode(text)).tobytes()


def added_tokens(path: str) -> dict[str, int]:
    """String -> id of the tokens that a tokenizer's JSON file matches in a text before anything else. Those that
    need a word of their own or take white space with them are refused: this file has none."""
    with open(path, encoding="utf-8") as lines:
        tokens = json.load(lines)["added_tokens"]
    if odd := [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens with rules of their own: {odd}")
    return {t["content"]: t["id"] for t in tokens}


_LOADED: dict[tuple, _Parts] = {}


def _loaded(path: str, pattern: str, added: dict[str, int]) -> _Parts:
    key = path, pattern, tuple(added.items())
    if key not in _LOADED:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _LOADED[key] = _Parts(encoding.encode_ordinary, added)
    parts = _LOADED[key]
    if len(parts) > parts.CACHED:
        parts.clear()
    return parts


def cut_pieces(docs: DataFrame, path: str, pattern: str, length: int, added: dict[str, int] | None = None) -> DataFrame:
    """The pieces of every row of ``docs`` (row, doc_id, text): row, doc_id, piece, start, length, ids_crc32 and ids
    (binary) of its ids and an end id 0; more than ``length`` ids are cut so that only piece 0 may be shorter.

    ``tiktoken`` with the rank file and the ``added`` tokens of the JSON file gives the ids that ``tokenizers`` gives
    with that file, at a third of the cost. Null and empty texts are one piece with the end id; null doc_ids are kept.
    """
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    end = (0).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _loaded(path, pattern, added or {})
        for batch in slices(batches, "text"):
            rows = []
            for row, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "text")], strict=True):
                ids = parts.ids(text) + end
                n = len(ids) // 4
                head = (n - 1) % length + 1
                for piece, start in enumerate([0, *range(head, n, length)]):
                    stop = start + length if piece else head
                    own = ids[4 * start : 4 * stop]
                    rows.append((row, doc_id, piece, start, stop - start, zlib.crc32(own), own))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


class _Available:
    """Counts of the lengths still to place, and how many pairs and triples of available lengths have each sum."""

    def __init__(self, counts: dict[int, int], length: int):
        self.length = length
        self.count = np.zeros(length + 1, np.int64)
        for size, n in counts.items():
            self.count[size] = n
        there = (self.count > 0).astype(np.int64)
        self.pairs = np.convolve(there, there)
        # kept as it is at the start: lengths only run out, so a sum that no triple has never gets one
        self.triples = np.convolve(self.pairs, there)

    def take(self, combination: tuple[int, ...], times: int) -> None:
        for size in combination:
            self.count[size] -= times
        for size in set(combination):
            if not self.count[size]:
                there = np.flatnonzero(self.count)
                self.pairs[size + there] -= 2
                self.pairs[2 * size] -= 1

    def times(self, combination: tuple[int, ...]) -> int:
        return min(int(self.count[size]) // n for size, n in Counter(combination).items())

    def complement(self, size: int) -> tuple[int, ...]:
        """One, two or three sizes that with ``size`` make exactly one sequence, largest first, or nothing."""
        gap = self.length - size
        if self.count[gap] and self.times((size, gap)):
            return (gap,)
        there = np.flatnonzero(self.count[: gap + 1])[::-1]
        if self.pairs[gap]:
            for a in there[(self.count[gap - there] > 0) & (2 * there >= gap)].tolist():
                if self.times((size, a, gap - a)):
                    return a, gap - a
        if self.triples[gap]:
            for a in there[(self.pairs[gap - there] > 0) & (3 * there >= gap)].tolist():
                rest = gap - a
                second = there[(there <= min(a, rest)) & (2 * there >= rest)]
                for b in second[self.count[rest - second] > 0].tolist():
                    if b < rest and self.times((size, a, b, rest - b)):
                        return a, b, rest - b
        return ()


Patterns = list[tuple[tuple[int, ...], int]]


def exact_patterns(counts: dict[int, int], length: int) -> tuple[Patterns, dict[int, int]]:
    """(patterns that fill a sequence exactly, counts of the lengths that found no exact complement)."""
    left = _Available(counts, length)
    patterns: Patterns = []
    if left.count[length]:
        patterns.append(((length,), int(left.count[length])))
        left.take((length,), int(left.count[length]))
    for size in range(length - 1, 0, -1):
        while left.count[size] and (rest := left.complement(size)):
            combination = (size, *rest)
            times = left.times(combination)
            patterns.append((combination, times))
            left.take(combination, times)
    return patterns, {size: int(left.count[size]) for size in np.flatnonzero(left.count).tolist()}


def best_fit(counts: dict[int, int], length: int) -> Patterns:
    """Longest first, each into the open sequence with the smallest sufficient gap."""
    open_by_gap: dict[int, Patterns] = defaultdict(list)
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            gap = min((g for g, x in open_by_gap.items() if x and g >= size), default=None)
            if gap is None:
                most = min(n, length // size)
                open_by_gap[length - most * size].append(((size,) * most, n // most))
                n %= most
                continue
            pattern, times = open_by_gap[gap].pop()
            used = min(n, times)
            open_by_gap[gap - size].append(((*pattern, size), used))
            if times > used:
                open_by_gap[gap].append((pattern, times - used))
            n -= used
    return [x for group in open_by_gap.values() for x in group]


def plan_patterns(counts: dict[int, int], length: int) -> Patterns:
    """(lengths of one sequence, number of such sequences) for a histogram of piece lengths.

    Exact complements of one to three lengths come first, best fit places what is left. Exact sequences use up short
    pieces that the residuals could need, so if the plan has more sequences than the sum of all lengths asks for,
    the sequences that hold the shortest pieces are opened again, twice as many each time, and their pieces are
    placed together with the residuals; the shortest plan counts, of equal ones that with the most exact sequences.
    """
    least = -(-sum(size * n for size, n in counts.items()) // length)
    exact, left = exact_patterns(counts, length)
    exact.sort(key=lambda p: (p[0] == (length,), -min(p[0])))  # whole pieces last but never opened
    whole = [p for p in exact if p[0] == (length,)]
    kept = [p for p in exact if p[0] != (length,)]
    n_exact, opened, step = sum(n for _, n in kept), 0, 1
    best: Patterns | None = None
    residual = Counter(left)
    while True:
        plan = whole + kept + best_fit(residual, length)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
        if sum(n for _, n in best) <= least or opened >= n_exact:
            return best
        want, step = step, 2 * step
        while want and kept:
            pattern, times = kept.pop()
            take = min(want, times)
            for size in pattern:
                residual[size] += take
            if times > take:
                kept.append((pattern, times - take))
            want, opened = want - take, opened + take


def plan_runs(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset): where the pieces of a length go."""
    runs, used, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            runs.append((size, used[size], used[size] + times, sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return runs


def pack_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (row, doc_id, piece, length between 1 and ``length``, ...)."""
    ranked = in_order(pieces, "length", "doc_id", "piece", "row")
    ranked = ranked.join(F.broadcast(offsets(ranked).select("_part", "_rows")), "_part").withColumn("_index", F.col("_rows") + F.col("_pos"))
    by_length = ranked.groupBy("length").agg(F.min("_index").alias("_first"), F.count(F.lit(1)).alias("n")).collect()  # one row per length
    runs = plan_runs(plan_patterns({r["length"]: r["n"] for r in by_length}, length))
    first = {r["length"]: r["_first"] for r in by_length}
    placed = pieces.sparkSession.createDataFrame(
        [(size, first[size] + a, first[size] + b, sequence, offset) for size, a, b, sequence, offset in runs],
        "length long, _from long, _to long, _sequence long, offset long",
    )
    return ranked.join(
        F.broadcast(placed),
        (ranked["length"] == placed["length"]) & (ranked["_index"] >= placed["_from"]) & (ranked["_index"] < placed["_to"]),
    ).select(*[ranked[c] for c in pieces.columns], (F.col("_sequence") + F.col("_index") - F.col("_from")).alias("sequence_id"), placed["offset"])


def pack_documents(docs: DataFrame, path: str, pattern: str, length: int = 2048, keep_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Packs all documents (null text: empty) into sequences of at most ``length`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row per piece, and with
    ``keep_ids`` the piece's ids as binary (little-endian unsigned 32-bit). An empty text is one piece with the end
    id. Repeated rows are packed as often as they occur; null doc_ids are kept; columns other than doc_id and text
    are left out, whatever their names; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    pieces = cut_pieces(rows, path, pattern, length, added)
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not keep_ids:
        return pack_pieces(cut(pieces.drop("ids")), length).select(*out)
    whole = stored(pieces, "pieces")
    # the ids are dealt out once, to meet their places; the order above is made without them
    placed = pack_pieces(whole.drop("ids"), length)
    return placed.join(whole.select("row", "piece", "ids"), ["row", "piece"]).select(*out, "ids")
