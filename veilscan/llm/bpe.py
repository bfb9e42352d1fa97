"""Byte-level BPE over padded matrices.

Texts are cut into pieces by the tokenizer's pattern. The distinct pieces of a batch are grouped by byte length and
laid out as one padded matrix of token ids per group. In every round each row merges its leftmost pair of minimum
rank; pair ranks come from an open-addressing hash table held in two numpy arrays, and the rows that have no pair
left are taken out, so the matrix shrinks. Pieces longer than the largest group use the same rule with a heap, whose
cost does not grow with the square of the length.

Decoding looks every id up in the vocabulary and joins the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

NO_RANK = np.int32(2**31 - 1)
#: Bytes of the longest piece of each matrix group.
GROUPS = (4, 6, 8, 12, 16, 24, 32, 64, 128)
_GROUP_OF = [next(g for g in GROUPS if n <= g) for n in range(GROUPS[-1] + 1)]
#: Rows of a matrix at most, which bounds its memory.
MATRIX_ROWS = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        if pairs:
            both = np.array(list(pairs), np.int64)
            keys, values = (both[:, 0] << 32) | both[:, 1], np.fromiter(pairs.values(), np.int32, len(pairs))
            slots = self._slot(keys)
            while len(keys):
                free = self.keys[slots] == -1
                slot, first = np.unique(slots[free], return_index=True)
                took = np.flatnonzero(free)[first]
                self.keys[slot], self.values[slot] = keys[took], values[took]
                left = np.ones(len(keys), bool)
                left[took] = False
                keys, values, slots = keys[left], values[left], (slots[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair; NO_RANK for pairs that do not merge or hold padding (-1)."""
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        out = np.full(keys.shape, NO_RANK, np.int32)
        rows = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = keys[rows]
        slots = self._slot(keys)
        while len(rows):
            there = self.keys[slots]
            hit = there == keys
            out[rows[hit]] = self.values[slots[hit]]
            on = ~hit & (there != -1)
            rows, keys, slots = rows[on], keys[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out.reshape(left.shape)


class Vocabulary:
    """Token bytes and merge ranks of a file with one ``base64 rank`` pair per line."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {
            (ranks[token[:i]], ranks[token[i:]]): rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.table = PairTable(self.pairs)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (known := self.ranks.get(piece)) is not None:
                out[i] = known.to_bytes(4, "little")
            elif piece:
                groups.setdefault(_GROUP_OF[len(piece)] if len(piece) <= GROUPS[-1] else 0, []).append(i)
        for width, members in groups.items():
            if not width:
                for i in members:
                    out[i] = self._long(pieces[i])
                continue
            for k in range(0, len(members), MATRIX_ROWS):
                part = members[k : k + MATRIX_ROWS]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = self.single[raw]
        ids[np.arange(width) >= lengths[:, None]] = -1
        ranks = self.table.ranks(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            at = ranks.argmin(axis=1)  # argmin gives the leftmost of equals
            merged = ranks[np.arange(len(rows)), at]
            done = merged == NO_RANK
            if done.any():
                packed = ids[done].astype("<u4")
                for row, line, n in zip(rows[done].tolist(), packed, lengths[done].tolist(), strict=True):
                    out[row] = line[:n].tobytes()
                keep = ~done
                rows, lengths, ids, ranks, at, merged = rows[keep], lengths[keep], ids[keep], ranks[keep], at[keep], merged[keep]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            ids[every, at] = merged
            lengths = lengths - 1
            closed = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, closed + (closed > at[:, None]), axis=1)  # drops the right half of the pair
            if ids.shape[1] == 1:
                ranks = np.full((len(rows), 1), NO_RANK, np.int32)
                continue
            closed = closed[:-1]
            ranks = np.take_along_axis(ranks, closed + (closed >= at[:, None]), axis=1)
            for col in (at - 1, at):  # only the pairs on both sides of the merged token are new
                ok = (col >= 0) & (col < ranks.shape[1])
                r, c = every[ok], col[ok]
                ranks[r, c] = self.table.ranks(ids[r, c], ids[r, c + 1])
        return out

    def _long(self, piece: bytes) -> bytes:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after, pairs = list(range(-1, n - 1)), [*range(1, n), -1], self.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := pairs.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        words = array("I", ids)
        return b"".join(map(self.bytes.__getitem__, words))


class TextEncoder:
    """Whole texts to ids. ``encode_parts`` turns strings, each taken by itself, into ids.

    No piece of the pattern spans a single space between two other characters except as its first character, so a
    text falls apart there into parts that encode by themselves. Parts are kept in a cache of bounded size.
    """

    CACHED, CACHED_CHARS = 300_000, 48

    def __init__(self, encode_parts: Callable[[list[str]], list[bytes]]):
        self.encode_parts, self.cache = encode_parts, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > self.CACHED:
            cache.clear()
        split = [t.split(" ") for t in texts]
        new, odd = set(), set()
        for part in set().union(*[s[1:] for s in split]) - cache.keys():
            if not part or part[0].isspace() or part[-1].isspace():
                odd.add(part)  # white space beside a space: such a text is not cut there
            else:
                new.add(part)
        whole = [bool(s[0]) and s[0][-1].isspace() or bool(odd) and not odd.isdisjoint(s[1:]) for s in split]
        ordered = list(new)
        first = [t if w else s[0] for t, s, w in zip(texts, split, whole, strict=True)]
        ids = self.encode_parts([" " + p for p in ordered] + first)
        fresh = dict(zip(ordered, ids, strict=False))
        heads = ids[len(ordered) :]
        cache.update((p, i) for p, i in fresh.items() if len(p) <= self.CACHED_CHARS)
        found = {p: i for p, i in fresh.items() if len(p) > self.CACHED_CHARS}
        get = (lambda p: found.get(p) or cache[p]) if found else cache.__getitem__
        return [h if w else h + b"".join(map(get, s[1:])) for h, s, w in zip(heads, split, whole, strict=True)]


def matrix_encoder(vocabulary: Vocabulary, pattern: str) -> TextEncoder:
    import regex

    find = regex.compile(pattern).findall

    def parts(texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        words, cut = [], []
        for i, t in enumerate(texts):
            # letters after at most one space are one piece
            (words if t[t.startswith(" ") :].isalpha() else cut).append(i)
        for i, ids in zip(words, vocabulary.encode([texts[i].encode() for i in words]), strict=True):
            out[i] = ids
        found = [find(texts[i]) for i in cut]
        pieces = list(set().union(*found))
        known = dict(zip(pieces, vocabulary.encode([p.encode() for p in pieces]), strict=True))
        for i, f in zip(cut, found, strict=True):
            out[i] = b"".join(map(known.__getitem__, f))
        return out

    return TextEncoder(parts)


#: What this process has loaded, by path: Python workers live through many tasks.
_LOADED: dict[tuple[str, str], tuple[Vocabulary, TextEncoder]] = {}


def loaded(path: str, pattern: str) -> tuple[Vocabulary, TextEncoder]:
    if (path, pattern) not in _LOADED:
        vocabulary = Vocabulary.load(path)
        _LOADED[path, pattern] = vocabulary, matrix_encoder(vocabulary, pattern)
    return _LOADED[path, pattern]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, none with much more than ``most_bytes`` of text unless one text alone has more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.fromiter((len(x or "") for x in batch.column(column).to_pylist()), np.int64, batch.num_rows))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text (null as empty) with the rank file at ``path``, which must be at the same
    place on every worker.

    Returns doc_id, n_tokens (long), ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the bytes decoded from the ids) and, with ``keep_ids``, the ids as binary. One row per row
    of the input, repeated or not; nulls in other columns pass or are left out; an empty text has 0 tokens.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder = loaded(path, pattern)
        for batch in slices(batches, "text"):
            ids = encoder.encode(batch.column("text").to_pylist())
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(vocabulary.decode(i)).hexdigest() for i in ids], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
