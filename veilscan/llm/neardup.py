"""Near-duplicate documents: SimHash fingerprints linked exactly within a Hamming radius, by vantage-point trees.

A vantage-point tree splits fingerprints by their Hamming distance to a vantage point, nearer ones to one branch,
farther ones to the other. By the triangle inequality a query at distance d needs the near branch only if
``d - radius <= split`` and the far branch only if ``d + radius > split``; a query close to the boundary visits both.

On 64 bits with unrelated fingerprints a split prunes little (distances crowd around 32 +- 4, so with radius 4 two
thirds of all queries visit both branches), and a single tree over everything would stay near quadratic. So Spark
first deals the fingerprints into shards that agree on some blocks of bits: with ``radius + e`` blocks, two
fingerprints within the radius agree on at least ``e`` of them, so every link lies in a shard, exactly. Each shard is
joined with itself by a vantage-point tree. Shards above a size are first cut into the leaves of a distributed
tree, whose vantage points and splits are aggregates; each fingerprint goes to its home leaf and, as a visitor, to
every leaf that its radius overlaps.

Shards return one link from each member to its group's first member, never all pairs; components come from joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import cut, discard, partitions, stored, text_or_empty
from .components import smallest_reachable

SEED = 42
LEAF = 16
#: Fingerprints a shard should have on average at least, and those above which it is cut by the distributed tree.
SHARD_MEAN, SHARD_MOST = 2048, 16384
#: Depth of the distributed tree at most.
DEPTH = 6


def simhash(text: str, words: int = 4) -> int:
    """The fingerprint of one text, as an unsigned 64-bit integer; no word: 0."""
    parts = text.encode().lower().split()  # bytes: only A-Z and the six ASCII spaces count
    if not parts:
        return 0
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1].tolist()
    stops = (ends - 1)[words - 1 :].tolist()
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every whole text, row by row; null counts as empty,
    and a text without words has fingerprint zero. Null doc_ids are kept; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bits = np.array([simhash(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


class _Sets:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def tree_links(members: np.ndarray, homes: np.ndarray, radius: int, compared: list[int] | None = None) -> np.ndarray:
    """For each of ``members`` (unsigned fingerprints) the index of the first member of its group, where links
    join a home to any member within the radius. A vantage-point tree over the homes is queried by all members.
    ``compared`` gets the number of distances taken at each vantage point and leaf."""
    sets = _Sets(len(members))
    todo = [(np.flatnonzero(homes), np.arange(len(members)))]
    while todo:
        own, queries = todo.pop()
        if not len(own) or not len(queries):
            continue
        if len(own) > LEAF:
            vantage = members[own[len(own) // 2]]
            if compared is not None:
                compared.append(len(queries))
            far, query_far = np.bitwise_count(members[own] ^ vantage), np.bitwise_count(members[queries] ^ vantage).astype(int)
            ball = queries[query_far <= radius]
            sets.join(ball, np.full(len(ball), own[len(own) // 2]))
            split = int(np.median(far))
            if far.max() == split:
                split -= 1  # else the far branch would be empty
            near = far <= split
            if near.any():
                todo.append((own[near], queries[query_far <= split + radius]))
                todo.append((own[~near], queries[query_far + radius > split]))
                continue
        for k in range(0, len(own), LEAF):
            part = own[k : k + LEAF]
            a, b = np.nonzero(np.bitwise_count(members[part][:, None] ^ members[queries][None, :]) <= radius)
            other = part[a] != queries[b]
            sets.join(part[a[other]], queries[b[other]])
            if compared is not None:
                compared.append(len(part) * len(queries))
    return sets.root


def _shard_links(radius: int):
    def links(shard: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fp = shard.column("fp").to_numpy()
        root = tree_links(fp.view(np.uint64), shard.column("home").to_numpy().astype(bool), radius)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return fp[moved], fp[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["combination", "key", "leaf"]
        rest = None
        for batch in (*batches, None):
            rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            at = np.zeros(rows.num_rows, bool)
            for k in keys:
                column = rows.column(k).to_numpy()
                at[1:] |= column[1:] != column[:-1]
            bounds = [0, *np.flatnonzero(at).tolist(), rows.num_rows]
            if batch is not None:  # the last shard may go on in the next batch
                rest = rows.slice(bounds[-2])
                bounds = bounds[:-1]
            found = [links(rows.slice(a, b - a)) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def _blocks(n: int, radius: int) -> tuple[list[tuple[int, int]], int]:
    """(shift, width) of what is taken of each block of bits, and how many blocks make a shard's key, for ``n``
    fingerprints: as few blocks, and no more of their bits, than shards of SHARD_MEAN to twice as many ask for."""
    bits, equal = max(0, (n // SHARD_MEAN).bit_length() - 1), 1
    while equal < 4 and bits > 64 * equal // (radius + equal):
        equal += 1
    ends = [round(64 * i / (radius + equal)) for i in range(radius + equal + 1)]
    return [(a, min(b - a, -(-bits // equal))) for a, b in zip(ends, ends[1:], strict=False)], equal


def _shards(fps: DataFrame, radius: int, n: int, most: int) -> DataFrame:
    """combination, key, leaf, fp, home: a row for each fingerprint and shard (leaf) it belongs to or visits."""
    blocks, equal = _blocks(n, radius)

    def key(combination: tuple[int, ...]):
        out, used = F.lit(0).cast("long"), 0
        for i in combination:
            shift, width = blocks[i]
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1), used))
            used += width
        return out

    # without bits all shards would be the same one
    chosen = list(combinations(range(len(blocks)), equal))[: None if blocks[0][1] else 1]
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("combination"), key(c).alias("key")) for i, c in enumerate(chosen)])).alias("_s")).select(
        "_s.combination", "_s.key", "fp"
    )
    shard = ["combination", "key"]
    vantage = [F.min_by("fp", F.xxhash64("fp", F.lit(i))).alias(f"_v{i}") for i in range(DEPTH)]
    large = cut(dealt.groupBy(*shard).agg(F.count(F.lit(1)).alias("_n"), *vantage).where(F.col("_n") > most))
    if large.isEmpty():
        return dealt.select(*shard, F.lit(0).alias("leaf"), "fp", F.lit(True).alias("home"))
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.col(f"_v{i}"))) for i in range(DEPTH)]
    inside = dealt.join(large, shard).withColumns({f"_d{i}": d for i, d in enumerate(distance)})
    splits = inside.groupBy(*shard).agg(*[F.percentile_approx(f"_d{i}", 0.5).alias(f"_m{i}") for i in range(DEPTH)])
    depth = F.least(F.lit(DEPTH), F.ceil(F.log2(F.col("_n") / most)).cast("int"))
    leaves = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), depth) - 1)

    def bit(leaf, i):
        return F.shiftright(leaf, i).bitwiseAND(1)

    def lies(leaf, reach: int):
        ok = F.lit(True)
        for i in range(DEPTH):
            side = F.when(bit(leaf, i) == 0, F.col(f"_d{i}") - reach <= F.col(f"_m{i}")).otherwise(F.col(f"_d{i}") + reach > F.col(f"_m{i}"))
            ok = ok & ((F.lit(i) >= depth) | side)
        return ok

    visits = F.transform(F.filter(leaves, lambda leaf: lies(leaf, radius)), lambda leaf: F.struct(leaf.alias("leaf"), lies(leaf, 0).alias("home")))
    cut_up = inside.join(splits, shard).select(*shard, "fp", F.explode(visits).alias("_l")).select(*shard, F.col("_l.leaf").alias("leaf"), "fp", F.col("_l.home").alias("home"))
    return dealt.join(large.select(*shard), shard, "left_anti").select(*shard, F.lit(0).alias("leaf"), "fp", F.lit(True).alias("home")).union(cut_up)


def linked_fingerprints(fps: DataFrame, radius: int = 4, most: int = SHARD_MOST) -> DataFrame:
    """a, b: links between the distinct fingerprints in ``fps`` (fp) that connect all that lie within the radius."""
    dealt = _shards(fps, radius, fps.count(), most)
    n = partitions(fps.sparkSession)
    keyed = dealt.repartition(n, "combination", "key", "leaf").sortWithinPartitions("combination", "key", "leaf", "fp")
    return keyed.mapInArrow(_shard_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, most: int = SHARD_MOST) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every document.

    Texts count whole; null counts as empty. A text without words has fingerprint zero and is linked like any other.
    Two documents are linked if their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    doc_id that can be reached. Repeated rows come back as often as they occur; rows without doc_id keep their
    component, or none if nothing in it has a doc_id. An empty table gives no rows.
    """
    every = cut(fingerprints(docs, words))
    distinct = cut(every.groupBy("fp").agg(F.min("doc_id").alias("label")))
    # fingerprints tell nodes apart, doc_ids need not: the smallest doc_id of a component is an aggregate of its own
    nodes = distinct.select(F.col("fp").alias("node"), F.col("fp").alias("label"))
    found = cut(smallest_reachable(nodes, cut(linked_fingerprints(distinct.select("fp"), radius, most))).select(F.col("node").alias("fp"), F.col("label").alias("_root")))
    smallest = stored(found.join(distinct, "fp").groupBy("_root").agg(F.min("label").alias("component_id")), "smallest")
    component = stored(found.join(smallest, "_root").select("fp", "component_id"), "components")
    return every.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by the likeness of their shingle sets, for the corpus pipeline.

#: Words of a shingle. Sets are linked from a (Dice) similarity of 0.8 on: twice the shingles they share over the shingles
#: of both. That is two thirds of their union, and one minus that share is a metric.
SHINGLE = 5
#: A shard's members agree on all of a band's least hashes: linked sets share no band with 0.802 ** 20 = 1.2e-2 at most,
#: those of similarity 0.86 (as 3 % changed words give) with 0.68 ** 20 = 5e-4.
BANDS, ROWS = 20, 4
#: At similarity 0.8 fingerprints of sets differ in 14 +- 3 bits.
WIDE = 24
_MIX = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    parts = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(parts[i : i + words]), SEED) for i in range(max(len(parts) - words + 1, min(len(parts), 1)))], np.uint64))


def _signature(hashes: np.ndarray) -> tuple[int, int, list[int]]:
    """A set's key (64-bit hash of its members), its SimHash and one key per band, as signed longs."""
    node = xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)
    if not len(hashes):
        return *np.array([node, 0], np.uint64).view(np.int64).tolist(), [0] * BANDS
    ones, least = np.zeros(64, np.int64), np.full(len(_MIX), 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        x = part[None, :] ^ _MIX[:, None]
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        np.minimum(least, x.min(axis=1), out=least)
    fp = int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])
    bands = [xxhash.xxh3_64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    signed = np.array([node, fp, *bands], np.uint64).view(np.int64).tolist()
    return signed[0], signed[1], signed[2:]


def _linked(shared, every):
    """Whether sets are linked, by how many shingles they share and have together (numbers, arrays or columns)."""
    return 3 * shared >= 2 * every


def _close(shared, every):
    """Whether sets may both be linked to a third one: no less than a third of their union is shared."""
    return 3 * shared >= every


def signatures(docs: DataFrame) -> DataFrame:
    """``docs`` with _node, _fp and _bands of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            node, fp, bands = zip(*[_signature(shingle_set(t or "")) for t in batch.column("text").to_pylist()], strict=True)
            more = [pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_node", "_fp", "_bands"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType()), T.StructField("_fp", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, schema)


def _band_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of the shards (key), sorted, of bounded size: a vantage-point tree links fingerprints within
    WIDE bits."""
    rest = None
    for batch in (*batches, None):
        rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rows is None or not rows.num_rows:
            continue
        key, node, fp = (rows.column(k).to_numpy() for k in ("key", "_node", "_fp"))
        at = np.ones(len(key), bool)
        at[1:] = key[1:] != key[:-1]
        bounds = np.append(np.flatnonzero(at), len(key))
        if batch is not None:  # the last shard may go on in the next batch
            rest = rows.slice(bounds[-2])
            bounds = bounds[:-1]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
            own = slice(bounds[i], bounds[i + 1])
            n = own.stop - own.start
            root = tree_links(fp[own].view(np.uint64), np.ones(n, bool), WIDE)
            moved = np.flatnonzero(root != np.arange(n))
            a.append(node[own][moved])
            b.append(node[own][root[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _candidate_links(nodes: DataFrame) -> DataFrame:
    """a, b: links between candidates among ``nodes`` (_node, _fp, _bands). A band's key is a hash of its own, so keys
    of different bands do not meet. Shards above SHARD_MOST members never come into one task: all of such a shard are
    candidates, linked to its smallest node by a join that Spark can split, and their sets decide."""
    dealt = nodes.select("_node", "_fp", F.explode(F.array_distinct("_bands")).alias("key"))
    large = cut(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("_node").alias("b")).where(F.col("_n") > SHARD_MOST).select("key", "b"))
    stars = None
    if not large.isEmpty():
        stars = dealt.join(large, "key").where("_node <> b").select(F.col("_node").alias("a"), "b")
        dealt = dealt.join(large, "key", "left_anti")
    sorted_ = dealt.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "_node").select("key", "_node", "_fp")
    links = sorted_.mapInArrow(_band_links, "a long, b long")
    return links if stars is None else links.union(stars)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of spans of an array, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _leading(size):
    """Linked sets share at least two thirds of the larger one, so one of so many rarest members of each at least
    (a number, array or column)."""
    return size - (2 * size + 2) // 3 + 1


def groups_of_sets(sets: list[np.ndarray]) -> np.ndarray:
    """For each of ``sets`` the index of the first member of its group, where links join sets of similarity 0.8
    or more. Each set meets all that no group has reached yet and that share one of its rarest members with one of
    theirs (see ``_leading``), so the result is that of all pairs, and sets that share what is common do not meet."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    _, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several, owner = counts[flat] > 1, np.repeat(np.arange(n), sizes)  # what one set has it shares with none
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    flat, owner = rank[flat[several]], owner[several]
    flat = flat[np.lexsort((flat, owner))]
    lengths = np.bincount(owner, minlength=n)
    starts = np.cumsum(lengths) - lengths
    heads = np.clip(_leading(sizes) - (sizes - lengths), 0, lengths)
    by_member = _spans(starts, heads)
    by_member = by_member[np.argsort(flat[by_member], kind="stable")]
    members, holders = flat[by_member], owner[by_member]
    mark, left, group = np.zeros(len(counts), bool), np.ones(n, bool), np.zeros(n, np.int64)
    todo, first, open_, held = [], 0, n, n
    while True:
        while not todo and first < n and not left[first]:
            first += 1
        if not todo:
            if first == n:
                return group
            left[first], group[first], todo, at, open_ = False, first, [first], first, open_ - 1
        x = todo.pop()
        if not sizes[x]:
            near = np.flatnonzero(left & (sizes == 0))
        elif not heads[x]:
            continue
        else:
            if 2 * open_ < held:  # only the sets that are left are looked at
                keep = left[holders]
                members, holders, held = members[keep], holders[keep], open_
            own = flat[starts[x] : starts[x] + lengths[x]]
            a, b = np.searchsorted(members, own[: heads[x]]), np.searchsorted(members, own[: heads[x]], "right")
            if np.sum(b - a) < open_:
                some = holders[_spans(a, b - a)]
                some = np.unique(some[left[some]])
            else:
                some = np.flatnonzero(left)
            most = np.minimum(lengths[x], lengths[some])
            some = some[_linked(most, sizes[x] + sizes[some] - most)]
            if not len(some):
                continue
            mark[own] = True
            sums = np.concatenate(([0], np.cumsum(mark[flat[_spans(starts[some], lengths[some])]])))
            mark[own] = False
            ends = np.cumsum(lengths[some])
            shared = sums[ends] - sums[ends - lengths[some]]
            near = some[_linked(shared, sizes[x] + sizes[some] - shared)]
        left[near], group[near], open_ = False, at, open_ - len(near)
        todo.extend(near.tolist())


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by candidate group the first with and the first without doc_id of each group of linked sets."""

    def kept(rows: pa.Table) -> pa.Table:
        group = groups_of_sets([shingle_set(t or "") for t in rows.column("text").to_pylist()])
        nameless = rows.column("doc_id").is_null().to_numpy()
        return rows.take(np.sort(np.unique(2 * group + nameless, return_index=True)[1]))

    rest: list[pa.Table] = []
    for batch in batches:
        at = batch.column("_group").to_numpy()
        for part in np.split(np.arange(len(at)), np.flatnonzero(at[1:] != at[:-1]) + 1):
            if not len(part):
                continue
            if rest and rest[0].column("_group")[0].as_py() != at[part[0]]:
                yield from kept(pa.concat_tables(rest)).to_batches(1024)
                rest = []
            rest.append(pa.Table.from_batches([batch.slice(part[0], len(part))]))
    if rest:
        yield from kept(pa.concat_tables(rest)).to_batches(1024)


#: A candidate group of at most so many texts and bytes is settled in one task, a larger one by rounds of pivots.
GROUP_TEXTS, GROUP_BYTES = 50_000, 64 << 20
#: Bytes of shingle sets that are broadcast at once.
RING_BYTES = 32 << 20
#: Pivots that a large group has in a round, and groups (numbers) that are broadcast at most.
PIVOTS, GROUPS_SENT = 64, 1 << 18


def _with_sets(rows: DataFrame) -> DataFrame:
    """_row, _group, doc_id and _set (array<long>, the shingle set) of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = pa.array([shingle_set(t or "").view(np.int64) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_group"), batch.column("doc_id"), sets], ["_row", "_group", "doc_id", "_set"])

    return rows.select("_row", "_group", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "_row long, _group long, doc_id long, _set array<long>")


def _set_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each set to the first of its linked sets; rows are sorted by group, and a group is bounded."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        first = groups_of_sets([s for _, s in rows]).tolist()
        pairs = [(rows[i][0], rows[j][0]) for i, j in enumerate(first) if i != j]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    rest: list[tuple] = []
    last = None
    for batch in batches:
        for row, group, own in zip(*[batch.column(c).to_pylist() for c in ("_row", "_group", "_set")], strict=True):
            if rest and group != last:
                yield links(rest)
                rest = []
            rest.append((row, np.array(own, np.int64).view(np.uint64)))
            last = group
    if rest:
        yield links(rest)


def _ring_links(core: DataFrame, ring: DataFrame) -> DataFrame | None:
    """a, b: members of ``ring`` and the pivot of their group, if a member of ``core`` is similar to them. The ring's
    sets are the queries, broadcast in blocks of bounded bytes, and no pairs leave a task but those found."""
    size = ring.agg(F.sum(F.size("_set") * 8)).first()[0] or 0
    blocks, out = -(-size // RING_BYTES), None
    for b in range(blocks):
        held: dict[int, list[tuple]] = {}
        for r in ring.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b).select("_row", "_group", "_pivot", "_set", "_same", "_all").toArrow().to_pylist():
            held.setdefault(r["_group"], []).append((r["_row"], r["_pivot"], np.sort(np.array(r["_set"], np.int64)), 1 - r["_same"] / r["_all"]))
        sent = core.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            open_ = {g: list(rows) for g, rows in sent.value.items()}
            for batch in batches:
                found = []
                for group, own, same, every in zip(*[batch.column(c).to_pylist() for c in ("_group", "_set", "_same", "_all")], strict=True):
                    if not open_.get(group):
                        continue
                    mine, far, still = np.sort(np.array(own, np.int64)), 1 - same / max(every, 1), []
                    for row, pivot, other, away in open_[group]:
                        # by the triangle inequality of Jaccard's distance the two are no more than a third apart only then
                        if away - far <= 1 / 3 + 1e-9:
                            shared = len(np.intersect1d(mine, other, assume_unique=True))
                            if _linked(shared, len(mine) + len(other) - shared):
                                found.append((row, pivot))
                                continue
                        still.append((row, pivot, other, away))
                    open_[group] = still
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        part = stored(core.select("_group", "_set", "_same", "_all").mapInArrow(run, "a long, b long").distinct(), "ring-links")
        out = part if out is None else out.union(part)
        sent.destroy()
    return out


def _of_groups(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``groups`` (_group, ...), which are broadcast if they are few: then no hot group is shuffled."""
    few = groups.count() <= GROUPS_SENT
    return rows.join(F.broadcast(groups) if few else groups, "_group", how)


def _chosen_pivots(left: DataFrame, sizes: DataFrame, turn: int) -> DataFrame:
    """_group, _row and _set of the rows that are pivots: about PIVOTS of each group, chosen by hash, and its first row."""
    first = left.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_first"))
    chance = F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(1 << 30)) < F.lit(PIVOTS * (1 << 30)) / F.col("_n")
    return _of_groups(left, sizes.select("_group", "_n").join(first, "_group"), "inner").where(chance | (F.col("_row") == F.col("_first"))).select("_group", "_row", "_set")


def _unlike(pivots: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """Pivots of one group without those that are linked to an earlier one: they would settle the same sets again."""
    kept: list[tuple[int, np.ndarray]] = []
    for row, own in pivots:
        shared = [len(np.intersect1d(own, other, assume_unique=True)) for _, other in kept]
        if not any(_linked(s, len(own) + len(other) - s) for s, (_, other) in zip(shared, kept, strict=True)):
            kept.append((row, own))
    return kept


MEASURED = "_row long, _group long, doc_id long, _set array<long>, _pivot long, _same long, _all long"


def _measured(left: DataFrame, pivots: DataFrame) -> DataFrame:
    """Every row of ``left`` with each pivot of its group that it is close to (MEASURED), or with none. Pivots pass in blocks of bounded bytes, each broadcast, over the rows of their groups."""
    size = pivots.agg(F.sum(F.size("_set") * 8 + 32)).first()[0] or 0
    blocks, out = -(-size // RING_BYTES), None
    for b in range(blocks):
        own = F.pmod(F.xxhash64("_group"), F.lit(blocks)) == b
        held: dict[int, list[tuple]] = {}
        for r in pivots.where(own).orderBy("_row").toArrow().to_pylist():
            held.setdefault(r["_group"], []).append((r["_row"], np.sort(np.array(r["_set"], np.int64))))
        sent = left.sparkSession.sparkContext.broadcast({g: _unlike(some) for g, some in held.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found = [], []
                for i, (row, group, values) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_row", "_group", "_set")], strict=True)):
                    mine, before = np.sort(np.array(values, np.int64)), len(found)
                    for pivot, other in sent.value.get(group, []):
                        shared = len(mine) if pivot == row else len(np.intersect1d(mine, other, assume_unique=True))
                        every = len(mine) + len(other) - shared
                        if pivot == row or _close(shared, every):
                            found.append((pivot, shared, every))
                    if len(found) == before:
                        found.append((None, None, None))
                    at += [i] * (len(found) - before)
                same = batch.take(pa.array(at, pa.int64()))
                more = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*[same.column(c) for c in ("_row", "_group", "doc_id", "_set")], *more], ["_row", "_group", "doc_id", "_set", "_pivot", "_same", "_all"])

        part = stored(left.where(own).select("_row", "_group", "doc_id", "_set").mapInArrow(run, MEASURED), "measured")
        out = part if out is None else out.union(part)
        sent.destroy()
    return out


def _sizes(left: DataFrame) -> DataFrame:
    return cut(left.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("_set") * 8).alias("_bytes")))


def _split(left: DataFrame) -> DataFrame:
    """``left`` (_row, _group, doc_id, _set) with groups within the groups: linked sets share one of their ``_leading``
    members, from the rarest in the group on, so sets that no such member connects are not linked. Each row is linked to the
    first of those that lead with the same member, never to all."""
    each = left.select("_group", "_row", F.size("_set").alias("_size"), F.explode(F.when(F.size("_set") > 0, F.col("_set")).otherwise(F.array(F.lit(0).cast("long")))).alias("_x"))
    several = each.groupBy("_group", "_x").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    own = Window.partitionBy("_row")
    held = each.join(several, ["_group", "_x"]).withColumns({"_place": F.row_number().over(own.orderBy("_times", "_x")), "_held": F.count(F.lit(1)).over(own)})
    leading = stored(held.where("_place <= _held - (2 * _size + 2) div 3 + 1").select("_group", "_x", "_row"), "leading")
    first = leading.groupBy("_group", "_x").agg(F.min("_row").alias("b"))
    links = cut(leading.join(first, ["_group", "_x"]).where("_row <> b").select(F.col("_row").alias("a"), "b").distinct())
    found = smallest_reachable(left.select(F.col("_row").alias("node"), F.col("_row").alias("label")), links)
    return left.drop("_group").join(found.select(F.col("node").alias("_row"), F.col("label").alias("_group")), "_row").select("_row", "_group", "doc_id", "_set")


def _kept_of_large_groups(heavy: DataFrame) -> DataFrame:
    """_row of the rows that stay of candidate groups too large for one task, by exact rounds.

    Each round compares every set with about PIVOTS pivots of its group, which are broadcast. Sets of similarity 0.8 or
    more (a pivot's core) are linked to the pivot and settled: by the triangle inequality only sets that are close to
    the pivot (its ring) can be linked to one of them, and those, settled or not, are compared with the core. All that
    is in no core goes on; a group that has become small ends in one task. So a group of near copies, however large,
    ends after a round or two, and no link is lost. One of unlike sets would lose only its pivots each round, so what is
    left is split first (``_split``), after rounds 1, 2, 3, 5, 9 and so on.
    """
    n = partitions(heavy.sparkSession)
    sets = stored(_with_sets(heavy), "large-groups")
    left, links, turn = sets, None, 0
    sizes, large = _sizes(left), (F.col("_n") > GROUP_TEXTS) | (F.col("_bytes") > GROUP_BYTES)
    while True:
        measured = _measured(left, _chosen_pivots(left, sizes, turn))
        core = (F.col("_row") == F.col("_pivot")) | _linked(F.col("_same"), F.col("_all"))
        near = measured.where(core & (F.col("_row") != F.col("_pivot"))).select(F.col("_row").alias("a"), F.col("_pivot").alias("b"))
        by_pivot = measured.where("_pivot IS NOT NULL").withColumn("_group", F.col("_pivot"))
        ring = _ring_links(by_pivot.where(core), by_pivot.where(~core))
        state = measured.groupBy("_row").agg(F.coalesce(F.bool_or(core), F.lit(False)).alias("_settled"))
        left = stored(left.join(state.where("NOT _settled").select("_row"), "_row", "left_semi"), "left")
        now = _sizes(left)
        whole = now.where(large).select("_group")
        if not turn & (turn - 1) and not whole.isEmpty():
            parts = _split(_of_groups(left, whole, "left_semi"))
            left = stored(_of_groups(left, whole, "left_anti").select(*parts.columns).union(parts), "split")
            now = _sizes(left)
        small = _of_groups(left, now.where(~large).select("_group"), "left_semi").repartition(n, "_group").sortWithinPartitions("_group", F.col("doc_id").asc_nulls_last(), "_row")
        ended = small.select("_row", "_group", "_set").mapInArrow(_set_links, "a long, b long")
        for part in (near, ring, ended):
            links = part if links is None else links if part is None else links.union(part)
        sizes = cut(now.where(large).select("_group", "_n"))
        if sizes.isEmpty():
            break
        left, turn = _of_groups(left, sizes.select("_group"), "left_semi"), turn + 1
    nodes = sets.select(F.col("_row").alias("node"), F.col("_row").alias("label"), "doc_id")
    found = smallest_reachable(nodes.select("node", "label"), cut(links)).join(nodes.select("node", "doc_id"), "node")
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "node")))["node"]
    nameless = F.min(F.when(F.col("doc_id").isNull(), F.col("node")))
    return found.groupBy("label").agg(F.array_compact(F.array(named, nameless)).alias("_rows")).select(F.explode("_rows").alias("_row"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...): of each group of near copies the one with the smallest doc_id, and the
    first of those without doc_id.

    Texts whose sets of 5-word shingles have a similarity of 0.8 or more (twice the shared over those of both) are
    linked; a group is what links connect. Candidates share a band of least hashes and lie within WIDE bits of each other, found by vantage-point
    trees; what candidates connect is a candidate group, in which the shingle sets decide. A candidate group of
    bounded size is settled in one task, a larger one by ``_kept_of_large_groups``.

    Null texts count as empty; texts without words are copies of each other. Rows that repeat a doc_id are told
    apart. Other columns are kept, whatever their names; an empty table gives no rows.
    """
    n = partitions(docs.sparkSession)
    names = {c: c if c in ("doc_id", "text") else f"x{i}" for i, c in enumerate(docs.columns)}
    keyed = stored(signatures(docs.toDF(*names.values())).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_row")))["_row"]
    nameless = F.min(F.when(F.col("doc_id").isNull(), F.col("_row")))
    nodes = cut(keyed.groupBy("_node", "_fp", "_bands").agg(F.array_compact(F.array(named, nameless)).alias("_rows")))
    links = cut(_candidate_links(nodes))
    linked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    groups = smallest_reachable(linked.withColumn("label", F.col("node")), links).select(F.col("node").alias("_node"), F.col("label").alias("_group"))
    first = stored(nodes.join(groups, "_node", "left").select(F.explode("_rows").alias("_row"), "_group"), "first-rows")
    # the first rows grow with the documents, so both sides are always dealt out, small inputs too
    rows = stored(keyed.drop("_node", "_fp", "_bands").join(first.hint("shuffle_merge"), "_row"), "distinct-rows")
    discard(keyed)
    sizes = rows.where("_group IS NOT NULL").groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("text")).alias("_bytes"))
    large = cut(sizes.where((F.col("_n") > GROUP_TEXTS) | (F.col("_bytes") > GROUP_BYTES)).select("_group"))
    close, out = rows.where("_group IS NOT NULL"), rows.where("_group IS NULL")
    if not large.isEmpty():
        heavy = close.join(large, "_group", "left_semi").select(*rows.columns)
        out = out.union(heavy.join(stored(_kept_of_large_groups(heavy), "kept"), "_row", "left_semi").select(*rows.columns))
        close = close.join(large, "_group", "left_anti").select(*rows.columns)
    close = close.repartition(n, "_group").sortWithinPartitions("_group", F.col("doc_id").asc_nulls_last(), "_row")
    return out.union(close.mapInArrow(_first_rows, rows.schema)).select(*[F.col(x).alias(c) for c, x in names.items()])
