"""Fingerprints and links against brute force."""

import re

import numpy as np
import pytest
import xxhash

from veilscan.llm import components, neardup
from veilscan.llm.components import smallest_reachable


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints, radius=4):
    ids = sorted(fingerprints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs, texts):
    fingerprints = {d: plain_fingerprint(t) for d, t in texts.items()}
    wanted = plain_components(fingerprints)
    found = neardup.near_duplicates(docs).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in found} == fingerprints
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "One TWO"), (8, "one two"), (None, "one two"), (None, "alone here"), (9, "One TWO"), (7, "é\u0085x É")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    found = sorted(map(tuple, neardup.near_duplicates(frame).collect()), key=repr)
    two, alone, last = (f"{plain_fingerprint(t):016x}" for t in ("one two", "alone here", "é\u0085x É"))
    zero = "0" * 16
    assert found == sorted([(5, zero, 3), (3, zero, 3), (4, zero, 3), (9, two, 8), (9, two, 8), (8, two, 8), (None, two, 8), (None, alone, None), (7, last, 7)], key=repr)
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def clustered(seed, bases, each, flips):
    rng = np.random.default_rng(seed)
    out = set()
    for base in rng.integers(0, 2**63, bases, dtype=np.uint64).tolist():
        for _ in range(each):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, flips)).tolist():
                x ^= 1 << bit
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("most", [8192, 15])
def test_links_of_clusters(spark, most):
    """With small shards the distributed tree is used; no link may be lost either way."""
    values = clustered(3, 8, 60, 9)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = neardup.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, most)
    nodes = spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "node long, label long")
    index = {v: i for i, v in enumerate(signed)}
    found = {index[r["node"]]: r["label"] for r in smallest_reachable(nodes, links).collect()}
    assert found == plain_components(dict(enumerate(values)))


@pytest.mark.parametrize("flips", [2, 6, 40])
def test_tree_equals_brute_force(flips):
    values = clustered(5, 3, 200, flips)
    roots = neardup.tree_links(np.array(values, np.uint64), np.ones(len(values), bool), 4)
    assert dict(enumerate(roots.tolist())) == plain_components(dict(enumerate(values)))


def test_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(i, (i * 17) % 41) for i in range(n)], "node long, label long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 20], "a long, b long")
    found = {r["node"]: r["label"] for r in smallest_reachable(nodes, edges).collect()}
    low, high = (min((i * 17) % 41 for i in part) for part in (range(21), range(21, n)))
    assert found == {i: low if i <= 20 else high for i in range(n)}


def test_edges_inside_a_group_are_taken_up_once(spark, monkeypatch):
    """Many links between the members of a large group, and a chain that needs rounds: merged nodes leave no edges."""
    rng = np.random.default_rng(4)
    pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, 200, 4000), rng.integers(0, 200, 4000), strict=True) if a > b}
    order = rng.permutation(60).tolist()
    pairs |= {(1000 + a, 1000 + b) for a, b in zip(order, order[1:], strict=False)} | {(1000, 1000)}
    sizes, keep = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: sizes.append(keep(df).count()) or keep(df) if df.columns == ["a", "b"] else keep(df))
    nodes = spark.createDataFrame([(n, 5000 - n) for n in [*range(200), *range(1000, 1060), 4000]], "node long, label long")
    found = {r["node"]: r["label"] for r in smallest_reachable(nodes, spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert found == {n: 4801 if n < 200 else 3941 if n < 1060 else 1000 for n in [*range(200), *range(1000, 1060), 4000]}
    assert sizes[-1] == 0 and sum(sizes) < 1.1 * len(pairs)


def test_linked_rows_without_or_with_repeated_ids(spark, monkeypatch):
    """Fingerprints that share a label (no doc_id, or a repeated one) stay in their own components."""
    names = "abcdefghi"
    value = dict(zip(names, (0x0, 0x1, 0xFF00, 0xFF01, 0xFF0000, 0xFF0001, 0xFF000000, 0xFF000001, 0xFF00000000), strict=True))
    rows = [(3, "a"), (None, "b"), (None, "c"), (None, "d"), (7, "e"), (None, "f"), (9, "g"), (9, "h"), (9, "i"), (8, "i")]
    known = spark.createDataFrame([(t, v) for t, v in value.items()], "text string, fp long")
    monkeypatch.setattr(neardup, "fingerprints", lambda docs, words: docs.join(known, "text").select("doc_id", "fp"))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    group = {"a": 3, "b": 3, "c": None, "d": None, "e": 7, "f": 7, "g": 9, "h": 9, "i": 8}
    assert sorted(map(tuple, found), key=repr) == sorted([(d, f"{value[t]:016x}", group[t]) for d, t in rows], key=repr)


def test_trees_prune_shards():
    """Unrelated fingerprints in one shard: most pairs are never compared, and copies with few flips are found."""
    values = clustered(11, 2000, 2, 4)
    compared = []
    roots = neardup.tree_links(np.array(values, np.uint64), np.ones(len(values), bool), 4, compared)
    assert dict(enumerate(roots.tolist())) == plain_components(dict(enumerate(values)))
    assert sum(compared) < 0.6 * len(values) ** 2


@pytest.mark.parametrize("n", [10, 5000, 10**6, 10**9, 10**12])
def test_blocks_lose_no_link(n):
    """Any four bits may differ: enough blocks are left on which two fingerprints agree."""
    blocks, equal = neardup._blocks(n, 4)
    assert len(blocks) == 4 + equal and all(0 <= width for _, width in blocks)
    assert all(a + width <= b for (a, width), (b, _) in zip(blocks, blocks[1:], strict=False)) and sum(blocks[-1]) <= 64
