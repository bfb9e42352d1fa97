"""BPE, sharding and packing against brute force and the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from veilscan.llm import bpe, packing, sharding

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "1", "²", "é", "日本", "!", "\u0085", "\x1c", " ", "😀", "ß", "İ", "‍", "the", "Ⅷ", "़", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return [*texts, "", " ", "  ", "a" * 5000, " " * 3000, "ab" * 3000, "日本語" * 2000, "x " * 500 + "  y", "\n a", " a ", "a\n b"]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_encoder_equals_the_libraries(encoding, texts):
    vocabulary, encoder = bpe.loaded(PATH, P.PATTERN)
    every = [*odd_texts(), *texts.values()]
    got = encoder.encode(every)
    assert got == [packed(encoding.encode_ordinary(t)) for t in every]
    assert [vocabulary.decode(g) for g in got] == [t.encode() for t in every]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    assert got == [packed(e.ids) for e in tokenizer.encode_batch(every, add_special_tokens=False)]


def test_packed_ids_equal_the_tokenizer_as_it_comes(texts):
    """With its defaults ``tokenizers`` matches the file's added token in a text; so must packing."""
    every = [*odd_texts(), *texts.values(), "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext|>\n"]
    parts = packing._loaded(PATH, P.PATTERN, packing.added_tokens(P.path("byte_bpe_50k.json")))
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [parts.ids(t) for t in every] == [packed(e.ids) for e in tokenizer.encode_batch(every, add_special_tokens=False)]


def test_matrix_and_heap_agree(monkeypatch):
    vocabulary = bpe.Vocabulary.load(PATH)
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcdethin ") for _ in range(rng.randint(1, 120))) for _ in range(500)]
    matrix = vocabulary.encode(pieces)
    assert matrix == [vocabulary._long(p) if p not in vocabulary.ranks else packed([vocabulary.ranks[p]]) for p in pieces]


def test_bpe_rows(spark, encoding):
    rows = [(1, None), (2, ""), (2, ""), (None, "hello world"), (3, "x" * 100_000)]
    found = bpe.encode_documents(spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, ids string"), PATH, P.PATTERN).collect()
    want = []
    for doc_id, text in rows:
        ids = encoding.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(empty, PATH, P.PATTERN).count() == 0


def test_sharding(spark, docs, texts):
    found = sharding.shard_documents(docs, 7).collect()
    assert len(found) == len(texts)
    total = sum(r["size"] for r in found)
    for s in range(7):
        own = [r for r in found if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 7) <= max(r["size"] for r in found)
    order = [r["doc_id"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)


def test_sharding_of_ties(spark):
    rows = [(None, None)] * 30 + [(7, "same")] * 300 + [(8, "")] * 5
    found = sharding.shard_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int"), 5).collect()
    assert len(found) == 335
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(5)]
    assert max(sizes) - min(sizes) <= 40
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 5).count() == 0


def check_packing(found, wanted, length):
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == wanted.keys()
    for doc_id, ids in wanted.items():
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == length for r in own[1:]) and (len(ids) > length) == (len(own) > 1)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(packed(ids[at : at + r["length"]]))
            at += r["length"]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_sequence)


def test_packing(spark, docs, texts, encoding):
    wanted = {d: [*encoding.encode_ordinary(t), 0] for d, t in texts.items()}
    n = check_packing(packing.pack_documents(docs, PATH, P.PATTERN, 2048).collect(), wanted, 2048)
    assert n <= 1.03 * -(-sum(map(len, wanted.values())) // 2048)
    rows = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b c " * 50, 9)], "doc_id long, text string, length int")
    small = {1: [0], 2: [0], 3: [*encoding.encode_ordinary("a b c " * 50), 0]}
    check_packing(packing.pack_documents(rows, PATH, P.PATTERN, 16).collect(), small, 16)
    assert packing.pack_documents(rows.limit(0), PATH, P.PATTERN).count() == 0
    kept = packing.pack_documents(rows, PATH, P.PATTERN, 16, keep_ids=True).orderBy("doc_id", "piece").collect()
    assert b"".join(r["ids"] for r in kept if r["doc_id"] == 3) == packed(small[3])


def test_plans_place_every_piece():
    rng = random.Random(4)
    for length in (8, 40, 500):
        counts = {}
        for _ in range(2000):
            size = min(length, int(rng.expovariate(4 / length)) + 1)
            counts[size] = counts.get(size, 0) + rng.choice((1, 1, 50))
        patterns = packing.plan_patterns(counts, length)
        assert any(len(p) > 2 and sum(p) == length for p, _ in patterns)
        placed = {}
        for pattern, times in patterns:
            assert times > 0 and sum(pattern) <= length
            for size in pattern:
                placed[size] = placed.get(size, 0) + times
        assert placed == counts
        total = sum(a * b for a, b in counts.items())
        assert sum(t for _, t in patterns) <= 1.02 * total / length + 1
