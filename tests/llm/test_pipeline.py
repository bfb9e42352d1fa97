"""The pipeline: every stage on what the one before kept."""

import random

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from veilscan.llm import neardup
from veilscan.llm.common import stored
from veilscan.llm.pii import find_pii


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert (docs.count() < before) == (name != "personal_data")
        before = docs.count()
    assert find_pii(docs).where("size(pii) > 0").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before


def test_deduplication_of_odd_rows(spark):
    rows = [(1, "same text here", "en", "s", 1), (1, "same text here", "en", "s", 1), (2, "same text here", "en", "s", 1), (None, "same text here", "en", "s", 1), (None, "other", "en", "s", 1), (3, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.deduplicate(spark, docs, "")
    assert sorted([tuple(r)[:2] for r in kept.collect()], key=repr) == sorted([(1, "same text here"), (None, "same text here"), (None, "other"), (3, None)], key=repr)


def near_copies(seed):
    """Texts of 60 to 400 words with copies whose words are changed here and there."""
    rng = random.Random(seed)
    texts = []
    for base in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for share in (0, 0, 0.003, 0.006, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.06):
            texts.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("most", "shard"), [(4000, 16384), (3, 16384), (4000, 4)])
def test_near_copies_against_brute_force(spark, monkeypatch, most, shard):
    """With small bounds candidate groups are settled by rounds of pivots, and shards of a band are linked by joins:
    neither may lose a link."""
    monkeypatch.setattr(neardup, "GROUP_TEXTS", most)
    monkeypatch.setattr(neardup, "SHARD_MOST", shard)
    monkeypatch.setattr(neardup, "RING_BYTES", 40_000)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    texts = near_copies(8)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * 2 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.deduplicate(spark, docs, "").collect()) == sorted(set(root))


def test_unlike_texts_with_a_common_passage_need_few_rounds(spark, monkeypatch):
    """They are candidates of each other by the passage, so their group grows with the input; it must not lose a few
    texts each round, whether it fits a task (4,100 texts) or not."""
    rng, rounds, chosen = random.Random(3), [], neardup._chosen_pivots
    monkeypatch.setattr(neardup, "_chosen_pivots", lambda *a: rounds.append(1) or chosen(*a))
    passage = [f"p{i}" for i in range(32)]

    def texts(n, least, most):
        words = lambda: [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(least, most))]
        return [" ".join([*words(), *passage, *words()]) for _ in range(n)]

    def same(some):
        kept = neardup.distinct_documents(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"))
        return {r["doc_id"] for r in kept.collect()} == set(neardup.groups_of_sets([neardup.shingle_set(t) for t in some]).tolist())

    assert same(texts(4100, 4, 9)) and not rounds
    monkeypatch.setattr(neardup, "GROUP_TEXTS", 100)
    monkeypatch.setattr(neardup, "PIVOTS", 8)
    assert same(texts(400, 9, 16)) and 1 <= len(rounds) <= 2


def test_recall_of_copies_with_changed_words(spark):
    """Copies with 3 % of their words changed (similarity 0.86 on average) go with their originals, other texts stay."""
    rng = random.Random(12)
    originals = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 400))] for _ in range(60)]
    copies = [[f"x{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in words] for words in originals for _ in range(4)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(originals + copies)], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.deduplicate(spark, docs, "").collect()}
    assert set(range(60)) <= kept and len(kept) - 60 <= 0.1 * len(copies)


def test_deduplication_decides_per_row(spark):
    """Texts that repeat a doc_id are told apart, and rows without doc_id are copies of each other."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    rows = [(3, a), (5, f"{a} more"), (5, b), (6, c), (6, b), (None, d), (None, d), (None, f"{d} more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = corpus_pipeline.deduplicate(spark, docs, "").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(3, a), (5, b), (6, c), (None, d)], key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_every_stage(spark, name):
    """Nulls, empty and repeated rows, an empty table and columns whose names operators use inside."""
    stage, sf = dict(corpus_pipeline.STAGES)[name], "/root/testdata/sf0.001"
    good = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").first()["text"]
    rows = [(None, None, None), (1, "", 0), (2, good, len(good)), (2, good, len(good)), (3, None, None), (4, "write to a@b.example now", 24)]
    clash = ["_score", "_pii", "_text", "_email", "_row", "_node", "_fp", "_group", "row", "ids", "length", "lang", "source"]
    docs = spark.createDataFrame([(*r, *[f"{i}"] * len(clash)) for i, r in enumerate(rows)], "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    out = stage(spark, docs, sf)
    assert stage(spark, docs.limit(0), sf).count() == 0
    found = out.collect()
    if name == "packing":
        assert sorted([r["doc_id"] for r in found if r["piece"] == 0], key=repr) == sorted([r[0] for r in rows], key=repr)
        assert all(len(r["ids"]) == 4 * r["length"] for r in found)
        return
    assert out.columns == docs.columns and {r["_row"] for r in found} <= set("012345")
    if name == "personal_data":
        assert len(found) == 6 and [r["text"] for r in found if r["doc_id"] == 4] == ["write to [EMAIL] now"]
        assert all(r["text"] == rows[int(r["_row"])][1] for r in found if r["doc_id"] != 4)
    if name == "near_duplicates":
        assert sorted([r["doc_id"] for r in found], key=repr) == sorted([None, 1, 2, 4], key=repr)


def test_packed_ids_are_those_of_the_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found, texts = corpus_pipeline.pack(spark, docs, "").collect(), {r["doc_id"]: r["text"] for r in docs.collect()}
    tokenizer, by_doc = Tokenizer.from_file(public.path("byte_bpe_50k.json")), {}
    for r in sorted(found, key=lambda r: r["piece"]):
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], []) + np.frombuffer(r["ids"], "<u4").tolist()
    assert by_doc == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
