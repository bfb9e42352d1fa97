"""Search, licenses, fingerprints, personal data and quality against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.oracle import rows_of_spark, rows_of_sql
from veilscan.llm import fingerprints, licenses, pii, quality, search
from veilscan.llm.common import stored
from veilscan.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    assert rows_of_spark(QUERIES[name](spark, small)) == rows_of_sql(SQL[name], small)


def plain_top(rows, k, every):
    """``rows``: (vec_id, vector); rows that repeat an id are queries and candidates of their own, and only vectors
    of one length meet."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q % every == 0:
            scored = sorted((-int(np.dot(v, w)), c) for j, (c, w) in enumerate(rows) if i != j and len(v) == len(w))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


def test_top_k_with_ties_and_gaps(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.floor(256 * rng.integers(-2, 3, 6) / 8.0)) for i in range(300)]
    rows += [(5, rows[5][1]), (50, rows[50][1]), (50, rows[7][1]), (1150, np.array([256.0]))]  # repeated ids, another length
    rows += [(2000 + i, rows[100][1]) for i in range(40)]  # more copies than k
    short = [(i, np.array([64.0, -128.0])) for i in (3000, 3001, 3050)]
    frame = [(i, [float(x) / 256 for x in v], "x") for i, v in rows + short]
    frame += [(1000, None, "x"), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (1100, [float("nan")] * 6, "x"), (1101, [float("inf")] * 6, "x"), (1200, [], "x"), (None, [1.0] * 6, "x")]
    table = spark.createDataFrame(frame, "vec_id long, embedding array<float>, score string")
    for block in (8192, 3):
        assert sorted(map(tuple, search.top_k(table, "vec_id % 50 = 0", 5, block=block).collect())) == plain_top(rows + short, 5, 50)
    assert sorted(map(tuple, search.top_k(table.where("vec_id < 2"), "vec_id % 50 = 0", 5).collect())) == plain_top(rows[:2], 5, 50)
    assert search.top_k(table.limit(0), "vec_id % 50 = 0").count() == 0
    assert search.top_k(table.where("vec_id = 1000"), "vec_id % 50 = 0").count() == 0
    assert search.top_k(table.where("vec_id = 7"), "vec_id % 50 = 0").count() == 0


def test_one_odd_length_changes_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, np.floor(256 * rng.normal(0, 0.3, 8))) for i in range(200)]
    frame = [(i, [float(x) / 256 for x in v]) for i, v in rows]
    table, more = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (frame, [*frame, (777, [1.0] * 9)]))
    assert sorted(map(tuple, search.top_k(more, "vec_id % 50 = 0").collect())) == sorted(map(tuple, search.top_k(table, "vec_id % 50 = 0").collect())) == plain_top(rows, 5, 50)


def test_few_vectors_are_read_in_full(spark):
    """Of the driver's embeddings the cells leave a few candidates per query; the other vectors are not read for it."""
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    exact = stored(search.integral(vectors.select("vec_id", "embedding")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    bounds = search.fitted(exact)
    n, found = exact.count(), search.candidates(search.cell_file(exact, bounds), exact, "vec_id % 50 = 0", bounds, 5)
    assert found.count() < 0.05 * n * exact.where("vec_id % 50 = 0").count()


def test_an_outlier_widens_few_cells(spark):
    """One component of one vector is far away; candidates stay below twice those without it."""
    rng = np.random.default_rng(8)
    rows = rng.normal(0, 0.3, (2000, 16))
    counts = []
    for k in range(2):
        rows[3, 2] = rows[3, 2] if k == 0 else 50.0
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        exact = stored(search.integral(frame).withColumn("row", F.monotonically_increasing_id()), "vectors")
        bounds = search.fitted(exact)
        counts.append(search.candidates(search.cell_file(exact, bounds), exact, "vec_id % 50 = 0", bounds, 5).count())
        plain = [(i, np.floor(256 * v)) for i, v in enumerate(rows)]
        assert sorted(map(tuple, search.top_k(frame, "vec_id % 50 = 0").collect())) == plain_top(plain, 5, 50)
    assert counts[1] < 2 * counts[0] < 0.1 * 40 * 2000


def plain_places(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def check_licenses(found, texts):
    for r in found:
        n, places = plain_places(texts[r["doc_id"]])
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        base = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(",")) | set() and 0 <= r["score"] <= 1


def test_licenses(spark, docs, texts):
    found = licenses.license_report(docs).collect()
    assert len(found) == len(texts)
    check_licenses(found, texts)
    bsd, mit = licenses.NOTICES["bsd"], licenses.NOTICES["mit"]
    odd = {0: None, 1: "", 2: "mit", 3: "MIT License mit license", 4: "gnu general public license gnu general public gnu general public license", 5: "cc-by CC BY", 6: f"x {mit.replace('copy', 'copies')} y", 7: "Kelvin İ mit\tlicense", 8: "cc by " * 3000, 9: f"{bsd} {licenses.NOTICES['lgpl']}"}
    frame = spark.createDataFrame([*[(k, v, 1) for k, v in odd.items()], (3, odd[3], 1)], "doc_id long, text string, label int")
    found = licenses.license_report(frame).collect()
    assert len(found) == 11
    check_licenses(found, odd)
    labels = {r["doc_id"]: r["labels"] for r in found}
    assert labels[6] == "mit" and labels[9] == "bsd,lgpl" and labels[0] == ""
    assert licenses.license_report(frame.limit(0)).count() == 0


def plain_digests(text):
    return set(re.findall(r"[^\n]{1,200}", text))


def plain_likeness(a, b):
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def check_versions(found, texts):
    order = sorted(texts, reverse=True)
    after = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    for r in found:
        text, following = texts[r["doc_id"]] or "", texts[after[r["doc_id"]]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = map(plain_digests, (text, edited, following))
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(plain_likeness(a, b)) and r["near_next"] == pytest.approx(plain_likeness(a, c))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (a == b)


def test_fingerprints(spark, docs, texts):
    found = fingerprints.version_report(docs).collect()
    assert len(found) == len(texts)
    check_versions(found, texts)
    odd = {1: None, 2: "", 3: "a\nb\nc", 7: "😀" * 1001, 8: "a\nb\nc", 9: "x\n" * 3000, 10: "\n".join(map(str, range(2000)))}
    frame = spark.createDataFrame([*[(k, v, 1) for k, v in odd.items()], (3, odd[3], 1), (3, odd[3], 1)], "doc_id long, text string, n_chars int")
    found = fingerprints.version_report(frame).collect()
    assert len(found) == 9
    check_versions(found, odd)
    assert fingerprints.version_report(frame.limit(0)).count() == 0
    assert fingerprints.version_report(frame.where("doc_id = 7")).first()["near_next"] == 1.0


def sketch_of(digests, third):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return fingerprints.sketches(spark.createDataFrame([(1, digests, third)], "k int, digests array<long>, third int"), "k")


@pytest.mark.parametrize(("third", "differ", "ok"), [(8, 170, False), (8, 5, True), (200, 170, True)])
def test_sketches_are_subtracted_and_peeled(spark, third, differ, ok):
    rng = random.Random(third)
    shared, own = ([rng.randrange(-(2**63), 2**63) for _ in range(n)] for n in (100, differ))
    a, b = sketch_of(shared + own[: differ // 3], third), sketch_of(shared + own[differ // 3 :], third)
    minus = b.withColumn("n", -F.col("n"))
    row = fingerprints.peeled(fingerprints._summed(a.union(minus), "k", "third"), "k").first()
    assert row["ok"] == ok and (row["found"] == differ or not ok)
    same = fingerprints._summed(a.union(a.withColumn("n", -F.col("n"))), "k", "third")
    assert same.isEmpty()


def test_shown_fingerprints_decode_by_themselves(spark):
    """The difference of two shown fingerprints, peeled by hand without the texts."""
    lines = [f"line {i}" for i in range(50)]
    texts = {2: "\n".join(lines), 1: "\n".join([*lines[:49], "another"])}
    rows = fingerprints.version_report(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    told = {}
    for r in rows:
        cells = [c.split(":") for c in r["fingerprint"].split(".")]
        told[r["doc_id"]] = {int(i): (int(n), int(d, 16), int(c, 16)) for i, n, d, c in cells}
    empty = (0, 0, 0)
    cells = [(p[0] - q[0], p[1] ^ q[1], p[2] ^ q[2]) for p, q in ((told[2].get(i, empty), told[1].get(i, empty)) for i in range(3 * fingerprints.FIRST))]
    want = spark.createDataFrame([("line 49",), ("another",)], "t string").select(F.xxhash64("t").alias("d"), F.xxhash64(F.xxhash64("t"), F.lit(7)).alias("c")).collect()
    assert {(n, d, c) for n, d, c in cells if abs(n) == 1} <= {(s, r["d"] % 2**64, r["c"] % 2**64) for r, s in zip(want, (1, -1), strict=True)}
    assert sum(abs(n) for n, _, _ in cells) in (2, 4, 6) and {r["near_next"] for r in rows} == {1 - 2 / 100}


def test_work_follows_the_digests(spark):
    """A text of 20,000 short lines against another one: no term grows with the square of its lines."""
    import time

    rows = [(1, "\n".join(f"a{i}" for i in range(20_000))), (2, "\n".join(f"b{i}" for i in range(20_000)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    check_versions(fingerprints.version_report(frame).collect(), dict(rows))
    assert time.time() - began < 60


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check_pii(found, texts):
    for r in found:
        spans = plain_spans(texts[r["doc_id"]])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), (texts[r["doc_id"]], r["spans"])
        assert all(r[f"n_{k}"] == sum(s[0] == k for s in spans) for k, _ in BASE)
        assert set(told.split(",")) - {""} <= set(r["spans"].split(","))


def test_pii(spark, docs, texts):
    check_pii(pii.pii_report(docs).collect(), texts)
    rng = random.Random(5)
    parts = [*"ab.@_-+%0123456789 ().", "é", "😀", "4111111111111111", "a@b.c", "1.2.3.4", "+1 (555) 555-2222 9", "GB82 WEST 1234 5698 7654 32", "iban", "ssn 123-45-6789", "256.1.1.1", "0012.1.2.255"]
    odd = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for i in range(1500)}
    odd |= {9000: None, 9001: "", 9002: "1 " * 5000, 9006: "4111111111111111 x " * 500, 9007: "+1" * 5000}
    frame = spark.createDataFrame([(k, v, 1) for k, v in odd.items()], "doc_id long, text string, pii int")
    found = pii.pii_report(frame).collect()
    assert len(found) == len(odd)
    check_pii(found, odd)
    assert pii.pii_report(frame.limit(0)).count() == 0


def test_long_runs_end(spark):
    """Texts on which a pattern that tries every start would take hours."""
    rows = [(1, "1" * 300_000), (2, "a.b" * 100_000 + "@"), (3, "+1" + " " * 300_000), (4, "1.2." * 50_000), (5, "A" * 300_000)]
    assert {r["spans"] for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id <> 4").collect()} == {""}


def test_many_matches_in_one_text(spark):
    """Work follows the matches: ten times as many take about ten times as long, not a hundred times."""
    import time

    def text(n):
        return "".join(f"{i % 256}.{i // 256 % 256}.1.2 " for i in range(n))

    times = []
    for n in (5_000, 50_000):
        began = time.time()
        frame = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        row = pii.find_pii(frame).select(F.size("pii").alias("n"), pii.redact(F.col("text"), F.col("pii")).alias("clean"), F.col("pii")[n - 1]["end"].alias("end")).first()
        assert row["n"] == n and row["clean"] == "[IP] " * n and row["end"] == len(text(n)) - 1
        times.append(time.time() - began)
    assert times[1] < 10 + 12 * times[0]
    texts = {4: "1.2." * 50_000, 5: "1.2." * 2_000}  # plain patterns take the square of such a run
    rows = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    check_pii([rows[5]], texts)
    assert rows[4]["n_ip"] == 25_000 and rows[4]["spans"].endswith("ip:199992:199999")


def test_more_kinds_and_redaction(spark):
    text = "iban GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32; ssn 123-45-6789; id 987-65-4321; write to a@b.example or +1 555 555 2222 today"
    found = pii.find_pii(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, score string"))
    row = found.select("score", "pii", pii.redact(F.col("text"), F.col("pii")).alias("clean")).first()
    assert [(s["kind"], s["text"]) for s in row["pii"]] == [("email", "a@b.example"), ("phone", "+1 555 555 2222"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert row["clean"] == "iban [IBAN], not GB83 WEST 1234 5698 7654 32; ssn [SSN]; id 987-65-4321; write to [EMAIL] or [PHONE] today"


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_report(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r["predicted"] == known[r["doc_id"]] for r in found if r["held_out"] and r["doc_id"] in known]
    assert sum(held) / len(held) >= 0.95
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "\n\n", 1), (3, "a\n" * 5000, 1)], "doc_id long, text string, score int").drop("score")
    assert quality.quality_report(odd, labels.limit(0)).count() == 4
    assert quality.quality_report(odd.limit(0), labels).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 4, 2, 6])
    evidence, stay = rng.normal(0, 2, sizes.sum()), 0.8
    good, log_z, equal = quality.marginals(evidence, stay, sizes)
    at = 0
    for k, n in enumerate(sizes.tolist()):
        own = evidence[at : at + n]
        states = np.array([[s >> i & 1 for i in range(n)] for s in range(1 << n)])
        same = (states[:, 1:] == states[:, :-1]).sum(axis=1)
        weight = np.exp(states @ own + stay * same)
        assert np.allclose(good[at : at + n], (weight @ states) / weight.sum())
        assert np.isclose(log_z[k], np.log(weight.sum())) and np.isclose(equal[k], weight @ same / weight.sum() if n > 1 else 0)
        at += n


def test_sample_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    assert quality.train(docs, labels, sample=5, chars=500).weight.shape == (3 * quality.N_FEATURES + 1,)


def test_ibans_before_upper_case_words_and_numbers(spark):
    texts = {
        "IBAN DE89370400440532013000 BIC COBADEFFXXX": ["DE89370400440532013000"],
        "GB82 WEST 1234 5698 7654 32 EUR 500": ["GB82 WEST 1234 5698 7654 32"],
        "é😀 NO93 8601 1117 947 2024 BE68 5390 0754 7034 AND NL91ABNA0417164300": ["NO93 8601 1117 947", "BE68 5390 0754 7034", "NL91ABNA0417164300"],
        "FI12 34 DE89 3704 0044 0532 0130 00 OK": ["DE89 3704 0044 0532 0130 00"],
        "AB12 ORDER MT84MALT011000012345MTLCAST001S NOW": ["MT84MALT011000012345MTLCAST001S"],
        "GB83 WEST 1234 5698 7654 32 EUR and DE89370400440532013000X": [],
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.find_pii(frame).withColumn("clean", pii.redact(F.col("text"), F.col("pii"))).collect()
    for r in rows:
        spans = [s for s in r["pii"] if s["kind"] == "iban"]
        assert [s["text"] for s in spans] == texts[r["text"]] and [r["text"][s["start"] : s["end"]] for s in spans] == texts[r["text"]]
        assert not any(t in r["clean"] for t in texts[r["text"]])


def test_context_words_are_whole_words_and_columns_stay(spark):
    texts = {"the hotel sent 123-45-6789 by the bassnet": "", "SSN: 123-45-6789": "ssn", "his ssns 123-45-6789": "ssn", "assn 123-45-6789": "", "Social Security no 123-45-6789": "ssn"}
    frame = spark.createDataFrame([(i, t, "kept", f"e{i}", i) for i, t in enumerate(texts)], "doc_id long, text string, _text string, _email string, _ssn int")
    found = pii.find_pii(frame)
    assert found.columns == [*frame.columns, "pii"]
    for r in found.collect():
        assert ",".join(s["kind"] for s in r["pii"]) == texts[r["text"]]
        assert (r["_text"], r["_email"], r["_ssn"]) == ("kept", f"e{r['doc_id']}", r["doc_id"])
    scores = {r["text"]: r["pii"][0]["score"] for r in pii.find_pii(spark.createDataFrame([("ship 1.2.3.4",), ("ip 1.2.3.4",), ("the hosts: 1.2.3.4",)], "text string")).collect()}
    assert scores["ship 1.2.3.4"] < scores["ip 1.2.3.4"] == scores["the hosts: 1.2.3.4"]
