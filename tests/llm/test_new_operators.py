"""Lexical search, url filters and conversation repair against brute force, and their odd cases."""

import hashlib
import itertools
import math
import random
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilscan.llm import lexical, repair, urls

# ranked lexical search


def plain_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c >= "\x80" or c in "0123456789" or "A" <= c <= "Z" or "a" <= c <= "z":
            word += c.lower() if c < "\x80" else c
        elif word:
            out, word = [*out, word], ""
    return out


def plain_search(docs, items, k=20):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(plain_terms(text)), []
        for d, c, n in counted:
            m = 75 + (25 * n * n_docs) // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return out


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block", [lexical.BLOCK, 200])
def test_search_equals_brute_force(spark, block):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["Übung", "É", "A1", "x_y", "日本", "don't"]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(2, 66)]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(None, "w1 w2 w3"), (None, None), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (500, ""), (501, "\x7f;;--\n"), (502, "w5 " * 3000 + "rare")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(25)] + [(3, "w1 W1 w2"), (None, "rare"), (90, None), (91, "nowhere")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, rank int")
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = lexical.search(lexical.build_index(frame.repartition(3)), asked, k=20, block=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(map(tuple, found.collect())) == ordered(plain_search(docs, items))


def test_shards_of_a_task_are_held_one_by_one(spark, monkeypatch):
    """What a task holds must not grow with its shards: each is a row group, and is sent to Python alone."""
    name, seen, keep = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, lexical.stored
    monkeypatch.setattr(lexical, "stored", lambda df, label, **more: seen.update({label: spark.conf.get(name)}) or keep(df, label, **more))
    before = spark.conf.get(name)
    docs = spark.range(20).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 150000) AS text").coalesce(1)
    rows = lexical.build_index(docs).rows
    (file,) = [urllib.parse.urlparse(f).path for f in rows.inputFiles()]
    groups = pq.ParquetFile(file).metadata
    assert groups.num_row_groups == groups.num_rows > 2
    assert seen["treaps"] == "1" and spark.conf.get(name) == before


def test_search_in_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert lexical.build_index(docs.limit(0)) is None and lexical.build_index(docs.where("doc_id = 2")) is None
    assert lexical.search(None, items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(lexical.build_index(docs), items).collect()] == [(1, 1, 1)]


def test_narrow_frontiers_give_the_same(monkeypatch):
    """A frontier that opens few cells at once, and the smallest ranges first where it is wide."""
    rng = random.Random(2)
    texts = [" ".join(f"t{int(rng.paretovariate(0.7)) % 500}" for _ in range(50)).encode() + b" " for _ in range(300)]
    grid = lexical._record(list(range(300)), texts)
    row = lexical._treap(300, grid["terms"])(iter([lexical._batch([grid], lexical.GRID)]))
    treap = lexical.Treap(next(row).to_pylist()[0])
    rows, weights = np.arange(40), np.arange(40, 0, -1) * 100
    want = None
    for opened, wide in ((1 << 14, 1 << 23), (40, 1 << 23), (40, 1)):
        monkeypatch.setattr(lexical, "OPENED", opened)
        monkeypatch.setattr(lexical, "WIDE", wide)
        scores, columns = treap.search(rows, weights, 10, 1)
        got = sorted(zip((-scores).tolist(), columns.tolist(), strict=True))[:10]
        want = want or got
        assert got == want
    heavy, columns = treap.search(rows, weights * 10**7, 10, 1)  # beyond what doubles hold exactly
    assert sorted(zip((-heavy).tolist(), columns.tolist(), strict=True))[:10] == [(s * 10**7, c) for s, c in want]


# url filters


def plain_verdict(url, rules, default):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    *_, rule, verdict = max(fits) if fits else (0, 0, None, default)
    return host, path, rule, verdict


def test_urls_equal_brute_force(spark):
    rng = random.Random(3)
    labels, parts = ["a", "b", "com", "net", "x-y", "é", ""], ["", "/", "/a", "/a/b", "/a/bc", "/é/", "/b/a/", "/a//"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), rng.choice(parts)) for _ in range(120))}.values())
    pages = [(i, f"http{rng.choice(['', 's'])}://{host()}{rng.choice(parts)}{rng.choice(['', '/q', 'c'])}{rng.choice(['', '?a=/b', '#x://y', '?'])}") for i in range(3000)]
    pages += [(None, "http://a.com/a/b"), (5, None), (5, ""), (6, "no host"), (7, "http://"), (8, "x://A.COM/a/b"), (9, "http://" + "a." * 3000 + "com/a/b"), (10, "ftp://a.com" + "/a" * 50_000)] + [(11, "http://b.net/a/bc")] * 40
    frame = spark.createDataFrame([(i, u, "kept") for i, u in pages], "page_id long, url string, verdict string")
    table = spark.createDataFrame([(v, h.upper(), p, 1) for v, h, p in rules if h != "é"] + [(v, h, p, 1) for v, h, p in rules if h == "é"], "verdict string, host string, path string, kind int")
    lowered = [(v, "".join(c.lower() if "A" <= c <= "Z" else c for c in (h if h == "é" else h.upper())), p) for v, h, p in rules]
    found = urls.judge_urls(frame.repartition(5), table, default="other").collect()
    want = [(i, *plain_verdict(u, lowered, "other")) for i, u in pages]
    assert ordered(map(tuple, found)) == ordered(want)
    assert {r["rule"] for r in found} - {None}


def test_urls_without_rows_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([("block", "a.com", "/"), ("allow", "a.com", "/")], "verdict string, host string, path string")
    assert tuple(urls.judge_urls(pages, rules).first()) == (1, "a.com", "/", "a.com/", "block")
    assert tuple(urls.judge_urls(pages, rules.limit(0)).first()) == (1, "a.com", "/", None, "allow")
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


# conversation repair

LEGAL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_repair(rows):
    """The cheapest edits of (role, text, fault) rows, ties ASCII-least, by states and whole strings."""
    best = {0: (0, "", ())}

    def offer(into, state, cost, edits, lines):
        if state not in into or (cost, edits) < into[state][:2]:
            into[state] = (cost, edits, lines)

    def with_inserts(states):
        for _ in range(3):
            for state, (cost, edits, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in LEGAL:
                        offer(states, LEGAL[state, role[0]], cost + 3, edits + "I", (*lines, f"{role}:"))
        return states

    for role, text, fault in rows:
        now = {}
        for state, (cost, edits, lines) in with_inserts(best).items():
            offer(now, state, cost + 4, edits + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if (state, role[:1]) in LEGAL:
                offer(now, LEGAL[state, role[:1]], cost + extra, edits + "K", (*lines, f"{role}:{text}"))
            for other in ("user", "assistant"):
                if (state, other[0]) in LEGAL:
                    offer(now, LEGAL[state, other[0]], cost + 3 + extra, edits + "R", (*lines, f"{other}:{text}"))
        best = now
    ended = with_inserts(best)
    return min(ended[s] for s in (0, 3) if s in ended)


def plain_faults(rows):
    out, seen = [], set()
    for role, text in rows:
        cut = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_report(rows):
    """``rows``: (turn, role, text) of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    told = plain_faults([r[1:] for r in rows])
    turns = {t for t, *_ in rows if t is not None}
    cost, audit, lines = plain_repair(told)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
    counts = Counter(f for *_, f in told)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


ROLES = ["user", "assistant", "system", "tool", "", None, "u", "super"]


def conversations(rng, n, longest):
    out = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(["Yes.", "No", "Why?", "", " \t\n", None, "ok!  ", "é.", "x;"])
            out.append((conv, rng.choice([turn, turn + 1, None]) if rng.random() < 0.2 else turn, rng.choices(ROLES, [8, 8, 3, 1, 1, 1, 1, 1])[0], text if rng.random() < 0.5 else f"{turn} {text}"))
    return out


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)  # small blocks cut conversations
    rows = conversations(random.Random(4), 120, 14) + [(1000, 1, "user", "again.")] * 30 + [(1001, i, "user", f"{i}.") for i in range(60)]
    frame = spark.createDataFrame([(*r, "kept") for r in rows], "conv_id long, turn long, role string, text string, edit string")
    found = {r[0]: tuple(r)[1:] for r in repair.repair_report(frame.repartition(5)).collect()}
    for conv in {r[0] for r in rows}:
        assert found[conv] == plain_report([r[1:] for r in rows if r[0] == conv]), conv
    assert len(found) == len({r[0] for r in rows})
    by_conv = {}
    for r in sorted(repair.repair_conversations(frame).collect(), key=lambda r: (r["id"], r["k"])):
        by_conv.setdefault(r["conv_id"], []).append(r)
    for conv, own in by_conv.items():
        lines = "\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D")
        assert "".join(r["edit"] for r in own) == found[conv][6] and hashlib.sha256(lines.encode()).hexdigest() == found[conv][7]


def test_runs_equal_single_rows():
    """Powers of transitions against one row at a time, on long runs."""
    rng = random.Random(5)
    for _ in range(40):
        runs = tuple((rng.randrange(9), rng.choice([1, 2, 3, 7, 40])) for _ in range(rng.randint(1, 5)))
        rows = [("suao"[s >> 1] if s < 8 else "u", "x", "blank" if s == 8 else "truncated" if s & 1 else "") for s, n in runs for _ in range(n)]
        (start, stop), = repair.chained([repair._folded(runs)])
        cost, edits = repair.ENDS[stop]
        assert (repair._folded(runs)[0][4 * start + stop] + cost, repair.unrolled(runs, start, stop) + edits) == plain_repair(rows)[:2]


def test_damage_and_empty_conversations(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kind = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    want = []
    for c, t, role, text in rows:
        k, role, text = kind(c, t), role or " ", text or " "
        changed = (c, t, "user" if k == 4 else role, "" if k == 1 else text.translate({ord(x): None for x in ".!?"}) if k == 2 else text)
        want += [changed] * (k > 0) + [changed] * (k == 3)
    assert ordered(map(tuple, repair.damaged(frame).collect())) == ordered(want)
    empty = repair.repair_report(frame.limit(0), every=frame).collect()
    assert {tuple(r)[1:] for r in empty} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(empty) == 61
    assert repair.repair_report(frame.limit(0)).count() == 0 and repair.repair_conversations(frame.limit(0)).count() == 0
    assert repair.repair_report(frame).where(F.col("cost") < 0).count() == 0
