"""Archives: round trips, revisits and the merged index."""

import base64
import gzip
import hashlib
import random

import pytest

from veilscan.llm import warc


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        merged = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert merged == sorted(x for r in runs for x in r)


def test_archives(spark, tmp_path):
    nasty = "WARC/1.1\r\n\r\n\r\nWARC/1.1"
    rows = [(None, None, None), (3, "http://a.b/x\r\nWARC/1.1", nasty), (1, "http://É.b/ x%20", ""), (4, "q", nasty), (9, "http://a.b/a", "é😀"), (2, "http://sub.a.b:80/?q=1", "é😀"), (6, "http://a.b/a", "long" * 200_000), (7, "e", "ends\r\n"), (8, "e", "ends\r\n\r\n"), (10, "e", "\r\r\n\r"), (11, "e", "\n\r\n\r\n\r\n")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha1 int")
    path = str(tmp_path / "archives")
    found = {r["page_id"]: r for r in warc.archive_pages(frame, path).collect()}
    first = {}
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page_id)
    for page_id, _, html in rows:
        raw, r = (html or "").encode(), found[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        own = first[html or ""] == page_id
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own else ("revisit", first[html or ""]))
    ordered = sorted(found.values(), key=lambda r: r["position"])
    assert [r["position"] for r in ordered] == list(range(len(rows)))
    assert [(r["url_key"], r["captured"]) for r in ordered] == sorted((r["url_key"], r["captured"]) for r in ordered)
    urls = {r["page_id"]: r["url"] for r in warc.read_archives(spark, path).collect()}
    assert urls == {p: u for p, u, _ in rows}
    whole = {f.name: gzip.decompress(f.read_bytes()) for f in (tmp_path / "archives").glob("part-*")}
    records = [r for raw in whole.values() for r in warc.parse_archive([raw])]
    assert len(records) == len(rows) and all(h["content-type"] == "application/http; msgtype=response" for _, h, _ in records)
    for raw in whole.values():
        pieces = [raw[i : i + 7] for i in range(0, min(len(raw), 5000), 7)] + [raw[5005:]]
        assert list(warc.parse_archive(pieces)) == list(warc.parse_archive([raw]))
    for r in found.values():  # each capture's offset is where its record starts
        assert whole[r["archive"]][r["offset"] :].startswith(b"WARC/1.1\r\n")
        assert r["payload_digest"] in whole[r["archive"]][r["offset"] :][:400].decode(errors="ignore")
    with pytest.raises(ValueError):
        list(warc.parse_archive([max(whole.values(), key=len)[:-50]]))
    assert warc.archive_pages(frame.limit(0)).count() == 0


def test_repeated_rows(spark):
    rows = [(3, "u", "same")] * 4 + [(5, "u", "same")] * 2
    found = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in found) == [(3, "response", None)] * 4 + [(5, "revisit", 3)] * 2


def test_index_of_many_small_partitions(spark, monkeypatch):
    """More partitions than sessions have, and rows whose keys are all equal."""
    monkeypatch.setattr(warc, "MERGED", 7)
    rows = [(None, "http://a.b/x", f"p{i % 9}") for i in range(60)] + [(i, "http://a.b/x", f"q{i}") for i in range(40)]
    found = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["position"] for r in found) == list(range(100))
    ordered = sorted(found, key=lambda r: r["position"])
    key = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in ordered]
    assert key == sorted(key)
