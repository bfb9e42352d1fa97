"""Jobs over files, kernels, many rules, key stores, carriers, scorers, sinks and streams."""

import io
import os
import random
import struct
import threading
import time
import tracemalloc
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan.functions import detect
from veilscan.operators import carriers, envelope, jobs, marks, patterns, report, rollup, rules, triage
from veilscan.sources import files, images, media
from veilscan.streaming import screen


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(width, height, body, depth=8, kind=2, interlaced=0, more=()):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlaced))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(more) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def rows_of(pixels, filters=(0,)):
    """PNG rows with the given filters in turn, filtered the slow and plain way."""
    out, above = b"", np.zeros(pixels.shape[1] * pixels.shape[2], int)
    for y, row in enumerate(pixels.reshape(len(pixels), -1).astype(int)):
        left, corner = (np.concatenate([np.zeros(3, int), x[:-3]]) for x in (row, above))
        near = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: [min(((abs(p - x), k) for k, x in enumerate(abc)))[1] for abc in zip(left, above, corner, strict=True) for p in [abc[0] + abc[1] - abc[2]]]}
        kind = filters[y % len(filters)]
        guess = np.choose(near[4], [left, above, corner]) if kind == 4 else near[kind]
        out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    return out


def sound(samples, width=2):
    with io.BytesIO() as out:
        with wave.open(out, "wb") as f:
            f.setparams((1, width, 8000, 0, "NONE", ""))
            f.writeframes(np.asarray(samples, "<i2").tobytes())
        return out.getvalue()


def marked(samples, payload):
    bits = np.unpackbits(np.frombuffer(len(payload).to_bytes(4, "big") + payload, np.uint8))
    out = np.array(samples)
    out[: len(bits)] = (out[: len(bits)] & ~1) | bits
    return out


# decoding in bands


def test_bands_equal_the_whole(monkeypatch):
    pixels = np.random.default_rng(1).integers(0, 256, (37, 23, 3)).astype(np.uint8)
    raw = png(23, 37, zlib.compress(rows_of(pixels, (0, 1, 2, 3, 4))))
    whole = images.rgb(raw)
    assert (whole == pixels).all()
    n = media.statistics(media.image_blocks(raw)[1])
    monkeypatch.setattr(images, "BAND", 100)
    bands = list(images.read_image(raw).bands)
    assert len(bands) > 10 and (np.concatenate(bands) == pixels).all()
    assert media.statistics(media.image_blocks(raw)[1]) == pytest.approx(n)
    bmp = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 0, 0, 54, 40, 23, 37, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(r[:, ::-1].tobytes() + b"\0" * 3 for r in pixels[::-1])
    assert (images.rgb(bmp) == pixels).all() and len(list(images.read_image(bmp).bands)) > 10


def test_interlaced_passes_side_by_side(monkeypatch):
    monkeypatch.setattr(images, "BAND", 64)
    pixels = np.random.default_rng(2).integers(0, 256, (13, 11, 3)).astype(np.uint8)
    body = b"".join(rows_of(pixels[y::down, x::right]) for x, y, right, down in images.PASSES if pixels[y::down, x::right].size)
    assert (images.rgb(png(11, 13, zlib.compress(body), interlaced=1)) == pixels).all()


def test_bombs_are_errors_in_bounded_memory(spark):
    pixels = np.zeros((4, 4, 3), np.uint8)
    bombs = {
        "more data": png(4, 4, zlib.compress(rows_of(pixels) + bytes(200 << 20), 9)),
        "cut short": png(1 << 20, 1 << 30, zlib.compress(bytes(1 << 20), 9)),
        "rows of": png((1 << 31) - 1, 1, zlib.compress(bytes(1000)), depth=16, kind=6),
        "do not fit": png(1 << 16, 1 << 16, zlib.compress(bytes(1000))),
    }
    tracemalloc.start()
    for said, raw in bombs.items():
        with pytest.raises(ValueError, match=said):
            images.rgb(raw) if said == "do not fit" else media.statistics(media.image_blocks(raw)[1])
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    frame = spark.createDataFrame([(k, ".png", bytearray(v)) for k, v in bombs.items()], "item_id string, ext string, content binary")
    rows = {r["item_id"]: r["error"] for r in images.image_samples(frame).collect()}
    assert all(said in rows[said] for said in bombs if said != "cut short") and all(rows.values())


def test_sound_statistics_in_blocks(monkeypatch):
    samples = np.random.default_rng(3).integers(-3000, 3000, 5001)
    whole = media.statistics(media.sound_blocks(sound(samples))[1])
    monkeypatch.setattr(media, "FRAMES", 7)
    assert media.statistics(media.sound_blocks(sound(samples))[1]) == pytest.approx(whole) and whole[:2] == (5001, int((samples & 1).sum()))


def test_payloads_are_read_no_further_than_they_go(monkeypatch):
    monkeypatch.setattr(images, "BAND", 256)
    pixels = marked(np.random.default_rng(4).integers(0, 256, 64 * 64 * 3), b"hidden").astype(np.uint8).reshape(64, 64, 3)
    cut = png(64, 64, zlib.compress(rows_of(pixels), 0)[:2000])  # the rest of the image is missing
    assert media.embedded(*media.image_blocks(cut)) == (b"hidden", "ok")
    with pytest.raises(ValueError, match="cut short"):
        images.rgb(cut)
    assert media.embedded(*media.sound_blocks(sound(marked(np.arange(300) - 150, b"")))) == (b"", "ok")
    assert media.embedded(*media.sound_blocks(sound([1] * 31))) == (None, "too_short")
    assert media.embedded(*media.sound_blocks(sound(marked(np.arange(100), b"12345678")))) == (b"12345678", "ok")
    assert media.embedded(*media.sound_blocks(sound(marked(np.arange(100), b"12345678")[:95]))) == (None, "declared_length_exceeds")


def test_recover_files(spark, tmp_path):
    """Round trips through real files, sealed ones, broken ones and ones without a mark."""
    salt, nonce = bytes(range(16)), bytes(12)
    keys = envelope.derive_keys(spark.createDataFrame([(bytearray(salt),)], "salt binary"), "password").cache()
    blobs = spark.createDataFrame([(1,)], "i int").crossJoin(keys).select(envelope.pack(F.lit(b"plain")).alias("p"), envelope.seal(F.lit(b"sealed"), F.col("key"), F.lit(nonce)).alias("s"), "salt")
    row = blobs.select("p", envelope.pack(F.col("s.sealed"), F.lit(True), F.col("salt"), F.col("s.nonce")).alias("e")).first()
    plain, sealed = bytes(row["p"]), bytes(row["e"])
    rng = np.random.default_rng(5)
    picture = lambda blob: marked(rng.integers(0, 256, 16 * 16 * 3), blob).astype(np.uint8).reshape(16, 16, 3)
    lines = lambda blob: "".join(f"word{' ' if b == '0' else chr(9)}\n" for b in "".join(f"{x:08b}" for x in blob)) + "end\n"
    tiff = b"MM\0*" + struct.pack(">IHHHIIIHHHIII", 8, 1, 0x8769, 4, 1, 26, 0, 1, 0x9286, 7, 8 + len(sealed), 44, 0) + b"STEGEXIF" + sealed
    given = {
        "a.PNG": png(16, 16, zlib.compress(rows_of(picture(plain)))), "b.png": png(16, 16, zlib.compress(rows_of(picture(sealed)))), "c.wav": sound(marked(rng.integers(-99, 99, 900), plain)),
        "d.txt": lines(sealed).encode(), "e.tiff": tiff, "f.txt": b"nothing here\n", "g.txt": b"\xff\xfe", "h.png": b"no image", "i.wav": sound([0] * 40), "j.bin": b"x",
    }
    for name, raw in given.items():
        (tmp_path / name).write_bytes(raw)
    scanned = files.scan_files(spark, str(tmp_path))
    found = {os.path.basename(r["item_id"]): r for r in jobs.recover_files(scanned, keys).collect()}
    told = {n: (r["status"], r["payload"] and bytes(r["payload"]), bool(r["error"])) for n, r in found.items()}
    assert told == {
        "a.PNG": ("ok", b"plain", False), "b.png": ("ok", b"sealed", False), "c.wav": ("ok", b"plain", False), "d.txt": ("ok", b"sealed", False), "e.tiff": ("ok", b"sealed", False),
        "f.txt": ("too_short", None, False), "g.txt": ("broken", None, True), "h.png": ("broken", None, True), "i.wav": ("too_short", None, False),
    }
    assert {r["status"] for r in jobs.recover_files(scanned).where("item_id LIKE '%b.png'").collect()} == {"key_needed"}


# kernels


def test_kernels_equal_the_native_form(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-500, 500, n).tolist(), bytearray(rng.bytes(p))) for i, (n, p) in enumerate([(40_000, 4000), (40_000, 1024), (40_000, 1023), (9000, 1100), (8224, 1024), (8223, 1024), (32, 0), (31, 0), (100, 3)])]
    rows += [(20, None, bytearray(b"x")), (21, [1, 2, 3] * 40, None)]
    frame = spark.createDataFrame(rows, "i int, s array<int>, p binary")
    both = frame.select("i", "s", "p", marks.mark_samples(F.col("s"), F.col("p")).alias("n"), marks.mark_samples(F.col("s"), F.col("p"), kernel=True).alias("k")).cache()
    for r in both.collect():
        fits = r["s"] is not None and r["p"] is not None and 32 + 8 * len(r["p"]) <= len(r["s"])
        assert r["n"] == r["k"] and (r["n"] == marked(r["s"], bytes(r["p"])).tolist() if fits else r["n"] is None)
    back = both.select("i", "p", marks.recover_samples(F.col("n")).alias("x"), marks.recover_samples(F.col("n"), kernel=True).alias("y"), F.col("n").isNotNull().alias("there")).collect()
    assert all(r["x"] == r["y"] and (not r["there"] or (r["x"]["status"], r["x"]["payload"]) == ("ok", r["p"])) for r in back)


def test_marking_touches_each_sample_once(spark):
    """Four times the payload costs about the same on long arrays, and lines times bits are no product."""

    def seconds(frame, column):
        best = 9e9
        for _ in range(3):
            began = time.time()
            frame.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    samples = F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: (i * 7 % 256).cast("int"))
    base = spark.range(8).select(samples.alias("s"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i.cast("string")), "\n").alias("t"))
    frames = {n: base.withColumn("p", F.unhex(F.repeat(F.lit("A5"), F.lit(n)))).cache() for n in (100, 400, 2000)}
    for f in frames.values():
        f.count()
    times = {n: seconds(f, marks.mark_samples(F.col("s"), F.col("p"), kernel=True)) for n, f in frames.items()}
    assert times[400] < 1.3 * times[100] + 0.3
    lines = {n: seconds(f, marks.mark_trailing(F.col("t"), F.col("p"))) for n, f in frames.items()}
    assert lines[2000] < 2 * lines[100] + 1


# keys


def test_key_store(spark, tmp_path, monkeypatch):
    store, salts = envelope.KeyStore(spark, str(tmp_path / "keys")), [bytes([i]) * 16 for i in range(20)]
    frame = spark.createDataFrame([(bytearray(s),) for s in salts] * 3 + [(None,), (bytearray(b"short"),)], "salt binary")
    first = {bytes(r["salt"]): r["key"] for r in store.keys(frame, "one").collect()}
    assert len(first) == 21 and first[b"short"] is None and all(first[s] is not None for s in salts)
    written = len(list((tmp_path / "keys").rglob("part-*")))

    def none(*_):
        raise AssertionError("derived again")

    monkeypatch.setattr(envelope, "derive_keys", none)
    again = {bytes(r["salt"]): r["key"] for r in store.keys(frame.limit(30), "one").collect()}
    assert again.items() <= first.items() and again and len(list((tmp_path / "keys").rglob("part-*"))) == written
    with pytest.raises(AssertionError):
        store.keys(frame, "two")
    assert store.known("two").count() == 0 and store.keys(frame.limit(0), "one").count() == 0


def test_salts_are_dealt_out(spark):
    salts = spark.range(200).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("salt"))
    used = envelope.derive_keys(salts, "password").withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(used) >= 4 and max(r["count"] for r in used) < 100


# many rules


def plain_matches(items, needles):
    return sorted((i, name) for i, c in items for name, n in needles if c is not None and n and n in c)


def test_many_rules_equal_the_nested_loop(spark):
    rng = random.Random(7)
    some = lambda n: bytes(rng.choice(b"abcd\x00\xff") for _ in range(n))
    items = [(i, some(rng.randint(0, 80))) for i in range(150)] + [(900, None), (901, b""), (902, b"ab"), (903, b"abc" * 30_000), (7, b"abcd")]
    needles = [(f"r{i}", some(rng.choice([1, 2, 3, 4, 5, 9, 30]))) for i in range(400)] + [("empty", b""), ("null", None), ("same", b"abca"), ("same", b"abca")]
    frame = spark.createDataFrame([(i, None if c is None else bytearray(c), "x") for i, c in items], "item_id long, content binary, gram string")
    table = spark.createDataFrame([(n, None if x is None else bytearray(x), 5) for n, x in needles], "name string, needle binary, score int")
    found = patterns.match_rules(frame, table)
    assert found.columns == ["item_id", "gram", "name", "score"]
    assert sorted((r["item_id"], r["name"]) for r in found.collect()) == plain_matches(items, needles)
    assert patterns.match_rules(frame, table.limit(0)).count() == patterns.match_rules(frame.limit(0), table).count() == patterns.match_rules(frame, table.where("name = 'empty'")).count() == 0


def test_ten_thousand_rules(spark, small):
    """Work hardly depends on the number of rules, and the result is that of the nested loop."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("content")).cache()
    rng, texts = random.Random(8), [bytes(r["content"]) for r in docs.collect()]
    cut = [t[a : a + rng.randint(6, 40)] for t in rng.choices([t for t in texts if len(t) > 80], k=5000) for a in [rng.randrange(len(t) - 40)]]
    needles = list({n: None for n in cut + [rng.randbytes(rng.randint(4, 12)) for _ in range(5000)]})
    table = spark.createDataFrame([(i, bytearray(n)) for i, n in enumerate(needles)], "rule int, needle binary").cache()
    times = {}
    for n in (100, 100, len(needles)):
        began = time.time()
        found = patterns.match_rules(docs, table.where(F.col("rule") < n)).groupBy("rule").count().collect()
        times[n] = time.time() - began
    want = {i: k for i, n in enumerate(needles) if (k := sum(n in t for t in texts))}
    assert {r["rule"]: r["count"] for r in found} == want
    assert times[len(needles)] < 5 * times[100] + 3


def test_contents_are_never_joined_and_needles_pass_in_blocks(spark, monkeypatch):
    """A content that holds many rules is looked at where it is read: no join, and so no shuffle, gets its bytes."""
    rng = random.Random(9)
    some = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    items, needles = [(i, some(300)) for i in range(40)], [(f"r{i}", some(rng.randint(2, 7))) for i in range(200)]
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in items], "item_id long, content binary")
    table = spark.createDataFrame([(n, bytearray(x)) for n, x in needles], "name string, needle binary")

    def joins(plan):
        below = [plan.children().apply(k) for k in range(plan.children().size())]
        return ([plan] if plan.nodeName() == "Join" else []) + [j for c in below for j in joins(c)]

    want = plain_matches(items, needles)
    for most in (32 << 20, 2000):
        monkeypatch.setattr(patterns, "BLOCK_BYTES", most, raising=False)
        found = patterns.match_rules(frame, table)
        assert sorted((r["item_id"], r["name"]) for r in found.collect()) == want
        inputs = [str(side.output().mkString(",")) for j in joins(found._jdf.queryExecution().optimizedPlan()) for side in (j.left(), j.right())]
        assert inputs and not any("content" in names for names in inputs)


def test_rule_signals(spark):
    table = spark.createDataFrame([("a", bytearray(b"needle"), 50, "A"), ("b", bytearray(b"nee"), 80, None)], "name string, needle binary, score int, detail string")
    items = spark.createDataFrame([("1", bytearray(b"a needle")), ("2", bytearray(b"knee")), ("3", bytearray(b"-"))], "item_id string, content binary")
    found = {r["item_id"]: [tuple(s) for s in r["signals"]] for r in patterns.rule_signals(items, table).collect()}
    assert found == {"1": [("b", 80, None), ("a", 50, "A")], "2": [("b", 80, None)]}


# sources, sinks and streams


def test_many_small_files_are_written_and_read_by_a_few_tasks_per_core(spark, tmp_path):
    """One input partition must not write all files, nor the driver move them, and 32 files must not make a task."""
    texts = spark.range(0, 700, 1, 1).select(F.concat(F.lit("t"), "id").alias("value"), F.concat(F.lit("."), F.col("id") % 2).alias("kind"))
    files.write_each(texts, str(tmp_path / "x"), "kind")
    names = [os.path.join(d, n) for d, _, found in os.walk(tmp_path / "x") for n in found if n.startswith("part-")]
    assert len(names) == 700 and len({os.path.basename(n).split("-")[1] for n in names}) == files.many_tasks(spark)
    found = files.scan_files(spark, str(tmp_path / "x"), "*.txt", tasks=files.many_tasks(spark))
    assert found.rdd.getNumPartitions() == files.many_tasks(spark) < files.scan_files(spark, str(tmp_path / "x"), "*.txt").rdd.getNumPartitions()
    assert sorted(bytes(r["content"]).decode() for r in found.collect()) == sorted(f"t{i}\n" for i in range(700))


def test_tasks_write_single_files_like_sparks_writer(spark, tmp_path, monkeypatch):
    """Spark's local store starts a process for each file, so the tasks write them; the files are the same."""
    rows = [(bytearray(b"a\xff\r\n"), ".png"), (bytearray(), ".x"), (None, ".x"), (bytearray("é".encode()), None), (bytearray(b"b"), "a [b] é/%^")]
    texts = spark.createDataFrame(rows, "value binary, kind string").withColumn("value", F.col("value").cast("string"))

    def written(name, by):
        files.write_each(texts if by else texts.select("value"), f"{tmp_path}/{name}", by)
        kept = [(os.path.relpath(d, tmp_path / name), open(os.path.join(d, n), "rb").read()) for d, _, found in os.walk(tmp_path / name) for n in found if n.startswith("part-")]
        return sorted(kept), os.path.exists(tmp_path / name / "_SUCCESS")

    own = [written("own", "kind"), written("own-plain", None)]
    assert not any(by_spark for _, by_spark in own)
    assert files._by_tasks(spark, f"file://{tmp_path}/own") and not files._by_tasks(spark, "viewfs://store/x")
    monkeypatch.setattr(files, "_by_tasks", lambda *a: False)
    sparks = [written("spark", "kind"), written("spark-plain", None)]
    assert all(by_spark for _, by_spark in sparks)
    assert [kept for kept, _ in own] == [kept for kept, _ in sparks]


def test_pruning_reaches_the_source(spark, tmp_path):
    for name in ("a.txt", "B.TXT", "c.md", "d.png", "e.wav"):
        (tmp_path / name).write_bytes(b"x" * (10 if name != "c.md" else 1000))
    assert rules.extensions_of("text_whitespace", "audio_wav") == (".md", ".txt", ".wav") and rules.extensions_of("signatures", "audio_wav") is None
    with pytest.raises(ValueError, match="catalog"):
        rules.extensions_of("nothing")
    found = files.scan_files(spark, str(tmp_path), extensions=rules.extensions_of("text_zerowidth"), most_bytes=100)
    assert sorted(os.path.basename(r["item_id"]) for r in found.collect()) == ["B.TXT", "a.txt"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan
    os.chmod(tmp_path / "d.png", 0)
    assert found.agg(F.sum(F.length("content"))).first()[0] == 20  # what is excluded is not opened
    with pytest.raises(ValueError, match="not both"):
        files.scan_files(spark, str(tmp_path), "*.txt", (".md",))


def test_a_second_run_screens_only_new_files(spark, tmp_path):
    place, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(f"{place}/deep")

    def run():
        screen.screen_directory(spark, place, out, state, "scan", extensions=(".txt", ".bin"), most_bytes=1000).awaitTermination()
        return {(os.path.basename(r["item_id"]), r["batch"]) for r in report.read_report(spark, out, "scan").collect()}

    for name in ("a.txt", "deep/b.bin", "c.skip"):
        (tmp_path / "in" / name).write_bytes(b"OPENSTEGO")
    (tmp_path / "in/large.txt").write_bytes(bytes(2000))
    assert run() == {("a.txt", 0), ("b.bin", 0)}
    assert run() == {("a.txt", 0), ("b.bin", 0)}
    (tmp_path / "in/d.TXT").write_bytes(b"new")
    assert run() == {("a.txt", 0), ("b.bin", 0), ("d.TXT", 1)}


def test_reports_can_be_written_again(spark, tmp_path):
    items = spark.createDataFrame([(str(i), ".txt", bytearray(b"shsh" if i % 3 else b"x")) for i in range(9)], "item_id string, ext string, content binary")
    path, found = str(tmp_path / "report"), rollup.findings(items)
    counts = lambda: sorted(map(tuple, report.report_counts(report.read_report(spark, path)).collect()))
    report.write_report(found, path, "one", 3)
    first = counts()
    report.report_sink(path, "one")(found, 3)
    assert counts() == first and sum(r[3] for r in first) == found.count()
    report.write_report(found, path, "two")
    assert len(counts()) == 2 * len(first) and report.read_report(spark, path, "two").count() == found.count()
    row = report.read_report(spark, path, "one").where("analyzer = 'ai_triage' AND item_id = '1'").first()
    assert row["suspicion"] == detect_score() and row["band"] == rollup_band(row["suspicion"]) and row["signals"][-1]["name"] == "steghide"
    report.write_report(found.limit(0), path, "one", 3)
    assert len(counts()) == 2 * len(first)


def detect_score():
    return next(s for n, x, s, _ in detect.SIGNATURES if x == "shsh")


def rollup_band(score):
    return "high" if score >= rollup.HIGH else "mid" if score >= rollup.MID else "low"


# carriers and scorers of the caller


def upper_carrier(**changes):
    given = {
        "name": "shout", "extensions": (".log",), "column": "text", "mark": lambda text, blob: F.concat(text, F.lit("#"), F.hex(blob)),
        "recover": lambda text: F.unhex(F.nullif(F.regexp_extract(text, "#([0-9A-F]+)$", 1), F.lit(""))), "capacity": lambda text: F.lit(60),
    }
    return carriers.Carrier(**given | changes)


def test_registered_carriers_round_trip(spark):
    own = carriers.Carriers()
    own.register(upper_carrier())
    own.register(upper_carrier(name="first", extensions=(".txt",), first=True))
    rows = [("1", ".log", "a\nb", b"hello"), ("2", ".txt", "c", b"first"), ("3", ".log", "d", b"x" * 40), ("4", ".md", "e", b"y"), ("5", ".zip", "f", b"z")]
    items = spark.createDataFrame([(*r[:3], None, None, bytearray(r[3]), None, None) for r in rows], "item_id string, ext string, text string, samples array<int>, user_comment binary, payload binary, salt binary, nonce binary")
    marked_items = jobs.mark_items(items, own=own).cache()
    assert {r["item_id"]: (r["carrier"], r["status"]) for r in marked_items.collect()} == {"1": ("shout", "ok"), "2": ("first", "ok"), "3": ("shout", "too_large"), "4": ("text_whitespace", "too_large"), "5": (None, "no_carrier")}
    back = {r["item_id"]: (r["carrier"], r["status"], r["payload"]) for r in jobs.recover_items(marked_items, own=own).collect()}
    assert back["1"] == ("shout", "ok", b"hello") and back["2"] == ("first", "ok", b"first") and back["3"][1] == "no_mark" and "5" not in back


@pytest.mark.parametrize(("changes", "error"), [({"mark": "text"}, TypeError), ({"capacity": None}, TypeError), ({"column": "pixels"}, ValueError), ({"extensions": ("log",)}, ValueError), ({"extensions": ()}, ValueError), ({"extensions": (".LOG",)}, ValueError), ({"name": "image_lsb"}, ValueError)])
def test_wrong_carriers_are_refused(changes, error):
    with pytest.raises(error):
        carriers.Carriers().register(upper_carrier(**changes))
    with pytest.raises(TypeError):
        carriers.Carriers().register(lambda text: text)


def test_calls_run_at_once_in_order_and_end():
    running, most, lock = 0, 0, threading.Lock()

    def slow(k):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.05)
        with lock:
            running -= 1
        return k

    began = time.time()
    found = triage.answers([lambda k=k: slow(k) for k in range(40)], 10, 5.0)
    assert [v for v, _ in found] == list(range(40)) and most == 10 and time.time() - began < 1.5
    began, tries = time.time(), []
    hang = triage.answers([lambda: time.sleep(60), lambda: 1, lambda: tries.append(0) or 1 / 0, lambda: 2], 2, 0.3, retries=2)
    assert [v for v, _ in hang] == [None, 1, None, 2] and time.time() - began < 5 and len(tries) == 3
    assert isinstance(hang[0][1], TimeoutError) and isinstance(hang[2][1], ZeroDivisionError)
    flaky = iter([ValueError("first"), None])

    def sometimes():
        error = next(flaky)
        if error:
            raise error
        return "then"

    assert triage.answers([sometimes], 1, 1.0, retries=1) == [("then", None)] and triage.answers([], 3, 1.0) == []


def test_a_hanging_scorer_gives_an_error_row(spark):
    items = spark.createDataFrame([(f"i{i}", i, []) for i in range(12)], f"item_id string, length long, signals array<{'struct<name:string,score:int,detail:string,metric:double>'}>").repartition(1)

    def scorer(item, signals):
        time.sleep(30 if item["item_id"] == "i3" else 0.2)
        return 500, item["item_id"]

    began = time.time()
    found = {r["item_id"]: r for r in triage.triage(items, scorer, concurrent=6, limit=2.0).collect()}
    assert time.time() - began < 15 and found["i3"]["error"].startswith("TimeoutError") and found["i3"]["suspicion"] == 0
    assert all(r["explanation"] == i and r["suspicion"] == 100 and r["error"] is None for i, r in found.items() if i != "i3")
