"""Bounds of the detectors, round trips of marks, envelopes, files and scorers."""

import os
import random
import struct
import time
import tracemalloc
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilscan.functions import bits, detect
from veilscan.operators import envelope, jobs, marks, rollup, triage
from veilscan.plans import fixtures
from veilscan.sources import files, images, media
from veilscan.streaming.screen import screen_stream


def one(spark, column, **values):
    kinds = {bytes: "binary", str: "string", int: "long", list: "array<int>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    row = tuple(bytearray(v) if isinstance(v, bytes) else v for v in values.values())
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def names(found):
    return {s["name"]: s["score"] for s in found}


def test_zero_width_bounds(spark):
    assert one(spark, detect.zero_width(F.col("t")), t="a clean sentence") == []
    marked = one(spark, marks.mark_zero_width(F.col("t"), F.col("p")), t="a clean sentence", p=b"abc")
    assert names(one(spark, detect.zero_width(F.col("t")), t=marked))["zero_width_chars"] >= 70
    assert one(spark, marks.recover_zero_width(F.col("t")), t=marked) == b"abc"


def test_trailing_whitespace(spark):
    cover = "\n".join(f"line {i}" for i in range(8))
    marked = one(spark, marks.mark_trailing(F.col("t"), F.col("p")), t=cover, p=b"Z")
    assert one(spark, marks.recover_trailing(F.col("t")), t=marked) == b"Z"
    assert names(one(spark, detect.trailing_whitespace(F.col("t")), t=marked))["trailing_whitespace_ratio"] >= 50
    assert names(one(spark, detect.trailing_whitespace(F.col("t")), t=cover)) == {"trailing_whitespace_ratio": 0}
    assert one(spark, detect.trailing_whitespace(F.col("t")), t="") == []
    assert one(spark, detect.trailing_whitespace(F.col("t")), t="a \n \t\nb\n")[0]["metric"] == pytest.approx(1 / 3)


def test_lines_follow_every_line_end(spark):
    text = "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k\n"
    assert one(spark, bits.lines(F.col("t")), t=text) == text.splitlines()
    assert one(spark, bits.lines(F.col("t")), t="\n\n") == ["", ""]


def test_signatures_and_trailers(spark):
    png = b"\x89PNG\r\n\x1a\n"
    assert names(one(spark, detect.known_signatures(F.col("c")), c=png + bytes(100) + b"OPENSTEGO" + bytes(50))) == {"openstego": 90}
    assert one(spark, detect.known_signatures(F.col("c")), c=png + bytes(200)) == []
    end = bytes.fromhex("49454E44AE426082")
    found = one(spark, detect.appended_data(F.lit(".png"), F.col("c")), c=png + end + b"PK\x03\x04" + bytes(30))
    assert names(found) == {"appended_data": 70, "embedded_ZIP_archive": 95}
    assert one(spark, detect.appended_data(F.lit(".png"), F.col("c")), c=png + end) == []
    assert one(spark, detect.appended_data(F.lit(".xyz"), F.col("c")), c=png + end + b"x") == []
    # a marker that lies across byte borders is none
    assert one(spark, detect.jpeg_trailer(F.col("c")), c=b"\x0f\xfd\x90abc") == []
    assert names(one(spark, detect.jpeg_trailer(F.col("c")), c=b"\xff\xd8\xff\xd9" + bytes(200)))["appended_data"] == 56
    assert names(one(spark, detect.appended_data(F.lit(".pdf"), F.col("c")), c=b"%%EOF\n")) == {"appended_data": 70}
    assert one(spark, detect.appended_data(F.lit(".pdf"), F.col("c"), ignore_trailing_eol=True), c=b"%%EOF\n") == []


def test_trailer_round_trip(spark):
    payload = random.Random(1).randbytes(300)
    marked = one(spark, marks.mark_trailer(F.col("c"), F.col("p")), c=b"\xff\xd8 pixels \xff\xd9 old trailer", p=payload)
    assert marked.startswith(b"\xff\xd8 pixels \xff\xd9STEGAPP")
    assert one(spark, marks.recover_trailer(F.col("c")), c=bytes(marked)) == payload
    assert one(spark, marks.mark_trailer(F.col("c"), F.col("p")), c=b"no image", p=payload) is None


def test_samples(spark):
    rng = np.random.default_rng(42)
    samples = rng.integers(0, 256, 64 * 64).tolist()
    assert max(names(one(spark, detect.pixel_signals(F.col("s")), s=samples)).values()) < 90
    payload = b"hidden"
    marked = one(spark, marks.mark_samples(F.col("s"), F.col("p")), s=samples, p=payload)
    assert [a >> 1 for a in marked] == [a >> 1 for a in samples]
    found = one(spark, marks.recover_samples(F.col("s")), s=marked)
    assert (found["payload"], found["status"]) == (payload, "ok")
    assert one(spark, marks.mark_samples(F.col("s"), F.col("p")), s=samples[:40], p=payload) is None
    assert one(spark, marks.recover_samples(F.col("s")), s=samples[:8])["status"] == "too_short"
    assert one(spark, detect.pixel_signals(F.col("s")), s=[]) == []
    assert one(spark, marks.capacity_of_samples(F.lit(64 * 64 * 3)), s=[]) == 64 * 64 * 3 // 8 - 4
    # audio samples may be negative
    assert one(spark, marks.mark_samples(F.col("s"), F.col("p")), s=[-3] * 40, p=b"\xff")[32:] == [-3] * 8


def test_native_and_batch_statistics_agree(spark):
    raw = np.random.default_rng(3).integers(0, 256, 501).astype(np.uint8)
    frame = spark.createDataFrame([(bytearray(raw.tobytes()), raw.tolist())], "c binary, s array<int>")
    row = frame.select(detect.sample_statistics(F.col("c")).alias("b"), detect.pair_ratio_of(F.col("s")).alias("r"), detect.ones_of(F.col("s")).alias("o")).first()
    assert row["b"]["pair_ratio"] == pytest.approx(row["r"]) and row["b"]["ones"] == row["o"] and row["b"]["n"] == 501


def test_envelope(spark):
    blob = one(spark, envelope.pack(F.col("p")), p=b"payload")
    assert len(blob) == 38 + 7 and blob[:6] == b"STEG\x01\x00"
    for raw, status in ((blob, "ok"), (blob[:20], "too_short"), (b"XXXX" + blob[4:], "bad_magic"), (blob[:4] + b"\x02" + blob[5:], "unsupported_version"), (blob[:-1], "truncated"), (blob + b"tail", "ok")):
        found = one(spark, envelope.unpack(F.col("b")), b=bytes(raw))
        assert found["status"] == status and (found["payload"] == b"payload") == (status == "ok")
    assert one(spark, envelope.pack(F.col("p"), salt=F.col("s")), p=b"x", s=b"short") is None


def test_seal_and_open(spark):
    items = spark.createDataFrame([(i, bytearray(b"secret %d" % i), bytearray(bytes([i % 2]) * 16)) for i in range(4)], "i int, p binary, salt binary")
    keys = envelope.derive_keys(items, "password").cache()
    assert keys.count() == 2
    sealed = items.join(keys, "salt").select("i", "salt", envelope.seal(F.col("p"), F.col("key")).alias("s"))
    blobs = sealed.select("i", envelope.pack(F.col("s.sealed"), F.lit(True), F.col("salt"), F.col("s.nonce")).alias("blob")).cache()
    opened = {r["i"]: (r["status"], r["payload"]) for r in envelope.open_envelopes(blobs, "blob", keys).collect()}
    assert opened == {i: ("ok", b"secret %d" % i) for i in range(4)}
    assert {r["status"] for r in envelope.open_envelopes(blobs, "blob").collect()} == {"key_needed"}
    wrong = keys.withColumn("key", F.expr("X'" + "22" * 32 + "'"))
    assert {r["status"] for r in envelope.open_envelopes(blobs, "blob", wrong).collect()} == {"not_opened"}


def test_admission(spark):
    payloads = spark.createDataFrame([(1, bytearray(b"ab")), (1, bytearray(b"abc")), (2, bytearray(b""))], "carrier_id long, payload binary")
    accepted, rejected = marks.admit(payloads, spark.createDataFrame([(1, 2)], "carrier_id long, capacity long"))
    assert [(r["carrier_id"], r["payload"]) for r in accepted.collect()] == [(1, b"ab")]
    assert sorted(r["carrier_id"] for r in rejected.collect()) == [1, 2]


@pytest.mark.parametrize(
    ("reply", "score", "explanation", "failed"),
    [
        ('{"suspicion": 75, "explanation": " e "}', 75, "e", False),
        ('{"suspicion": 999}', 100, "(no explanation)", False),
        ('{"suspicion": -5}', 0, "(no explanation)", False),
        ('Sure! {"suspicion": 42} done', 42, "(no explanation)", False),
        ("garbage", 0, None, True),
        ("[1]", 0, None, True),
        ('{"suspicion": "many"}', 0, None, True),
    ],
)
def test_replies(spark, reply, score, explanation, failed):
    found = one(spark, triage.parse_reply(F.col("r")), r=reply)
    assert (found["score"], found["explanation"], found["error"] is not None) == (score, explanation, failed)


def test_findings_of_hostile_items(spark):
    rows = [("bad", ".txt", bytearray(b"\xff\xfe")), ("empty", ".png", bytearray()), ("none", ".md", None), ("noext", "", bytearray(b"STEGAPP"))]
    found = rollup.findings(spark.createDataFrame(rows, "item_id string, ext string, content binary")).collect()
    by = {(r["item_id"], r["analyzer"]): r for r in found}
    assert by["bad", "text_whitespace"]["error"] == "not valid UTF-8" and by["bad", "text_zerowidth"]["error"] is None and by["bad", "signatures"]["error"] is None
    assert by["empty", "image_lsb"]["error"] and not by["empty", "image_lsb"]["signals"]
    assert by["noext", "ai_triage"]["explanation"] == "stegapp:95" and by["empty", "ai_triage"]["explanation"] == "no signals"
    assert by["none", "ai_triage"]["suspicion"] == 0


def test_registering_detectors():
    own = triage.Detectors()
    with pytest.raises(TypeError):
        own.register("x", "not a function")
    with pytest.raises(ValueError):
        own.register("x", lambda e, c: c, ("png",))


def png(path, pixels, kind):
    height, width = pixels.shape[:2]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    body = b"".join(b"\0" + row.tobytes() for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))


def test_files(spark, tmp_path):
    rng = np.random.default_rng(42)
    rgb, rgba, grey = (rng.integers(0, 256, s).astype(np.uint8) for s in ((4, 5, 3), (4, 5, 4), (4, 5)))
    png(tmp_path / "rgb.png", rgb, 2)
    png(tmp_path / "rgba.png", rgba, 6)
    png(tmp_path / "grey.png", grey, 0)
    (tmp_path / "cut.png").write_bytes((tmp_path / "rgb.png").read_bytes()[:40])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "full.TXT").write_bytes(b"x")
    (tmp_path / "sub" / "empty.bin").write_bytes(b"")
    got = {os.path.basename(r["item_id"]): r for r in files.image_samples(spark, str(tmp_path)).collect()}
    assert got["rgb.png"]["data"] == rgb.tobytes() and got["grey.png"]["data"] == np.repeat(grey.reshape(-1, 1), 3, 1).tobytes()
    assert got["rgba.png"]["data"] == rgba[:, :, :3].tobytes()
    assert got["cut.png"]["error"] and got["cut.png"]["data"] is None
    for name, width in (("a.wav", 2), ("b.wav", 1)):
        with wave.open(str(tmp_path / name), "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(width)
            out.setframerate(8000)
            out.writeframes(np.arange(-5, 5).astype("<i2").tobytes())
    (tmp_path / "c.wav").write_bytes(b"RIFF")
    sound = {os.path.basename(r["item_id"]): r for r in files.wav_samples(files.scan_files(spark, str(tmp_path), "*.wav")).collect()}
    assert sound["a.wav"]["samples"] == list(range(-5, 5)) and sound["b.wav"]["error"] and sound["c.wav"]["error"]
    found = {os.path.basename(r["item_id"]): (r["ext"], r["length"]) for r in files.scan_files(spark, str(tmp_path)).select("item_id", "ext", "length").collect()}
    assert found["full.TXT"] == (".txt", 1) and "empty.bin" not in found and len(found) == 8  # Spark leaves out empty files
    assert files.user_comment(b"\xff\xd8\xff\xd9") == b"" and files.user_comment(b"") == b""


def test_stream(spark, tmp_path):
    items = spark.createDataFrame([("1", ".txt", bytearray(b"shsh"))], "item_id string, ext string, content binary")
    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    screen_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("analyzer = 'ai_triage'").first()["suspicion"] == 70


def filtered_png(path, pixels, depth=8, kind=2, interlaced=False):
    """A PNG whose rows use all five filters, the samples packed to ``depth`` bits."""
    height, width, channels = pixels.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    body = b""
    for x, y, right, down in images.PASSES if interlaced else ((0, 0, 1, 1),):
        part = pixels[y::down, x::right]
        if not part.size:
            continue
        if depth == 16:
            rows = part.astype(">u2").reshape(part.shape[0], -1).view(np.uint8)
        elif depth == 8:
            rows = part.astype(np.uint8).reshape(part.shape[0], -1)
        else:
            bits = (part.reshape(part.shape[0], -1, 1) >> np.arange(depth - 1, -1, -1)) & 1
            rows = np.packbits(bits.reshape(part.shape[0], -1).astype(np.uint8), axis=1)
        step, above = max(1, channels * depth // 8), [0] * rows.shape[1]
        for i, row in enumerate(rows.tolist()):
            out = []
            for j, v in enumerate(row):
                a, b, c = (row[j - step] if j >= step else 0), above[j], (above[j - step] if j >= step else 0)
                p = a + b - c
                nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append((v - (0, a, b, (a + b) // 2, nearest)[i % 5]) & 255)
            body += bytes([i % 5, *out])
            above = row
    head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, int(interlaced))
    palette = chunk(b"PLTE", bytes(range(48))) if kind == 3 else b""
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + palette + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))


def test_decoded_images_equal_those_of_the_image_source(spark, tmp_path):
    rng = np.random.default_rng(9)
    for name, channels, kind, depth, interlaced in (("rgb", 3, 2, 8, False), ("rgba", 4, 6, 8, False), ("grey", 1, 0, 8, False), ("four", 1, 0, 4, False), ("palette", 1, 3, 4, False), ("woven", 3, 2, 8, True), ("bit", 1, 0, 1, True)):
        filtered_png(tmp_path / f"{name}.png", rng.integers(0, 1 << depth, (11, 13, channels)), depth, kind, interlaced)
    for name, height in (("up", 5), ("down", -5)):
        rows = rng.integers(0, 256, (5, 20), dtype=np.uint8).tobytes()
        (tmp_path / f"{name}.bmp").write_bytes(struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 54, 40, 6, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows)
    wanted = {os.path.basename(r["item_id"]): (r["width"], r["height"], r["data"]) for r in files.image_samples(spark, str(tmp_path)).collect()}
    found = images.image_samples(files.scan_files(spark, str(tmp_path))).collect()
    assert len(found) == 9 and all(r["error"] is None for r in found)
    got = {os.path.basename(r["item_id"]): (r["width"], r["height"], r["data"]) for r in found}
    assert [n for n in wanted if got[n] != wanted[n]] == []
    deep = rng.integers(0, 1 << 16, (3, 4, 1))
    filtered_png(tmp_path / "deep.png", deep, 16, 0)
    assert (images.rgb((tmp_path / "deep.png").read_bytes()) == deep >> 8).all()
    whole = (tmp_path / "rgb.png").read_bytes()
    for broken in (b"", b"BM", whole[:50], whole[:-60], b"\x89PNG\r\n\x1a\n" + b"\xff" * 40, whole.replace(b"IDAT", b"XDAT")):
        with pytest.raises(ValueError):
            images.rgb(broken)


def test_findings_of_media(spark, tmp_path):
    """Marked carriers score in ``findings`` as in their own detectors, from a directory as from a table."""
    rng = np.random.default_rng(42)
    pixels = rng.integers(0, 256, (64, 64, 3))
    png(tmp_path / "clean.png", pixels.astype(np.uint8), 2)
    payload = bytes(1500)
    marked = one(spark, marks.mark_samples(F.col("s"), F.col("p")), s=pixels.reshape(-1).tolist(), p=payload)
    png(tmp_path / "marked.png", np.array(marked, np.uint8).reshape(64, 64, 3), 2)
    sound = one(spark, marks.mark_samples(F.col("s"), F.col("p")), s=rng.integers(-1000, 1000, 8000).tolist(), p=bytes(900))
    with wave.open(str(tmp_path / "marked.wav"), "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(2)
        out.setframerate(8000)
        out.writeframes(np.array(sound, "<i2").tobytes())
    jpeg = one(spark, fixtures.jpeg_with_comment(F.col("c")), c=b"STEGEXIF secret")
    (tmp_path / "marked.jpg").write_bytes(jpeg)
    (tmp_path / "note.txt").write_text("nothing here\n")
    found = {(os.path.basename(r["item_id"]), r["analyzer"]): r for r in rollup.findings(files.scan_files(spark, str(tmp_path))).collect()}
    assert not any(r["error"] for r in found.values())
    lsb = {n: names(found[f"{n}.png", "image_lsb"]["signals"]) for n in ("clean", "marked")}
    assert lsb["clean"]["lsb_pair_ratio"] < 70 and lsb["marked"]["lsb_bit_bias"] > lsb["clean"]["lsb_bit_bias"]
    assert lsb["marked"] == names(one(spark, detect.pixel_signals(F.col("s")), s=marked))
    assert names(found["marked.wav", "audio_wav"]["signals"]) == names(one(spark, detect.audio_signals(F.col("s")), s=sound)) != {}
    assert found["marked.jpg", "filestruct_exif"]["suspicion"] == 95 and found["marked.jpg", "ai_triage"]["suspicion"] == 95
    assert found["note.txt", "ai_triage"]["suspicion"] == 0
    assert found["marked.png", "image_lsb"]["signals"][1]["detail"] == f"LSB mean = {np.mean(np.array(marked) & 1):.3f}"


def test_details_round_as_printf_does(spark):
    samples = [1] * 9 + [0] * 7  # 0.5625
    assert one(spark, detect.audio_signals(F.col("s")), s=samples)[0]["detail"] == "LSB mean=0.562"


def test_sealed_round_trip_of_items(spark):
    rng = np.random.default_rng(1)
    rows = [
        ("png", ".png", None, rng.integers(0, 256, 2000).tolist(), None, b"s" * 16), ("wav", ".wav", None, rng.integers(-9, 9, 2000).tolist(), None, b"t" * 16),
        ("txt", ".txt", "line\n" * 800, None, None, None), ("jpg", ".jpg", None, None, bytearray(b"old"), b"s" * 16), ("small", ".png", None, [1] * 100, None, None), ("none", ".bin", "x", None, None, None),
    ]
    schema = "item_id string, ext string, text string, samples array<int>, user_comment binary, salt binary, carrier string"
    items = spark.createDataFrame([(*r, "clash") for r in rows], schema).select("*", F.encode(F.concat(F.lit("for "), "item_id"), "UTF-8").alias("payload"), F.lit(None).cast("binary").alias("nonce"))
    keys = envelope.derive_keys(items.where("salt IS NOT NULL"), "password")
    marked = jobs.mark_items(items.drop("carrier").withColumn("nonce", F.unhex(F.lit("07" * 12))), keys).cache()
    assert {r["item_id"]: (r["status"], r["encrypted"]) for r in marked.collect()} == {"png": ("ok", True), "wav": ("ok", True), "txt": ("ok", False), "jpg": ("ok", True), "small": ("too_large", False), "none": ("no_carrier", False)}
    opened = {r["item_id"]: (r["status"], r["payload"]) for r in jobs.recover_items(marked.where("status = 'ok'"), keys).collect()}
    assert opened == {i: ("ok", f"for {i}".encode()) for i in ("png", "wav", "txt", "jpg")}
    refused = {r["item_id"]: r["status"] for r in jobs.recover_items(marked, None).collect()}
    assert refused == {"png": "key_needed", "wav": "key_needed", "txt": "ok", "jpg": "key_needed", "small": refused["small"]} and refused["small"] != "ok"


def test_keys_follow_the_published_function():
    """RFC 7914: the first 32 of the 64 bytes that it lists."""
    assert envelope.scrypt_key("pleaseletmein", b"SodiumChloride").hex() == "7023bdcb3afd7348461c06cd81fd38ebfda8fbba904f8e3ea9b543f6545da1f2"


def test_trailing_whitespace_costs_little_more_than_counting_lines(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    texts = docs.crossJoin(spark.range(10)).select("text").repartition(4).cache()
    texts.count()

    def best(column):
        times = []
        for _ in range(4):
            began = time.time()
            texts.select(column.alias("s")).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        return min(times)

    assert best(detect.trailing_whitespace(F.col("text"))) < 6 * best(F.regexp_count("text", F.lit(bits.LINE_END)))


def test_lines_are_counted_without_being_made(spark):
    rng = random.Random(6)
    odd = ["", "\n", "\r\n", "a", "a\r", None] + ["".join(rng.choice(["a", "\n", "\r", "\r\n", "\x1c", "\x85", "\u2028", "\U0001f600"]) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in odd], "text string").select("text", bits.line_count(F.col("text")).alias("n"), F.size(bits.lines(F.col("text"))).alias("size")).collect()
    assert all(r["n"] == r["size"] == len(r["text"].splitlines()) for r in rows if r["text"] is not None) and rows[5]["n"] == rows[5]["size"]


def test_contents_are_measured_without_copies():
    """A worker's memory follows the Arrow batch it reads, not several copies of it."""
    one = b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + 6 + 44 + 20_000) + b"Exif\0\0" + bytes.fromhex("4D4D002A00000008000187690004000000010000001A0000000000019286000700004E200000002C00000000") + b"STEGEXIF".ljust(20_000, b".")
    kinds, contents = pa.array([".jpg"] * 2000), pa.array([one] * 2000)
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    found = media.measured(kinds, contents)
    held, made = tracemalloc.get_traced_memory()[1], pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert contents.nbytes > 40_000_000 and held < 4_000_000 and made < 1_000_000
    assert set(map(str, found.to_pylist())) == {str({"n": None, "ones": None, "pair_ratio": None, "comment_bytes": 20_000, "marked": True, "error": None})}


def test_unreadable_contents_send_only_their_start(spark):
    """Text under an image's, sound's or comment's extension tells its error by its first bytes."""
    starts = [b"", b"B", b"BM", b"R", b"RIFF", b"RIFX", b"RIFF" + bytes(8), b"\xff", b"\xff\xd8", b"\xff\xd8\xff\xe1\0", b"I", b"II", b"II*\0", b"MM\0*\0\0\0\x08", b"\x89PNG\r\n\x1a\n", b"\x89PNG", b"any words at all"]
    rows = [(ext, bytearray(start + end)) for ext in (".png", ".bmp", ".wav", ".jpg", ".jpeg", ".tiff", ".txt") for start in starts for end in (b"", b"words " * 500)]
    rows += [(".png", None), (".jpg", None)]
    items = spark.createDataFrame(rows, "ext string, content binary")
    found = items.select("ext", "content", media.facts(F.col("ext"), F.col("content")).alias("f"), F.length(media._readable(F.col("ext"), F.col("content"))).alias("sent")).collect()
    for r in found:
        known = r.ext != ".txt" and r.content is not None
        assert tuple(r.f) == (media._facts(r.ext, bytes(r.content)) if known else (None,) * 6), (r.ext, bytes(r.content or b"")[:20])
        if r.content is not None and bytes(r.content).startswith((b"any words", b"RIFX")):
            assert (r.sent or 0) <= 8


def test_lines_and_marks_are_counted_as_python_does(spark):
    """The same counts as Python's, and no character of a text becomes a string of its own."""
    rng = random.Random(8)
    common, rare = ["a", " ", "\t", "\n", "\n", "\u3000", "\u200b", "\u200c", "\u200d", "\U0001f600", "\u00e9"], ["\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    odd = ["", " ", "\n", "a ", "a\t", " \n", "a \n", "a\n ", "\t \n \n", *(f"a {end}b\t" for end in rare)]
    odd += ["".join(rng.choice(common if k % 3 else common + rare) for _ in range(rng.randint(1, 12))) for k in range(6000)]
    rows = spark.createDataFrame([(t,) for t in odd] + [(None,)], "text string").select("text", detect.trailing_whitespace(F.col("text")).alias("t"), detect.zero_width(F.col("text")).alias("z")).collect()
    plan = spark.range(1).select(detect.zero_width(F.col("id").cast("string")).alias("z"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan
    for text, tails, marks_ in rows:
        lines = (text or "").splitlines()
        flagged = sum(line.strip() != "" and line[-1] in " \t" for line in lines)
        assert [s["detail"] for s in tails] == ([f"{flagged}/{len(lines)}"] if lines else []), text
        n = sum((text or "").count(c) for c in "\u200b\u200c\u200d")
        assert [(s["detail"], s["score"]) for s in marks_] == ([(f"{n} zero-width chars", min(100, 70 + n // 2))] if n else []), text
