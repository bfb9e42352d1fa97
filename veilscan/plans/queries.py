"""One query per operator over tables derived from the driver's: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect
from ..functions.bits import unhex
from ..operators import carriers, envelope, jobs, marks, patterns, report, rollup, routing, rules, triage
from ..schemas import FINDINGS
from ..sources import files, images
from ..streaming import screen
from . import fixtures as fx

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def shared(spark: SparkSession, label: str) -> str:
    """A new place in the folder that driver and executors share; only a local session may go without a set one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='veilscan-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def told(signals: Column) -> list[Column]:
    """Signals as plain columns that SQL can be compared with; detail texts are left to the tests."""
    each = F.transform(signals, lambda s: F.concat_ws(":", s["name"], s["score"].cast("string")))
    return [detect.suspicion(signals).alias("suspicion"), F.array_join(each, ";").alias("signals")]


def metric(signals: Column) -> Column:
    return F.round(F.get(signals, 0)["metric"], 6).alias("metric")


def sha(column: Column, name: str) -> Column:
    return F.sha2(column, 256).alias(name)


# sources, sinks and rule tables
@query
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.scan_files(spark, sf_dir, "*.parquet")
    return found.select(F.substring_index("item_id", "/", -1).alias("item_id"), "ext", "length")


@query
def scan_pruned(spark, sf_dir):
    """The text files of a directory that also holds other ones, up to a size: both pruned before anything is read."""
    place = shared(spark, "pruned")
    texts = fx.table(spark, sf_dir, "benchmark").select("text")
    files.write_each(texts, f"{place}/texts")
    texts.write.csv(f"{place}/tables")
    found = files.scan_files(spark, place, extensions=rules.extensions_of("text_whitespace", "text_zerowidth"), most_bytes=250)
    return found.select("ext", "length", sha(F.col("content"), "sha256"))


@query
def text_items(spark, sf_dir):
    # every fourth text ends in half a character
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(fx.utf8(F.col("text")), unhex("C3"))).otherwise(fx.utf8(F.col("text")))
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", files.strict_text(raw).alias("t"))
    return docs.select("doc_id", sha(F.col("t.text"), "text_sha256"), F.col("t.error").isNotNull().alias("bad"))


@query
def text_lenient(spark, sf_dir):
    broken = F.concat(unhex("FF"), fx.utf8(F.col("text")), unhex("C3"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", sha(files.lenient_text(broken), "text_sha256"))


@query
def image_samples(spark, sf_dir):
    """Image files built from the sample table (grey, RGB, RGBA, BMP) and decoded again."""
    items = fx.media_items(spark, sf_dir).where("ext IN ('.png', '.bmp')")
    return images.image_samples(items).select("item_id", "width", "height", F.lower(F.hex("data")).alias("rgb_hex"), F.col("error").isNotNull().alias("bad"))


@query
def wav_samples(spark, sf_dir):
    """Sound files built from the sample table and decoded again; every seventh has 8-bit samples."""
    items = fx.sample_items(spark, sf_dir).select("vec_id", fx.wav_with_samples(F.col("samples"), F.col("vec_id") % 7 == 0).alias("content"))
    found = files.wav_samples(items)
    return found.select("vec_id", F.size(F.coalesce("samples", F.array().cast("array<int>"))).alias("n"), F.aggregate(F.coalesce("samples", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("error").isNotNull().alias("bad"))


@query
def exif_comment(spark, sf_dir):
    """JPEG files built around the comments and read again."""
    found = files.exif_comment(fx.comments(spark, sf_dir).select("doc_id", fx.jpeg_with_comment(F.col("user_comment")).alias("content")))
    return found.select("doc_id", F.hex("user_comment").alias("comment_hex"), F.col("error").isNotNull().alias("bad"))


@query
def signature_rules(spark, sf_dir):
    """Every rule of the table against every document: a broadcast join on ``contains`` with a table of fixed size."""
    rule = F.broadcast(rules.signature_rules(spark))
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", fx.utf8(F.col("text")).alias("content"))
    return docs.join(rule, F.contains(F.col("content"), F.col("needle"))).select("doc_id", "name", "score")


@query
def match_rules(spark, sf_dir):
    """Hundreds of patterns cut from the benchmark, looked for in every document by their rarest grams."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", fx.utf8(F.col("text")).alias("content"))
    return patterns.match_rules(docs, fx.needles(spark, sf_dir))


@query
def trailer_rules(spark, sf_dir):
    """End markers and trailer prefixes as rule tables instead of constants."""
    found = rules.trailers_by_rules(fx.file_items(spark, sf_dir), rules.end_markers(spark), rules.trailer_prefixes(spark))
    return found.select("item_id", F.length("trailer").alias("bytes"), "label")


@query
def analyzer_catalog(spark, sf_dir):
    """How many of the pages' and files' extensions each catalog entry takes."""
    catalog = rules.analyzer_catalog(spark).select("order", "name", "kind", "can_embed", "can_extract", F.explode_outer("extensions").alias("ext"))
    counts = fx.file_items(spark, sf_dir).groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    return catalog.join(F.broadcast(counts), "ext", "left").groupBy("order", "name", "kind", "can_embed", "can_extract").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"))


# routing
@query
def item_ext(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select("page_id", routing.extension(F.col("url")).alias("ext"))


@query
def route_carriers(spark, sf_dir):
    return routing.route_carriers(fx.file_items(spark, sf_dir)).select("item_id", "analyzer")


@query
def route_all(spark, sf_dir):
    return routing.route_all(fx.file_items(spark, sf_dir)).select("item_id", "analyzer")


@query
def route_embed(spark, sf_dir):
    return routing.route_embed(fx.file_items(spark, sf_dir)).select("item_id", "carrier")


@query
def route_embed_rejects(spark, sf_dir):
    return routing.route_embed_rejects(fx.file_items(spark, sf_dir)).select("item_id", "ext")


@query
def route_extract(spark, sf_dir):
    return routing.route_extract(fx.file_items(spark, sf_dir)).select("item_id", "carrier")


@query
def attachable_images(spark, sf_dir):
    return fx.file_items(spark, sf_dir).where(routing.attachable(F.col("ext"), F.col("length"))).select("item_id", "length")


@query
def mime_by_ext(spark, sf_dir):
    return routing.with_mime(fx.file_items(spark, sf_dir)).select("item_id", "mime")


# detectors
@query
def detect_zero_width(spark, sf_dir):
    found = fx.text_marked(spark, sf_dir).select("doc_id", detect.zero_width(F.col("text")).alias("s"))
    return found.select("doc_id", *told(F.col("s")), metric(F.col("s")))


@query
def detect_trailing_ws(spark, sf_dir):
    found = fx.text_trailing(spark, sf_dir).select("doc_id", detect.trailing_whitespace(F.col("text")).alias("s"))
    return found.select("doc_id", *told(F.col("s")), metric(F.col("s")))


@query
def detect_signatures(spark, sf_dir):
    found = fx.file_items(spark, sf_dir).select("item_id", detect.known_signatures(F.col("content")).alias("s"))
    return found.select("item_id", *told(F.col("s")))


@query
def detect_appended(spark, sf_dir):
    found = fx.file_items(spark, sf_dir).select("item_id", F.filter(detect.appended_data(F.col("ext"), F.col("content")), lambda s: s["name"] == "appended_data").alias("s"))
    return found.select("item_id", *told(F.col("s")), metric(F.col("s")))


@query
def detect_polyglot(spark, sf_dir):
    found = fx.file_items(spark, sf_dir).select("item_id", F.filter(detect.appended_data(F.col("ext"), F.col("content")), lambda s: s["score"] == 95).alias("s"))
    return found.where(F.size("s") > 0).select("item_id", *told(F.col("s")))


@query
def detect_jpeg_trailer(spark, sf_dir):
    found = fx.file_items(spark, sf_dir).where("ext IN ('.jpg', '.jpeg')").select("item_id", F.filter(detect.jpeg_trailer(F.col("content")), lambda s: s["name"] == "appended_data").alias("s"))
    return found.select("item_id", *told(F.col("s")), metric(F.col("s")))


@query
def detect_stegapp(spark, sf_dir):
    found = fx.file_items(spark, sf_dir).select("item_id", F.filter(detect.jpeg_trailer(F.col("content")), lambda s: s["name"] == "stegapp_marker").alias("s"))
    return found.where(F.size("s") > 0).select("item_id", *told(F.col("s")))


@query
def detect_exif_comment(spark, sf_dir):
    found = fx.comments(spark, sf_dir).select("doc_id", detect.exif_comment(F.col("user_comment")).alias("s"))
    return found.select("doc_id", *told(F.col("s")))


def _pixel(spark, sf_dir, name):
    found = fx.sample_items(spark, sf_dir).select("vec_id", F.filter(detect.pixel_signals(F.col("samples")), lambda s: s["name"] == name).alias("s"))
    return found.select("vec_id", *told(F.col("s")), metric(F.col("s")))


@query
def detect_pair_ratio(spark, sf_dir):
    return _pixel(spark, sf_dir, "lsb_pair_ratio")


@query
def detect_lsb_bias(spark, sf_dir):
    return _pixel(spark, sf_dir, "lsb_bit_bias")


@query
def detect_wav_bias(spark, sf_dir):
    found = fx.sample_items(spark, sf_dir).select("vec_id", detect.audio_signals(F.col("samples")).alias("s"))
    return found.select("vec_id", *told(F.col("s")), metric(F.col("s")))


@query
def byte_statistics(spark, sf_dir):
    """Pair ratio and lowest bits of whole texts as bytes: the batch kernel for long contents."""
    stats = fx.table(spark, sf_dir, "documents").select("doc_id", detect.sample_statistics(fx.utf8(F.col("text"))).alias("s"))
    return stats.select("doc_id", "s.n", "s.ones", F.round("s.pair_ratio", 6).alias("pair_ratio"))


# findings and reports
@query
def analyzer_suspicion(spark, sf_dir):
    return rollup.findings(fx.all_items(spark, sf_dir)).groupBy("analyzer", "suspicion").agg(F.count(F.lit(1)).alias("n"))


@query
def findings(spark, sf_dir):
    return rollup.findings(fx.all_items(spark, sf_dir)).select("item_id", "analyzer", "suspicion", F.size("signals").alias("n_signals"), "explanation")


@query
def signals_flat(spark, sf_dir):
    return rollup.signals_flat(rollup.findings(fx.all_items(spark, sf_dir))).select("item_id", "analyzer", "seq", "name", "score", "detail")


@query
def triage_heuristic(spark, sf_dir):
    found = rollup.findings(fx.all_items(spark, sf_dir)).where("analyzer = 'ai_triage'")
    return found.select("item_id", "suspicion", "explanation")


@query
def scan_count(spark, sf_dir):
    return rollup.findings(fx.all_items(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query
def severity_band(spark, sf_dir):
    found = rollup.findings(fx.all_items(spark, sf_dir))
    return found.select("item_id", "analyzer", rollup.band(F.col("suspicion")).alias("band"))


@query
def report_rows(spark, sf_dir):
    return rollup.report_rows(rollup.findings(fx.all_items(spark, sf_dir)))


@query
def report_json_rows(spark, sf_dir):
    rows = rollup.report_json(rollup.findings(fx.all_items(spark, sf_dir)))
    parsed = F.from_json("json", "path string, analyzer string, suspicion int, signals array<struct<name:string,score:int,detail:string>>, explanation string")
    return rows.select(parsed.alias("j")).select("j.path", "j.analyzer", "j.suspicion", F.size("j.signals").alias("n_signals"))


@query
def item_result_json(spark, sf_dir):
    """The result list of the item with the most signals, chosen from the whole table."""
    found = rollup.findings(fx.all_items(spark, sf_dir))
    chosen = found.where("analyzer = 'ai_triage'").orderBy(F.desc(F.size("signals")), "item_id").select("item_id").limit(1)
    own = rollup.report_json(found.join(F.broadcast(chosen), "item_id"))
    return rollup.json_list(own)


@query
def scan_report(spark, sf_dir):
    """A directory of files, one per document, scanned from end to end: found, read, screened and reported."""
    place = shared(spark, "scan")
    files.write_each(fx.text_marked(spark, sf_dir).select("text"), place)
    found = rollup.findings(files.scan_files(spark, place, "*.txt", tasks=files.many_tasks(spark)))
    return rollup.report_rows(found.where("analyzer = 'ai_triage'")).groupBy("suspicion", "band", "summary").agg(F.count(F.lit(1)).alias("n"))


@query
def report_table(spark, sf_dir):
    """All findings written as a report, a batch of it twice, and read again."""
    place = shared(spark, "report")
    found = rollup.findings(fx.all_items(spark, sf_dir))
    for scan in ("first", "second", "first"):
        report.write_report(found, place, scan)
    return report.report_counts(report.read_report(spark, place))


@query
def screen_directory(spark, sf_dir):
    """A directory screened by a stream of its files, then again after more files have come: only those are read."""
    place = shared(spark, "directory")
    texts = fx.table(spark, sf_dir, "benchmark")
    for half in (0, 1):
        files.write_each(texts.where(F.col("item_id") % 2 == half).select("text"), f"{place}/files/{half}")
        screen.screen_directory(spark, f"{place}/files", f"{place}/report", f"{place}/state", "all", extensions=(".txt",)).awaitTermination()
    rows = report.read_report(spark, f"{place}/report")
    return rows.groupBy("batch", "analyzer", "band").agg(F.count(F.lit(1)).alias("n"))


@query
def suspicion_by_analyzer_band(spark, sf_dir):
    return rollup.by_analyzer_and_band(rollup.findings(fx.all_items(spark, sf_dir)))


@query
def top_suspects(spark, sf_dir):
    return rollup.top_suspects(rollup.findings(fx.all_items(spark, sf_dir)), 20)


# capacity, marks and recovery
@query
def capacity_text(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", marks.capacity_of_lines(F.col("text")).alias("by_lines"), F.lit(1_000_000).alias("by_zero_width"))


@query
def capacity_samples(spark, sf_dir):
    return fx.sample_items(spark, sf_dir).select("vec_id", marks.capacity_of_samples(F.size("samples")).alias("capacity"))


@query
def capacity_catalog(spark, sf_dir):
    routed = routing.route_carriers(fx.file_items(spark, sf_dir)).where("fixed_capacity IS NOT NULL")
    return routed.groupBy("analyzer").agg(F.sum("fixed_capacity").alias("capacity"), F.count(F.lit(1)).alias("n"))


def _admission(spark, sf_dir):
    return marks.admit(fx.payloads(spark, sf_dir), fx.carriers(spark, sf_dir))


@query
def admit_payloads(spark, sf_dir):
    return _admission(spark, sf_dir)[0].select("carrier_id", "part", F.length("payload").alias("bytes"))


@query
def reject_payloads(spark, sf_dir):
    return _admission(spark, sf_dir)[1].select("carrier_id", "part", F.length("payload").alias("bytes"))


def _id_payload() -> Column:
    return fx.utf8(F.concat(F.lit("id:"), F.col("doc_id").cast("string")))


@query
def mark_zero_width(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", sha(marks.mark_zero_width(F.col("text"), _id_payload()), "sha256"))


@query
def recover_zero_width(spark, sf_dir):
    return fx.text_marked(spark, sf_dir).select("doc_id", F.hex(marks.recover_zero_width(F.col("text"))).alias("payload_hex"))


@query
def mark_trailing_ws(spark, sf_dir):
    return fx.text_ws_mark(spark, sf_dir).select("doc_id", sha(marks.mark_trailing(F.col("text"), F.col("payload")), "sha256"))


@query
def recover_trailing_ws(spark, sf_dir):
    marked = fx.text_ws_mark(spark, sf_dir).select("doc_id", marks.mark_trailing(F.col("text"), F.col("payload")).alias("text"))
    return marked.select("doc_id", F.hex(marks.recover_trailing(F.col("text"))).alias("payload_hex"))


@query
def mark_trailer(spark, sf_dir):
    return fx.file_items(spark, sf_dir).select("item_id", sha(F.hex(marks.mark_trailer(F.col("content"), fx.utf8(F.col("item_id")))), "sha256"))


@query
def recover_trailer(spark, sf_dir):
    found = fx.file_items(spark, sf_dir).select("item_id", F.hex(marks.recover_trailer(F.col("content"))).alias("payload_hex"))
    return found.where("payload_hex IS NOT NULL")


@query
def mark_samples(spark, sf_dir):
    marked = fx.sample_items(spark, sf_dir).select("vec_id", marks.mark_samples(F.col("samples"), F.col("payload")).alias("s"))
    return marked.select("vec_id", F.array_join(F.col("s").cast("array<string>"), ",").alias("samples"))


@query
def recover_samples(spark, sf_dir):
    """Marked samples, those of every third vector unmarked."""
    items = fx.sample_items(spark, sf_dir)
    mixed = items.select("vec_id", F.when(F.col("vec_id") % 3 > 0, marks.mark_samples(F.col("samples"), F.col("payload"))).otherwise(F.col("samples")).alias("s"))
    return mixed.select("vec_id", marks.recover_samples(F.col("s")).alias("r")).select("vec_id", F.hex("r.payload").alias("payload_hex"), "r.status")


@query
def recover_exif(spark, sf_dir):
    found = fx.comments(spark, sf_dir).select("doc_id", marks.recover_comment(F.col("user_comment")).alias("r"))
    return found.select("doc_id", F.hex("r.payload").alias("payload_hex"), "r.status")


@query
def mark_log(spark, sf_dir):
    """What was written where, and whether it was sealed."""
    items = fx.carrier_items(spark, sf_dir)
    marked = jobs.mark_items(items, envelope.derive_keys(items.where("salt IS NOT NULL"), PASSWORD)).where("status = 'ok'")
    return marked.groupBy("carrier", "encrypted").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_written").alias("bytes_written"))


# envelopes
def _packed(spark, sf_dir):
    text = fx.table(spark, sf_dir, "documents")
    return text.select("doc_id", envelope.pack(fx.utf8(F.col("text"))).alias("blob"))


@query
def pack_envelope(spark, sf_dir):
    return _packed(spark, sf_dir).select("doc_id", sha(F.hex("blob"), "sha256"))


@query
def unpack_envelope(spark, sf_dir):
    """Envelopes, some of them cut, with another magic or another version."""
    k = F.col("doc_id") % 5
    b = F.col("blob")
    from_third = F.call_function("substring", b, F.lit(6))
    broken = (
        F.when(k == 0, F.call_function("substring", b, F.lit(1), F.lit(20)))
        .when(k == 1, F.concat(unhex("58585858"), F.call_function("substring", b, F.lit(5))))
        .when(k == 2, F.concat(F.call_function("substring", b, F.lit(1), F.lit(4)), unhex("02"), from_third))
        .when(k == 3, F.call_function("substring", b, F.lit(1), F.length(b) - 1))
        .otherwise(F.concat(b, unhex("FFFF")))
    )
    found = _packed(spark, sf_dir).select("doc_id", envelope.unpack(broken).alias("e"))
    return found.select("doc_id", "e.status", F.length("e.payload").alias("bytes"), "e.encrypted")


#: Test value, not a secret.
PASSWORD = "correct horse"


def _salted(spark, sf_dir):
    """Every item has a salt of its own, so keys are derived for as many salts as there are items."""
    items = fx.table(spark, sf_dir, "benchmark")
    return items.select("item_id", fx.utf8(F.col("text")).alias("payload"), F.unhex(F.md5(F.col("item_id").cast("string"))).alias("salt"))


@query
def derive_keys(spark, sf_dir):
    return envelope.derive_keys(_salted(spark, sf_dir), PASSWORD).select(F.hex("salt").alias("salt_hex"), F.hex("key").alias("key_hex"))


def _sealed(spark, sf_dir):
    items = _salted(spark, sf_dir)
    keys = envelope.derive_keys(items, PASSWORD)
    nonce = F.unhex(F.lpad(F.hex("item_id"), 24, "0"))
    return items.join(keys, "salt").select("item_id", "payload", "salt", "key", envelope.seal(F.col("payload"), F.col("key"), nonce).alias("s"))


@query
def seal_payloads(spark, sf_dir):
    return _sealed(spark, sf_dir).select("item_id", F.length("s.sealed").alias("bytes"), F.hex("s.nonce").alias("nonce_hex"))


@query
def open_payloads(spark, sf_dir):
    """Sealed payloads opened again, those of every third item with a wrong key."""
    key = F.when(F.col("item_id") % 3 == 0, unhex("22" * 32)).otherwise(F.col("key"))
    opened = _sealed(spark, sf_dir).select("item_id", envelope.open_sealed(F.col("s.sealed"), key, F.col("s.nonce")).alias("p"))
    return opened.select("item_id", F.sha2("p", 256).alias("payload_sha256"))


@query
def mark_payloads(spark, sf_dir):
    """Items of every carrier marked with their ids, every third sealed; the changed part of plain ones as a hash."""
    items = fx.carrier_items(spark, sf_dir)
    marked = jobs.mark_items(items, envelope.derive_keys(items.where("salt IS NOT NULL"), PASSWORD))
    changed = F.coalesce("text", F.array_join(F.col("samples").cast("array<string>"), ","), F.hex("user_comment"))
    return marked.select("item_id", "carrier", "status", "bytes_written", "encrypted", F.when(~F.col("encrypted"), F.sha2(changed, 256)).alias("sha256"))


@query
def recover_payloads(spark, sf_dir):
    """The marked items routed, recovered, unpacked and opened again; those of every fifth hundred of ids have no key.
    The keys come from a store, so those of the second job are not derived again."""
    items = fx.carrier_items(spark, sf_dir)
    store = envelope.KeyStore(spark, shared(spark, "keys"))
    keys = store.keys(items, PASSWORD)
    known = store.keys(items.where("(cast(substring(item_id, 2) AS long) div 100) % 5 > 0"), PASSWORD)
    found = jobs.recover_items(jobs.mark_items(items, keys).where("status = 'ok'"), known)
    return found.select("item_id", "carrier", "status", F.decode("payload", "UTF-8").alias("payload"))


@query
def recover_files(spark, sf_dir):
    """The marked items written as PNG, BMP, WAV, JPEG, TIFF and text files, and recovered from the files' bytes."""
    items, place = fx.carrier_items(spark, sf_dir), shared(spark, "carriers")
    store = envelope.KeyStore(spark, shared(spark, "keys"))
    keys = store.keys(items, PASSWORD)
    fx.write_files(jobs.mark_items(items, keys).where("status = 'ok'"), place)
    known = store.keys(items.where("(cast(substring(item_id, 2) AS long) div 100) % 5 > 0"), PASSWORD)
    # Spark names all of them .txt, and the folders tell what they are
    written = files.scan_files(spark, place, tasks=files.many_tasks(spark)).withColumn("ext", F.regexp_extract("item_id", "/kind=([^/]+)/", 1))
    return jobs.recover_files(written, known).select("carrier", "status", F.decode("payload", "UTF-8").alias("payload"), "error")


@query
def custom_carrier(spark, sf_dir):
    """A caller's carrier for .bin texts beside the built-in ones: the envelope in hexadecimal digits at the end."""
    own = carriers.Carriers()
    own.register(
        carriers.Carrier(
            "text_hex", (".bin",), "text", lambda text, blob: F.concat(text, F.lit("<!--"), F.hex(blob), F.lit("-->")),
            lambda text: F.unhex(F.nullif(F.regexp_extract(text, "<!--([0-9A-F]*)-->$", 1), F.lit(""))), lambda text: F.lit(1_000_000),
        )
    )
    marked = jobs.mark_items(fx.carrier_items(spark, sf_dir), own=own).where("status = 'ok'")
    return jobs.recover_items(marked, own=own).select("item_id", "carrier", "status", F.decode("payload", "UTF-8").alias("payload"))


# scorers
def _items(spark, sf_dir):
    return fx.file_items(spark, sf_dir).select("item_id", "length", detect.known_signatures(F.col("content")).alias("signals"))


@query
def triage_custom(spark, sf_dir):
    """A scorer that counts signals, 40 points each."""
    return triage.triage(_items(spark, sf_dir), lambda item, signals: (40 * len(signals), f"{len(signals)} signals"))


@query
def triage_errors(spark, sf_dir):
    """A scorer that fails for items without signals and answers far too high for the others."""

    def scorer(item: dict, signals: list[dict]) -> tuple[int, str]:
        return 1000 // len(signals), "high"

    return triage.triage(_items(spark, sf_dir), scorer).select("item_id", "heuristic", "suspicion", F.col("error").isNotNull().alias("failed"))


@query
def triage_prompt(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", triage.prompt(F.col("item_id"), F.col("signals")).alias("prompt"))


@query
def parse_triage_reply(spark, sf_dir):
    found = fx.replies(spark, sf_dir).select("event_id", triage.parse_reply(F.col("reply")).alias("r"))
    return found.select("event_id", "r.score", "r.explanation", F.col("r.error").isNotNull().alias("failed"))


@query
def custom_analyzer(spark, sf_dir):
    """A caller's detector beside the built-in ones: contents of an odd length."""
    own = triage.Detectors()
    own.register("odd_length", lambda ext, content: detect.signals(F.when(F.length(content) % 2 == 1, detect.signal("odd", 10, "odd length"))), (".png", ".bin"))
    found = rollup.findings(fx.file_items(spark, sf_dir), own.columns())
    return found.where("analyzer IN ('odd_length', 'ai_triage')").groupBy("analyzer", "suspicion").agg(F.count(F.lit(1)).alias("n"))


@query
def screen_stream(spark, sf_dir):
    """The same findings from a stream over the documents table, appended to Parquet until all is read."""
    place = shared(spark, "stream")
    schema = fx.table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    items = docs.select(F.col("doc_id").cast("string").alias("item_id"), F.lit(".txt").alias("ext"), fx.utf8(F.col("text")).alias("content"))
    screen.screen_stream(items, f"{place}/out", f"{place}/state").awaitTermination()
    found = spark.read.schema(FINDINGS).parquet(f"{place}/out")
    return found.select("item_id", "analyzer", "suspicion", F.size("signals").alias("n_signals"))


