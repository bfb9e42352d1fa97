"""Findings: from signals to an item's suspicion, band, triage and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect
from ..schemas import SIGNALS
from ..sources.files import lenient_text
from ..sources.media import COMMENT, IMAGE, SOUND, facts

HIGH, MID = 70, 30
NO_SIGNAL = "—"


def band(suspicion: Column) -> Column:
    return F.when(suspicion >= HIGH, "high").when(suspicion >= MID, "mid").otherwise("low")


def explanation(signals: Column) -> Column:
    told = F.array_join(F.transform(signals, lambda s: F.concat(s["name"], F.lit(":"), s["score"].cast("string"))), "; ")
    return F.when(F.size(signals) > 0, told).otherwise("no signals")


def summary(signals: Column) -> Column:
    each = F.transform(signals, lambda s: F.concat(s["name"], F.lit("("), s["score"].cast("string"), F.lit("): "), F.coalesce(s["detail"], F.lit(""))))
    return F.when(F.size(signals) > 0, F.array_join(each, "; ")).otherwise(NO_SIGNAL)


def file_signals(content: Column, text: Column, lenient: Column, trailer: Column, media: Column) -> dict[str, tuple[tuple[str, ...] | None, Column]]:
    """Detector name -> (extensions, or none for every item; its signals), in catalog order, for byte contents.
    A JPEG file's end marker is that of its type, so both trailer detectors share ``trailer``."""
    return {
        "audio_wav": (SOUND, detect.sound_signals(media["n"], media["ones"])),
        "filestruct_appended": (tuple(detect.END_MARKERS), detect.appended_signals(trailer)),
        "filestruct_exif": (COMMENT, detect.comment_signals(media["comment_bytes"], media["marked"])),
        "image_jpeg": ((".jpg", ".jpeg"), detect.jpeg_signals(content, trailer)),
        "image_lsb": (IMAGE, detect.image_signals(media["n"], media["ones"], media["pair_ratio"])),
        "text_whitespace": ((".txt", ".md"), detect.trailing_whitespace(text)),
        "text_zerowidth": ((".txt", ".md"), detect.zero_width(lenient)),
        "signatures": (None, detect.known_signatures(content)),
    }


def findings(items: DataFrame, extra: dict[str, tuple[tuple[str, ...] | None, Column]] | None = None) -> DataFrame:
    """One row per item and detector that matches it, triage last: item_id, analyzer, suspicion, signals,
    explanation, error.

    ``items`` has item_id, ext and content. All detectors read the row once and no shuffle is needed: the findings
    of an item are built in its row and spread afterwards. Images, sound and image comments are decoded in one
    Arrow function, which gets no other bytes. What is no image, sound or (for whitespace) valid UTF-8 gives its
    detector an ``error`` instead of signals; other detectors go on. ``extra`` adds detectors, see
    ``triage.Detectors``.
    """
    none = F.array().cast(SIGNALS)
    valid = F.coalesce(F.call_function("is_valid_utf8", F.col("content").cast("string")), F.lit(True))
    # the trailer and the text are computed once and used by several detectors
    rows = items.withColumn("_media", facts(F.col("ext"), F.col("content"))).withColumn("_trailer", detect.trailer_of(F.col("ext"), F.col("content")))
    rows = rows.withColumn("_valid", valid).withColumn("_text", F.when(F.col("_valid"), F.col("content").cast("string")).otherwise(""))
    entries = []
    built_in = file_signals(F.col("content"), F.col("_text"), lenient_text(F.col("content")), F.col("_trailer"), F.col("_media"))
    errors = {"text_whitespace": F.when(~F.col("_valid"), "not valid UTF-8")} | dict.fromkeys(("audio_wav", "filestruct_exif", "image_lsb"), F.col("_media.error"))
    for name, (extensions, found) in (built_in | (extra or {})).items():
        error = errors.get(name, F.lit(None))
        entry = F.struct(
            F.lit(name).alias("analyzer"), F.coalesce(found, none).cast(SIGNALS).alias("signals"), F.lit(None).cast("string").alias("explanation"), error.cast("string").alias("error")
        )
        entries.append(entry if extensions is None else F.when(F.col("ext").isin(*extensions), entry))
    rows = rows.select("item_id", F.array_compact(F.array(*entries)).alias("_found"))
    prior = F.flatten(F.transform("_found", lambda f: f["signals"]))
    rows = rows.withColumn("_prior", prior)
    triage = F.struct(F.lit("ai_triage").alias("analyzer"), F.col("_prior").alias("signals"), explanation(F.col("_prior")).alias("explanation"), F.lit(None).cast("string").alias("error"))
    # outer: the array is never empty, and a filter on its size would compute all detectors twice
    spread = rows.select("item_id", F.explode_outer(F.array_append("_found", triage)).alias("f"))
    return spread.select("item_id", "f.analyzer", detect.suspicion(F.col("f.signals")).alias("suspicion"), "f.signals", "f.explanation", "f.error")


def signals_flat(found: DataFrame) -> DataFrame:
    """A row per signal of ``findings`` other than triage: item_id, analyzer, seq, name, score, detail, metric."""
    own = found.where("analyzer <> 'ai_triage'")
    return own.select("item_id", "analyzer", F.posexplode("signals").alias("seq", "s")).select("item_id", "analyzer", "seq", "s.name", "s.score", "s.detail", "s.metric")


def by_analyzer_and_band(found: DataFrame) -> DataFrame:
    return found.groupBy("analyzer", band(F.col("suspicion")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def top_suspects(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` items with the highest suspicion in triage, ties in order of item_id."""
    return found.where("analyzer = 'ai_triage'").select("item_id", "suspicion").orderBy(F.desc("suspicion"), "item_id").limit(n)


def report_rows(found: DataFrame) -> DataFrame:
    return found.select("item_id", "analyzer", "suspicion", band(F.col("suspicion")).alias("band"), summary(F.col("signals")).alias("summary"))


def report_json(found: DataFrame) -> DataFrame:
    """item_id, analyzer and a JSON object per finding; write it with ``write.text`` as JSON lines."""
    fields = F.struct(F.col("item_id").alias("path"), "analyzer", "suspicion", F.transform("signals", lambda s: F.struct(s["name"].alias("name"), s["score"].alias("score"), s["detail"].alias("detail"))).alias("signals"), "explanation")
    return found.select("item_id", "analyzer", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def json_list(rows: DataFrame) -> DataFrame:
    """item_id and one JSON array of an item's findings (rows of ``report_json``: at most one per detector)."""
    return rows.groupBy("item_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("json")), ","), F.lit("]")).alias("json"))


def item_result(found: DataFrame, item_id: str) -> DataFrame:
    """The findings of one item as one JSON array; the filter is applied before anything is computed."""
    return json_list(report_json(found.where(F.col("item_id") == item_id)))
