"""Rule tables: small dimensions whose size is fixed by this file or by the caller's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import after_last
from ..functions.detect import END_MARKERS, SIGNATURES, TRAILER_PREFIXES

# Detectors in the order in which they are tried; those without extensions see every item.
# (name, kind, extensions, can mark, can recover, fixed capacity)
CATALOG = (
    ("audio_wav", "carrier", (".wav",), True, True, None),
    ("filestruct_appended", "carrier", (".png", ".jpg", ".jpeg", ".gif", ".pdf"), False, False, 0),
    ("filestruct_exif", "carrier", (".jpg", ".jpeg", ".tiff"), True, True, 60_000),
    ("image_jpeg", "carrier", (".jpg", ".jpeg"), True, True, 10 * 1024 * 1024),
    ("image_lsb", "carrier", (".png", ".bmp"), True, True, None),
    ("text_whitespace", "carrier", (".txt", ".md"), True, True, None),
    ("text_zerowidth", "carrier", (".txt", ".md"), True, True, 1_000_000),
    ("signatures", "analyzer", (), False, False, None),
    ("ai_triage", "analyzer", (), False, False, None),
)

# MIME types of images; anything else is DEFAULT_MIME.
MIME = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".bmp": "image/bmp",
    ".gif": "image/gif",
    ".tiff": "image/tiff",
    ".webp": "image/webp",
}
DEFAULT_MIME = "application/octet-stream"
ATTACH_BYTES = 4 * 1024 * 1024


def analyzer_catalog(spark: SparkSession, own=None) -> DataFrame:
    """The catalog, with the entries of ``own`` (``carriers.Carriers``)."""
    rows = [(i, n, k, list(e), m, r, c) for i, (n, k, e, m, r, c) in enumerate(CATALOG)] + (own.catalog_rows() if own else [])
    return spark.createDataFrame(rows, "order int, name string, kind string, extensions array<string>, can_embed boolean, can_extract boolean, fixed_capacity long")


def extensions_of(*names: str) -> tuple[str, ...] | None:
    """The extensions that the named catalog entries look at, None if one of them looks at every item."""
    unknown = set(names) - {name for name, *_ in CATALOG}
    if unknown:
        raise ValueError(f"not in the catalog: {sorted(unknown)}")
    chosen = [extensions for name, _, extensions, *_ in CATALOG if name in names]
    return tuple(sorted({e for extensions in chosen for e in extensions})) if all(chosen) else None


def signature_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, bytearray(x.encode()), s, d) for n, x, s, d in SIGNATURES], "name string, needle binary, score int, detail string")


def end_markers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, bytearray.fromhex(m)) for e, m in END_MARKERS.items()], "ext string, marker binary")


def trailer_prefixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, bytearray.fromhex(p), n) for i, (p, n) in enumerate(TRAILER_PREFIXES)], "order int, prefix binary, label string")


def trailers_by_rules(items: DataFrame, markers: DataFrame, prefixes: DataFrame) -> DataFrame:
    """item_id, trailer (bytes after the last end marker of the item's type, none without one) and label (of the first
    prefix that it starts with) of ``items`` (item_id, ext, content), by rule tables: ``markers`` (ext, marker) and
    ``prefixes`` (order, prefix, label). Rule tables are short lists that people write; they are broadcast."""
    cut = items.join(F.broadcast(markers), "ext").select("item_id", after_last(F.col("content"), F.col("marker")).alias("trailer"))
    label = F.broadcast(prefixes.groupBy().agg(F.array_sort(F.collect_list(F.struct("order", "prefix", "label"))).alias("_rules")))
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("trailer"), r["prefix"])), 0)
    return cut.join(label, how="left").select("item_id", "trailer", first["label"].alias("label"))


def mime_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MIME.items()), "ext string, mime string")
