"""Which detectors see an item, and which carrier marks or recovers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ATTACH_BYTES, CATALOG, DEFAULT_MIME, MIME, analyzer_catalog, mime_types


def extension(path: Column) -> Column:
    """The lower-case last suffix of a path, with its dot; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def route_carriers(items: DataFrame) -> DataFrame:
    """One row per item and carrier whose extensions hold the item's ``ext``, by a broadcast join with the catalog."""
    catalog = analyzer_catalog(items.sparkSession).where("kind = 'carrier'")
    each = catalog.select("order", F.col("name").alias("analyzer"), "can_embed", "can_extract", "fixed_capacity", F.explode("extensions").alias("ext"))
    return items.join(F.broadcast(each), "ext")


def route_all(items: DataFrame) -> DataFrame:
    """One row per item and detector without extensions. The detectors are a handful of catalog entries."""
    names = [name for name, kind, *_ in CATALOG if kind == "analyzer"]
    return items.withColumn("analyzer", F.explode(F.array(*[F.lit(n) for n in names])))


def first_by_extension(items: DataFrame, able: str, own=None) -> DataFrame:
    """ext and carrier: the first of the catalog, with the caller's ``own`` carriers, that is able to do it."""
    catalog = analyzer_catalog(items.sparkSession, own).where(F.col(able))
    return catalog.select("order", "name", F.explode("extensions").alias("ext")).groupBy("ext").agg(F.min_by("name", "order").alias("carrier"))


def route_embed(items: DataFrame) -> DataFrame:
    """The carrier that marks each item: the first in catalog order. The first choice is made per extension, on the
    catalog's side, so the items are neither expanded nor shuffled."""
    return items.join(F.broadcast(first_by_extension(items, "can_embed")), "ext")


def route_embed_rejects(items: DataFrame) -> DataFrame:
    return items.join(F.broadcast(first_by_extension(items, "can_embed")), "ext", "left_anti")


def route_extract(items: DataFrame) -> DataFrame:
    return items.join(F.broadcast(first_by_extension(items, "can_extract")), "ext")


def attachable(ext: Column, length: Column) -> Column:
    """Whether an item may go along with a scorer's request: an image of bounded size."""
    return ext.isin(*MIME) & (length <= ATTACH_BYTES)


def with_mime(items: DataFrame) -> DataFrame:
    found = items.join(F.broadcast(mime_types(items.sparkSession)), "ext", "left")
    return found.withColumn("mime", F.coalesce("mime", F.lit(DEFAULT_MIME)))
