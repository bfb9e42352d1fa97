"""The corpus pipeline: quality, near-duplicates, personal data and packing, each stage on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and hands the reread table on. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.common import stored, table, unused
from veilscan.llm.neardup import distinct_documents
from veilscan.llm.packing import added_tokens, pack_documents
from veilscan.llm.pii import find_pii, redact
from veilscan.llm.quality import THRESHOLD, train, with_quality


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay. Null texts are scored as empty ones, repeated rows
    alike; without labelled rows every score is one half and no document stays; an empty table gives no rows."""
    model = train(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "_score")
    return with_quality(docs, model, score).where(F.col(score) >= THRESHOLD).drop(score)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingle sets of similarity 0.8 or more) the row with the smallest
    doc_id stays, and beside it the first of the rows without doc_id. Rows that repeat a doc_id are told apart. Null
    texts count as empty, and texts without words are copies of each other; an empty table gives no rows."""
    return distinct_documents(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets; n_chars follows the text. Rows are kept one
    for one; null texts stay null and texts without spans as they are; an empty table gives no rows."""
    (pii,) = unused(docs, "_pii")
    found, some = find_pii(docs, "text", pii), F.size(pii) > 0
    clean = found.withColumn("text", F.when(some, redact(F.col("text"), F.col(pii))).otherwise(F.col("text")))
    counted = clean.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return counted.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of at most 2048: a row per piece with its ids (little-endian unsigned
    32-bit), sequence and offset. Null texts are empty ones, a piece with the end id; rows without doc_id and repeated
    rows are packed like others; an empty table gives no rows."""
    import public_tokenizers as public

    added = added_tokens(public.path("byte_bpe_50k.json"))
    return pack_documents(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, 2048, keep_ids=True, added=added)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("near_duplicates", deduplicate),
    ("personal_data", remove_personal_data),
    ("packing", pack),
]

#: Neither the classifier nor the fingerprints nor the tokens can be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
