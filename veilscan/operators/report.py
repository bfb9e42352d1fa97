"""Reports as files: findings written once per scan, in partitions that can be written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rollup import band, summary

#: A report's columns; those that name its partitions come last.
REPORT = "item_id string, suspicion int, band string, summary string, explanation string, error string, signals array<struct<name:string,score:int,detail:string,metric:double>>, scan string, batch long, analyzer string"


def write_report(found: DataFrame, path: str, scan: str, batch: int = 0) -> None:
    """Writes ``findings`` to the report at ``path``, in a partition per scan, batch and analyzer. Only partitions that
    get rows are replaced, so writing the same batch again changes nothing and other scans stay."""
    rows = found.select("item_id", "suspicion", band(F.col("suspicion")).alias("band"), summary(F.col("signals")).alias("summary"), "explanation", "error", "signals", F.lit(scan).alias("scan"), F.lit(batch).cast("long").alias("batch"), "analyzer")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan", "batch", "analyzer").parquet(path)


def report_sink(path: str, scan: str) -> Callable[[DataFrame, int], None]:
    """The same as a function for ``foreachBatch``: a batch of a stream is a partition of its own."""
    return lambda found, batch: write_report(found, path, scan, batch)


def read_report(spark: SparkSession, path: str, scan: str | None = None) -> DataFrame:
    """The rows of all scans, or of one; other scans' files are not read."""
    rows = spark.read.schema(REPORT).parquet(path)
    return rows if scan is None else rows.where(F.col("scan") == scan)


def report_counts(rows: DataFrame) -> DataFrame:
    """How many findings of each scan, analyzer and band a report holds."""
    return rows.groupBy("scan", "analyzer", "band").agg(F.count(F.lit(1)).alias("n"))
