"""Screening of streams: the same expressions, without state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.report import report_sink
from ..operators.rollup import findings
from ..sources.files import scan_files


def screen_stream(items: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends the findings of a stream of items (item_id, ext, content) to Parquet at ``path``
    and stops when what is there now has been read."""
    out = findings(items).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()


def screen_directory(spark: SparkSession, root: str, path: str, checkpoint: str, scan: str, extensions: tuple[str, ...] | None = None, most_bytes: int | None = None) -> StreamingQuery:
    """Starts a query that screens the files below ``root`` that no earlier run with this ``checkpoint`` has seen, and
    stops when those are done. The report goes to ``path`` under the name ``scan`` (see ``operators.report``), a
    partition for each batch, so a batch that is repeated after a failure replaces what it wrote."""
    found = findings(scan_files(spark, root, extensions=extensions, most_bytes=most_bytes, stream=True))
    out = found.writeStream.foreachBatch(report_sink(path, scan)).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()
