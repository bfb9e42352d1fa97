"""What the operators of this subpackage share: tables, shared folders, checkpoints and a gapless global order."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a
    temporary one; a cluster has no such folder, so there an error says what to set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="veilscan-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes wide rows once, as Parquet in the shared folder, and reads them again."""
    path = scratch(df.sparkSession, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Actions inside send at most so many rows to Python at once, for rows whose sizes Spark does not look at."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(rows: DataFrame) -> None:
    """Removes what ``stored`` wrote, once all that was made of it is stored itself."""
    hadoop = rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in rows.inputFiles()}:
        place = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(hadoop).delete(place, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where ``df`` has such a column already."""
    out = []
    for name in names:
        while name.lower() in map(str.lower, df.columns):
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ``_part`` and ``_pos``: the range partition a row falls into when sorted by ``keys`` and its place there.

    The result is checkpointed, so both columns stay as they are however often it is read. Give keys that tell
    rows apart (a hot first key is then cut between partitions by the next ones); rows equal in every key may
    trade places.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    ids = (
        df.repartitionByRange(partitions(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # the documented layout of the id: partition number above bit 33, row number in the partition below
    return cut(ids.withColumns({"_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"))


def offsets(ordered: DataFrame, **sums: str) -> DataFrame:
    """One row per ``_part`` of ``in_order``: for every ``name=column`` the total of all earlier partitions, and
    ``name_all`` of all of them; ``_rows`` and ``_rows_all`` count rows. It has as many rows as partitions."""
    from pyspark.sql import Window

    totals = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    names = ["_rows", *sums]
    return totals.select(
        "_part",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names],
        *[F.sum(n).over(everything).alias(f"{n}_all") for n in names],
    )
