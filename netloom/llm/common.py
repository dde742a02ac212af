"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts that one numpy pass takes together, in bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A local one stands in only where it is unset and Spark runs in one process, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return folder or current.get()


_owners: list[list[str]] = []


@contextmanager
def collecting(tables: list[str]) -> Iterator[None]:
    """Notes in ``tables`` what written() writes inside, so that its owner can drop it."""
    _owners.append(tables)
    try:
        yield
    finally:
        _owners.remove(tables)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written as Parquet in the shared scratch folder and read back.

    This cuts the lineage: lost executors cost a read, not the work above it. Tables stay until
    their owner drops them; those of nobody go with the folder.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _owners:
        _owners[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, tables: list[str]) -> None:
    """Deletes tables: for when all results that are read from them have been stored."""
    while tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one window of running sums.
SPAN = 4096


def sums_before(counts: DataFrame, key: str, at: str, n: str) -> DataFrame:
    """``counts`` (key without nulls, at: distinct whole numbers of it, n) with ``before``, the sum of n at smaller ``at`` of the key.

    Two levels of windows, within SPAN numbers and over such spans.
    """
    spans = counts.withColumn("__span", F.floor(F.col(at) / SPAN))
    sums = spans.groupBy(key, "__span").agg(F.sum(n).alias("__n"))
    earlier = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    above = sums.select(key, "__span", F.coalesce(F.sum("__n").over(earlier(Window.partitionBy(key), "__span")), F.lit(0)).alias("__above"))
    within = F.coalesce(F.sum(n).over(earlier(Window.partitionBy(key, "__span"), at)), F.lit(0))
    return spans.withColumn("__within", within).join(above, [key, "__span"]).withColumn("before", F.col("__above") + F.col("__within")).drop("__span", "__within", "__above")


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches whose texts make up about ``limit`` bytes, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        first = size = 0
        part: list[bytes] = []
        for i, value in enumerate(texts):
            text = value.as_py() or b""
            if part and size + len(text) > limit:
                yield batch.slice(first, i - first), part
                first, size, part = i, 0, []
            part.append(text)
            size += len(text)
        if part:
            yield batch.slice(first), part
