"""Readers and writers of the network's files, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import checkpointed

#: Columns of a block table (fixed values).
BLOCK_SCHEMA = "dataset string, stack string, idx_1 int, idx_2 int, layer int, ind long, r float"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Centreline voxels of all blocks; missing and unreadable files are skipped."""
    return spark.read.schema(BLOCK_SCHEMA).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "false").parquet(path)


def gather_blocks(blocks: DataFrame, idx_1: tuple[int, int], idx_2: tuple[int, int], layer: tuple[int, int]) -> DataFrame:
    """The voxels of an index range of blocks; on a table partitioned by these columns only its files are read."""
    return blocks.where(F.col("idx_1").between(*idx_1) & F.col("idx_2").between(*idx_2) & F.col("layer").between(*layer))


def write_analysis(df: DataFrame, path: str, keys: Sequence[str] = ("dataset", "stack")) -> None:
    """A result table, partitioned by its keys; only the partitions at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_analysis(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """A result table, cut down to the given keys by partition pruning."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def write_region_csv(df: DataFrame, path: str) -> None:
    """A regional table as CSV twice: ``all``, and ``finite`` with the rows whose numbers are all finite."""
    df.write.mode("overwrite").csv(f"{path}/all", header=True)
    finite_rows(df).write.mode("overwrite").csv(f"{path}/finite", header=True)


def finite_rows(df: DataFrame) -> DataFrame:
    """Rows whose double and float columns are all finite."""
    out = df
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out = out.where(F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf")))
    return out


def read_descriptors(spark: SparkSession, path: str, features: int = 2) -> DataFrame:
    """Space-delimited points: x, y, z, f0, …, and the file they are from."""
    schema = ", ".join(["x double", "y double", "z double", *(f"f{i} double" for i in range(features))])
    return spark.read.schema(schema).csv(path, sep=" ").withColumn("file", F.input_file_name())


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Tree files: file, id, type, x, y, z, r, parent; OFFSET of the header lines is added to the coordinates."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("line")).where("line <> ''")
    number = r"([-+0-9.eE]+)"
    head = lines.where("line LIKE '#%OFFSET%'")
    offsets = head.groupBy("file").agg(*(F.max(F.regexp_extract("line", rf"OFFSET\s+{number}\s+{number}\s+{number}", i).cast("double")).alias(f"o{k}") for i, k in enumerate("xyz", 1)))
    parts = lines.where("line NOT LIKE '#%'").withColumn("p", F.split("line", r"\s+"))
    rows = parts.select("file", F.col("p")[0].cast("long").alias("id"), F.col("p")[1].cast("int").alias("type"), *(F.col("p")[i].cast("double").alias(k) for i, k in ((2, "x"), (3, "y"), (4, "z"), (5, "r"))), F.col("p")[6].cast("long").alias("parent"))
    joined = rows.join(offsets, "file", "left")
    return joined.select("file", "id", "type", *((F.col(k) + F.coalesce(f"o{k}", F.lit(0.0))).alias(k) for k in "xyz"), "r", "parent")


def read_acquisition(spark: SparkSession, path: str) -> DataFrame:
    """``key: value`` files below a folder: one row a file with gx, gy, gz, cut and position sx, sy, sz (mm).

    Where a file has no grid index it is the position in units of the median step of its axis.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), F.split("value", r"\s*:\s*", 2).alias("kv")).where("size(kv) = 2")
    names = ("x", "y", "z", "cut_count", "x_mm", "y_mm", "z_mm")
    wide = checkpointed(lines.groupBy("file").agg(*(F.max(F.when(F.col("kv")[0] == k, F.col("kv")[1])).cast("double").alias(k) for k in names)))  # each file is opened once

    for k in "xyz":
        places = wide.select(F.round(f"{k}_mm", 6).alias("p")).distinct()
        step = places.withColumn("d", F.lead("p").over(Window.partitionBy(F.lit(0)).orderBy("p")) - F.col("p")).agg(F.median("d").alias("step"), F.min("p").alias("low"))
        wide = wide.crossJoin(F.broadcast(step)).withColumn(f"g{k}", F.coalesce(F.col(k), F.round((F.col(f"{k}_mm") - F.col("low")) / F.coalesce("step", F.lit(1.0))) + 1).cast("long")).drop("step", "low")  # step: one row
    return wide.select("file", "gx", "gy", "gz", F.col("cut_count").cast("long").alias("cut"), F.col("x_mm").alias("sx"), F.col("y_mm").alias("sy"), F.col("z_mm").alias("sz"))


def missing_outputs(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without a matching output."""
    return inputs.join(outputs.select(key), key, "left_anti")
