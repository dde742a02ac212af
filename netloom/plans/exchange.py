"""Queries: tables written as the network's files in the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spatial
from ..sources import files
from ..sources.scratch import new_folder
from .coordinates import r6
from .registry import Tables, query
from .sources import TREE, tree


@query("s1_block_reader", "SELECT block_id AS layer, count(*) AS n, sum(voxel_id)::BIGINT AS ids, round(sum(r), 4) AS r FROM V GROUP BY block_id")
def s1(t: Tables) -> DataFrame:
    """Voxels written as one folder a block and read by the block reader: what each block holds."""
    path = new_folder(t.spark)
    rows = t.V.select(F.lit("d").alias("dataset"), F.lit("s").alias("stack"), F.lit(1).alias("idx_1"), F.lit(1).alias("idx_2"), F.col("block_id").cast("int").alias("layer"), F.col("voxel_id").alias("ind"), F.col("r").cast("float").alias("r"))
    rows.repartition("layer").write.partitionBy("layer").parquet(path)
    return files.read_blocks(t.spark, path).groupBy(F.col("layer").cast("long").alias("layer")).agg(F.count("*").alias("n"), F.sum("ind").alias("ids"), F.round(F.sum(F.round("r", 1).cast("double").cast("decimal(10,1)")).cast("double"), 4).alias("r"))


@query("s3_analysis_table", "SELECT side AS stack, nation, n, total FROM (SELECT c_custkey % 2 AS side, c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1, 2) q WHERE side = 1")
def s3(t: Tables) -> DataFrame:
    """A result table written by data set and stack; one stack read back."""
    path = new_folder(t.spark)
    out = t.customer.groupBy((F.col("c_custkey") % 2).alias("stack"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    files.write_analysis(out.withColumn("dataset", F.lit("customers")), path)
    return files.read_analysis(t.spark, path, dataset="customers", stack="1").select(F.col("stack").cast("long").alias("stack"), "nation", "n", "total")


D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


@query("s5_descriptor_channels", f"""WITH one AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, node FROM N), two AS (SELECT x + 0.25 AS x, y - 0.25 AS y, z::DOUBLE AS z, node FROM N WHERE node % 3 <> 0),
p AS (SELECT a.node AS a, b.node AS b, {D3} AS d FROM one a JOIN two b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 WHERE {D3} <= 1), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i, row_number() OVER (PARTITION BY b ORDER BY d, a) AS j FROM p) SELECT a AS node, round(d, 6) AS distance FROM k WHERE i = 1 AND j = 1""")
def s5(t: Tables) -> DataFrame:
    """Points written as space-delimited text, one folder a channel; kept are those of the first that have a mutual nearest within 1 in the second."""
    path = new_folder(t.spark)
    one = t.N.select(*(F.col(k).cast("double").alias(k) for k in "xyz"), "node")
    two = one.where("node % 3 <> 0").select((F.col("x") + 0.25).alias("x"), (F.col("y") - 0.25).alias("y"), "z", "node")
    channels = []
    for name, rows in (("0", one), ("1", two)):
        rows.write.csv(f"{path}/{name}", sep=" ")
        channels.append(files.read_descriptors(t.spark, f"{path}/{name}", 1).withColumn("node", F.col("f0").cast("long")))
    return spatial.mutual_nearest(*channels, "node", 1).select(F.col("a").alias("node"), r6(F.col("distance")).alias("distance"))


@query("s6_tree_files", f"WITH {TREE} SELECT id, round(x + 1, 6) AS x, round(y + 2, 6) AS y, round(z + 3, 6) AS z, parent FROM tree")
def s6(t: Tables) -> DataFrame:
    """A tree written as files with offset lines, and read with the offset added."""
    path = new_folder(t.spark)
    rows = tree(t).select((F.col("id") % 4).alias("part"), F.concat_ws(" ", "id", F.lit("2"), "x", "y", "z", F.lit("1.0"), "parent").alias("value"))
    head = rows.select("part").distinct().select("part", F.lit("# OFFSET 1 2 3").alias("value"))
    rows.unionByName(head).repartition("part").write.partitionBy("part").text(path)
    return files.read_trees(t.spark, f"{path}/part=*").select("id", *(r6(F.col(k)).alias(k) for k in "xyz"), "parent")


@query("s7_acquisition_files", "SELECT gx, gy, gz, tile AS cut, round(gx * 0.5, 6) AS sx, round(gy * 0.25, 6) AS sy, round(gz * 2.0, 6) AS sz FROM T")
def s7(t: Tables) -> DataFrame:
    """A file of keys and values for each tile; every other one lacks its grid index, which is derived from the positions."""
    path = new_folder(t.spark)
    known = F.when(F.col("tile") % 2 == 0, F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"g{k}").cast("string").alias("v")) for k in "xyz"))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    place = F.array(F.struct(F.lit("cut_count").alias("k"), F.col("tile").cast("string").alias("v")), *(F.struct(F.lit(f"{k}_mm").alias("k"), (F.col(f"g{k}") * s).cast("string").alias("v")) for k, s in (("x", 0.5), ("y", 0.25), ("z", 2.0))))
    lines = t.T.select("tile", F.explode(F.concat(known, place)).alias("p")).select("tile", F.concat_ws(": ", "p.k", "p.v").alias("value"))
    lines.repartition("tile").write.partitionBy("tile").text(path)
    return files.read_acquisition(t.spark, path).select("gx", "gy", "gz", "cut", *(r6(F.col(f"s{k}")).alias(f"s{k}") for k in "xyz"))
