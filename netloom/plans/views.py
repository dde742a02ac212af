"""Spatial-network tables derived from the driver's tables: voxels, links, points, tiles, link features."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: SQL that runs unchanged on Spark and DuckDB. Labels start at 1 because 0 means "no node".
VIEWS = {
    "V": """SELECT x, y, z, x + 24*(y-1) + 576*(z-1) AS voxel_id, CAST(floor((z-1)/24.0) AS BIGINT) AS block_id, max(q)/10.0 AS r
FROM (SELECT l_partkey % 24 + 1 AS x, CAST(floor(l_extendedprice) AS BIGINT) % 24 + 1 AS y,
             CAST(floor(l_orderkey/80.0) AS BIGINT) + 1 AS z, l_quantity AS q
      FROM lineitem WHERE l_linenumber = 1) t
GROUP BY x, y, z""",
    "L": """SELECT o_orderkey AS link_label, o_custkey + 1 AS node_a, CAST(floor(o_totalprice) AS BIGINT) % n + 1 AS node_b,
       o_totalprice/1000.0 AS length, (o_orderkey % 97)/10.0 + 0.5 AS r, o_orderkey % 251 AS intensity
FROM orders CROSS JOIN (SELECT count(*) AS n FROM customer) c WHERE o_orderkey % 12 = 0""",
    "M": """SELECT o_orderkey AS link_label, o_custkey % k + 1 AS node_a, CAST(floor(o_totalprice) AS BIGINT) % k + 1 AS node_b,
       o_totalprice/1000.0 AS length, CAST(floor(o_totalprice/10000.0) AS BIGINT) + 1 AS n_voxel, o_orderkey % 251 AS intensity
FROM orders CROSS JOIN (SELECT CAST(floor(count(*)/10.0) AS BIGINT) AS k FROM customer) c WHERE o_orderkey % 12 = 0""",
    "N": """SELECT c_custkey + 1 AS node, c_custkey % 2 AS side, (c_custkey*7919) % 1000 + 1 AS x,
       CAST(floor(abs(c_acctbal)*100) AS BIGINT) % 1000 + 1 AS y, (c_custkey*104729) % 997 + 1 AS z
FROM customer""",
    "T": """SELECT s_suppkey AS tile, s_suppkey % 5 + 1 AS gx, CAST(floor(s_suppkey/5.0) AS BIGINT) % 5 + 1 AS gy,
       CAST(floor(s_suppkey/25.0) AS BIGINT) + 1 AS gz, s_acctbal > 0 AS reliable, s_acctbal/1000.0 AS model
FROM supplier""",
    "C": """SELECT l_orderkey*10 + l_linenumber AS link_label, l_suppkey AS block_id, l_extendedprice/1000.0 AS length,
       l_quantity/10.0 AS r, l_discount - 0.05 AS vx, l_tax - 0.04 AS vy, l_quantity/50.0 - 0.5 AS vz,
       l_returnflag AS class
FROM lineitem""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names = [t for t in TABLES if re.search(rf"\b{t}\b", VIEWS[name])]
    text = VIEWS[name]
    for t in names:
        text = re.sub(rf"\b{t}\b", "{" + t + "}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def with_views(sql: str) -> str:
    """``sql`` with the views that it names defined before its own common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql.strip()
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        return f"WITH {own[1] or ''}{head},\n{sql[own.end() :].strip()}"
    return f"WITH {head}\n{sql.strip()}"
