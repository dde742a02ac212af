"""Tables and folders of intermediate results where the session names them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local one stands in only where it is unset and Spark runs in one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read back.

    This cuts the lineage, and the files' true sizes take the place of estimates, which grow
    beyond measure in loops of joins. The files go when the process that runs the driver ends.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    return f"{shared_folder(spark).rstrip('/')}/files/{uuid.uuid4().hex}"
