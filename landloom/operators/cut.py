"""Cutting lineage: a table written to the shared folder of spark.checkpoint.dir and read again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="landloom-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: plans of many rounds stay short, lost executors cost nothing before it, and its measured size decides about broadcasts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/landloom/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
