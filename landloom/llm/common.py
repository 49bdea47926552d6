"""Helpers shared by the operators: table access, ASCII folding, tables written to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def id_text(c: Column) -> Column:
    """An id on its way through pandas, where longs beside a null would become doubles."""
    return c.cast("long").cast("string")


def id_back(df: DataFrame, *names: str) -> DataFrame:
    """df with the ids of id_text() as longs again, in their places."""
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else c for c in df.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    if not found:
        found = tempfile.mkdtemp(prefix="landloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        _remove(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    The copy survives lost executors, cuts the lineage, and has a measured size, so that Spark's own
    limit decides whether a join may broadcast it. It is removed when the driver ends, or by forget().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/landloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._landloom_path = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Removes tables of materialise() which nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_landloom_path", None)
        if path:
            _remove(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]
