"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where none is set, a temporary folder serves a local
    session; a cluster's executors would not see it, so there it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder; removed when the application ends, if not before."""
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    _LIVE.append(path)
    return path


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame as Parquet and read it back: cuts lineage and survives the loss of
    executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables made inside when left; their frames must be used up by then."""
    before = len(_LIVE)
    try:
        yield
    finally:
        for path in _LIVE[before:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _LIVE[before:]
