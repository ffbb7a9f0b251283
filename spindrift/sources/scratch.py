"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, or the context's checkpoint folder. A temporary folder is made only where neither is set and all runs in one process."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or getattr(spark, "_spindrift_scratch", None):
        return path.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark._spindrift_scratch = f"file://{tempfile.mkdtemp(prefix='spindrift-')}"
    return spark._spindrift_scratch


def fresh(spark: SparkSession, kind: str) -> str:
    """A new path in it, which goes with the folder's owner or by drop()."""
    return f"{folder(spark)}/spindrift-{kind}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str = "rows") -> DataFrame:
    """The rows written and read again, which cuts the lineage; lost executors lose nothing of it."""
    path = fresh(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spindrift_scratch = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Removes tables made by kept() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_spindrift_scratch", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
