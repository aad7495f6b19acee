"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, have) if p)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, a local session gets a folder of its own; a cluster has none to guess."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file:///tmp/tidepool-{os.getuid()}/shared"
    return where.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    The written table cuts the lineage: it survives lost executors, and later readers neither recompute nor re-shuffle it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidepool/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that materialise() wrote and nothing will read again."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
