"""Tables in the folder that driver and executors share; loops cut their lineage here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="registra-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Tables that cut() wrote and clean() hasn't deleted.
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Writes a frame and reads it back, so what follows survives the loss of any executor. Results may read such tables, so they stay until clean()."""
    path = f"{shared_folder(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes all tables of cut(), once the results that read them were taken; returns how many there were."""
    jvm, n = spark.sparkContext._jvm, len(_written)
    while _written:
        p = jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n
