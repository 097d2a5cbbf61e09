"""Tables written on the way: they cut lineage, and are deleted once nothing reads them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: the cluster's ``spark.checkpoint.dir``. Only a local master, which is one machine, may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return "file:///tmp/checkpoints"
    raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table and read it back, so that later jobs start from files."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete the files of tables that ``settle`` wrote and nothing reads any more; other tables stay."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f[: f.index("/", f.index("/quern-") + 1)] for f in df.inputFiles() if "/quern-" in f}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
