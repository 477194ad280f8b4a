"""Intermediate results in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one of this process, if that runs all tasks; on a cluster that is an error, as
    each executor would write to a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset under {master or 'an unknown master'}: name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="photonlake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def kept(df: DataFrame, name: str = "part") -> DataFrame:
    """df written once into the shared folder and read again: lineage ends there, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/photonlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
