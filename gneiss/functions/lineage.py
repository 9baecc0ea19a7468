"""Cutting the lineage of iterative plans on reliable storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a local one if the master is local, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            found = tempfile.mkdtemp(prefix="gneiss-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written under the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
