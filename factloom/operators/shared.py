"""Tables written once in the folder that all executors share, for results that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset, one below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return f"{base}/{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` computed once: written as Parquet, in a folder for each value of the columns ``by``, and read back.

    A lost executor costs a read. The folder is scratch space, to be cleared with the job's other checkpoints.
    """
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
