"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where spark.checkpoint.dir is not set and one machine runs all, as in tests.
OWN = "/tmp/pactum-shared"


def shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or OWN).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: it outlives lost executors, and later plans start from it."""
    spark = df.sparkSession
    path = f"{shared(spark)}/pactum-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
