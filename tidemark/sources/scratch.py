"""Tables written between steps: a folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or below the warehouse where it is unset; never a folder of one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidemark-scratch"
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written and read back: what follows neither recomputes it nor carries its plan."""
    path = f"{scratch(df.sparkSession)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
