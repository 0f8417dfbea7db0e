"""What the training-data operators share: the scratch folder, written tables, and column hygiene."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir, or one in the warehouse where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidemark-scratch"
    return root.rstrip("/")


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the scratch folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """As write_table, in buckets of a key: later groupings by it read the table without a shuffle."""
    spark, name = df.sparkSession, f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): other columns, whatever their names, are left behind; a null text is empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
