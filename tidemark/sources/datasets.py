"""Published datasets: Parquet with a manifest of identity, partitions and fingerprints; verification and reuse."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import PointInTimeError


def identity(kind: str, policy: dict, inputs: list[str]) -> str:
    """Kind and the first 16 hex digits of a digest of what determines the dataset."""
    text = json.dumps({"kind": kind, "policy": policy, "inputs": sorted(inputs)}, sort_keys=True, separators=(",", ":"))
    return f"{kind}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """Per partition: rows and an order-free sum of row hashes."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(row).alias("fingerprint"))


def publish(df: DataFrame, folder: str, name: str, by: list[str]) -> str:
    """Write df under folder/name by partition with its manifest; an equal dataset is left alone, another of that name an error."""
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{name}"
    manifest = fingerprint(df, by)
    if _exists(spark, f"{path}/manifest"):
        old = spark.read.parquet(f"{path}/manifest")
        if not old.exceptAll(manifest).isEmpty() or not manifest.exceptAll(old).isEmpty():
            raise PointInTimeError(f"{name} is published with other contents")
        return path
    df.withColumns({f"p_{c}": F.col(c) for c in by}).write.partitionBy(*[f"p_{c}" for c in by]).parquet(f"{path}/data")
    manifest.write.parquet(f"{path}/manifest")
    return path


def publish_identity(df: DataFrame, folder: str, kind: str, policy: dict, inputs: list[str], by: list[str]) -> str:
    """publish under the name of the identity, so equal kind, policy and inputs can hold no two contents."""
    return publish(df, folder, identity(kind, policy, inputs), by)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def verify(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Partitions whose rows or fingerprint are not those of the manifest; empty if all is well."""
    data = spark.read.parquet(f"{path}/data")
    data = data.drop(*[f"p_{c}" for c in by])
    want = spark.read.parquet(f"{path}/manifest").withColumnsRenamed({"rows": "want_rows", "fingerprint": "want"})
    both = fingerprint(data, by).join(want, by, "full")
    return both.where(~(F.col("rows").eqNullSafe(F.col("want_rows")) & F.col("fingerprint").eqNullSafe(F.col("want"))))


def scan(spark: SparkSession, path: str, by: list[str], where: Column | None = None) -> DataFrame:
    """Rows of a published dataset; a condition on p_<partition> columns prunes folders."""
    data = spark.read.parquet(f"{path}/data")
    return (data if where is None else data.where(where)).drop(*[f"p_{c}" for c in by])


def reusable(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """now with `reuse`: whether the same partition with equal hashes was built before."""
    known = before.select(*keys).distinct().withColumn("known", F.lit(True))
    condition = None
    for k in keys:
        c = now[k].eqNullSafe(known[k])
        condition = c if condition is None else condition & c
    return now.join(known, condition, "left").select(*[now[c] for c in now.columns], F.coalesce(known["known"], F.lit(False)).alias("reuse"))
