"""Publishing, verifying, pruning and reuse of datasets."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.core import PointInTimeError
from tidemark.sources import datasets as D


def test_identity_ignores_input_order():
    assert D.identity("k", {"a": 1}, ["x", "y"]) == D.identity("k", {"a": 1}, ["y", "x"]) != D.identity("k", {"a": 2}, ["x", "y"])


def test_publish_verify_scan(spark, tmp_path):
    folder, df = f"file://{tmp_path}", spark.range(100).select(F.col("id").alias("v"), (F.col("id") % 3).alias("year"))
    path = D.publish(df, folder, "a", ["year"])
    assert D.publish(df.orderBy(F.desc("v")), folder, "a", ["year"]) == path
    assert D.verify(spark, path, ["year"]).isEmpty()
    assert sorted(r.v for r in D.scan(spark, path, ["year"], F.col("p_year") == 1).collect()) == list(range(1, 100, 3))
    with pytest.raises(PointInTimeError):
        D.publish(df.where("v < 99"), folder, "a", ["year"])
    df.where("v = 5").withColumn("p_year", F.col("year")).write.mode("append").partitionBy("p_year").parquet(f"{path}/data")
    assert [r.year for r in D.verify(spark, path, ["year"]).collect()] == [2]


def test_reusable_is_null_safe(spark):
    a = spark.createDataFrame([(1, "h"), (2, None)], "session int, h string")
    b = spark.createDataFrame([(1, "h"), (2, None), (3, "h"), (1, "x")], "session int, h string")
    assert sorted((r.session, str(r.h), r.reuse) for r in D.reusable(a, b, ["session", "h"]).collect()) == [(1, "h", True), (1, "x", False), (2, "None", True), (3, "h", False)]
