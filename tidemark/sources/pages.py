"""Raw pages of JSON, their headers, and the age and size of files, read in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.core import parse_day


def scan_raw_pages(pages: DataFrame, record: str, day: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(records of sound pages with their session, bad pages with a reason).

    pages: (session, payload), a JSON text {"records": [...]} of records of a schema `record`. A page is bad as a whole: malformed
    when it is no JSON object with a list of objects, wrong_day when a record's `day` isn't the page's session, lacks_key
    when a record's `key` is blank, repeated_key when two records share one, and empty without records.
    """
    schema = f"records array<struct<{record}>>, broken string"
    parsed = F.from_json("payload", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    p = pages.select("session", "payload", parsed.alias("p"))
    records = F.col("p.records")
    keys = F.transform(records, lambda r: F.trim(F.coalesce(r[key].cast("string"), F.lit(""))))
    reason = (
        F.when(F.col("p.broken").isNotNull() | records.isNull() | F.exists(records, lambda r: r.isNull()), "malformed")
        .when(F.size(records) == 0, "empty")
        .when(F.exists(records, lambda r: ~parse_day(r[day]).eqNullSafe(F.col("session"))), "wrong_day")
        .when(F.exists(keys, lambda k: k == ""), "lacks_key")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated_key")
    )
    judged = p.withColumn("reason", reason)
    rows = judged.where("reason is null").select("session", F.explode("p.records").alias("r"))
    return rows.select("session", "r.*").withColumn(key, F.trim(F.col(key).cast("string"))), judged.where("reason is not null").select("session", "reason")


def page_headers(pages: DataFrame) -> DataFrame:
    """(natural_key, source_kind, status, report, year, receipt, has_labels, is_financial) of filing pages (natural_key, payload).

    A key is company:year:report:kind. Of the first record come the receipt and, with the key's report, what the page is; labels
    are there when any record names an account. A payload that is no JSON object has no status.
    """
    parts = F.split("natural_key", ":")
    body = F.from_json("payload", "status string, records array<struct<receipt string, account string, statement string>>")
    p = pages.select("natural_key", parts.alias("k"), body.alias("b"))
    return p.select(
        "natural_key", F.get("k", F.lit(3)).alias("source_kind"), F.col("b.status").alias("status"), F.get("k", F.lit(2)).alias("report"), F.get("k", F.lit(1)).try_cast("int").alias("year"),
        F.get(F.col("b.records"), F.lit(0))["receipt"].alias("receipt"), F.coalesce(F.exists("b.records", lambda r: F.coalesce(r["account"], F.lit("")) != ""), F.lit(False)).alias("has_labels"),
        F.coalesce(F.exists("b.records", lambda r: r["statement"].isin("BS", "IS", "CF")), F.lit(False)).alias("is_financial"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of all files below a folder; only metadata is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def stale_files(found: DataFrame, now: Column, days: int, apart: tuple[str, ...] = ()) -> DataFrame:
    """(path, age_days) of files older than so many days; those in folders of the names `apart` are kept elsewhere and don't count."""
    folders = F.split("path", "/")
    own = found.where(~F.arrays_overlap(F.slice(folders, 1, F.size(folders) - 1), F.array(*map(F.lit, apart)))) if apart else found
    return own.where(F.col("modified") < now - F.make_interval(days=F.lit(days))).select("path", F.datediff(now, F.col("modified")).alias("age_days"))


def footprint(found: DataFrame, limit: int) -> DataFrame:
    """One row: files, bytes, and whether they are over the limit."""
    total = found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return total.withColumn("over", F.col("bytes") > limit)


def migration_candidates(pages: DataFrame, answered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the page of most records of each session that is not answered yet, ties to the smallest hash; number of pages passed over).

    pages: (session, hash, records).
    """
    best = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("records"), "hash"))
    ranked = pages.withColumn("place", best)
    return ranked.where("place = 1").drop("place").join(answered.select("session").distinct(), "session", "left_anti"), ranked.where("place > 1").agg(F.count("*").alias("skipped"))
