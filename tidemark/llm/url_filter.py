"""URL filters: domain and path rules, then a blocked Bloom filter of listed URLs in front of an exact hash join.

A blocked Bloom filter keeps all bits of a key in one block of 512 bits, so a probe is one equi-join on the block number
and a few bit tests. Blocks are built by a bitwise-or aggregate, and only URLs that pass go on to the exact join, which
removes false positives. All of it is DataFrame work; nothing of the list's size goes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import write_table

#: 64-bit words of a block, bits set for a key, and bits of filter for each listed URL.
WORDS, HASHES, BITS_PER_KEY = 8, 6, 12


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling for the URLs of a page: no scheme, query, fragment, www., m., final slash or .html."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"(?:\.html|/+)$", ""))


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def _bits(key: Column) -> list[Column]:
    """The WORDS words in which a key's bits are set."""
    places = [F.pmod(_hash(key, 1 + i), F.lit(64 * WORDS)) for i in range(HASHES)]
    words = []
    for w in range(WORDS):
        bit = F.lit(0).cast("long")
        for p in places:
            bit = bit.bitwiseOR(F.when(F.floor(p / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
        words.append(bit)
    return words


def block_count(keys: DataFrame) -> int:
    """Blocks for the distinct keys' number, counted over all of them."""
    n = keys.count()
    return max(1, math.ceil(n * BITS_PER_KEY / (64 * WORDS)))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w7) from distinct keys (key)."""
    words = keys.select(F.pmod(_hash(F.col("key"), 0), F.lit(blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_bits(F.col("key")))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(urls: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """Rows of urls (key, ...) whose bits are all set in their block: all listed ones and few others."""
    names = urls.columns
    probe = urls.withColumn("block", F.pmod(_hash(F.col("key"), 0), F.lit(blocks))).join(filter_blocks, "block")
    for i, w in enumerate(_bits(F.col("key"))):
        probe = probe.where(F.col(f"w{i}").bitwiseAND(w) == w)
    return probe.select(names)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of a short list of rules (verdict, host/path) that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        h, p = text[:at], text[at:]
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judged_urls(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): the verdict of the longest fitting rule, or else block if listed.

    listed has one column `key` of canonical URLs; nulls and repeats in it count once or not at all. A url that is null or
    has no :// has an empty host and path, fits no rule, and is listed only if the empty key is. Rows that repeat stay.
    Extra columns are ignored; empty tables give empty results or, for the list, verdict allow.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path")).alias("key"))
    keys = write_table(listed.select("key").where("key is not null").distinct(), "listed")
    blocks = block_count(keys)
    asked = rows.select("key").distinct()
    hits = possible_hits(asked, bloom_blocks(keys, blocks), blocks).join(keys, "key").select("key", F.lit(True).alias("hit"))
    out = rows.join(hits, "key", "left")
    seen = F.coalesce("hit", F.lit(False))
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(seen, "block").otherwise("allow")).alias("verdict"), seen.alias("listed")
    )
