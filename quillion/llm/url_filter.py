"""URL filters (operator 8): a blocked Bloom filter in front of an exact hash join.

The list holds canonical URLs, each a host directly followed by a path that
starts with ``/`` (``example.org/es/``), with a verdict. An entry fits a URL if
the URL's host is the entry's host or a subdomain of it and the URL's path
starts with the entry's path; the longest fitting entry wins, among equally
long ones that with the longer host.

Every URL is turned into the canonical keys that could be listed: each suffix
of its host of a listed label count, with each prefix of its path of a listed
length. Keys that hit the filter go on to the exact join, which removes false
positives; rows without a hit never reach it.

Defined results: a null URL, or one without ``://``, has empty host and path
and gets the default verdict; repeated rows are judged one by one; null page
ids are kept; an empty table gives an empty table; other columns are ignored,
whatever their names; URLs may have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of 64 bits in the filter: enough for a false-positive rate below 1 % up to MAX_BLOCKS / 2 entries.
#: A longer list keeps this size (1 MB); its extra false positives are removed by the join.
MIN_BLOCKS, MAX_BLOCKS = 64, 1 << 17

#: A list of up to this many bytes, as counted, is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _mask(h: Column) -> Column:
    """Four bits of the 64 of a block."""
    m = F.lit(0).cast("long")
    for shift in (0, 6, 12, 18):
        bit = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        m = m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return m


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1)).cast("int")


def bloom_words(listed: DataFrame, blocks: int) -> Column:
    """The filter as one array of ``blocks`` longs: a scalar subquery of a size that does not depend on the data."""
    h = F.xxhash64("entry")
    words = listed.groupBy(_block(h, blocks).alias("b")).agg(F.bit_or(_mask(h)).alias("w"))
    every = listed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b"))
    full = every.join(words, "b", "left").agg(F.sort_array(F.collect_list(F.struct("b", F.coalesce("w", F.lit(0).cast("long")).alias("w")))).alias("s"))
    return full.select(F.transform("s", lambda x: x.w)).scalar()


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``listed``: entry string, verdict string; null or repeated entries are ignored (the smallest verdict holds)."""
    listed = listed.where(F.col("entry").isNotNull()).groupBy("entry").agg(F.min("verdict").alias("verdict"))
    at = F.instr("entry", "/")
    listed = listed.where(at > 1).withColumns({"labels": F.size(F.split(F.substring_index("entry", "/", 1), r"\.")), "path_length": F.length("entry") - at + 1})
    size = F.octet_length("entry") + F.octet_length(F.coalesce("verdict", F.lit(""))) + 64
    shape = listed.agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    blocks = MIN_BLOCKS
    while blocks < min(MAX_BLOCKS, 2 * shape.n):
        blocks *= 2

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    plain = ["page_id", "host", "path"]
    none = [F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")]
    if not shape.n:
        return rows.select(*plain, *none)

    # substring_index(host, '.', -k) is the whole host where it has fewer labels: such keys repeat and are made distinct.
    suffixes = F.array(*[F.substring_index("host", ".", -k) for k in sorted(shape.labels)])
    heads = F.array(*[F.substring("path", 1, k) for k in sorted(shape.lengths)])
    keys = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(F.col("heads"), lambda p: F.concat(s, p)))))
    rows = rows.withColumn("heads", heads).withColumn("keys", keys).drop("heads")
    words = bloom_words(listed, blocks)

    def may_be_listed(key: Column) -> Column:
        m = _mask(F.xxhash64(key))
        return F.get(F.col("words"), _block(F.xxhash64(key), blocks)).bitwiseAND(m) == m

    rows = rows.withColumn("words", words).withColumn("hits", F.filter("keys", may_be_listed)).drop("keys", "words")
    missed = rows.where(F.size("hits") == 0).select(*plain, *none)
    # The row number comes from the scan's partitions, which are the same when a task runs again.
    hit = rows.where(F.size("hits") > 0).withColumn("row", F.monotonically_increasing_id()).select("row", *plain, F.explode("hits").alias("entry"))
    exact = listed.select("entry", F.col("verdict").alias("v"))
    joined = hit.join(F.broadcast(exact) if shape.bytes <= BROADCAST_BYTES else exact, "entry", "left")
    best = joined.groupBy("row", *plain).agg(
        F.max(F.when(F.col("v").isNotNull(), F.struct(F.length("entry").alias("n"), F.length(F.substring_index("entry", "/", 1)).alias("h"), F.col("entry"), F.col("v")))).alias("best")
    )
    return missed.unionByName(best.select(*plain, F.col("best.entry").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict")))
