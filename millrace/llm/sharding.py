"""Longest-processing-time scheduling of groups onto shards.

Equal texts stay together. Groups, largest first, go to the least-loaded shard through a
heap. Groups of one size are interchangeable, so what is scheduled is how many of them
each shard gets: the driver sees the distinct sizes of groups and their counts, of which there
are at most the square root of twice all bytes, and each size's groups are then
numbered and handed out on the executors.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import delete, saved, side

SHARDS = 24
#: Rows that one task numbers, about.
SECTION_ROWS = 50_000


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of count groups of a size each shard gets, by a heap of (load, shard).

    What the heap would do in many like steps is taken at once: the groups stand at the
    count least values of load + size * k, ties at the lower shard.
    """
    got = [0] * len(loads)
    if size and count > 4 * len(loads):
        below = lambda top: [max(0, (top - load - 1) // size + 1) if load < top else 0 for load in loads]  # noqa: E731  values under top
        low, high = min(loads), max(loads) + size * count
        while low < high:  # the largest top that has at most count values under it
            top = (low + high + 1) // 2
            low, high = (top, high) if sum(below(top)) <= count else (low, top - 1)
        got = below(low)
    heap = [(load + size * n, s) for s, (load, n) in enumerate(zip(loads, got))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        got[s] += 1
    return got


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(size, count) of groups to (size, groups that each shard gets), largest first."""
    loads, out = [0] * shards, []
    for size, count in sorted(sizes, reverse=True):
        got = deal(loads, size, count)
        loads = [load + size * n for load, n in zip(loads, got)]
        out.append((size, got))
    return out


def _numbered(rows: DataFrame, key: str, order: list[Column], salt: Column) -> DataFrame:
    """rows with nth: their numbers from 0 within key, without gaps.

    A key's rows are numbered in sections by a hash of salt, so that no task holds more than
    SECTION_ROWS of them, about; the sections' counts give where each begins.
    """
    totals = saved(rows.groupBy(key).agg((F.count("*") / SECTION_ROWS).cast("int").alias("_sections")), "numbered", sized=True)
    cut = rows.join(side(totals), key).withColumn("_section", F.pmod(F.xxhash64(salt), F.col("_sections") + 1).cast("int"))
    counts = cut.groupBy(key, "_section").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_section").rowsBetween(W.unboundedPreceding, -1)
    firsts = saved(counts.select(key, "_section", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), "sections", sized=True)
    nth = F.row_number().over(W.partitionBy(key, "_section").orderBy(*order)) - 1
    out = cut.withColumn("nth", nth).join(side(firsts), [key, "_section"]).withColumn("nth", F.col("_first") + F.col("nth"))
    return out.drop("_sections", "_section", "_first")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs(doc_id, text).

    size: UTF-8 bytes of the text and 8 for the id; null text: empty. Shards have the loads that
    the longest-processing-time rule gives for the groups of equal texts. Slots number
    a shard's rows from 0 without gaps. Null and repeated
    doc_ids are rows like others; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),  # two texts of one hash merely stay together too
    )
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "sharding")
    groups = saved(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n"))
    dealt = [(size, list(itertools.accumulate(got))) for size, got in schedule([(r.bytes, r.n) for r in sizes.collect()], shards)]
    table = saved(spark.createDataFrame(dealt, "bytes long, ends array<long>"), "shard-sizes", sized=True)
    numbered = _numbered(groups, "bytes", [F.col("group")], F.col("group")).join(side(table), "bytes")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("nth")))  # of the first shard whose groups end after it
    placed = saved(numbered.select("group", shard.alias("shard")), "shard-of-group", sized=True)
    placed_rows = saved(rows.join(side(placed), "group").select("doc_id", "size", "text_crc32", "shard", "row"), "shard-rows")
    delete(rows, groups, table, placed)
    out = _numbered(placed_rows, "shard", [F.col("row")], F.col("row"))
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("nth").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
