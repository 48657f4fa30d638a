"""Catalogs: one row per disc image or other item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import path_key, upper_path_key


def first_of(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key, by order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A keyed table built line by line: of equal keys the last line stays."""
    return first_of(df, keys, [F.col(order).desc()])


def with_title(items: DataFrame, titles: DataFrame, ident: str, fallback: Column, short: int = 4) -> DataFrame:
    """items with title: of the whole id, else of its first characters, else fallback. titles(id, title) has one row per id."""
    whole = titles.select(F.col("id").alias(ident), F.col("title").alias("_whole"))
    part = titles.where(F.length("id") == short).select(F.col("id").alias("_short"), F.col("title").alias("_part"))
    out = items.join(whole, ident, "left").withColumn("_short", F.substring(ident, 1, short)).join(part, "_short", "left")
    return out.withColumn("title", F.coalesce("_whole", "_part", fallback)).drop("_whole", "_part", "_short")


def totals(df: DataFrame, group: str, size: str) -> DataFrame:
    """Count and total size of each group, and of all (group null)."""
    return df.rollup(group).agg(F.count("*").alias("n"), F.sum(size).alias("total"))


#: Sort modes over the columns title, name, id, fname, part_index, size_mib, used_blocks, slot, itime, mtime,
#: ctime, atime, n_part, fragments. Each chain ends in that of the title, so the order is total where a file holds an item once.
TITLE = ("lower(coalesce(title, name))", "lower(name)", "id", "coalesce(fname, '')", "part_index")
#: Sectors of a MiB; an item without a count of used blocks counts by its size.
SIZE = ("CASE WHEN coalesce(used_blocks, 0) > 0 THEN used_blocks ELSE size_mib * 32 END", *TITLE)
#: Unknown times come first.
_M = ("mtime", "itime", "ctime", "atime", *TITLE)
SORTS = {
    "title": TITLE,
    "name": ("lower(name)", *TITLE),
    "id": ("id", *TITLE),
    "file": ("coalesce(fname, '')", *TITLE),
    "size": SIZE,
    "offset": ("slot", *SIZE),
    "region": ("substring(id, 4, 1)", "id", *TITLE),
    "container": ("part_index", *TITLE),
    "n_part": ("n_part", *TITLE),
    "fragments": ("fragments", *TITLE),
    "itime": ("itime", "ctime", *_M),
    "mtime": _M,
    "ctime": ("ctime", *_M),
    "atime": ("atime", *_M),
    "path": TITLE,
    "nintendo": TITLE,
}


def sort_key(mode: str, reverse: bool = False) -> list[Column]:
    """Columns to order by; reverse turns all of them, ties too."""
    first = {"path": [path_key(F.col("name"))], "nintendo": [upper_path_key(F.col("name"))]}.get(mode, [])
    keys = first + list(map(F.expr, SORTS[mode]))
    return [k.desc_nulls_last() if reverse else k.asc_nulls_first() for k in keys]


def unique(items: DataFrame, level: int = 1, ties: Sequence[str | Column] = ()) -> DataFrame:
    """One row of each id, name and size (level 1) or of each id (level 2): the first by id and title, then by ties."""
    return first_of(items, ["id", "name", "size_mib"] if level == 1 else ["id"], [*sort_key("id"), *ties])


def first_links(files: DataFrame) -> DataFrame:
    """files(dev, ino, path) with link_to: null for the first path of an inode, that path for later ones."""
    first = F.first("path").over(W.partitionBy("dev", "ino").orderBy("path"))
    return files.withColumn("link_to", F.when(first != F.col("path"), first))


def rename(items: DataFrame, mapping: DataFrame, ident: str) -> DataFrame:
    """items with new_name by mapping(selector, new_name); selector + stands for all others."""
    named = mapping.where("selector <> '+'").withColumnsRenamed({"selector": ident, "new_name": "_own"})
    other = mapping.where("selector = '+'").agg(F.max("new_name")).scalar()
    return items.join(named, ident, "left").withColumn("new_name", F.coalesce("_own", other)).drop("_own")


def inode_vote(rows: DataFrame, geometry: Sequence[str]) -> DataFrame:
    """Candidate geometries of rows(geometry..., mtime): those at least a quarter as frequent as the most frequent, newest first in rank."""
    votes = rows.groupBy(*geometry).agg(F.count("*").alias("n"), F.max("mtime").alias("newest"))
    most = votes.agg(F.max("n").alias("_most"))
    kept = votes.where(F.col("n") * 4 >= most.scalar())
    return kept.withColumn("rank", F.row_number().over(W.orderBy(F.desc("newest"), F.desc("n"), *geometry)))
