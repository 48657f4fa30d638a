"""Merging source items into a target catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODES = ("add", "update", "new", "overwrite", "sync")


def plan(source: DataFrame, target: DataFrame, mode: str, excluded: Column | None = None) -> DataFrame:
    """id, path, action for source(id, mtime, path) against target(id, mtime); a null mtime is unknown.

    Source rows are taken by path. One whose id neither target nor an earlier row has is added. Another one:
    add: `exists`; update: skipped; new: replaces, if it is newer than what is then there or of unknown
    time, else skipped; overwrite: replaces; sync: as update, and target ids that no source has are
    removed, but for those that start with an underscore. Rows without an id are always added.
    excluded: of the source's columns; such rows are skipped, and their ids count as no source's.
    """
    by_path = W.partitionBy("id").orderBy("path")
    earlier = by_path.rowsBetween(W.unboundedPreceding, -1)
    rows = source if excluded is None else source.where(~F.coalesce(excluded, F.lit(False)))
    there = target.select("id", F.col("mtime").alias("t_mtime"), F.lit(True).alias("there"))
    rows = rows.join(there, "id", "left").withColumn("nth", F.row_number().over(by_path))
    # What is there: since the last row of unknown time, which replaced all, the latest time.
    rows = rows.withColumn("turn", F.coalesce(F.count_if(F.col("mtime").isNull()).over(earlier), F.lit(0)))
    latest = F.max("mtime").over(W.partitionBy("id", "turn").orderBy("path").rowsBetween(W.unboundedPreceding, -1))
    latest = F.greatest(latest, F.when(F.col("turn") == 0, F.col("t_mtime")))
    newer = F.col("mtime").isNull() | latest.isNull() | (F.col("mtime") > latest)
    present = {
        "add": F.lit("exists"),
        "update": F.lit("skip"),
        "new": F.when(newer, "replace").otherwise("skip"),
        "overwrite": F.lit("replace"),
        "sync": F.lit("skip"),
    }[mode]
    new = F.col("id").isNull() | (F.col("there").isNull() & (F.col("nth") == 1))
    out = rows.select("id", F.col("path").cast("string").alias("path"), F.when(new, "add").otherwise(present).alias("action"))
    if excluded is not None:
        out = out.unionByName(source.where(excluded).select("id", F.col("path").cast("string").alias("path"), F.lit("skip").alias("action")))
    if mode == "sync":
        kept = source if excluded is None else source.where(~F.coalesce(excluded, F.lit(False)))
        gone = target.join(kept.select("id"), "id", "left_anti").where(~F.col("id").startswith("_"))
        out = out.unionByName(gone.select("id", F.lit(None).cast("string").alias("path"), F.lit("remove").alias("action")))
    return out


def unused(params: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Parameters that name nothing in the catalog."""
    return params.join(catalog, key, "left_anti")


def remove(catalog: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """The catalog less the items that selected names."""
    return catalog.join(selected.select(key), key, "left_anti")


def touch(catalog: DataFrame, selected: DataFrame, key: str, time: Column, columns: tuple[str, ...] = ("itime", "mtime", "ctime", "atime")) -> DataFrame:
    """The catalog with these time columns (all four, if none is named) set to time in the items that selected names."""
    hit = selected.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = catalog.join(hit, key, "left")
    columns = columns or ("itime", "mtime", "ctime", "atime")
    return joined.withColumns({c: F.when(F.col("_hit"), time).otherwise(F.col(c)) for c in columns}).drop("_hit").select(*catalog.columns)


def job_limit(jobs: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first limit jobs of a plan: a limit is what is asked for here."""
    return jobs.orderBy(*order).limit(limit)


def exclude_found(items: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """items without those whose key a scan of other paths has found."""
    return items.join(found.select(key).where(F.col(key).isNotNull()), key, "left_anti")
