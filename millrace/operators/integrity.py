"""Comparison and verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, equal_too: bool = True) -> DataFrame:
    """keys, status of the full outer join of two tables: only_left, only_right, differ, equal."""
    a = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("differ")
    out = a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))
    return out if equal_too else out.where("status <> 'equal'")


def first_messages(rows: DataFrame, by: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """At most limit rows of each source, with n_all, the number there are."""
    w = W.partitionBy(*by)
    ranked = rows.withColumn("n_all", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(*order)))
    return ranked.where(F.col("_at") <= limit).drop("_at")


def check_container(slots: DataFrame, refs: DataFrame, fbt: DataFrame, n_blocks: int) -> DataFrame:
    """kind, slot, block of each fault of a container.

    slots(slot), refs(slot, idx, block) with block 0 for none, fbt(block, is_free).
    invalid: a reference beyond the last block; marked_free: a referenced block that
    the table calls free; multi_use: a block with several references; no_blocks: a
    slot without any; lost: a block neither free nor referenced.
    """
    refs = refs.where("block <> 0")
    good = refs.where(F.col("block") < n_blocks)
    none = F.lit(None).cast("long")
    row = lambda df, kind, slot, block: df.select(F.lit(kind).alias("kind"), slot.cast("long").alias("slot"), block.cast("long").alias("block"))
    slot, block = F.col("slot"), F.col("block")
    counts = good.groupBy("block").agg(F.count("*").alias("k"))
    parts = [
        row(refs.where(block >= n_blocks), "invalid", slot, block),
        row(good.join(fbt.where("is_free"), "block", "left_semi"), "marked_free", slot, block),
        row(counts.where("k > 1"), "multi_use", none, block),
        row(slots.join(refs, "slot", "left_anti"), "no_blocks", slot, none),
        row(fbt.where("not is_free").join(good, "block", "left_anti"), "lost", none, block),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repaired_table(refs: DataFrame, n_blocks: int) -> DataFrame:
    """block, is_free for blocks 1 to n_blocks - 1, derived from the references."""
    used = refs.where(f"block > 0 and block < {n_blocks}").select("block").distinct().withColumn("used", F.lit(True))
    blocks = refs.sparkSession.range(1, n_blocks).select(F.col("id").alias("block"))
    return blocks.join(used, "block", "left").select("block", F.col("used").isNull().alias("is_free"))


def recoverable(deleted: DataFrame, refs: DataFrame) -> DataFrame:
    """slot of the deleted slots none of whose blocks another slot uses; refs(slot, block) of all slots."""
    own = refs.join(deleted, "slot", "left_semi")
    live = refs.join(deleted, "slot", "left_anti").select("block").distinct()
    clash = own.join(live, "block", "left_semi").select("slot").distinct()
    return deleted.join(clash, "slot", "left_anti")


def hash_tree(blocks: DataFrame, by: Sequence[str], fanouts: Sequence[int]) -> DataFrame:
    """by, level, idx, hash: level 0 is blocks(by..., idx, hash); each further level hashes the joined hashes of fanout neighbours.

    A group holds at most fanout hashes, so no task gathers more than that for a hash.
    """
    level = blocks.select(*by, F.lit(0).alias("level"), F.col("idx").cast("long").alias("idx"), "hash")
    out = level
    for i, fanout in enumerate(fanouts, 1):
        ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]), "")
        level = level.groupBy(*by, F.floor(F.col("idx") / fanout).alias("_i")).agg(F.sha2(ordered, 256).alias("hash"))
        level = level.select(*by, F.lit(i).alias("level"), F.col("_i").alias("idx"), "hash")
        out = out.unionByName(level)
    return out


def verify(stored: DataFrame, computed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, status: OK, ERR where the hashes differ, NO-HASH where none is stored, INVALID where nothing was computed."""
    a = stored.select(*keys, F.col("hash").alias("_s"))
    b = computed.select(*keys, F.col("hash").alias("_c"))
    status = F.when(F.col("_c").isNull(), "INVALID").when(F.col("_s").isNull(), "NO-HASH").when(F.col("_s") == F.col("_c"), "OK").otherwise("ERR")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def verify_levels(stored: DataFrame, computed: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """keys, status by the hashes of several levels, lowest first: OK, or that of the first level that differs with -ERR.

    NO-HASH where no level is stored, INVALID where nothing was computed. A level that isn't stored isn't compared.
    """
    a = stored.select(*keys, *[F.col(x).alias(f"_s{i}") for i, x in enumerate(levels)])
    b = computed.select(*keys, *[F.col(x).alias(f"_c{i}") for i, x in enumerate(levels)], F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "INVALID").when(F.coalesce(*[F.col(f"_s{i}") for i in range(len(levels))]).isNull(), "NO-HASH")
    for i, x in enumerate(levels):
        status = status.when(F.col(f"_s{i}") != F.col(f"_c{i}"), f"{x.upper()}-ERR")
    return a.join(b, list(keys), "full_outer").select(*keys, status.otherwise("OK").alias("status"))


def make_patches(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, data of new(keys..., data) where old has other data or none: what apply_patches needs to make new of old's places."""
    was = old.select(*keys, F.col("data").alias("_was"), F.lit(True).alias("_there"))
    return new.join(was, list(keys), "left").where(F.col("_there").isNull() | ~F.col("data").eqNullSafe(F.col("_was"))).select(*keys, "data")


def apply_patches(blocks: DataFrame, patches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """blocks(keys..., data) with the data of the last of patches(keys..., ord, data) that covers each."""
    last = patches.groupBy(*keys).agg(F.max_by("data", "ord").alias("_p"))
    return blocks.join(last, list(keys), "left").select(*keys, F.coalesce("_p", "data").alias("data"), F.col("_p").isNotNull().alias("patched"))


def block_diff(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n_blocks, n_differ, first_differ of two block tables(by..., sector, usage, hash) compared place by place.

    Blocks differ if either is missing, or in usage class or hash.
    """
    side = lambda df, x: df.select(*by, "sector", F.struct("usage", "hash").alias(x))
    both = side(left, "a").join(side(right, "b"), [*by, "sector"], "full_outer")
    differ = ~F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    return both.groupBy(*by).agg(F.count("*").alias("n_blocks"), F.count_if(differ).alias("n_differ"), F.min(F.when(differ, F.col("sector"))).alias("first_differ"))
