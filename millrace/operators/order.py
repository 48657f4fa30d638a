"""Numbers and running sums over a whole table, without bringing it into one task.

Rows are range-partitioned by the order, sorted within partitions and written; then each
partition's own numbers or sums are moved on by those of all partitions before it, of which there
is one row each. The order must be total, else equal rows are numbered as they come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import fresh, saved


def _sorted(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, str, str]:
    """df in order, as a saved table, and the names of its columns for the partition and the place there, from 0."""
    part, at = fresh(df, "part", "at")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    return saved(rows.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), "ordered"), part, at


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """df with out: a row's number from 0 among the rows with its keys (all rows, if there are none), by order."""
    rows, part, at = _sorted(df, [*map(F.col, keys), *order])
    base, first = fresh(rows, "base", "first")
    sizes = rows.groupBy(part).agg(F.count("*").alias(base))
    before = sizes.select(part, F.coalesce(F.sum(base).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(base))
    placed = rows.join(F.broadcast(before), part).withColumn(at, F.col(at) + F.col(base)).drop(part, base)
    if keys:
        starts = placed.groupBy(*keys).agg(F.min(at).alias(first))
        same = [fresh(placed, f"k{i}")[0] for i in range(len(keys))]
        starts = starts.withColumnsRenamed(dict(zip(keys, same)))
        on = [placed[k].eqNullSafe(starts[s]) for k, s in zip(keys, same)]
        placed = placed.join(starts, on).withColumn(at, F.col(at) - F.col(first)).drop(first, *same)
    return placed.withColumn(out, F.col(at)).drop(at) if out != at else placed


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """df with out: the sum of value over the earlier rows with its keys (all earlier rows, if there are none), by order; 0 for the first."""
    own = fresh(df, "value")[0]
    rows, part, at = _sorted(df.withColumn(own, value), [*map(F.col, keys), *order])
    base = fresh(rows, "base")[0]
    group = [*keys, part]  # a key may lie in several partitions
    sums = rows.groupBy(*group).agg(F.sum(own).alias(base))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    within = W.partitionBy(*group).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn(out, F.coalesce(F.sum(own).over(within), F.lit(0)))
    same = [fresh(summed, f"k{i}")[0] for i in range(len(group))]
    sums = sums.withColumnsRenamed(dict(zip(group, same)))
    joined = summed.join(sums, [summed[k].eqNullSafe(sums[s]) for k, s in zip(group, same)])
    return joined.withColumn(out, F.col(out) + F.col(base)).drop(part, at, own, base, *same)
