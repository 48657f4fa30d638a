"""Computations over extents: rows with an offset, a size and a map (or owner) they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import running


def islands(df: DataFrame, by: Sequence[str], touching: bool = True) -> DataFrame:
    """by, off, size of the areas that extents(by..., off, size) cover; touching areas merge, or only overlapping ones."""
    earlier = W.partitionBy(*by).orderBy("off", "size").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.col("off") + F.col("size")).over(earlier)
    apart = (F.col("off") > reach) if touching else (F.col("off") >= reach)
    marked = df.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(W.partitionBy(*by).orderBy("off", "size").rowsBetween(W.unboundedPreceding, 0)))
    areas = numbered.groupBy(*by, "_island").agg(F.min("off").alias("off"), F.max(F.col("off") + F.col("size")).alias("end"))
    return areas.select(*by, "off", (F.col("end") - F.col("off")).alias("size"))


def gaps(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, off, size of the unused space between areas."""
    areas = islands(df, by)
    after = F.lead("off").over(W.partitionBy(*by).orderBy("off"))
    end = F.col("off") + F.col("size")
    return areas.select(*by, end.alias("off"), (after - end).alias("size")).where("size > 0")


def subtract(df: DataFrame, minus: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, off, size of what df covers and minus doesn't, by running coverage over all bounds."""
    ends = lambda x, column: islands(x, by).select(*by, F.explode(F.array(F.struct(F.col("off").alias("p"), F.lit(1).alias("d")), F.struct((F.col("off") + F.col("size")).alias("p"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.p", *[(F.col("e.d") if c == column else F.lit(0)).alias(c) for c in ("plus", "less")])
    bounds = ends(df, "plus").unionByName(ends(minus, "less")).groupBy(*by, "p").agg(F.sum("plus").alias("plus"), F.sum("less").alias("less"))
    w = W.partitionBy(*by).orderBy("p")
    run = bounds.select(*by, F.col("p").alias("off"), (F.lead("p").over(w) - F.col("p")).alias("size"), F.sum("plus").over(w).alias("a"), F.sum("less").over(w).alias("b"))
    return islands(run.where("a > 0 and b = 0 and size > 0").select(*by, "off", "size"), by)


def fragments(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n_fragments of blocks(by..., idx, block): runs of consecutive block numbers; block 0 is a hole and breaks no run."""
    before = F.lag("block").over(W.partitionBy(*by).orderBy("idx"))
    starts = F.when(before.isNull() | (F.col("block") != before + 1), 1).otherwise(0)
    return blocks.where("block <> 0").withColumn("_s", starts).groupBy(*by).agg(F.sum("_s").alias("n_fragments"))


def _level(size: Column) -> Column:
    """The least power of two that is not below a size."""
    return F.when(size <= 1, 0).otherwise(F.ceil(F.log2(size.cast("double")))).cast("int")


def _down(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value.cast("long"), level)


def _levels(*sizes: DataFrame) -> Column:
    """The levels of one-column tables of sizes: at most 63."""
    found = {r[0] for df in sizes for r in df.select(_level(F.col(df.columns[0]))).distinct().collect()}
    return F.array(*map(F.lit, sorted(x for x in found if x is not None))).cast("array<int>")


def compose(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, src, dst, size: extents of first(src to mid) followed by second(mid to dst), joined where they overlap in mid.

    first has src, mid, size; second mid, dst, size. The overlap join is an equi-join on cells of the middle
    offset: two extents meet in the cells of the larger one's size, of which each touches two at most, whatever its
    size; a pair counts in the cell where its overlap begins. Adjacent pieces become one.
    """
    levels = _levels(first.select("size"), second.select("size"))

    def spread(df: DataFrame, x: str, other: str) -> DataFrame:
        rows = df.select(*by, F.col(other).alias(f"{x}_{other}"), F.col("mid").alias(f"{x}_mid"), F.col("size").alias(f"{x}_size"), _level(F.col("size")).alias(f"{x}_own"))
        rows = rows.withColumn("_level", F.explode(F.filter(levels, lambda n: n >= F.col(f"{x}_own"))))
        last = F.col(f"{x}_mid") + F.greatest(F.col(f"{x}_size") - 1, F.lit(0))
        return rows.withColumn("_cell", F.explode(F.sequence(_down(F.col(f"{x}_mid"), F.col("_level")), _down(last, F.col("_level")))))

    low, high = F.greatest("a_mid", "b_mid"), F.least(F.col("a_mid") + F.col("a_size"), F.col("b_mid") + F.col("b_size"))
    met = spread(first, "a", "src").join(spread(second, "b", "dst"), [*by, "_level", "_cell"])
    met = met.where((F.col("_level") == F.greatest("a_own", "b_own")) & (low < high) & (_down(low, F.col("_level")) == F.col("_cell")))
    return joined(met.select(*by, (F.col("a_src") + low - F.col("a_mid")).alias("src"), (F.col("b_dst") + low - F.col("b_mid")).alias("dst"), (high - low).alias("size")), by)


def joined(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, src, dst, size: pieces that go on where another ends, at both places, as one."""
    w = W.partitionBy(*by).orderBy("src", "dst", "size")
    goes_on = (F.col("src") == F.lag(F.col("src") + F.col("size")).over(w)) & (F.col("dst") == F.lag(F.col("dst") + F.col("size")).over(w))
    rows = pieces.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_piece", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_piece").agg(F.min("src").alias("src"), F.min("dst").alias("dst"), F.sum("size").alias("size")).drop("_piece")


def map_union(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, block, usage of two block maps(by..., block, usage): the greater usage where both have a block."""
    return left.unionByName(right).groupBy(*by, "block").agg(F.max("usage").alias("usage"))


def overlapping(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with overlaps: the extent begins before the end of some extent ahead of it in (off, size) order."""
    earlier = W.partitionBy(*by).orderBy("off", "size").rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("overlaps", F.coalesce(F.col("off") < F.max(F.col("off") + F.col("size")).over(earlier), F.lit(False)))


def covering(points: DataFrame, files: DataFrame, by: Sequence[str]) -> DataFrame:
    """points(by..., at) with file and inside: the file whose extent holds the point, else the next one after it.

    files(by..., file, off, size) don't overlap; sizes count up to a multiple of 4.
    One window over both tables takes the last file at or before, and the first after.
    """
    rounded = F.ceil(F.col("size") / 4) * 4
    f = files.select(*by, F.col("off").alias("at"), F.lit(0).alias("point"), F.struct("file", (F.col("off") + rounded).alias("end")).alias("f"), F.lit(None).cast("struct<file:string>").alias("k"))
    p = points.select(*by, "at", F.lit(1).alias("point"), F.lit(None).cast(f.schema["f"].dataType).alias("f"), F.struct(F.lit("").alias("file")).alias("k"))
    both = f.unionByName(p)
    order = W.partitionBy(*by).orderBy("at", "point")
    here = F.last("f", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("f", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    out = both.select(*by, "at", "point", here.alias("h"), after.alias("n")).where("point = 1")
    inside = F.coalesce(F.col("at") < F.col("h.end"), F.lit(False))
    return out.select(*by, "at", inside.alias("inside"), F.when(inside, F.col("h.file")).otherwise(F.col("n.file")).alias("file"))


def layout(items: DataFrame, by: Sequence[str], order: Sequence[str], unit: int) -> DataFrame:
    """items with off: the sum of the sizes before it, each rounded up to unit. A large group is summed over many tasks."""
    return running(items, by, list(map(F.col, order)), (F.ceil(F.col("size") / unit) * unit).cast("long"), "off")

def used_groups(sectors: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """by, n_groups of sectors(by..., sector, used): groups of n neighbours with a used one."""
    groups = sectors.groupBy(*by, F.floor(F.col("sector") / n).alias("_g")).agg(F.max(F.col("used").cast("int")).alias("_u"))
    return groups.groupBy(*by).agg(F.sum("_u").alias("n_groups"))


def runs(sectors: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, first, length, used of the alternating runs of sectors(by..., sector, used)."""
    w = W.partitionBy(*by).orderBy("sector")
    turn = F.when(F.lag("used").over(w).eqNullSafe(F.col("used")), 0).otherwise(1)
    numbered = sectors.withColumn("_t", turn).withColumn("_r", F.sum("_t").over(w))
    return numbered.groupBy(*by, "_r").agg(F.min("sector").alias("first"), F.count("*").alias("length"), F.first("used").alias("used")).drop("_r")


def paint(extents: DataFrame, by: Sequence[str], unit: int) -> DataFrame:
    """by, sector, marker: units that extents(by..., off, size, marker, ord) touch; the last in ord wins."""
    touched = extents.select(*by, "marker", "ord", F.explode(F.sequence(F.floor(F.col("off") / unit), F.floor((F.col("off") + F.col("size") - 1) / unit))).alias("sector"))
    return touched.groupBy(*by, "sector").agg(F.max_by("marker", "ord").alias("marker"))


def free_slots(used: DataFrame, by: Sequence[str], slot: str, n: int) -> DataFrame:
    """by and the n smallest slot numbers from 0 that are not in use."""
    keys = used.select(*by).distinct()
    taken = used.groupBy(*by).agg(F.count_distinct(slot).alias("_k"))
    room = keys.join(taken, list(by)).select(*by, F.explode(F.sequence(F.lit(0), F.col("_k").cast("int") + (n - 1))).alias(slot))
    left = room.join(used.select(*by, slot), [*by, slot], "left_anti")
    return left.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(slot))).where(F.col("_at") <= n).drop("_at")


def alignment(offsets: Column) -> Column:
    """Aggregate: the largest power of two that divides all offsets."""
    joined = F.bit_or(offsets)
    return joined.bitwiseAND(-joined)


def in_section(areas: DataFrame, sections: DataFrame, by: Sequence[str]) -> DataFrame:
    """areas(by..., off, size) with section: the first of sections(by..., section, start, length) that holds all of the area.

    The range join is an equi-join on cells of the section's size: a section touches two at most, an area's offset one of each size.
    """
    key, levels = [*by, "off", "size"], _levels(sections.select(F.col("length") + 1))
    spread = sections.select(*by, "section", "start", "length", _level(F.col("length") + 1).alias("_level"))
    spread = spread.withColumn("_cell", F.explode(F.sequence(_down(F.col("start"), F.col("_level")), _down(F.col("start") + F.col("length"), F.col("_level")))))
    points = areas.select(*key).distinct().withColumn("_level", F.explode(levels)).withColumn("_cell", _down(F.col("off"), F.col("_level")))
    held = points.join(spread, [*by, "_level", "_cell"]).where("off >= start and off + size <= start + length").groupBy(*key).agg(F.min("section").alias("section"))
    return areas.join(held, key, "left")


def segments(words: DataFrame, by: Sequence[str], hole: int) -> DataFrame:
    """by, first, length of the runs of words(by..., idx, word) that aren't zero; holes shorter than hole stay inside a run."""
    w = W.partitionBy(*by).orderBy("idx")
    used = words.where("word <> 0")
    apart = F.coalesce(F.col("idx") - F.lag("idx").over(w) > hole, F.lit(True)).cast("int")
    numbered = used.withColumn("_n", apart).withColumn("_s", F.sum("_n").over(w))
    return numbered.groupBy(*by, "_s").agg(F.min("idx").alias("first"), (F.max("idx") - F.min("idx") + 1).alias("length")).drop("_s")


def phantoms(spark, n: int, seed: int, most: int) -> DataFrame:
    """n made-up items: id, size from 1 to most; equal for equal seeds."""
    return spark.range(n).select(F.format_string("PHT%03d", F.col("id")).alias("id"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most)) + 1).alias("size"))
