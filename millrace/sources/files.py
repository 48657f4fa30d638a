"""Files as rows: listings, types by content, pieces of split files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (type, offset, bytes in hex) that tell a file's type. Fixed values.
SIGNATURES = (
    ("parquet", 0, "50415231"),
    ("orc", 0, "4F5243"),
    ("gzip", 0, "1F8B"),
    ("zip", 0, "504B0304"),
    ("zstd", 0, "28B52FFD"),
    ("ciso", 0, "4349534F"),
    ("iso9660", 32769, "4344303031"),
)


def listing(spark: SparkSession, path: str, glob: str = "*", max_depth: int | None = None) -> DataFrame:
    """path, depth, size, mtime of the files below a folder. Names that start with a dot are left out; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rest = F.substring_index("path", path.rstrip("/").rpartition("/")[2] + "/", -1)
    out = files.select("path", F.size(F.split(rest, "/")).alias("depth"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    out = out.where(~F.substring_index("path", "/", -1).startswith("."))
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def with_type(files: DataFrame, signatures: Sequence[tuple[str, int, str]] = SIGNATURES) -> DataFrame:
    """files(content) with type: of the first signature that its bytes show, else `other`."""
    kind = F.lit("other")
    for name, at, bytes_ in reversed(signatures):
        kind = F.when(F.hex(F.substring("content", at + 1, len(bytes_) // 2)) == bytes_, name).otherwise(kind)
    return files.withColumn("type", kind)


def pieces(files: DataFrame) -> DataFrame:
    """files(path, size) with whole, part, start: pieces `x`, `x.1`, `x.2` ... of a split file, and where each begins in it."""
    part = F.regexp_extract("path", r"\.([1-9][0-9]*)$", 1)
    named = files.withColumn("part", F.when(part == "", 0).otherwise(F.expr("try_cast(regexp_extract(path, '[.]([1-9][0-9]*)$', 1) as int)")))
    named = named.withColumn("whole", F.regexp_replace("path", r"\.[1-9][0-9]*$", ""))
    before = W.partitionBy("whole").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return named.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
