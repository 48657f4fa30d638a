"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on doc_id.

Files are range-partitioned and sorted by doc_id, so stripe and row-group
statistics are narrow: a lookup by document id reads the one stripe that holds
it, a scan is split by stripe.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from ..shared import new_path

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}
SCHEMA = "doc_id long, tie long, shard int, pos long, n_tokens long, ids array<int>"


def _encode(batches, path: str):
    """Rows of one sorted partition. pos: ids of all its earlier documents."""
    from pyspark import TaskContext

    shard, pos = TaskContext.get().partitionId(), 0
    for rows, ids, ends in tokens.encoded(batches, path):
        starts = np.concatenate([[0], ends])
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                rows.column("tie"),
                pa.array(np.full(len(ends), shard, np.int32)),
                pa.array(pos + starts[:-1]),
                pa.array(np.diff(starts)),
                pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)),
            ],
            names=["doc_id", "tie", "shard", "pos", "n_tokens", "ids"],
        )
        pos += len(ids)


def write_tokens(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Encode docs(doc_id, text) and write ORC files in ascending doc_id order.

    Null text: empty, so only the end id. Null doc_ids come first. Rows that share
    a doc_id follow by a hash of their text, which is also part of the range key:
    one id that holds many rows still spreads over files. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # Texts are dealt before they are encoded: finding the range bounds must not encode them twice.
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ids = dealt.mapInArrow(partial(_encode, path=path or tokens.default_path()), SCHEMA)
    ids.write.options(**ORC_OPTIONS).orc(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows; a filter on doc_id reaches the reader and prunes by statistics and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(out)


def bases(files: DataFrame) -> DataFrame:
    """shard, base: ids in all earlier shards. One row for each file, so small enough to order in one task."""
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def with_starts(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rows (or the files' own) with start: ids of all documents before theirs, over all shards."""
    joined = (files if rows is None else rows).join(F.broadcast(bases(files)), "shard")
    return joined.withColumn("start", F.col("base") + F.col("pos")).drop("base")


def _crc(batches):
    for batch in batches:
        ids = batch.column("ids")
        values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("shard"), batch.column("pos"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
            names=["doc_id", "shard", "pos", "n_tokens", "ids_crc32"],
        )


def digests(files: DataFrame) -> DataFrame:
    """doc_id, shard, pos, n_tokens, ids_crc32 of the ids as they stand in the files."""
    rows = files.select("doc_id", "shard", "pos", "ids")
    return rows.mapInArrow(_crc, "doc_id long, shard int, pos long, n_tokens long, ids_crc32 long")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-orc")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    files = read_tokens(spark, out)
    return with_starts(files, digests(files)).select("doc_id", "start", "n_tokens", "ids_crc32")
