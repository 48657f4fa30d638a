"""Tables in the folder that driver and executors share.

Writing an intermediate result there cuts its lineage: a lost executor costs a
reread, not a recomputation, and no block lives on one machine alone.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join above this size isn't broadcast.
BROADCAST_MB = 32

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _LOCAL[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            every = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType).cast("long"))
            return F.lit(16) + F.coalesce(every, F.lit(0).cast("long"))
        return F.lit(16) + F.coalesce(F.array_size(value), F.lit(0)) * 8
    return F.lit(8)


def saved(df: DataFrame, name: str, sized: bool = False, **measures: Column) -> DataFrame:
    """df, written as Parquet to the shared folder and read again.

    sized: also add up, while writing, the bytes that its rows take in memory, for side().
    measures: aggregates that are taken while writing; the table's told has their values.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if sized:
        row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
        measures["saved_bytes"] = F.sum(row.cast("long"))
    told = Observation()
    (df.observe(told, *[m.alias(k) for k, m in measures.items()]) if measures else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path, out.told = path, told.get if measures else {}
    return out


def delete(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing will read any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def side(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df, broadcast if of (by default df), a table saved with its size, is small enough; else Spark shuffles it.

    df may be some columns of the saved table, or some of its rows.
    """
    size = (df if of is None else of).told["saved_bytes"] or 0
    return F.broadcast(df) if size <= BROADCAST_MB * 1e6 else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row; body's lambdas would compute it for each element."""
    return F.transform(F.array(value), body)[0]
