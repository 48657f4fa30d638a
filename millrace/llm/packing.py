"""Cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n, since attention runs
within a document. Documents go in descending cost to the sequence of least cost
that still has room. Packing works on blocks of neighbouring documents of a
partition, so nothing is shuffled and a task holds one block at a time; a block
opens as many sequences as its tokens fill, hence leaves under one sequence of
padding.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

MAX_TOKENS = 2048
#: Cost of a token and of a pair of tokens: attention outweighs the rest beyond 4096 tokens.
LINEAR, QUADRATIC = 4096.0, 1.0
BLOCK_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_block(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of each piece, in order of placement.

    A document longer than a sequence fills whole sequences and leaves a rest. When
    no open sequence has room for a piece, the cheapest one takes what it has room
    for and the remainder is placed next; ties go to the lower number.
    """
    whole = lengths // capacity
    out, opened = [], 0
    for d in np.flatnonzero(whole):
        for k in range(whole[d]):
            out.append((int(d), k * capacity, capacity, opened))
            opened += 1
    rests = lengths - whole * capacity
    room = np.full(-(-int(rests.sum()) // capacity), capacity, np.int64)
    cost = np.zeros(len(room))
    for d in np.argsort(-rests, kind="stable"):
        start, left = int(whole[d]) * capacity, int(rests[d])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(np.where(room > 0, cost, np.inf).argmin())
            n = min(left, int(room[s]))
            out.append((int(d), start, n, opened + s))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def _emit(doc_ids: list, ids: list[np.ndarray], capacity: int, first: int) -> tuple[pa.RecordBatch, int]:
    placed = pack_block(np.fromiter(map(len, ids), np.int64, len(ids)), capacity)
    filled: dict[int, int] = {}
    rows = []
    for d, start, n, s in placed:
        at = filled.get(s, 0)
        filled[s] = at + n
        rows.append((doc_ids[d], start, n, zlib.crc32(ids[d][start : start + n].astype("<u4").tobytes()), len(ids[d]), first + s, at))
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in SCHEMA.split(", ")]), len(filled)


def _pack(batches, path: str, capacity: int, block_tokens: int):
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 40  # sequences of one task lie together
    doc_ids, ids, n = [], [], 0
    for rows, got, ends in tokens.encoded(batches, path):
        for doc_id, x in zip(rows.column("doc_id").to_pylist(), np.split(got, ends[:-1])):
            doc_ids.append(doc_id)
            ids.append(x)
            n += len(x)
            if n >= block_tokens:
                out, opened = _emit(doc_ids, ids, capacity, first)
                yield out
                first += opened
                doc_ids, ids, n = [], [], 0
    if ids:
        yield _emit(doc_ids, ids, capacity, first)[0]


def pack(docs: DataFrame, capacity: int = MAX_TOKENS, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of docs(doc_id, text) with their sequence and offset there; SCHEMA has the columns.

    Null text: empty, so one end id. Null and repeated doc_ids are packed row by
    row. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_pack, path=path or tokens.default_path(), capacity=capacity, block_tokens=block_tokens), SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
