"""Functions over bytes and codes: checksums, base letters, compression names, ratings."""

from __future__ import annotations

import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = ("none", "purge", "bzip2", "lzma", "lzma2")


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    """Adler-32 of binary blocks; null for null."""
    return data.map(zlib.adler32, na_action="ignore").astype("Int64")


def _base_letters() -> tuple[str, str]:
    """Characters beyond U+00FF, and the letters up to there that they decompose to."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0x100, 0x3000))]
    pairs = [(c, first) for c, first in pairs if ord(first) < 0x100]
    return "".join(c for c, _ in pairs), "".join(first for _, first in pairs)


ACCENTED, BASE_LETTERS = _base_letters()


def base_letters(text: Column) -> Column:
    """Characters beyond U+00FF replaced by the base letter that they decompose to, where there is one."""
    return F.translate(text, ACCENTED, BASE_LETTERS)


def compression(text: Column) -> Column:
    """A compression name `method[.level][@chunk]` as struct(method, level, chunk); null for an unknown method."""
    part = lambda i: F.regexp_extract(F.lower(text), r"^([a-z0-9]+?)(?:\.([0-9]+))?(?:@([0-9]+))?$", i)
    number = lambda i: F.nullif(part(i), F.lit("")).try_cast("int")
    return F.when(part(1).isin(*METHODS), F.struct(part(1).alias("method"), number(2).alias("level"), number(3).alias("chunk")))


def print_compression(value: Column) -> Column:
    """The name of a struct(method, level, chunk)."""
    level = F.when(value["level"].isNotNull(), F.concat(F.lit("."), value["level"].cast("string")))
    chunk = F.when(value["chunk"].isNotNull(), F.concat(F.lit("@"), value["chunk"].cast("string")))
    return F.concat(value["method"], F.coalesce(level, F.lit("")), F.coalesce(chunk, F.lit("")))


def ratings(values: Column) -> Column:
    """An array of ages as text: the top bit of a byte marks no rating, the next one a pending one."""
    return F.array_join(F.transform(values, lambda v: F.when(v.bitwiseAND(F.lit(0x80)) != 0, F.lit("-")).otherwise(F.concat(v.bitwiseAND(F.lit(0x1F)).cast("string"), F.when(v.bitwiseAND(F.lit(0x40)) != 0, "?").otherwise("")))), ",")


def zero_blocks(data: Column) -> Column:
    """Whether binary data holds zero bytes alone."""
    return ~F.hex(data).rlike("[^0]")
