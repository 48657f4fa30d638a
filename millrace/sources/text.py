"""Text sources and sinks: title lists, settings, argument lists, sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import last_wins

#: A title line: an id, a star for all ids that begin so, a title.
TITLE_LINE = r"^\s*([A-Za-z0-9]+)\s*(\*?)\s*=\s*(.*?)\s*$"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file (its place in paths), line (its place in the file), value of the lines of text files.

    Each file is one row of its reader and split there; lists of this kind are small.
    """
    out = None
    for i, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.lit(i).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_titles(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """id, title of title lists. Later lines and files win; an empty title deletes its id, with a star longer ids too."""
    part = lambda i: F.regexp_extract("value", TITLE_LINE, i)
    rows = _lines(spark, paths).select((F.col("file") * (1 << 32) + F.col("line")).alias("ord"), F.upper(part(1)).alias("id"), (part(2) == "*").alias("star"), part(3).alias("title")).where("id <> ''")
    wiped = rows.where("star and title = ''").select(F.col("id").alias("start"), F.length("id").alias("k"), F.col("ord").alias("at"))
    kept = last_wins(rows, ["id"], "ord").where("title <> ''")
    # Ids are short, so their prefixes meet the wiping lines in an equi-join.
    prefixes = kept.select("id", "ord", F.explode(F.transform(F.sequence(F.lit(1), F.length("id")), lambda k: F.substring("id", F.lit(1), k))).alias("start"))
    gone = prefixes.join(wiped, "start").where("at > ord").select("id").distinct()
    return kept.join(gone, "id", "left_anti").select("id", "title")


def read_settings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """name, value of lines `name = value`; # starts a comment line; the last definition of a name wins."""
    part = lambda i: F.regexp_extract("value", r"^\s*([^#=\s][^=]*?)\s*=\s*(.*?)\s*$", i)
    rows = _lines(spark, paths).select((F.col("file") * (1 << 32) + F.col("line")).alias("ord"), part(1).alias("name"), part(2).alias("setting")).where("name <> ''")
    return last_wins(rows, ["name"], "ord").select("name", F.col("setting").alias("value"))


def read_arguments(spark: SparkSession, path: str) -> DataFrame:
    """line, value: one argument a line, empty lines left out."""
    return _lines(spark, [path]).where("trim(value) <> ''").select("line", "value")


def sections(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """One text a row: a section head and a line key=value for each column; null values are empty."""
    lines: list[Column] = [F.concat(F.lit("["), F.col(name).cast("string"), F.lit("]"))]
    lines += [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return df.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value"))


def write_sections(df: DataFrame, path: str, name: str, columns: Sequence[str]) -> None:
    sections(df, name, columns).write.text(path)
