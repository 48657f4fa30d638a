"""From documents to packed sequences: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, line_dedup, near_dup, packing, quality
from millrace.shared import delete, fresh, saved, side


def _of(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined, "left_anti" or "left_semi", to a saved table rows(doc_id, th), th being the hash of a row's text."""
    d, t = fresh(docs, "d", "t")
    rows = side(rows).select(F.col("doc_id").alias(d), F.col("th").alias(t))
    return docs.join(rows, (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(t)) & F.col("doc_id").eqNullSafe(F.col(d)), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy, whole rows. Null, empty and very short texts fail it; repeated rows are judged alike."""
    return quality.keep_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that stand earlier; those left without a word go, for all their lines stand elsewhere.

    Texts without a removed line stay as they are, null and empty ones too. n_chars, if there is such a column, follows the text.
    """
    others = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", others.alias("others")))
    left = (F.size("lines_removed") == 0) | F.col("text").rlike(quality.WORD)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.where(left).select(*[own.get(c, F.col(f"others.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least doc_id, null ones last.

    Of rows that share it, one of those with the text of least hash. Texts without words are in no group and all stay.
    """
    found = near_dup.near_duplicates(docs)
    gone = saved(found.where("not first").select("doc_id", "th").distinct(), "near-gone", sized=True)
    again = found.where("first and n_shingles > 0").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    again = saved(again.select("doc_id", "th"), "near-again", sized=True)
    kept = _of(docs, gone, "left_anti")
    return _of(kept, again, "left_anti").unionByName(_of(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none; repeated rows go or stay together."""
    found = decontam.contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _of(docs, saved(found.select("doc_id", "th").distinct(), "leaks", sized=True), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes once the next one is written, but for the last one's input."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            delete(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
