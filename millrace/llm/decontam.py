"""Benchmark decontamination: which documents contain a test item.

Items are short and documents long, so their Jaccard similarity is near 0 and tells
little; containment of the item's shingles is what counts. Items are partitioned by
size, and each keeps a MinHash sample of its shingles (those of least hash), as
many as its size class needs. A document that holds enough of a sample is a
candidate; candidates are confirmed by the containment of the full shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, saved, side

SHINGLE_WORDS = 5
#: Contained: PERCENT of the item's distinct shingles occur in the document.
PERCENT = 75
#: Size classes: items of up to so many shingles, sample size, sampled shingles that a
#: candidate holds. Items of the first class are sampled whole; in the others, an item
#: at the threshold misses with a probability below 3e-7.
CLASSES = ((16, 16, None), (64, 16, 2), (256, 24, 5), (None, 32, 8))


def _words(text: Column) -> Column:
    """Words of letters and digits in lower case, as a row of their own so that they are split once."""
    return F.explode(F.array(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")))


def _shingles(words: Column, widths: list[int]) -> Column:
    """Distinct hashes of all runs of these numbers of words."""
    of = lambda w: F.when(
        F.size(words) >= w, F.transform(F.sequence(F.lit(1), F.size(words) - (w - 1)), lambda i: F.xxhash64(F.slice(words, i, w)))
    ).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(*map(of, widths)))


def sketch_items(items: DataFrame) -> DataFrame:
    """item_id, width, n, shingles, sample, need of items(item_id, text); items without words are left out.

    An item of fewer words than a shingle is one shingle, as wide as it is long.
    """
    rows = items.where("text is not null").select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(SHINGLE_WORDS))
    rows = rows.select("item_id", width.alias("width"), F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - width + 1), lambda i: F.xxhash64(F.slice("words", i, width))))).alias("shingles"))
    rows = rows.withColumn("n", F.size("shingles"))
    whole = F.ceil(F.col("n") * PERCENT / 100).cast("int")
    sample, need = F.lit(CLASSES[-1][1]), F.lit(CLASSES[-1][2])
    for most, kept, held in reversed(CLASSES[:-1]):
        sample = F.when(F.col("n") <= most, kept).otherwise(sample)
        need = F.when(F.col("n") <= most, whole if held is None else F.lit(held)).otherwise(need)
    return rows.select("item_id", "width", "n", "shingles", F.slice("shingles", F.lit(1), sample).alias("sample"), need.alias("need"))


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_shingles (the item's), n_shared: items contained in docs(doc_id, text).

    Null and empty texts contain nothing and are contained nowhere. Rows equal in
    doc_id and text count once, as do equal items of one id; of unlike items of one id the largest
    counts are given. Long texts are searched whole. Without documents or items there are no rows.
    Other columns are ignored.
    """
    items = saved(sketch_items(items).distinct(), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # SHINGLE_WORDS values at most
    own = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    if not widths:
        return own.limit(0).select("doc_id", "th", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("n_shingles"), F.lit(0).alias("n_shared"))
    rows = own.select("doc_id", "th", _words(F.col("text")).alias("words"))
    samples = saved(items.select("item_id", "n", "need", F.explode("sample").alias("shingle")), "item-samples", sized=True)
    hits = rows.select("doc_id", "th", F.explode(_shingles(F.col("words"), widths)).alias("shingle")).join(side(samples), "shingle")
    counted = hits.groupBy("doc_id", "th", "item_id", "n", "need").agg(F.count_distinct("shingle").alias("held"))
    found = saved(counted.where("held >= need").select("doc_id", "th", "item_id", "n"), "item-candidates")
    wanted = saved(found.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct(), "item-documents", sized=True)
    texts = own.join(side(wanted), (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("d", "t", "text")
    full = texts.dropDuplicates(["d", "t"]).select("d", "t", _words(F.col("text")).alias("words"))
    full = full.select("d", "t", _shingles(F.col("words"), widths).alias("have"))
    pairs = found.join(full, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).join(items.select("item_id", "n", "shingles"), ["item_id", "n"])
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect("shingles", "have")))
    pairs = pairs.where(100 * F.col("n_shared") >= PERCENT * F.col("n"))
    out = saved(pairs.groupBy("doc_id", "th", "item_id").agg(F.max("n").alias("n_shingles"), F.max("n_shared").alias("n_shared")), "contained-items")
    delete(items, samples, found, wanted)
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained_items(docs, items).select("doc_id", "item_id", "n_shingles", "n_shared")


ORACLE_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS width,
    unnest([array_to_string(w[k:k + least(len(w), 5) - 1], ' ') FOR k IN range(1, len(w) - least(len(w), 5) + 2)]) AS g
  FROM i WHERE len(w) > 0
), n AS (
  SELECT item_id, count(*) AS n FROM s GROUP BY item_id
), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, width, unnest([array_to_string(w[k:k + width - 1], ' ') FOR k IN range(1, len(w) - width + 2)]) AS g
  FROM d, (SELECT DISTINCT width FROM s) WHERE len(w) >= width
)
SELECT doc_id, item_id, n::INTEGER AS n_shingles, count(*)::INTEGER AS n_shared
FROM g JOIN s USING (width, g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n
"""
