"""Quality rules as a bitmask ledger.

Every rule is measured once per document; the ledger keeps the measurements and
one bit per failed rule. A policy is a mask of bits that reject, so policies can
change, be compared and be ablated from the ledger alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import let, saved

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: Rules by bit: name and failing condition over the ledger's measurements.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("stutter", "10 * n_stutters > 3 * n_words"),
)
BASE_RULES = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject.
POLICIES = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "symbols", "repeated_lines", "long_words", "short_words", "stutter"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters")


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in rules)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found at least twice in an array of words.

    Windows are compared by their 64-bit hash within one document.
    """
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (window - 1)),
        lambda i: F.xxhash64(F.slice(words, i, window)),
    )

    def covered(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            marked,
            lambda m: F.array_sort(
                F.transform(
                    F.filter(
                        m,
                        lambda x, k: (x["h"] == F.get(m, k - 1)["h"]) | F.coalesce(x["h"] == F.get(m, k + 1)["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        # Each start adds a window, less what the start before it has covered already.
        return F.aggregate(
            twice,
            F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(window))).alias("n")),
            lambda a: a["n"],
        )

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > window, found).otherwise(F.lit(0).cast("long"))


def ledger(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, MEASURES, failed (bits of RULES that fail) for each row of docs(doc_id, text), and more columns of docs.

    Null and empty texts have no words. A line counts if it has a word; each copy
    of an earlier line counts once in n_dup_lines, each copy of the word before it once
    in n_stutters. Repeated rows and null doc_ids
    are measured like others; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        *more,
        "doc_id",
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    long = lambda c: c.cast("long")
    measures = (
        long(F.size("words")),
        long(F.length(F.array_join("words", ""))),
        long(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))),
        long(F.size("lines")),
        long(F.size("lines") - F.size(F.array_distinct("lines"))),
        repeat_words(F.col("words")),
        long(F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1)))),
    )
    # As a row of their own, so that a filter on them doesn't bring them in again.
    row = F.struct(*[m.alias(name) for name, m in zip(MEASURES, measures)])
    measured = rows.select(*more, "doc_id", F.explode(F.array(row)).alias("measured_row")).select(*more, "doc_id", "measured_row.*")
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def apply_policy(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """A ledger with kept: none of the policy's rules failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def keep_documents(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of docs, all columns, that a policy keeps."""
    rows = ledger(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row")), "whole_row")
    return apply_policy(rows, policy).where("kept").select("whole_row.*")


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: rows it fails, and rows that it alone rejects, from one pass over the ledger."""
    all_bits = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])))
    patterns = rows.groupBy(all_bits.alias("bits")).agg(F.count("*").alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in POLICIES[policy]]))
    return (
        patterns.select("bits", "n", names.alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        )
    )


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-ledger")
    return apply_policy(rows).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(mask(BASE_RULES))) != 0).alias("base_failed"),
        "kept",
        "n_lines",
        "n_stutters",
        "failed",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """policy, rule, failed, failed_alone of every policy, all from one stored ledger."""
    rows = saved(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("failed"), "quality-ledger")
    each = [ablations(rows, policy).select(F.lit(policy).alias("policy"), "rule", "failed", "failed_alone") for policy in POLICIES]
    return each[0].unionByName(each[1])


_MEASURED_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents
), h AS (
  SELECT *, CASE WHEN len(w) < 8 THEN []::VARCHAR[] ELSE
    [array_to_string(w[i:i+7], ' ') FOR i IN range(1, len(w) - 6)] END AS win
  FROM t
), o AS (
  SELECT doc_id, unnest(win) AS win, unnest(range(len(win))) AS i FROM h
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM o) WHERE n > 1
), p AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM d) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]])::BIGINT AS n_stutters
  FROM t LEFT JOIN p USING (doc_id)
), b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 25 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_stutters > 3 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed FROM m
)
"""

ORACLE_SQL = f"""{_MEASURED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, n_lines, n_stutters, failed FROM b
"""

ABLATIONS_SQL = f"""{_MEASURED_SQL}
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS failed, count(*) FILTER (failed & mask = bit) AS failed_alone
FROM b, (VALUES ('v1', 3, 'few_words', 1), ('v1', 3, 'repeated_windows', 2), ('v2', 127, 'few_words', 1), ('v2', 127, 'repeated_windows', 2), ('v2', 127, 'symbols', 4),
  ('v2', 127, 'repeated_lines', 8), ('v2', 127, 'long_words', 16), ('v2', 127, 'short_words', 32), ('v2', 127, 'stutter', 64)) AS r(policy, mask, rule, bit)
GROUP BY ALL
"""
