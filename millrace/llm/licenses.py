"""Licence scan: canonical digests of entire texts, joined to known licences.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings make no difference) and its digest looked up. Entire
documents and their single lines are looked up, so a notice that is one line of a
document is found as well as a document that is a licence. In an entire document a line
that is a licence's title, or that all rights are reserved, makes no difference either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .known_licenses import DIGESTS, LICENSES, SPELLINGS, notices
from ..shared import saved, side

#: A line that names a copyright's year or owner; lower case.
COPYRIGHT = r"^[^\p{L}\p{N}(©]*(portions )?(copyright\s*(\(c\)|©|:|by\b|[0-9]{4})|(\(c\)|©)\s*(copyright|[0-9]{4}))"
#: A canonical line that an entire text may have or not.
TITLE = r"^(all rights reserved|(the )?(mit|isc|zlib|0bsd|unlicense|apache|((simplified|new|modified) )?bsd( [0-9] clause)?|mit no attribution|boost software)( software)? licen[cs]e( mit| expat)?)$"


def _canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form; copyright lines are empty."""
    low = F.lower(text)
    plain = F.transform(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}\n]+", " "), "\n"), lambda x: F.trim(x))
    said = low.contains("copyright") | low.contains("(c)") | low.contains("©")
    return F.when(said, F.zip_with(plain, F.split(low, "\n"), lambda x, line: F.when(line.rlike(COPYRIGHT), "").otherwise(x))).otherwise(plain)


def _whole(lines: Column) -> Column:
    """An entire text's words from its canonical lines."""
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(TITLE)), " ")


def _n_words(words: Column) -> Column:
    return F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1


def _spelled(words: Column) -> Column:
    """Canonical words with one spelling for equivalent ones; as many words."""
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    pattern = r"\b(" + "|".join(SPELLINGS) + r")\b"
    told = F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    return F.when(words.rlike(pattern), told).otherwise(words)


def _digest(words: Column) -> Column:
    return F.sha2(_spelled(words), 256)


def digests(texts: DataFrame) -> DataFrame:
    """license_id, n_words, digest of texts(license_id, text), a table of known licences or notices."""
    rows = texts.select("license_id", _whole(_canonical_lines(F.col("text"))).alias("whole"), F.array_join(F.filter(_canonical_lines(F.col("text")), lambda x: x != ""), " ").alias("words"))
    words = F.when(F.col("whole") != "", F.col("whole")).otherwise(F.col("words"))  # of a notice that is a title, its words
    return rows.select("license_id", _n_words(words).alias("n_words"), _digest(words).alias("digest")).distinct()


def known(spark: SparkSession) -> DataFrame:
    """license_id, n_words, digest of what this module knows, by the same functions as the documents."""
    texts = [*LICENSES.items(), *((i, text) for text, i in notices().items())]
    own = digests(spark.createDataFrame(texts, "license_id string, text string"))
    return own.unionByName(spark.createDataFrame([(i, n, d) for i, (n, d) in DIGESTS.items()], "license_id string, n_words int, digest string"))


def scan(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """doc_id, license_id, whole (the entire document is the licence), n_lines, first_line of each hit in docs(doc_id, text).

    table has what digests() gives, by default known(); it is broadcast if it is small, and texts of as many
    words as none of it are not digested. first_line counts from 0 and is null if only the
    document as a whole fits. Null and empty texts have no hits, nor does an empty table; a long text
    is digested whole. Rows that share a doc_id are taken together; a text that is two licences gives
    a row for each. Other columns are ignored.
    """
    table = saved(known(docs.sparkSession) if table is None else table, "licences", sized=True)
    counts = [r.n_words for r in table.select("n_words").distinct().collect()]  # a few hundred values, not rows of the documents
    rows = docs.select("doc_id", _canonical_lines(F.col("text")).alias("lines"))
    whole = F.struct(F.lit(None).cast("int").alias("line"), _whole(F.col("lines")).alias("words"))
    parts = F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("words")))
    units = rows.select("doc_id", F.explode(F.concat(F.array(whole), parts)).alias("u")).where((F.col("u.words") != "") & _n_words(F.col("u.words")).isin(counts))
    hits = units.select("doc_id", "u.line", _digest(F.col("u.words")).alias("digest")).join(side(table).select("license_id", "digest"), "digest")
    return hits.groupBy("doc_id", "license_id").agg(
        F.max(F.col("line").isNull()).alias("whole"), F.count("line").alias("n_lines"), F.min("line").alias("first_line")
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]"
    texts = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in [*LICENSES.items(), *((i, t) for t, i in notices().items())])
    long = ", ".join(f"({quoted(i)}, {quoted(d)})" for i, (_, d) in DIGESTS.items())
    line = f"""CASE WHEN (contains(lower(x), 'copyright') OR contains(lower(x), '(c)') OR contains(lower(x), '©')) AND regexp_matches(lower(x), {quoted(COPYRIGHT)})
      THEN '' ELSE trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END"""
    whole = f"array_to_string([x FOR x IN lines IF x <> '' AND NOT regexp_matches(x, {quoted(TITLE)})], ' ')"
    digest = f"sha256(array_to_string([coalesce({listed(SPELLINGS.values())}[list_position({listed(SPELLINGS)}, w)], w) FOR w IN string_split(u.words, ' ')], ' '))"
    return f"""
WITH k(license_id, text) AS (VALUES {texts}),
kl AS (SELECT license_id, [{line} FOR x IN string_split(text, chr(10))] AS lines FROM k),
ku AS (SELECT license_id, CASE WHEN {whole} <> '' THEN {whole} ELSE array_to_string([x FOR x IN lines IF x <> ''], ' ') END AS words FROM kl),
kd AS (SELECT license_id, {digest} AS digest FROM ku u UNION SELECT * FROM (VALUES {long})),
dl AS (SELECT doc_id, [{line} FOR x IN string_split(text, chr(10))] AS lines FROM documents WHERE text IS NOT NULL),
du AS (SELECT doc_id, NULL::INTEGER AS line, {whole} AS words FROM dl
  UNION ALL SELECT doc_id, unnest(range(len(lines)))::INTEGER, unnest(lines) FROM dl),
h AS (SELECT doc_id, line, license_id FROM (SELECT doc_id, line, {digest} AS digest FROM du u WHERE words <> '') JOIN kd USING (digest))
SELECT doc_id, license_id, bool_or(line IS NULL) AS whole, count(line) AS n_lines, min(line) AS first_line FROM h GROUP BY ALL"""


ORACLE_SQL = _oracle()
