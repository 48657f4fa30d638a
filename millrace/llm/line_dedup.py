"""Line deduplication by deletion neighbourhoods, edits counted in words, in short lines in characters.

Two lines are near if one word inserted, deleted or replaced turns one into the
other. A line emits a hashed key for each word left out (with its position, for
replacements; without, for deletions) and one for itself; equal keys join. All
lines that share a replacement key are near each other, and all that share a
deletion key are near the line it spells, so the earliest line behind a key stands for
the others: no pairs are emitted within a key.

Only lines that share their first or last half with another line can be near any
(one edit leaves a half alone), so only they emit keys.

The same holds for characters in place of words. A line of few words, or in a script
without spaces, emits the keys of its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, fresh, let, saved, side

#: Lines of as many words are near within a word; of fewer, it is too much of them.
NEAR_MIN_WORDS = 8
#: Lines of up to NEAR_MIN_WORDS words are near within a character if both have as many of these.
NEAR_MIN_CHARS = 8


def _words(line: Column) -> Column:
    """Words between ASCII white space, as rows of their own so that they are split once."""
    return F.explode(F.array(F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")))


def _order(doc_id: Column, th: Column, pos: Column) -> Column:
    """Earliest first; null doc_ids last; rows that share a doc_id by a hash of their text."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), th.alias("th"), pos.alias("pos"))


def _keep(spent: list[DataFrame], df: DataFrame, name: str, sized: bool = False) -> DataFrame:
    """df saved, and noted among the tables to delete."""
    spent.append(saved(df, name, sized))
    return spent[-1]


def _spaced(text: Column) -> Column:
    """text with all white space but line feeds as spaces."""
    odd = "\t\x0b\x0c\r"
    there = [text.contains(c) for c in odd]
    return F.when(there[0] | there[1] | there[2] | there[3], F.translate(text, odd, " " * len(odd))).otherwise(text)


def _joined(line: Column) -> Column:
    """The words of a line of _spaced, one space between them."""
    wide = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(wide, F.array_join(F.array_remove(F.split(line, " "), ""), " ")).otherwise(line)


def _halves(line: Column, n: Column) -> Column:
    """Keys of the halves that a line of n joined words shares with a line one edit away."""
    keys = []
    # Lines of m and m or m + 1 words, one edit apart, share (m - 1) div 2 words at either end.
    for m in (n, n - 1):
        a = F.floor((m - 1) / 2).cast("int")
        keys.append(F.xxhash64(m, F.lit("head"), F.call_function("substring_index", line, F.lit(" "), a)))
        keys.append(F.xxhash64(m, F.lit("tail"), F.call_function("substring_index", line, F.lit(" "), -a)))
    return F.array(*keys)


def _by_chars(words: Column, near_min_words: int, near_min_chars: int) -> Column:
    """Whether a line is compared by characters: also at near_min_words, which a space less leaves below."""
    return (F.size(words) <= near_min_words) & (F.length(F.array_join(words, " ")) >= near_min_chars)


def _char_halves(line: Column) -> Column:
    """_halves in characters."""
    n = F.length(line)
    keys = []
    for m in (n, n - 1):
        a = F.floor((m - 1) / 2).cast("int")
        keys.append(F.xxhash64(m, F.lit("first"), line.substr(F.lit(1), a)))
        keys.append(F.xxhash64(m, F.lit("last"), line.substr(n - a + 1, a)))
    return F.array(*keys)


def _occurrences(docs: DataFrame, near_min_words: int, near_min_chars: int) -> DataFrame:
    """A narrow row for each line that has a word: where it is, its 128-bit hash and its halves."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(F.split(_spaced(text), "\n")).alias("pos", "line"))
    # As a row of its own, so that it is made once.
    rows = rows.select("doc_id", "th", "pos", F.explode(F.array(_joined(F.col("line")))).alias("line")).where("line <> ''")
    n = (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("int")
    rows = rows.select("doc_id", "th", "pos", "line", F.explode(F.array(n)).alias("n"))
    line, n, none = F.col("line"), F.col("n"), F.array().cast("array<bigint>")
    by_words = F.when(n >= near_min_words, _halves(line, n))
    by_chars = F.when((n <= near_min_words) & (F.length(line) >= near_min_chars), _char_halves(line))
    both = F.concat(F.coalesce(by_words, none), F.coalesce(by_chars, none))
    return rows.select(
        _order(F.col("doc_id"), F.col("th"), F.col("pos")).alias("at"),
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
        F.when(n > near_min_words, by_words).otherwise(both).alias("halves"),
    )


def _lines_at(docs: DataFrame, places: DataFrame, spent: list) -> DataFrame:
    """places (saved, of at) with the words of the line there."""
    text = F.coalesce("text", F.lit(""))
    of_doc = _keep(spent, places.groupBy("at.doc_id", "at.th").agg(F.collect_set("at.pos").alias("want")), "lines-wanted", sized=True)
    own = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    found = own.join(side(of_doc), (F.col("t") == F.col("th")) & F.col("d").eqNullSafe(F.col("doc_id")))
    lines = found.select("doc_id", "th", F.split("text", "\n").alias("lines"), F.explode("want").alias("pos"))
    return lines.select(_order(F.col("doc_id"), F.col("th"), F.col("pos")).alias("at"), _words(F.col("lines")[F.col("pos")]).alias("words")).dropDuplicates(["at"])


def within_one_edit(a: Column, b: Column) -> Column:
    """Edit distance of two arrays at most 1: what differs between their common ends is one element at most."""

    def common(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(first == 0, F.greatest(F.size(x), F.size(y))).otherwise(first - 1)

    longer = F.greatest(F.size(a), F.size(b))
    near = F.abs(F.size(a) - F.size(b)) <= 1
    return near & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longer - 1)


def _spellings(units: Column, form: Column) -> Column:
    """own: hash of an array of words or characters, as form says; rests: its hash without each of them in turn.

    A hash is the exclusive or of the units' hashes at their places; leaving out a unit
    moves those after it one place down.
    """
    places = F.transform(units, lambda w, i: F.struct(F.xxhash64(form, w, i).alias("a"), F.xxhash64(form, w, i - 1).alias("b")))
    long = lambda x: x.cast("long")

    def step(s: Column, x: Column) -> Column:
        down = s["down"].bitwiseXOR(x["b"])
        return F.struct(s["own"].bitwiseXOR(x["a"]).alias("own"), down.alias("down"), F.concat(s["rests"], F.array(s["own"].bitwiseXOR(down))).alias("rests"))

    def walk(places: Column) -> Column:
        start = F.struct(long(F.lit(0)).alias("own"), F.aggregate(places, long(F.lit(0)), lambda h, x: h.bitwiseXOR(x["b"])).alias("down"), F.array().cast("array<bigint>").alias("rests"))
        return F.aggregate(places, start, step)

    return let(places, walk)


def near_earlier(docs: DataFrame, first: DataFrame, spent: list, near_min_words: int, near_min_chars: int) -> DataFrame:
    """at of those distinct lines (first: at, halves of each) that have a near line before them."""
    keyed = first.where("halves is not null").select("at", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    live = _keep(spent, keyed.join(shared, "half", "left_semi").select("at").distinct(), "live-lines")
    lines = _lines_at(docs, live, spent).repartitionByRange("at").sortWithinPartitions("at")
    lines = _keep(spent, lines.withColumn("id", F.monotonically_increasing_id()), "live-words")  # ids in order of at
    chars = lambda words: F.split(F.array_join(words, " "), "")
    by_words = lambda words: F.size(words) >= near_min_words
    by_chars = lambda words: _by_chars(words, near_min_words, near_min_chars)
    form = lambda name, units: F.struct(F.lit(name).alias("form"), units.alias("units"))
    forms = F.array(F.when(by_words("words"), form("words", F.col("words"))), F.when(by_chars("words"), form("chars", chars("words"))))
    units = lines.select("id", F.explode(F.array_compact(forms)).alias("f"))
    rests = units.select("id", F.size("f.units").alias("n"), F.explode(F.array(_spellings(F.col("f.units"), F.col("f.form")))).alias("s")).select("id", "n", "s.own", "s.rests")
    kind = lambda k, key: F.struct(F.lit(k).alias("kind"), key.alias("key"))
    variants = F.concat(
        F.array(kind("self", F.col("own"))),
        F.transform("rests", lambda r, i: kind("replace", F.xxhash64(r, i, "n"))),
        F.transform("rests", lambda r: kind("delete", r)),
    )
    emitted = _keep(spent, rests.select("id", F.inline(variants)), "line-variants")
    least = lambda k: F.min(F.when(F.col("kind") == k, F.col("id")))
    groups = emitted.groupBy("key").agg(least("replace").alias("r"), least("self").alias("s"), least("delete").alias("d"), F.count("*").alias("n")).where("n > 1")
    # The earliest line near a member by this key, if it is before it.
    partner = F.when(F.col("kind") == "replace", F.col("r")).when(F.col("kind") == "delete", F.col("s")).otherwise(F.col("d"))
    pairs = emitted.join(groups, "key").select("id", partner.alias("by")).where("by < id").distinct()
    texts = lambda x, *more: lines.select(F.col("id").alias(x), F.col("words").alias(f"{x}_words"), *more)
    a, b = F.col("id_words"), F.col("by_words")
    near = by_words(a) & by_words(b) & within_one_edit(a, b)
    near = near | (by_chars(a) & by_chars(b) & within_one_edit(chars(a), chars(b)))
    verified = pairs.join(texts("id", "at"), "id").join(texts("by"), "by").where(near)
    return verified.select("at").distinct()


def removed_lines(docs: DataFrame, near_min_words: int = NEAR_MIN_WORDS, near_min_chars: int = NEAR_MIN_CHARS) -> DataFrame:
    """doc_id, th (hash of the text), removed (line numbers from 0) of the documents that lose lines: a saved table."""
    spent: list[DataFrame] = []
    near_min_words, near_min_chars = max(near_min_words, 3), max(near_min_chars, 4)  # with fewer, a half would be empty
    lines = _keep(spent, _occurrences(docs, near_min_words, near_min_chars), "lines")
    first = lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    first = _keep(spent, first, "first-lines")
    copies = _keep(spent, first.where("n > 1").select("h1", "h2", F.col("at").alias("kept")), "copied-lines", sized=True)
    again = lines.join(side(copies), ["h1", "h2"]).where("at > kept").select("at")
    near = near_earlier(docs, first.select("at", "halves"), spent, near_min_words, near_min_chars)
    gone = _keep(spent, first.join(near, "at", "left_semi").select("h1", "h2"), "near-lines", sized=True)
    edited = lines.join(side(gone), ["h1", "h2"], "left_semi").select("at")
    both = again.unionByName(edited)
    out = saved(both.groupBy("at.doc_id", "at.th").agg(F.sort_array(F.collect_set("at.pos")).alias("removed")), "removed-lines", sized=True)
    delete(*spent)
    return out


def dedup_lines(docs: DataFrame, near_min_words: int = NEAR_MIN_WORDS, near_min_chars: int = NEAR_MIN_CHARS) -> DataFrame:
    """docs with text less its removed lines, and new columns lines_total, lines_removed (array of line numbers).

    A line that has a word is removed if the same line, or a near one, stands earlier in the table:
    by doc_id, then line number. Near within a word are lines of near_min_words words at least;
    within a character, white space between words counted as one, lines of at most so many words
    and of near_min_chars characters at least, which also serves scripts without spaces. What
    is near an earlier line goes even if that line
    goes too. White space within lines doesn't count. Null text stays null and has
    no lines; an empty text has one, which stays. A text's lines are all looked at, however many.
    Rows equal in doc_id and text count as one and keep the same lines; rows that share
    a doc_id alone follow by a hash of the text; null doc_ids come last. An empty table gives no rows.
    A column of docs named lines_total or lines_removed is replaced.
    """
    docs = docs.drop("lines_total", "lines_removed")
    d, t, r = fresh(docs, "d", "t", "r")
    gone = removed_lines(docs.select("doc_id", "text"), near_min_words, near_min_chars)
    gone = side(gone).select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("removed").alias(r))
    text = F.coalesce("text", F.lit(""))

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(r))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    joined = docs.join(gone, (F.xxhash64(text) == F.col(t)) & F.col("doc_id").eqNullSafe(F.col(d)), "left")
    return (
        joined.withColumn("lines_total", F.when(F.col("text").isNull(), 0).otherwise(n_lines))
        .withColumn("text", F.when(F.col(r).isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest)))
        .withColumn("lines_removed", F.coalesce(r, F.array().cast("array<int>")))
        .drop(d, t, r)
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("lines_total").alias("n_lines"),
        F.size("lines_removed").alias("n_removed"),
        F.array_join(F.transform("lines_removed", lambda x: x.cast("string")), ",").alias("removed"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM d),
x AS (SELECT doc_id, pos, array_to_string(w, ' ') AS t, w, {'d': doc_id, 'p': pos} AS place
  FROM (SELECT doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM o) WHERE len(w) > 0),
f AS (SELECT t, any_value(w) AS w, min(place) AS place FROM x GROUP BY t),
u AS (SELECT t, place, 'w' AS kind, w AS units FROM f WHERE len(w) >= 8
  UNION ALL SELECT t, place, 'c', string_split(t, '') FROM f WHERE len(w) <= 8 AND length(t) >= 8),
v AS (SELECT t, place, kind, len(units) AS n, i, [units[1:i - 1], units[i + 1:]] AS around, units[1:i - 1] || units[i + 1:] AS rest
  FROM (SELECT *, unnest(range(1, len(units) + 1)) AS i FROM u)),
g AS (SELECT kind, n, i, around, min(place) AS least FROM v GROUP BY ALL),
near AS (
  SELECT v.t FROM v JOIN g USING (kind, n, i, around) WHERE least < place
  UNION SELECT v.t FROM v JOIN u ON u.kind = v.kind AND u.units = v.rest WHERE u.place < v.place
  UNION SELECT u.t FROM v JOIN u ON u.kind = v.kind AND u.units = v.rest WHERE v.place < u.place
), gone AS (
  SELECT x.doc_id, x.pos FROM x JOIN f USING (t) WHERE x.place > f.place OR t IN (SELECT t FROM near)
), r AS (SELECT doc_id, list_sort(list(pos)) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0)::INTEGER AS n_lines, coalesce(len(removed), 0)::INTEGER AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed,
  md5(coalesce(array_to_string([l[i + 1] FOR i IN range(len(l)) IF removed IS NULL OR NOT list_contains(removed, i)], chr(10)), '')) AS text_md5
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id)
"""
