"""URL judgement: longest-match rules, then a Bloom filter cascade over hosts.

Level 1 of the cascade holds the listed hosts that occur, level 2 those unlisted
hosts that pass level 1, level 3 the listed hosts that pass level 2, and so on until no
false positive is left. Over the hosts it was built on, the cascade is exact; a
url is judged by testing bits, without a join.

A level is cut into blocks of 8 KB, and all bits of a key lie in one block. Levels are
built by block on the executors, whatever their size. A level of up to MAX_FILTER_MB is sent
to all of them; of a larger one each key meets its own block only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, saved

#: (host, path, verdict): applies to the host, its subdomains and all paths that start so.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Hosts listed for blocking: each name under each ending, alone and under each prefix.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ENDINGS = ("example.com", "example.net", "example.org")
LISTED_PREFIXES = ("", "www.", "blog.", "m.")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits a key on the first level, for 1 false positive in 2 ** HASHES there; later levels halve.
HASHES = 8
#: Bits of a block, at most.
BLOCK_BITS = 1 << 16
#: Above this size a level isn't sent to the executors as a whole.
MAX_FILTER_MB = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty for null or without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equal ones that with the longer host; else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


class _Level:
    """One Bloom filter of a cascade over a column key: blocks of 64-bit words."""

    def __init__(self, keys: DataFrame, n: int, depth: int, max_filter_mb: float):
        self.depth, self.hashes = depth, HASHES if depth == 0 else 1
        bits = 64 * max(1, -(-int(n * self.hashes * 1.4427) // 64))
        self.blocks = -(-bits // BLOCK_BITS)
        self.bits = bits if self.blocks == 1 else BLOCK_BITS
        words = self.bits // 64
        block, at = self._place(F.col("key"))
        spots = keys.select(block.alias("block"), F.explode(F.array(*at)).alias("bit"))
        spots = spots.select("block", F.expr("bit div 64").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("set"))
        # Words without a bit are given too, so that a block is an array of all its words.
        none = keys.sparkSession.range(self.blocks * words).select(F.expr(f"id div {words}").alias("block"), F.expr(f"id % {words}").alias("word"), F.lit(0).cast("long").alias("set"))
        full = spots.unionByName(none).groupBy("block", "word").agg(F.bit_or("set").alias("set"))
        table = full.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("words"))
        self.table = saved(table, "url-level")
        self.sent = bits <= max_filter_mb * 8e6
        if self.sent:
            whole = self.table.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "words"))), lambda x: x["words"]).alias("blocks"))
            whole, spent = saved(whole, "url-level"), self.table
            self.table = whole
            delete(spent)

    def _place(self, key: Column) -> tuple[Column, list[Column]]:
        """A key's block, and its bits there."""
        hashed = lambda i: F.xxhash64(key, F.lit(1000 * self.depth + i))
        return F.pmod(hashed(999), F.lit(self.blocks)), [F.pmod(hashed(i), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """df with a boolean column out: whether the filter passes the key. A null key doesn't pass."""
        block, at = self._place(F.col(key))
        if self.sent:
            words = F.get(self.table.scalar(), block.cast("int"))
        else:
            own = f"block-{uuid.uuid4().hex}"
            df = df.withColumn(own, block).join(self.table.select(F.col("block").alias(own), F.col("words").alias(f"{own}-words")), own, "left")
            words = F.col(f"{own}-words")
        hit = F.col(key).isNotNull()
        for bit in at:
            hit = hit & (F.getbit(F.get(words, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1)
        df = df.withColumn(out, F.coalesce(hit, F.lit(False)))
        return df if self.sent else df.drop(own, f"{own}-words")


class Cascade:
    """Exact membership of the keys of universe in listed, both DataFrames with a column key.

    Null keys are in neither. Repeated keys count once. An empty universe or list gives a
    cascade without levels, which holds nothing.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, max_filter_mb: float = MAX_FILTER_MB):
        tagged = universe.select("key", F.lit(0).alias("on"), F.lit(1).alias("seen"))
        tagged = tagged.unionByName(listed.select("key", F.lit(1).alias("on"), F.lit(0).alias("seen"))).where("key is not null")
        keys = tagged.groupBy("key").agg(F.max("on").alias("on"), F.max("seen").alias("seen")).where("seen = 1")
        keys = saved(keys.select("key", "on"), "url-keys", n=F.count_if(F.col("on") == 1))
        self.levels: list[_Level] = []
        inside, outside, n, spent = keys.where("on = 1").select("key"), keys.where("on = 0").select("key"), keys.told["n"], [keys]
        while n:
            level = _Level(inside, n, len(self.levels), max_filter_mb)
            self.levels.append(level)
            # A key that its own level passes belongs to it or is the next level's.
            passed = saved(level.passes(outside, "key", "passes").where("passes").select("key"), "url-keys", n=F.count(F.lit(1)))
            inside, outside, n = passed, inside, passed.told["n"]
            spent.append(passed)
        delete(*spent)

    def contains(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """df with a boolean column out; key must be one of the universe's or null, which gives false."""
        passed = [f"passes-{uuid.uuid4().hex}" for _ in self.levels]
        for level, name in zip(self.levels, passed):
            df = level.passes(df, key, name)
        # Member if the first level that it fails is of even number, counted from 0 as level 1.
        found = F.lit(len(self.levels) % 2 == 1)
        for depth, name in reversed(list(enumerate(passed))):
            found = F.when(F.col(name), found).otherwise(F.lit(depth % 2 == 1))
        return df.withColumn(out, F.col(key).isNotNull() & found).drop(*passed)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_filter_mb: float = MAX_FILTER_MB) -> DataFrame:
    """pages(page_id, url) with host, path, rule, listed, verdict. listed: a DataFrame with a column key of hosts.

    A rule decides first; else listed hosts are blocked and others allowed. Null
    urls have an empty host, which no rule fits. Of equally long rules the one with the longer
    host decides. Repeated rows are judged alike; long urls are judged whole; an empty table gives
    no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    cascade = Cascade(rows.select(F.col("host").alias("key")), listed, max_filter_mb)
    rows = cascade.contains(rows, "host", "listed")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, by_list).alias("verdict"))


def listed_hosts() -> list[str]:
    return [f"{p}{n}.{e}" for n in LISTED_NAMES for e in LISTED_ENDINGS for p in LISTED_PREFIXES]


def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in listed_hosts()], "key string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE {rule} END AS rule FROM u
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({allow}) THEN 'allow' WHEN rule IN ({block}) THEN 'block'
    WHEN host IN ({listed}) THEN 'block' ELSE 'allow' END AS verdict
FROM r
""".format(
    upper=UPPER,
    lower=LOWER,
    rule=" ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    ),
    allow=", ".join(f"'{h}{p}'" for h, p, v in RULES if v == "allow"),
    block=", ".join(f"'{h}{p}'" for h, p, v in RULES if v == "block"),
    listed=", ".join(f"'{h}'" for h in listed_hosts()),
)
