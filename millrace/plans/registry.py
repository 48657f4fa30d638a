"""Queries over the driver's tables, and the SQL that gives the same rows.

The tables stand in for catalogs: parts, orders and customers for items, events of
a user for the extents of a map, order lines for blocks and references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import patterns as P
from ..functions import scalars as S
from ..operators import catalog, extents, integrity, merge, order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read as they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str):
    """Register a function of Tables under its name, with its SQL."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[make.__name__] = lambda spark, folder: make(Tables(spark, folder))
        ORACLES[make.__name__] = sql
        return make

    return register


# --- catalogs

_ITEMS = "SELECT p_partkey AS key, upper(p_type) AS id, p_name AS name, p_size * 1048576 + p_partkey * 1000 AS size, p_brand FROM part"


def _items(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("key"), F.upper("p_type").alias("id"), F.col("p_name").alias("name"),
        (F.col("p_size") * 1048576 + F.col("p_partkey") * 1000).alias("size"), "p_brand",
    )


_TITLES = [("ECONOMY", "Economy class"), ("SMAL", "Small things"), ("PROM", "Promotions"), ("LARGE", "Large things"), ("STAN", "Standard class")]
_TITLE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TITLES) + ") AS x(id, title)"


@query(f"""
WITH i AS ({_ITEMS}), x AS (SELECT * FROM {_TITLE_SQL}),
j AS (SELECT i.*, coalesce(a.title, b.title, i.name) AS title FROM i LEFT JOIN x a ON a.id = i.id
  LEFT JOIN x b ON length(b.id) = 4 AND b.id = substr(i.id, 1, 4)),
u AS (SELECT *, row_number() OVER (PARTITION BY id, name, (size + 524288) // 1048576 ORDER BY key) AS nth FROM j)
SELECT key, id, title, name, ((size + 524288) // 1048576)::BIGINT AS size_mib,
  row_number() OVER (ORDER BY lower(title), lower(name), id, key)::BIGINT AS place FROM u WHERE nth = 1
""")
def catalog_list(t: Tables) -> DataFrame:
    items = catalog.with_title(_items(t), t.spark.createDataFrame(_TITLES, "id string, title string"), "id", F.col("name"))
    items = items.withColumn("size_mib", S.half_up(F.col("size"), S.MIB))
    kept = catalog.first_of(items, ["id", "name", "size_mib"], ["key"])
    placed = order.numbered(kept, [], [F.lower("title"), F.lower("name"), F.col("id"), F.col("key")], "place")
    return placed.select("key", "id", "title", "name", "size_mib", (F.col("place") + 1).alias("place"))


@query("""
SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, n_chars ORDER BY doc_id) AS n FROM documents) WHERE n = 1
""")
def unique_items(t: Tables) -> DataFrame:
    return catalog.first_of(t.documents, ["lang", "source", "n_chars"], ["doc_id"]).select("doc_id", "lang", "source")


@query("""
SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents) WHERE n = 1
""")
def unique_ids(t: Tables) -> DataFrame:
    return catalog.first_of(t.documents, ["lang", "source"], ["doc_id"]).select("doc_id", "lang", "source")


@query("""
SELECT o_orderpriority AS grp, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY ROLLUP (o_orderpriority)
""")
def totals_footer(t: Tables) -> DataFrame:
    return catalog.totals(t.orders, "o_orderpriority", "o_custkey").withColumnRenamed("o_orderpriority", "grp")


@query("SELECT DISTINCT upper(substr(p_type, 1, 4)) AS id FROM part")
def distinct_ids(t: Tables) -> DataFrame:
    return t.part.select(F.upper(F.substring("p_type", 1, 4)).alias("id")).distinct()


_DISCS = """SELECT p_partkey AS key, upper(p_type) AS id, replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '.' ELSE '_' END) AS name,
  CASE WHEN p_partkey % 5 <> 0 THEN lower(p_brand) END AS title, CASE WHEN p_partkey % 6 <> 0 THEN 'd' || p_partkey % 7 || '/' || p_name END AS fname, (p_partkey % 3)::INTEGER AS part_index,
  p_size::BIGINT AS size_mib, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size * 30 + p_partkey % 5 END AS used_blocks, p_partkey % 11 AS slot, p_size % 4 AS n_part, p_partkey % 6 AS fragments,
  CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 4 END AS itime, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 5 END AS mtime, p_partkey % 3 AS ctime, p_size % 3 AS atime FROM part"""


def _discs(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    mark = F.when(key % 3 == 0, "/").when(key % 3 == 1, ".").otherwise("_")
    return t.part.select(
        key.alias("key"), F.upper("p_type").alias("id"), F.replace("p_name", F.lit(" "), mark).alias("name"), F.when(key % 5 != 0, F.lower("p_brand")).alias("title"),
        F.when(key % 6 != 0, F.concat(F.lit("d"), (key % 7).cast("string"), F.lit("/"), F.col("p_name"))).alias("fname"), (key % 3).cast("int").alias("part_index"),
        size.cast("long").alias("size_mib"), F.when(key % 4 == 0, 0).otherwise(size * 30 + key % 5).alias("used_blocks"), (key % 11).alias("slot"), (size % 4).alias("n_part"), (key % 6).alias("fragments"),
        F.when(key % 10 != 0, key % 4).alias("itime"), F.when(key % 9 != 0, key % 5).alias("mtime"), (key % 3).alias("ctime"), (size % 3).alias("atime"),
    )


def _sorted(mode: str, reverse: bool):
    def make(t: Tables) -> DataFrame:
        key = F.col("key").desc() if reverse else F.col("key").asc()
        placed = order.numbered(_discs(t), [], [*catalog.sort_key(mode, reverse), key], "place")
        return placed.select("key", (F.col("place") + 1).alias("place"))

    return make


def _sort_sql(keys: str, reverse: bool) -> str:
    by = ", ".join(k + (" DESC NULLS LAST" if reverse else " NULLS FIRST") for k in [*keys.split("; "), "key"])
    return f"WITH i AS ({_DISCS}) SELECT key, row_number() OVER (ORDER BY {by}) AS place FROM i"


_CHAIN_SQL = "lower(coalesce(title, name)); lower(name); id; coalesce(fname, ''); part_index"
_SIZE_SQL = f"CASE WHEN used_blocks <> 0 THEN used_blocks ELSE size_mib * 32 END; {_CHAIN_SQL}"
_MTIME_SQL = f"mtime; itime; ctime; atime; {_CHAIN_SQL}"
#: By component: the slash before all, then lower case; or slash, full stop, then capitals, where the end of a name comes first.
_BY_PATH = "[{'a': CASE WHEN c LIKE '%/' THEN lower(c)[:-2] || chr(1) ELSE lower(c) || chr(2) END, 'b': c} FOR c IN regexp_extract_all(name, '[^/]*/|[^/]+')]"
_BY_CAPITALS = "[{'a': translate(upper(c), '/.', chr(1) || chr(2)), 'b': c} FOR c IN regexp_extract_all(name, '[^/]*/|[^/]+')]"
for _mode, _keys, _reverse in (
    ("title", _CHAIN_SQL, False), ("name", f"lower(name); {_CHAIN_SQL}", False), ("id", f"id; {_CHAIN_SQL}", True), ("file", f"coalesce(fname, ''); {_CHAIN_SQL}", False),
    ("size", _SIZE_SQL, True), ("offset", f"slot; {_SIZE_SQL}", False), ("region", f"substr(id, 4, 1); id; {_CHAIN_SQL}", False), ("container", f"part_index; {_CHAIN_SQL}", False),
    ("n_part", f"n_part; {_CHAIN_SQL}", False), ("fragments", f"fragments; {_CHAIN_SQL}", True), ("itime", f"itime; ctime; {_MTIME_SQL}", False), ("mtime", _MTIME_SQL, True),
    ("ctime", f"ctime; {_MTIME_SQL}", False), ("atime", f"atime; {_MTIME_SQL}", False), ("path", f"{_BY_PATH}; {_CHAIN_SQL}", False), ("nintendo", f"{_BY_CAPITALS}; {_CHAIN_SQL}", False),
):
    _name = {"path": "sort_by_name_path", "nintendo": "sort_by_name_capitals"}.get(_mode, f"sort_by_{_mode}")
    QUERIES[_name] = lambda spark, folder, make=_sorted(_mode, _reverse): make(Tables(spark, folder))
    ORACLES[_name] = _sort_sql(_keys, _reverse)


@query(f"""
WITH i AS ({_DISCS}), u AS (SELECT * FROM i WHERE key % 2 = 0 OR key % 3 = 0 UNION ALL SELECT * REPLACE (part_index + 10 AS part_index) FROM i WHERE key % 2 = 1 OR key % 5 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY id, name, size_mib ORDER BY id, {_CHAIN_SQL.replace("; ", ", ")}, key) AS nth FROM u)
SELECT key, id, name, part_index, row_number() OVER (ORDER BY {_CHAIN_SQL.replace("; ", ", ")}, key) AS place FROM f WHERE nth = 1
""")
def mixed_listing(t: Tables) -> DataFrame:
    one, two = _discs(t).where("key % 2 = 0 or key % 3 = 0"), _discs(t).where("key % 2 = 1 or key % 5 = 0")
    items = catalog.unique(one.unionByName(two.withColumn("part_index", F.col("part_index") + 10)), ties=["key"])
    return order.numbered(items, [], [*catalog.sort_key("title"), F.col("key")], "place").select("key", "id", "name", "part_index", (F.col("place") + 1).alias("place"))


_PATH_SQL = "regexp_replace(url, '^[^:]*://', '')"


@query(f"""
SELECT page_id, row_number() OVER (ORDER BY [{{'a': CASE WHEN c LIKE '%/' THEN lower(c)[:-2] || chr(1) ELSE lower(c) || chr(2) END, 'b': c}} FOR c IN regexp_extract_all({_PATH_SQL}, '[^/]*/|[^/]+')], page_id) AS place FROM pages
""")
def sort_by_path(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "^[^:]*://", "")
    placed = order.numbered(t.pages.select("page_id", S.path_key(path).alias("key")), [], [F.col("key"), F.col("page_id")], "place")
    return placed.select("page_id", (F.col("place") + 1).alias("place"))


@query("""
SELECT user_id, event_id, CASE WHEN first <> event_id THEN first END AS link_to
FROM (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS first FROM events)
""")
def hard_links(t: Tables) -> DataFrame:
    files = t.events.select(F.col("user_id").alias("dev"), F.col("event_type").alias("ino"), F.col("event_id").alias("path"))
    return catalog.first_links(files).select(F.col("dev").alias("user_id"), F.col("path").alias("event_id"), "link_to")


@query("""
SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Little' WHEN 'LARGE' THEN 'Big' ELSE 'Other' END AS new_name FROM part
""")
def rename_mapping(t: Tables) -> DataFrame:
    mapping = t.spark.createDataFrame([("SMALL", "Little"), ("LARGE", "Big"), ("+", "Other")], "selector string, new_name string")
    return catalog.rename(t.part, mapping, "p_type").select("p_partkey", "new_name")


@query("""
SELECT p_type, last FROM (SELECT p_type, p_partkey AS last, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1
""")
def last_definition_wins(t: Tables) -> DataFrame:
    return catalog.last_wins(t.part, ["p_type"], "p_partkey").select("p_type", F.col("p_partkey").alias("last"))


@query("""
WITH v AS (SELECT l_suppkey, l_linenumber, count(*) AS n, max(l_shipdate) AS newest FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_linenumber, n, row_number() OVER (ORDER BY newest DESC, n DESC, l_suppkey, l_linenumber)::BIGINT AS rank
FROM v WHERE n * 4 >= (SELECT max(n) FROM v)
""")
def geometry_vote(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_linenumber", F.col("l_shipdate").alias("mtime"))
    return catalog.inode_vote(rows, ["l_suppkey", "l_linenumber"]).select("l_suppkey", "l_linenumber", "n", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
""")
def union_of_catalogs(t: Tables) -> DataFrame:
    part = lambda df, kind, p: df.select(F.lit(kind).alias("kind"), F.col(f"{p}_{'cust' if p == 'c' else 'supp'}key").alias("key"), F.col(f"{p}_name").alias("name"))
    return part(t.customer, "customer", "c").unionByName(part(t.supplier, "supplier", "s"))


# --- predicates


@query("""
SELECT c_custkey, (c_mktsegment IN ('BUILDING', 'FURNITURE') OR NOT c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AS excluded,
  (NOT c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AND c_mktsegment IN ('BUILDING', 'FURNITURE') AS excluded_include_first
FROM customer
""")
def include_exclude(t: Tables) -> DataFrame:
    inside = F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")
    outside = F.col("c_mktsegment").isin("BUILDING", "FURNITURE")
    return t.customer.select("c_custkey", P.excluded(inside, outside, True).alias("excluded"), P.excluded(inside, outside, True, True).alias("excluded_include_first"))


@query("""
SELECT p_partkey, regexp_full_match(upper(substr(p_name, 1, 6)), '.ED W.|S.....') AS hit FROM part
""")
def id_patterns(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", P.id_in(F.substring("p_name", 1, 6), [".ed w.", "s+"]).alias("hit"))


@query("""
SELECT p_partkey, CASE WHEN upper(p_type) LIKE 'S_A%' THEN true WHEN upper(p_type) LIKE 'S%' THEN false WHEN upper(p_type) LIKE 'E%' THEN true ELSE false END AS keep FROM part
""")
def ordered_id_rules(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", P.id_rules(F.col("p_type"), [("+", "s.a"), ("-", "s"), ("+", "e")]).alias("keep"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, regexp_matches(path, '[^/]*[.]html$') AS page, path LIKE '/en/%' AS english,
  regexp_matches(path, '/(fr|de)/[0-9]+$') AS numbered, regexp_matches(path, '/[0-9]+/$') AS folder FROM p
""")
def path_globs(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", "^[^:]*://[^/]*(/[^?#]*)", 1)
    slashed = F.concat(F.lit("x"), path)
    return t.pages.select(
        "page_id", P.glob_matches(path, "*.html").alias("page"), P.glob_matches(F.substring(path, 2, 1 << 20), "/en/").alias("english"),
        P.glob_matches(slashed, "{/fr,/de}/#").alias("numbered"), P.glob_matches(slashed, "[+/]#/").alias("folder"),
    )


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN path LIKE '%.html' THEN (CASE WHEN path LIKE '%/' THEN true ELSE false END)
  WHEN NOT regexp_matches(path, '/en/[^/]*/?$') AND false THEN true
  WHEN regexp_matches(path, '/fr/[0-9]+$') THEN false WHEN path LIKE '%/' THEN true ELSE false END AS keep FROM p
""")
def path_rules(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", "^[^:]*://[^/]*(/[^?#]*)", 1)
    return t.pages.select("page_id", P.path_rules(path, [("+", 1, "*.html"), ("-", 0, "fr/#"), ("+", 0, "*/")]).alias("keep"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN false WHEN l_linenumber < 4 THEN true ELSE false END AS selected FROM lineitem
""")
def part_selector(t: Tables) -> DataFrame:
    rules = [("-", F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"), ("+", None, F.col("l_linenumber") < 4)]
    return t.lineitem.select("l_orderkey", "l_linenumber", P.select_parts(rules).alias("selected"))


@query("""
SELECT count(*) FILTER (l_linenumber BETWEEN 2 AND 4) AS a_to_b, count(*) FILTER (l_linenumber <= 3) AS to_b,
  count(*) FILTER (l_linenumber >= 5) AS from_a, count(*) FILTER (l_linenumber = 6) AS one, 0::BIGINT AS turned FROM lineitem
""")
def slot_ranges(t: Tables) -> DataFrame:
    n = lambda text, name: F.count_if(P.in_range(F.col("l_linenumber"), text, 1, 7)).alias(name)
    return t.lineitem.agg(n("2-4", "a_to_b"), n("-3", "to_b"), n("5-", "from_a"), n("6", "one"), n("4-2", "turned"))


@query("""
SELECT page_id, url FROM pages WHERE len(string_split(regexp_replace(url, '^[^:]*://', ''), '/')) <= 3
""")
def depth_limit(t: Tables) -> DataFrame:
    return t.pages.where(F.size(F.split(F.regexp_replace("url", "^[^:]*://", ""), "/")) <= 3).select("page_id", "url")


# --- merging

#: Every order is a source; every third customer isn't there yet, some under another name.
_SOURCE = """SELECT o_custkey::VARCHAR AS id, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE epoch(o_orderdate)::BIGINT END AS m, o_orderkey AS path, o_orderstatus,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders"""
_TARGET = """SELECT CASE WHEN c_custkey % 7 = 0 THEN '_' ELSE '' END || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE epoch(TIMESTAMP '1995-01-01') + c_custkey * 86400 END::BIGINT AS m
  FROM customer WHERE c_custkey % 3 <> 0"""


def _source(t: Tables) -> DataFrame:
    time = F.when(F.col("o_orderkey") % 11 != 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    return t.orders.select(F.col("o_custkey").cast("string").alias("id"), time.alias("mtime"), F.col("o_orderkey").alias("path"), "o_orderstatus")


def _target(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    time = F.when(key % 5 != 0, F.unix_timestamp(F.lit("1995-01-01").cast("timestamp")) + key * 86400)
    return t.customer.where(key % 3 != 0).select(F.concat(F.when(key % 7 == 0, "_").otherwise(""), key.cast("string")).alias("id"), time.alias("mtime"))


def _merge_sql(mode: str, source: str = _SOURCE, skipped: str = "") -> str:
    """One row after another, as they come; m = 0 is an unknown time."""
    newer = "s.m = 0 OR s.m > f.m"
    taken = {"overwrite": "true", "new": newer}.get(mode, "false")
    other = {"add": "exists", "update": "skip", "new": "skip", "overwrite": "replace", "sync": "skip"}[mode]
    gone = "UNION ALL SELECT id, NULL, 'remove' FROM t WHERE id NOT IN (SELECT id FROM s) AND NOT starts_with(id, '_')" if mode == "sync" else ""
    return f"""
WITH RECURSIVE s AS ({source}), t AS ({_TARGET}),
f(id, nth, m, there, path, action) AS (
  SELECT s.id, 0, coalesce(t.m, 0), t.id IS NOT NULL, NULL::VARCHAR, NULL::VARCHAR FROM (SELECT DISTINCT id FROM s) AS s LEFT JOIN t ON t.id = s.id
  UNION ALL
  SELECT s.id, f.nth + 1, CASE WHEN NOT f.there OR {taken} THEN s.m ELSE f.m END, true, s.path::VARCHAR, CASE WHEN NOT f.there THEN 'add' WHEN {taken} THEN 'replace' ELSE '{other}' END
  FROM f JOIN s ON s.id = f.id AND s.nth = f.nth + 1
)
SELECT id, path, action FROM f WHERE nth > 0 {skipped} {gone}"""


for _mode in merge.MODES:
    QUERIES[f"merge_{_mode}"] = lambda spark, folder, mode=_mode: merge.plan(_source(Tables(spark, folder)), _target(Tables(spark, folder)), mode)
    ORACLES[f"merge_{_mode}"] = _merge_sql(_mode)


@query(
    _merge_sql(
        "sync",
        "SELECT * REPLACE (row_number() OVER (PARTITION BY id ORDER BY path) AS nth) FROM (" + _SOURCE + ") WHERE o_orderstatus <> 'F'",
        "UNION ALL SELECT o_custkey::VARCHAR, o_orderkey::VARCHAR, 'skip' FROM orders WHERE o_orderstatus = 'F'",
    )
)
def merge_excluded(t: Tables) -> DataFrame:
    return merge.plan(_source(t), _target(t), "sync", F.col("o_orderstatus") == "F")


@query("SELECT s_suppkey + n AS key FROM supplier, range(0, 3) AS x(n) WHERE s_suppkey + n NOT IN (SELECT l_suppkey FROM lineitem)")
def unused_parameters(t: Tables) -> DataFrame:
    params = t.supplier.select(F.explode(F.sequence("s_suppkey", F.col("s_suppkey") + 2)).alias("key"))
    return merge.unused(params, t.lineitem.select(F.col("l_suppkey").alias("key")).distinct(), "key")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def remove_items(t: Tables) -> DataFrame:
    selected = t.orders.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.remove(t.customer.select("c_custkey", "c_name"), selected, "c_custkey")


@query(f"""
WITH i AS ({_DISCS}), s AS (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
SELECT key, CASE WHEN key IN (FROM s) THEN 77 ELSE itime END::BIGINT AS itime, mtime, ctime, CASE WHEN key IN (FROM s) THEN 77 ELSE atime END::BIGINT AS atime FROM i
""")
def touch_items(t: Tables) -> DataFrame:
    items = _discs(t).select("key", "itime", "mtime", "ctime", F.col("atime").cast("long").alias("atime"))
    return merge.touch(items, t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("key")), "key", F.lit(77).cast("long"), ("itime", "atime"))


@query("SELECT o_orderkey AS job FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 25")
def job_limit(t: Tables) -> DataFrame:
    return merge.job_limit(t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job")), [F.col("job")], 25)


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS there FROM customer")
def existence(t: Tables) -> DataFrame:
    there = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("there", F.lit(True))
    return t.customer.select("c_custkey").join(there, "c_custkey", "left").select("c_custkey", F.coalesce("there", F.lit(False)).alias("there"))


# --- extents

_EXT = "SELECT user_id, event_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS off, 600 + event_id % 7 * 6000 AS size FROM events"


def _ext(t: Tables) -> DataFrame:
    off = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))) - F.lit(1704067200)
    return t.events.select("user_id", "event_id", off.alias("off"), (600 + F.col("event_id") % 7 * 6000).alias("size"))


def _islands_sql(sign: str) -> str:
    return f"""
WITH e AS ({_EXT}), m AS (SELECT *, max(off + size) OVER (PARTITION BY user_id ORDER BY off, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR off {sign} reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY off, size ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT user_id, min(off) AS off, max(off + size) - min(off) AS size FROM n GROUP BY user_id, i"""


@query(_islands_sql(">"))
def interval_union(t: Tables) -> DataFrame:
    return extents.islands(_ext(t), ["user_id"])


@query(_islands_sql(">="))
def interval_union_overlap(t: Tables) -> DataFrame:
    return extents.islands(_ext(t), ["user_id"], touching=False)


@query(f"""
WITH a AS ({_islands_sql(">")}), g AS (SELECT user_id, off + size AS off, lead(off) OVER (PARTITION BY user_id ORDER BY off) - off - size AS size FROM a)
SELECT * FROM g WHERE size > 0
""")
def unused_gaps(t: Tables) -> DataFrame:
    return extents.gaps(_ext(t), ["user_id"])


@query(f"""
WITH e AS ({_EXT}), p AS (SELECT DISTINCT user_id, unnest([off, off + size]) AS p FROM e),
s AS (SELECT user_id, p AS off, lead(p) OVER (PARTITION BY user_id ORDER BY p) AS e FROM p),
c AS (SELECT s.* FROM s WHERE e IS NOT NULL
  AND EXISTS (SELECT 1 FROM e x WHERE x.user_id = s.user_id AND x.event_id % 2 = 0 AND x.off <= s.off AND x.off + x.size >= s.e)
  AND NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = s.user_id AND x.event_id % 2 = 1 AND x.off <= s.off AND x.off + x.size >= s.e))
SELECT user_id, sum(e - off)::BIGINT AS left_over FROM c GROUP BY user_id
""")
def interval_subtraction(t: Tables) -> DataFrame:
    e = _ext(t)
    left = extents.subtract(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"])
    return left.groupBy("user_id").agg(F.sum("size").alias("left_over"))


@query(f"""
WITH e AS ({_EXT}), a AS (SELECT user_id, event_id * 1000 AS src, off AS mid, size FROM e WHERE event_id % 2 = 0),
b AS (SELECT user_id, off AS mid, event_id * 7 AS dst, size FROM e WHERE event_id % 2 = 1),
c AS (SELECT a.user_id, a.src + greatest(a.mid, b.mid) - a.mid AS src, b.dst + greatest(a.mid, b.mid) - b.mid AS dst,
  least(a.mid + a.size, b.mid + b.size) - greatest(a.mid, b.mid) AS size
FROM a JOIN b ON a.user_id = b.user_id AND a.mid < b.mid + b.size AND b.mid < a.mid + a.size),
n AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY src, dst, size ROWS UNBOUNDED PRECEDING) AS piece
  FROM (SELECT *, coalesce(src = lag(src + size) OVER w AND dst = lag(dst + size) OVER w, false) AS goes_on FROM c WINDOW w AS (PARTITION BY user_id ORDER BY src, dst, size)))
SELECT user_id, min(src) AS src, min(dst) AS dst, sum(size)::BIGINT AS size FROM n GROUP BY user_id, piece
""")
def extent_compose(t: Tables) -> DataFrame:
    e = _ext(t)
    a = e.where("event_id % 2 = 0").select("user_id", (F.col("event_id") * 1000).alias("src"), F.col("off").alias("mid"), "size")
    b = e.where("event_id % 2 = 1").select("user_id", F.col("off").alias("mid"), (F.col("event_id") * 7).alias("dst"), "size")
    return extents.compose(a, b, ["user_id"])


@query(f"""
WITH e AS ({_EXT})
SELECT user_id, event_id, coalesce(off < max(off + size) OVER (PARTITION BY user_id ORDER BY off, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM e
""")
def overlap_marks(t: Tables) -> DataFrame:
    return extents.overlapping(_ext(t), ["user_id"]).select("user_id", "event_id", "overlaps")


@query(f"""
WITH f AS (SELECT user_id, off, ceil(size / 4) * 4 AS size FROM ({_islands_sql(">")})), p AS (SELECT user_id, off + size // 2 + 3000 AS pos FROM ({_EXT}) ),
h AS (SELECT p.*, (SELECT max(off) FROM f WHERE f.user_id = p.user_id AND f.off <= p.pos) AS here, (SELECT min(off) FROM f WHERE f.user_id = p.user_id AND f.off > p.pos) AS after FROM p)
SELECT h.user_id, pos, coalesce(pos < here + f.size, false) AS inside, CASE WHEN pos < here + f.size THEN here ELSE after END::VARCHAR AS file FROM h LEFT JOIN f ON f.user_id = h.user_id AND f.off = here
""")
def offset_lookup(t: Tables) -> DataFrame:
    files = extents.islands(_ext(t), ["user_id"]).withColumn("file", F.col("off").cast("string"))
    points = _ext(t).select("user_id", (F.col("off") + F.expr("size div 2") + 3000).alias("at"))
    return extents.covering(points, files, ["user_id"]).withColumnRenamed("at", "pos")


@query("""
WITH b AS (SELECT l_suppkey, l_orderkey // 40 AS block, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS idx FROM lineitem),
d AS (SELECT *, lag(block) OVER (PARTITION BY l_suppkey ORDER BY idx) AS prev FROM b WHERE block <> 0)
SELECT l_suppkey, sum(CASE WHEN prev IS NULL OR block <> prev + 1 THEN 1 ELSE 0 END)::BIGINT AS n_fragments, (sum(CASE WHEN prev IS NULL OR block <> prev + 1 THEN 1 ELSE 0 END) - 1)::BIGINT * 1024 // count(*) AS ratio FROM d GROUP BY ALL
""")
def fragments(t: Tables) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    blocks = t.lineitem.select("l_suppkey", F.expr("l_orderkey div 40").alias("block"), nth.alias("idx"))
    sizes = blocks.where("block <> 0").groupBy("l_suppkey").agg(F.count("*").alias("k"))
    out = extents.fragments(blocks, ["l_suppkey"]).join(sizes, "l_suppkey")
    return out.select("l_suppkey", "n_fragments", F.expr("(n_fragments - 1) * 1024 div k").alias("ratio"))


@query("""
SELECT l_suppkey, sum(u)::BIGINT AS n_groups FROM (SELECT l_suppkey, l_orderkey // 8 AS g, max(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS u FROM lineitem GROUP BY ALL) GROUP BY ALL
""")
def used_blocks(t: Tables) -> DataFrame:
    return extents.used_groups(t.lineitem.select("l_suppkey", F.col("l_orderkey").alias("sector"), (F.col("l_quantity") > 40).alias("used")), ["l_suppkey"], 8)


@query("""
SELECT p_type, g AS geometry, sum((p_size * 100000 + g - 1) // g)::BIGINT AS n_blocks, sum((p_size * 100000 + g - 1) // g * g)::BIGINT AS size FROM part, (VALUES (32768), (2097152), (8388608)) AS x(g) GROUP BY ALL
""")
def image_sizes(t: Tables) -> DataFrame:
    rows = t.part.select("p_type", (F.col("p_size") * 100000).cast("long").alias("s"), F.explode(F.array(*map(F.lit, (32768, 2097152, 8388608)))).alias("geometry"))
    blocks = F.expr("(s + geometry - 1) div geometry")
    return rows.groupBy("p_type", "geometry").agg(F.sum(blocks).alias("n_blocks"), F.sum(blocks * F.col("geometry")).alias("size"))


@query("""
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS free, count(*) - count(*) FILTER (o_orderstatus = 'F') AS used,
  100 * (count(*) - count(*) FILTER (o_orderstatus = 'F')) // count(*) AS percent FROM orders GROUP BY ALL
""")
def space_report(t: Tables) -> DataFrame:
    out = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("free"))
    return out.withColumn("used", F.col("total") - F.col("free")).withColumn("percent", F.expr("100 * used div total"))


@query("SELECT l_suppkey, bit_or(l_orderkey * 64) & -bit_or(l_orderkey * 64) AS aligned FROM lineitem WHERE l_orderkey > 0 GROUP BY ALL")
def alignment(t: Tables) -> DataFrame:
    return t.lineitem.where("l_orderkey > 0").groupBy("l_suppkey").agg(extents.alignment(F.col("l_orderkey") * 64).alias("aligned"))


@query("SELECT l_partkey, least(count(*), 255) AS n_refs FROM lineitem GROUP BY ALL")
def block_multiplicity(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.least(F.count("*"), F.lit(255)).alias("n_refs"))


@query("""
SELECT host, count(*) AS n, count(*) FILTER (url LIKE '%/') AS n_dirs, max(length(url))::BIGINT AS longest FROM (SELECT url, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages) GROUP BY ALL
""")
def tree_statistics(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "://([^/]*)", 1).alias("host")
    return t.pages.groupBy(host).agg(F.count("*").alias("n"), F.count_if(F.col("url").endswith("/")).alias("n_dirs"), F.max(F.length("url")).cast("long").alias("longest"))


@query("""
SELECT user_id, bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 4 ELSE 8 END)::INTEGER AS status FROM events GROUP BY ALL
""")
def status_bits(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    bit = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "error", 4).otherwise(8)
    return t.events.groupBy("user_id").agg(F.bit_or(bit).alias("status"))


@query(f"""
WITH e AS ({_EXT}), x AS (SELECT user_id, event_id, unnest(range(off // 3600, (off + size - 1) // 3600 + 1)) AS sector FROM e)
SELECT user_id, sector, max(event_id) AS marker FROM x GROUP BY ALL
""")
def usage_table(t: Tables) -> DataFrame:
    return extents.paint(_ext(t).withColumn("marker", F.col("event_id")).withColumn("ord", F.col("event_id")), ["user_id"], 3600)


@query("""
SELECT g AS old_group, row_number() OVER (ORDER BY g) - 1 AS new_group FROM (SELECT DISTINCT l_orderkey // 8 AS g FROM lineitem WHERE l_quantity > 49)
""")
def pack_used(t: Tables) -> DataFrame:
    groups = t.lineitem.where("l_quantity > 49").select(F.expr("l_orderkey div 8").alias("old_group")).distinct()
    return order.numbered(groups, [], [F.col("old_group")], "new_group")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey AS sector, o_orderstatus = 'F' AS used FROM orders),
d AS (SELECT *, sector_turn FROM (SELECT *, CASE WHEN lag(used) OVER w IS NOT DISTINCT FROM used THEN 0 ELSE 1 END AS sector_turn FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY sector))),
r AS (SELECT *, sum(sector_turn) OVER (PARTITION BY o_custkey ORDER BY sector) AS r FROM d)
SELECT o_custkey, min(sector) AS first, count(*) AS length, bool_and(used) AS used FROM r GROUP BY o_custkey, r
""")
def usage_runs(t: Tables) -> DataFrame:
    return extents.runs(t.orders.select("o_custkey", F.col("o_orderkey").alias("sector"), (F.col("o_orderstatus") == "F").alias("used")), ["o_custkey"])


@query("""
SELECT p_type, p_partkey, coalesce(sum((p_size * 1000 + 4095) // 4096 * 4096) OVER (PARTITION BY p_type ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM part
""")
def running_layout(t: Tables) -> DataFrame:
    return extents.layout(t.part.withColumn("size", F.col("p_size") * 1000), ["p_type"], ["p_partkey"], 4096).select("p_type", "p_partkey", "off")


@query("""
WITH u AS (SELECT DISTINCT p_type, p_size - 1 AS slot FROM part WHERE p_size % 3 <> 0), r AS (SELECT * FROM (SELECT DISTINCT p_type FROM u), range(0, 200) x(slot)),
f AS (SELECT r.*, row_number() OVER (PARTITION BY p_type ORDER BY slot) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.p_type = r.p_type AND u.slot = r.slot))
SELECT p_type, slot::INTEGER AS slot FROM f WHERE n <= 5
""")
def free_slots(t: Tables) -> DataFrame:
    return extents.free_slots(t.part.where("p_size % 3 <> 0").select("p_type", (F.col("p_size") - 1).alias("slot")), ["p_type"], "slot", 5)


# --- integrity


@query("""
WITH a AS (SELECT o_orderkey, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, md5(CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 9 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.h IS NULL THEN 'only_left' WHEN a.h IS NULL THEN 'only_right' WHEN a.h = b.h THEN 'equal' ELSE 'differ' END AS status
FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey
""")
def tree_diff(t: Tables) -> DataFrame:
    side = lambda n, value: t.orders.where(f"o_orderkey % {n} <> 0").select("o_orderkey", F.md5(value.cast("binary")).alias("h"))
    changed = F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus"))
    return integrity.diff(side(10, F.col("o_orderstatus")), side(9, changed), ["o_orderkey"], "h")


@query("""
WITH d AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_discount > 0.05),
r AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS n_all, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS n FROM d)
SELECT l_suppkey, l_orderkey, l_linenumber, n_all FROM r WHERE n <= 3
""")
def message_limit(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_discount > 0.05").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return integrity.first_messages(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "n_all")


#: Some references lie beyond the last block.
_REFS = """SELECT l_suppkey AS slot, l_linenumber AS idx, CASE WHEN l_quantity < 2 THEN 0 WHEN l_quantity > 49 THEN l_partkey + (SELECT max(p_partkey) FROM part) ELSE l_partkey END AS block
  FROM lineitem WHERE l_returnflag = 'R' OR l_discount > 0.06"""
_FBT = "SELECT p_partkey AS block, p_size > 25 AS is_free FROM part"


def _container(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Slots, references, table of free blocks and number of blocks."""
    last = t.part.agg(F.max("p_partkey")).first()[0]
    block = F.when(F.col("l_quantity") < 2, 0).when(F.col("l_quantity") > 49, F.col("l_partkey") + last).otherwise(F.col("l_partkey"))
    refs = t.lineitem.where("l_returnflag = 'R' or l_discount > 0.06").select(F.col("l_suppkey").alias("slot"), F.col("l_linenumber").alias("idx"), block.alias("block"))
    return t.supplier.select(F.col("s_suppkey").alias("slot")), refs, t.part.select(F.col("p_partkey").alias("block"), (F.col("p_size") > 25).alias("is_free")), last + 1


@query(f"""
WITH r AS (SELECT * FROM ({_REFS}) WHERE block <> 0), g AS (SELECT * FROM r WHERE block <= (SELECT max(p_partkey) FROM part)), f AS ({_FBT})
SELECT 'invalid' AS kind, slot, block FROM r WHERE block > (SELECT max(p_partkey) FROM part) UNION ALL SELECT 'marked_free', slot, block FROM g WHERE block IN (SELECT block FROM f WHERE is_free)
UNION ALL SELECT 'multi_use', NULL, block FROM g GROUP BY block HAVING count(*) > 1 UNION ALL SELECT 'no_blocks', s_suppkey, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT slot FROM r)
UNION ALL SELECT 'lost', NULL, block FROM f WHERE NOT is_free AND block NOT IN (SELECT block FROM g)
""")
def container_check(t: Tables) -> DataFrame:
    return integrity.check_container(*_container(t))


@query(f"SELECT b AS block, b NOT IN (SELECT block FROM ({_REFS})) AS is_free FROM range(1, (SELECT max(p_partkey) FROM part) + 1) x(b)")
def container_repair(t: Tables) -> DataFrame:
    _, refs, _, n_blocks = _container(t)
    return integrity.repaired_table(refs, n_blocks)


@query(f"""
WITH r AS ({_REFS}), d AS (SELECT s_suppkey AS slot FROM supplier WHERE s_suppkey % 4 = 0)
SELECT slot FROM d WHERE slot NOT IN (SELECT slot FROM r WHERE slot IN (SELECT slot FROM d) AND block IN (SELECT block FROM r WHERE slot NOT IN (SELECT slot FROM d)))
""")
def container_recover(t: Tables) -> DataFrame:
    slots, refs, _, _ = _container(t)
    return integrity.recoverable(slots.where("slot % 4 = 0"), refs)


@query("""
WITH l0 AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, sha256(text) AS hash FROM documents),
l1 AS (SELECT lang, idx // 31 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM l0 GROUP BY lang, idx // 31),
l2 AS (SELECT lang, idx // 8 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM l1 GROUP BY lang, idx // 8),
l3 AS (SELECT lang, idx // 8 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM l2 GROUP BY lang, idx // 8)
SELECT lang, 0 AS level, idx, hash FROM l0 UNION ALL SELECT lang, 1, idx, hash FROM l1 UNION ALL SELECT lang, 2, idx, hash FROM l2 UNION ALL SELECT lang, 3, idx, hash FROM l3
""")
def hash_tree(t: Tables) -> DataFrame:
    hashes = t.documents.select("lang", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return integrity.hash_tree(order.numbered(hashes, ["lang"], [F.col("doc_id")], "idx").select("lang", "idx", "hash"), ["lang"], [31, 8, 8])


@query("""
SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'NO-HASH' WHEN doc_id % 10 = 2 THEN 'INVALID' WHEN doc_id % 10 = 3 THEN 'ERR' ELSE 'OK' END AS status FROM documents
""")
def verify_status(t: Tables) -> DataFrame:
    k, own = F.col("doc_id") % 10, F.sha2(F.col("text").cast("binary"), 256)
    stored = t.documents.select("doc_id", F.when(k != 1, F.when(k == 3, F.lit("0")).otherwise(own)).alias("hash"))
    return integrity.verify(stored, t.documents.where("doc_id % 10 <> 2").select("doc_id", own.alias("hash")), ["doc_id"])


@query("""
SELECT p_partkey, coalesce(p.data, p_name) AS data, p.data IS NOT NULL AS patched FROM part
LEFT JOIN (SELECT l_partkey, arg_max(l_orderkey::VARCHAR, l_orderkey) AS data FROM lineitem WHERE l_quantity > 48 GROUP BY 1) p ON l_partkey = p_partkey
""")
def patch_overlay(t: Tables) -> DataFrame:
    patches = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("ord"), F.col("l_orderkey").cast("string").alias("data"))
    return integrity.apply_patches(t.part.select("p_partkey", F.col("p_name").alias("data")), patches, ["p_partkey"])


# --- scalars


def _spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly over the tasks of a shuffle: a file is read in as many tasks as it has row groups, often one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@query("""
SELECT p_partkey, (p_size * 1000 + 512)::BIGINT AS a, p_size * 1048576::BIGINT + p_partkey AS b, (p_size * 32768)::BIGINT AS c, p_size * 1047552::BIGINT AS minus, p_size::BIGINT AS cut,
  CASE WHEN p_size >= 4 THEN p_size * 1459978240::BIGINT - 4699979776 END AS discs, p_size * 1024::BIGINT + 7 AS sign, NULL::BIGINT AS other FROM part
""")
def parse_sizes(t: Tables) -> DataFrame:
    text = lambda *x: F.concat(*[F.col(y).cast("string") if y.startswith("p_") else F.lit(y) for y in x])
    return _spread(t.part.select("p_partkey", "p_size")).select(
        "p_partkey", S.parse_size(text("p_size", "k+512")).alias("a"), S.parse_size(text("p_size", "+", "p_partkey"), S.MIB).alias("b"), S.parse_size(text("p_size", "/2", "s", "+", "p_size", "/2s")).alias("c"),
        S.parse_size(text("p_size", "M - ", "p_size", "K")).alias("minus"), S.parse_size(text("p_size", ".75")).alias("cut"), S.parse_size(text("p_size", "u-1W")).alias("discs"),
        S.parse_size(text("p_size", "K+"), 1, 7).alias("sign"), S.parse_size(text("x", "p_size")).alias("other"),
    )


def _print_size_sql(base: int, names: str) -> str:
    h = lambda k: f"({base}::BIGINT ** {k})::BIGINT"
    return f"""
WITH s AS (SELECT p_partkey, unnest([p_size::BIGINT << (p_partkey % 40)::INTEGER, p_size::BIGINT * p_partkey, p_size * {h(1)} ** (p_partkey % 4)::BIGINT, p_partkey + 9000])::BIGINT AS size FROM part),
r AS (SELECT *, (size + {base // 2}) // {base} AS k, (size + {base**2 // 2}) // {base**2} AS m, size // {base**2} AS d FROM s),
q AS (SELECT *, (d + {base**2 // 2}) // {base**2} AS tt, (d + {base // 2}) // {base} AS g FROM r),
n AS (SELECT p_partkey, size, CASE WHEN m < 10000 THEN CASE WHEN k < 10 THEN size WHEN k < 10000 THEN k ELSE m END WHEN tt < 10 THEN g ELSE tt END AS n,
  CASE WHEN m < 10000 THEN CASE WHEN k < 10 THEN 0 WHEN k < 10000 THEN 1 ELSE 2 END WHEN tt < 10 THEN 3 ELSE 4 END AS u FROM q)
SELECT p_partkey, size, CASE WHEN n > 0 AND n % {base} = 0 THEN n // {base} || ' ' || {names}[u + 2] ELSE n || ' ' || {names}[u + 1] END AS text FROM n"""


def _print_sizes(base: int):
    def make(t: Tables) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size").cast("long")
        powers = F.element_at(F.array(*[F.lit(base**k).cast("long") for k in range(4)]), (key % 4 + 1).cast("int"))
        rows = _spread(t.part.select("p_partkey", "p_size")).select("p_partkey", F.explode(F.array(F.call_function("shiftleft", size, (key % 40).cast("int")), size * key, size * powers, key + 9000)).alias("size"))
        return rows.select("p_partkey", "size", S.print_size(F.col("size"), base).alias("text"))

    return make


for _base, _name, _units in ((1024, "print_sizes", "['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB', 'EiB']"), (1000, "print_sizes_si", "['B', 'kB', 'MB', 'GB', 'TB', 'PB', 'EB']")):
    QUERIES[_name] = lambda spark, folder, make=_print_sizes(_base): make(Tables(spark, folder))
    ORACLES[_name] = _print_size_sql(_base, _units)


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS minute,
  CASE WHEN o_orderkey % 5 = 0 THEN '---------- --:--:--' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS second, o_orderdate = o_orderdate AS same,
  date_trunc('hour', t) AS hours, date_trunc('minute', t) AS minutes, date_trunc('second', t) AS seconds, date_trunc('hour', t) AS plain_hours, NULL::TIMESTAMP AS dotted
FROM (SELECT *, o_orderdate + to_seconds((o_orderkey * 7919 % 86400)::INTEGER) AS t FROM orders)
""")
def print_times(t: Tables) -> DataFrame:
    time = F.col("o_orderdate").cast("timestamp")
    same = (S.parse_time(S.print_time(time)) == time) & (S.parse_time(F.date_format(time, "yyyyMMdd")) == time) & (S.parse_time(F.unix_timestamp(time).cast("string")) == time)
    later = F.timestamp_seconds(F.unix_timestamp(time) + F.col("o_orderkey") * 7919 % 86400)
    told = lambda form, name: S.parse_time(F.date_format(later, form)).cast("timestamp_ntz").alias(name)
    return _spread(t.orders.select("o_orderkey", "o_orderdate")).select(
        "o_orderkey", S.print_time(time, "date").alias("day"), S.print_time(time, "minute").alias("minute"), S.print_time(F.when(F.col("o_orderkey") % 5 != 0, time)).alias("second"), same.alias("same"),
        told("yyyy-MM-dd HH", "hours"), told("yyyy-MM-dd HHmm", "minutes"), told("yyyyMMdd HHmmss", "seconds"), told("yyyyMMdd HH", "plain_hours"), told("dd.MM.yyyy HH:mm", "dotted"),
    )


@query("""
SELECT p_partkey, upper(substr(p_name, 1, 3)) || ' [' || p_type || '] ' || lower(p_brand) || ' 100%' AS name FROM part
""")
def name_template(t: Tables) -> DataFrame:
    fields = {"n": F.col("p_name"), "i": F.col("p_type"), "b": F.col("p_brand")}
    return t.part.select("p_partkey", S.fill_template("%1-3un [%i] %lb 100%%", fields).alias("name"))


@query("""
SELECT p_partkey, p_name || ' - [' || p_type || '] {x} & 100% "' AS cleaned, upper(substr(p_type, 1, 4)) || 'Q1' AS found, upper(substr(p_type, 1, 4)) AS four,
  CASE WHEN p_partkey % 2 = 0 THEN 'AB_D01' ELSE upper(substr(p_type, 1, 3)) || 'D01' END AS before_name, NULL::VARCHAR AS five,
  upper(substr(p_type, 1, 1)) || 'X' || upper(substr(p_type, 3, 1)) || 'Y' || substr(upper(p_type), 5) AS patched, length(p_type) = 6 AS is_id FROM part
""")
def names_and_ids(t: Tables) -> DataFrame:
    ident, text = F.upper("p_type"), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    four = F.substring(ident, 1, 4)
    first = F.when(F.col("p_partkey") % 2 == 0, "AB_D01 = ").otherwise(text(F.substring(ident, 1, 3), "D01 and "))
    return t.part.select(
        "p_partkey", S.clean_name(text(" ", F.col("p_name"), " : [", F.col("p_type"), '] {x} & 100% *?"~')).alias("cleaned"),
        S.find_id(text("[AAAA01] ", F.col("p_name"), " [", four, "Q1] [ZZ]")).alias("found"), S.find_id(text(" ", four, " ")).alias("four"), S.find_id(text(first, F.col("p_name"))).alias("before_name"),
        S.find_id(text(F.substring(ident, 1, 3), "45 and more")).alias("five"), S.patch_id(ident, ".x.y").alias("patched"), S.is_id(ident, (6,)).alias("is_id"),
    )


_REGION_NAMES = """['All', '-?-', 'Chinese', 'German', 'NTSC/USA', 'French', '-?-', 'Netherlands', 'Italian', 'Japan', 'Korea', 'Japan->PAL', 'America->PAL', 'Japan->NTSC', '-?-', 'PAL', 'Korea (japanese)', 'Russia',
  'Spanish', 'Korea (english)', 'Australia', 'Scandinavian', 'Taiwan', 'Almost Europe', 'Almost Europe', 'PAL or US', '-?-']"""
_REGION_CODES = "['ALL', '-?-', 'CHIN', 'GERM', 'USA', 'FREN', '-?-', 'NL', 'ITAL', 'JAPA', 'KORE', 'J>PL', 'A>PL', 'J>US', '-?-', 'PAL', 'KO/J', 'RUS', 'SPAN', 'KO/E', 'AUS', 'SCAN', 'TAIW', 'EURO', 'EURO', 'ANY', '-?-']"


@query(f"""
SELECT p_partkey, {_REGION_NAMES}[p_partkey % 27 + 1] AS region, {_REGION_CODES}[p_partkey % 27 + 1] AS code,
  (p_partkey + 63) // 64 * 64 AS aligned, bit_count(p_partkey)::INTEGER AS bits, p_partkey & -p_partkey AS low, (p_partkey >> 3) || ':' || ((p_partkey << 29) & 4294967295) AS version,
  p_size * 4294967296 + p_partkey AS parsed, 4294967296 + p_partkey AS alone, p_size * 4294967296 + 255 AS hexed, NULL::BIGINT AS bad FROM part
""")
def regions_and_bits(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    letter = F.when(key % 27 == 26, "_").when(key % 2 == 0, F.char((key % 27 + 65).cast("int"))).otherwise(F.char((key % 27 + 97).cast("int")))
    ident = F.concat(F.lit("ABC"), letter, F.lit("01"))
    return t.part.select(
        "p_partkey", S.region(ident).alias("region"), S.region(ident, short=True).alias("code"), S.align_up(key, 64).alias("aligned"), F.bit_count(key).alias("bits"), S.low_bit(key).alias("low"), S.version_pair(F.shiftleft(key, 29)).alias("version"),
        S.parse_version(F.concat(size, F.lit(":"), key.cast("string"))).alias("parsed"), S.parse_version(key.cast("string")).alias("alone"), S.parse_version(F.concat(size, F.lit("-0xFF"))).alias("hexed"),
        S.parse_version(F.concat(size, F.lit(":"))).alias("bad"),
    )


@query("""
SELECT p_partkey, CASE WHEN length(p_type) <= 6 THEN upper(p_type) ELSE substr(p_type, 1, 4) END AS id, ascii(substr(p_type, 1, 1)) * 256 + ascii(substr(p_type, 2, 1))::BIGINT AS number, ascii(substr(p_type, 2, 1)) * 256 + ascii(substr(p_type, 1, 1))::BIGINT AS little,
  concat_ws('|', CASE WHEN p_size & 1 <> 0 THEN 'odd' END, CASE WHEN p_size & 2 <> 0 THEN 'two' END, CASE WHEN p_size & 4 <> 0 THEN 'four' END) AS status FROM part
""")
def hex_ids(t: Tables) -> DataFrame:
    spelled = F.when(F.length("p_type") <= 6, F.col("p_type")).otherwise(F.concat(F.lit("00010000"), F.hex(F.substring("p_type", 1, 4).cast("binary"))))
    return t.part.select("p_partkey", S.hex_id(spelled).alias("id"), S.big_endian(F.col("p_type").cast("binary"), 0, 2).alias("number"), S.little_endian(F.col("p_type").cast("binary"), 0, 2).alias("little"), S.status_text(F.col("p_size"), ["odd", "two", "four"]).alias("status"))


@query("""
WITH a AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS sector, l_partkey, l_quantity FROM lineitem),
l AS (SELECT l_suppkey, sector, min(l_partkey) % 3 AS usage, sha256(min(l_quantity)::INTEGER::VARCHAR) AS hash FROM a WHERE sector % 17 <> 0 GROUP BY l_suppkey, sector),
q AS (SELECT l_suppkey, sector, min(l_partkey) % 3 AS usage, min(l_quantity)::INTEGER AS v FROM a WHERE sector % 23 <> 0 GROUP BY l_suppkey, sector),
r AS (SELECT l_suppkey, sector, usage, sha256((v + CASE WHEN sector % 19 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS hash FROM q),
j AS (SELECT coalesce(l.l_suppkey, r.l_suppkey) AS l_suppkey, coalesce(l.sector, r.sector) AS sector, NOT coalesce(l.usage = r.usage AND l.hash = r.hash, false) AS d FROM l FULL OUTER JOIN r ON l.l_suppkey = r.l_suppkey AND l.sector = r.sector)
SELECT l_suppkey, count(*) AS n_blocks, count(*) FILTER (d) AS n_differ, min(sector) FILTER (d) AS first_differ FROM j GROUP BY ALL
""")
def block_diff(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("sector", F.col("l_orderkey") * 8 + F.col("l_linenumber"))

    def side(n: int, step: int) -> DataFrame:
        value = F.min("l_quantity").cast("int") + (F.when(F.col("sector") % 19 == 0, 1).otherwise(0) if step else F.lit(0))
        return rows.where(f"sector % {n} <> 0").groupBy("l_suppkey", "sector").agg((F.min("l_partkey") % 3).alias("usage"), F.sha2(value.cast("string").cast("binary"), 256).alias("hash"))

    return integrity.block_diff(side(17, 0), side(23, 1), ["l_suppkey"])


@query(f"""
WITH e AS ({_EXT}), s AS (SELECT user_id, event_id AS section, off - 3000 AS start, size * 3 AS length FROM e WHERE event_id % 4 = 0)
SELECT e.user_id, e.event_id, (SELECT min(section) FROM s WHERE s.user_id = e.user_id AND e.off >= s.start AND e.off + e.size <= s.start + s.length) AS section FROM e
""")
def section_lookup(t: Tables) -> DataFrame:
    e = _ext(t)
    sections = e.where("event_id % 4 = 0").select("user_id", F.col("event_id").alias("section"), (F.col("off") - 3000).alias("start"), (F.col("size") * 3).alias("length"))
    return extents.in_section(e, sections, ["user_id"]).select("user_id", "event_id", "section")


@query("""
WITH w AS (SELECT o_custkey, o_orderkey AS idx, o_orderkey % 5 AS word FROM orders), u AS (SELECT *, idx - lag(idx) OVER (PARTITION BY o_custkey ORDER BY idx) > 1500 AS gap FROM w WHERE word <> 0),
n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY idx) AS s FROM u)
SELECT o_custkey, min(idx) AS first, max(idx) - min(idx) + 1 AS length FROM n GROUP BY o_custkey, s
""")
def hole_segments(t: Tables) -> DataFrame:
    words = t.orders.select("o_custkey", F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 5).alias("word"))
    return extents.segments(words, ["o_custkey"], 1500)


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL ELSE CASE p_size % 4 WHEN 1 THEN 'lzma' WHEN 2 THEN 'bzip2' ELSE 'none' END || CASE WHEN p_size % 3 = 0 THEN '.' || p_size % 10 ELSE '' END || CASE WHEN p_size % 5 = 0 THEN '@' || p_size ELSE '' END END AS name,
  CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' || p_size & 31 END || ',' || (p_size & 31) || CASE WHEN p_size % 3 = 0 THEN '?' ELSE '' END AS ages FROM part
""")
def compression_names(t: Tables) -> DataFrame:
    size = F.col("p_size")
    method = F.when(size % 4 == 1, "LZMA").when(size % 4 == 2, "BZip2").when(size % 4 == 3, "none").otherwise("rar")
    text = F.concat(method, F.when(size % 3 == 0, F.concat(F.lit("."), (size % 10).cast("string"))).otherwise(""), F.when(size % 5 == 0, F.concat(F.lit("@"), size.cast("string"))).otherwise(""))
    bits = F.array(size.bitwiseAND(F.lit(31)) + F.when(size % 2 == 0, 128).otherwise(0), size.bitwiseAND(F.lit(31)) + F.when(size % 3 == 0, 64).otherwise(0))
    return t.part.select("p_partkey", B.print_compression(B.compression(text)).alias("name"), B.ratings(bits).alias("ages"))


@query(f"""
WITH b AS (SELECT doc_id, text, [('0x' || x)::INTEGER FOR x IN regexp_extract_all(hex(encode(text)), '..')] AS d FROM documents)
SELECT doc_id, ((1 + coalesce(list_sum(d), 0)) % 65521 + ((len(d) + coalesce(list_sum([x * (len(d) - i + 1)::BIGINT FOR x, i IN d]), 0)) % 65521) * 65536)::BIGINT AS adler32,
  translate(text, '{B.ACCENTED}', '{B.BASE_LETTERS}') AS base_text FROM b
""")
def block_checksums(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", B.adler32(F.col("text").cast("binary")).alias("adler32"), B.base_letters(F.col("text")).alias("base_text"))


@query("""
SELECT l_suppkey, block, max(usage)::INTEGER AS usage FROM (SELECT l_suppkey, l_orderkey // 16 AS block, l_linenumber AS usage FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL SELECT l_suppkey, l_orderkey // 24, l_linenumber + 1 FROM lineitem WHERE l_linestatus <> 'F') GROUP BY ALL
""")
def map_union(t: Tables) -> DataFrame:
    side = lambda rows, unit, usage: t.lineitem.where(rows).select("l_suppkey", F.expr(f"l_orderkey div {unit}").alias("block"), usage.alias("usage"))
    return extents.map_union(side("l_linestatus = 'F'", 16, F.col("l_linenumber")), side("l_linestatus <> 'F'", 24, F.col("l_linenumber") + 1), ["l_suppkey"])


@query("""
WITH k AS (SELECT o_orderkey, o_orderkey % 10 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 1 THEN 'NO-HASH' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'H0-ERR' WHEN 4 THEN 'H1-ERR' WHEN 5 THEN 'H2-ERR' WHEN 6 THEN 'H2-ERR' ELSE 'OK' END AS status FROM k
""")
def verify_levels(t: Tables) -> DataFrame:
    k, levels = F.col("o_orderkey") % 10, ("h0", "h1", "h2")
    own = lambda x: F.md5(F.concat(F.lit(x), F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).cast("binary"))
    bad = {"h0": (3,), "h1": (3, 4), "h2": (4, 5, 6)}
    stored = t.orders.select("o_orderkey", *[F.when(k.isin(*bad[x]), F.lit("0")).when((k != 1) & ((k != 6) | (x != "h1")), own(x)).alias(x) for x in levels])
    return integrity.verify_levels(stored, t.orders.where(k != 2).select("o_orderkey", *[own(x).alias(x) for x in levels]), ["o_orderkey"], levels)


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS data, p_partkey % 5 = 0 AND upper(p_name) <> p_name AS patched FROM part")
def patch_round_trip(t: Tables) -> DataFrame:
    old = t.part.select("p_partkey", F.col("p_name").alias("data"))
    new = t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("data"))
    patches = integrity.make_patches(old, new, ["p_partkey"]).withColumn("ord", F.lit(1))
    return integrity.apply_patches(old, patches, ["p_partkey"])


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'DATA' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'CHANNEL' WHEN 3 THEN 'HAB' || p_size % 10 ELSE format('{:x}', p_partkey + 3) END AS name,
  CASE WHEN p_size % 6 = 0 THEN 'STANDARD' WHEN p_size % 6 IN (1, 2) THEN 'STATUS' WHEN p_size % 6 = 3 THEN 'AUTO' END AS word FROM part
""")
def part_names(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    spelled = F.conv(F.hex(F.concat(F.lit("HAB"), (size % 10).cast("string")).cast("binary")), 16, 10).cast("long")
    kind = F.when(key % 5 < 3, key % 5).when(key % 5 == 3, spelled).otherwise(key + 3)
    word = F.when(size % 6 == 0, "stand").when(size % 6 == 1, "STATU").when(size % 6 == 2, "status").when(size % 6 == 3, "a").when(size % 6 == 4, "sta").otherwise("x")
    return t.part.select("p_partkey", S.part_name(kind).alias("name"), S.keyword(word, ["STANDARD", "STATUS", "AUTO"]).alias("word"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def exclude_found(t: Tables) -> DataFrame:
    items = t.orders.select("o_orderkey", F.col("o_custkey").alias("id"))
    return merge.exclude_found(items, t.supplier.select(F.col("s_suppkey").alias("id")), "id").select("o_orderkey")
