"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles becomes M registers: each is the least of the
shingles' exponential hash values there, kept as its rounded logarithm to a base near
1. Equal sets fall together first. Bands of ROWS registers bring sets that may be
near into buckets; a pair's similarity is estimated from its registers by maximum
likelihood, and confirmed on the full shingle sets.

A bucket's members first meet its least one. A bucket is settled once its members are
of one component; else some of its members, drawn by hash, meet its members of other
components, and leave the bucket, for they have met all. In a bucket of up to REPRESENTATIVES
these are all members; a larger one needs another round, so a round looks at each member
so many times at most. Pairs within a component are not made, nor pairs that can't be near: two sets share at most what of each occurs in another set
at all, and differ in an element at least for each bit that differs in the bitmaps that
their shingles are hashed to.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from ..shared import delete, saved, side

SHINGLE_WORDS = 5
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: A pair at the threshold is missed by all 32 bands once in 200,000 times.
REGISTERS, ROWS = 128, 4
#: Sketch parameters: base, rate and limit of the registers (16 bits each).
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
#: Estimates this far (5 standard errors) below the threshold are not confirmed.
MARGIN = 0.2
#: Bits of the bitmaps.
BITS = 1024
#: Members of a bucket that meet its others in the first round, about; the factor by which they grow each round.
REPRESENTATIVES, GROWTH = 64, 16
BATCH_TEXTS, BATCH_SHINGLES = 2048, 1 << 18

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The set of 64-bit hashes of a text's word shingles, sorted.

    A-Z in lower case, words between ASCII white space. Fewer words than a shingle
    make one shingle; no words make none.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketch(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Registers of many sets, one row each (uint16).

    Every element sends a Poisson stream of marks to random registers; a register
    keeps its first mark's time. An element stops once its next mark is later than
    all its set's registers, so a set takes about its size plus m log m steps.
    """
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    h = np.concatenate([np.zeros(0, np.uint64), *sets])
    time = np.zeros(len(h))
    least = np.full(len(sets) * m, np.inf)
    step = 0
    while len(h):
        step += 1
        bits = _mix(h + _U(step * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log1p(-(bits >> _U(11)).astype(np.float64) * 2.0**-53) / (RATE * m)
        np.minimum.at(least, doc * m + (bits % _U(m)).astype(np.int64), time)
        if step % 4 == 0 or len(h) > 50_000:
            here, back = np.unique(doc, return_inverse=True)
            going = time <= least.reshape(-1, m)[here].max(axis=1)[back]
            doc, h, time = doc[going], h[going], time[going]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(np.nan_to_num(k, neginf=0), 0, LIMIT + 1).astype("<u2").reshape(-1, m)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows, given the sets' sizes."""
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    log_b = np.log(BASE)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / log_b
    dp = lambda x: (BASE - 1) / BASE / (1 - x * (BASE - 1) / BASE) / log_b
    for _ in range(30):  # the likelihood is concave in the similarity: halve towards its slope's zero
        j = (lo + hi) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        slope = -more * v * dp(x) / p(x) - less * u * dp(y) / p(y) + same * (v * dp(x) + u * dp(y)) / np.maximum(1 - p(x) - p(y), 1e-12)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def _sketched(batches, size: int):
    """doc_id, th, n, sid (hash of the whole set), regs of each row."""
    import xxhash

    for batch in batches:
        texts = batch.column("text")
        at = 0
        while at < batch.num_rows:
            sets, n = [], 0
            while at + len(sets) < batch.num_rows and len(sets) < BATCH_TEXTS and n < BATCH_SHINGLES:
                sets.append(shingles(texts[at + len(sets)].as_py() or "", size))
                n += len(sets[-1])
            rows = batch.slice(at, len(sets))
            full = [i for i, x in enumerate(sets) if len(x)]
            regs = dict(zip(full, sketch([sets[i] for i in full])))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("th"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.array([regs[i].tobytes() if i in regs else None for i in range(len(sets))], pa.binary()),
                ],
                names=["doc_id", "th", "n", "sid", "regs"],
            )
            at += len(sets)


def _shingled(batches, size: int):
    for batch in batches:
        sets = [shingles(x or "", size) for x in batch.column("text").to_pylist()]
        ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        bits = np.zeros((len(sets), BITS), np.uint8)
        for row, x in zip(bits, sets):
            row[x % _U(BITS)] = 1
        words = np.packbits(bits, axis=1).view(np.int64).ravel()
        each = np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)
        lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(v)) for e, v in ((ends, flat), (each, words))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "shingles", "bits"])


def _estimated(batches, least: float):
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("a_regs", "b_regs"))
            j = estimate(a, b, *(batch.column(c).to_numpy().astype(float) for c in ("a_n", "b_n")))
            yield batch.select(["a", "b"]).filter(pa.array(j >= least))


def _own(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _bounded(full: DataFrame) -> DataFrame:
    """id, n, c, bits: sizes of the full sets, how many of their shingles another of them holds, and their bitmaps: saved."""
    once = full.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("k"), F.min("id").alias("id"))
    own = saved(once.where("k = 1").groupBy("id").agg(F.count("*").alias("u")), "near-own", sized=True)
    out = full.select("id", F.size("shingles").alias("n"), "bits").join(side(own), "id", "left")
    out = saved(out.select("id", "n", "bits", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c")), "near-bounds", sized=True)
    delete(own)
    return out


def _possible(c: Column, n: Column, m: Column, percent: int) -> Column:
    """Sets of n and m shingles with c in common at most may be near."""
    return 100 * c >= percent * (n + m - c)


def _alike(a: str, b: str, percent: int) -> Column:
    """Sets whose n, c and bits have these prefixes may be near."""
    bits = lambda i: F.bit_count(F.get(F.col(f"{a}bits"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{b}bits"), F.lit(i))))
    differ = sum((bits(i) for i in range(1, BITS // 64)), bits(0))
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    few = _possible(F.least(f"{a}c", f"{b}c"), n, m, percent)
    return few & _possible(F.floor((n + m - differ) / 2).cast("int"), n, m, percent)


def _confirm(pairs: DataFrame, traits: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those pairs(a, b) whose bitmaps, then registers, then full sets, are near enough: a saved table."""
    of = lambda x: side(traits).select(*[F.col(c).alias(x if c == "id" else f"{x}_{c}") for c in traits.columns])
    bounded = pairs.join(of("a"), "a").join(of("b"), "b").where(_alike("a_", "b_", percent))
    registers = bounded.select("a", "b", "a_n", "b_n", "a_regs", "b_regs")
    likely = saved(registers.mapInArrow(partial(_estimated, least=percent / 100 - MARGIN), "a long, b long"), "near-likely", sized=True)
    either = likely.select(F.explode(F.array("a", "b")).alias("id"))
    own = saved(full.join(side(either, of=likely), "id", "left_semi").select("id", "shingles"), "near-sets", sized=True)
    words = lambda x: side(own).select(F.col("id").alias(x), F.col("shingles").alias(f"{x}_s"))
    both = F.size(F.array_intersect("a_s", "b_s"))
    links = likely.join(words("a"), "a").join(words("b"), "b").withColumn("both", both)
    links = links.where(100 * F.col("both") >= percent * (F.size("a_s") + F.size("b_s") - F.col("both")))
    out = saved(links.select("a", "b"), "near-links", n=F.count(F.lit(1)))
    delete(likely, own)
    return out


def _links(members: DataFrame, traits: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """id, comp (saved) of the linked members of buckets members(key, id, n, c), a saved table, which goes."""
    pair = (F.least("id", "r_id").alias("a"), F.greatest("id", "r_id").alias("b"))
    of = lambda *columns: [F.col(x).alias(f"r_{x}") for x in columns]
    least = members.groupBy("key").agg(F.min(F.struct("id", "n", "c")).alias("r")).select("key", "r.*").select("key", *of("id", "n", "c"))
    least = saved(least, "near-first", sized=True)
    met = members.join(side(least), "key").where((F.col("id") != F.col("r_id")) & _possible(F.least("c", "r_c"), F.col("n"), F.col("r_n"), percent))
    links = _confirm(met.select(*pair).distinct(), traits, full, percent)
    comps = components(links)
    rest = members.join(side(least), "key").where("id <> r_id").select("key", "id", "r_id")
    rest = saved(rest, "near-members", n=F.count(F.lit(1)))  # of the first one, only the component counts from now on
    delete(members, links)
    reps = REPRESENTATIVES
    while rest.told["n"]:
        labelled = rest.join(side(comps), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).where("lo <> hi")
        keys = saved(keys.select("key", "k"), "near-open-keys", sized=True)
        opened = labelled.join(side(keys), "key").join(side(traits.select("id", "n", "c", "bits"), of=traits), "id")
        opened = opened.select("key", "id", "comp", "n", "c", "bits", (F.pmod(F.xxhash64("key", "id", F.lit(reps)), "k") < reps).alias("drawn"))
        opened = saved(opened, "near-open")
        drawn = saved(opened.where("drawn").select("key", *of("id", "comp", "n", "c", "bits")), "near-drawn", sized=True)
        apart = (F.col("comp") != F.col("r_comp")) & (~F.col("drawn") | (F.col("id") < F.col("r_id")))
        met = opened.join(side(drawn), (opened["key"] == drawn["key"]) & apart & _alike("", "r_", percent))
        found = _confirm(met.select(*pair).distinct(), traits, full, percent)
        spent = [rest, keys, opened, drawn, found]
        if found.told["n"]:
            both = found.unionByName(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")))
            spent.append(comps)
            comps = components(both)
        rest = saved(opened.where("not drawn").select("key", "id"), "near-members", n=F.count(F.lit(1)))
        delete(*spent)
        reps *= GROWTH
    delete(least, rest)
    return comps


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept, first for each row of docs(doc_id, text).

    component_id is the least doc_id that links can reach; kept: it is the row's own.
    first: of the rows kept, those with the text of least hash; repeated rows are all first.
    Null, empty and blank texts have no shingles and link with nothing; they are first. Null doc_ids
    count only if all of a component are null. Rows that share a doc_id are all kept
    or all not. A text is one set however long it is. An empty table gives no rows.
    Other columns are ignored.
    """
    rows = saved(_own(docs).mapInArrow(partial(_sketched, size=size), "doc_id long, th long, n long, sid binary, regs binary"), "near-rows")
    sets = rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("of"), F.first("regs").alias("regs"))
    sets = saved(sets.withColumn("id", F.monotonically_increasing_id()), "near-sets")
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    banded = sets.select("id", F.explode(bands).alias("key"))
    shared = saved(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "near-keys", sized=True)
    members = saved(banded.join(side(shared), "key", "left_semi"), "near-members")
    ids = saved(members.select("id").distinct(), "near-ids", sized=True)
    wanted = sets.join(side(ids), "id", "left_semi").select("id", F.col("of.doc_id").alias("d"), F.col("of.th").alias("t"), "regs")
    wanted = saved(wanted, "near-wanted", sized=True)
    texts = _own(docs).join(side(wanted.select("id", "d", "t"), of=wanted), (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    full = saved(texts.select("id", "text").mapInArrow(partial(_shingled, size=size), "id long, shingles array<long>, bits array<long>").dropDuplicates(["id"]), "near-full")
    bounds = _bounded(full)
    hopeful = bounds.where(_possible(F.col("c"), F.col("n"), F.col("c"), percent))  # with a subset of themselves
    traits = saved(wanted.select("id", "regs").join(side(hopeful, of=bounds), "id"), "near-traits", sized=True)
    spent = [shared, members, ids, wanted, bounds]
    members = saved(members.join(side(traits.select("id", "n", "c"), of=traits), "id"), "near-members")
    delete(*spent)
    comps = _links(members, traits, full, percent)
    delete(traits, full)

    firsts = saved(sets.join(side(comps), "id").groupBy("comp").agg(F.min("of").alias("first")), "near-firsts", sized=True)
    classes = sets.join(side(comps), "id", "left").join(side(firsts), "comp", "left")
    classes = saved(classes.select("sid", F.coalesce("first", "of").alias("first")), "near-classes", sized=True)
    delete(sets, comps, firsts)
    out = rows.select("doc_id", "th", "n", "sid").join(side(classes), "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    first = F.col("sid").isNull() | (kept & (F.col("th") == F.col("first.th")))
    out = saved(out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), first.alias("first")), "near-duplicates")
    delete(rows, classes)
    return out


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k + least(len(w), 5) - 1], ' ') FOR k IN range(1, len(w) - least(len(w), 5) + 2)]) AS g FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""
