"""Scalar functions against plain versions of theirs, and how their queries are dealt out."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.plans import registry

SF = "/root/testdata/sf0.001"


def seconds(df, column):
    """The quickest of three runs."""
    took = []
    for _ in range(3):
        start = time.time()
        df.select(column.alias("x")).write.format("noop").mode("overwrite").save()
        took.append(time.time() - start)
    return min(took)


@pytest.mark.parametrize("name", ["print_times", "print_sizes", "print_sizes_si", "parse_sizes"])
def test_rows_of_one_row_group_go_to_many_tasks(spark, name):
    assert registry.QUERIES[name](spark, SF).select(F.spark_partition_id()).distinct().count() == 4


def every_format_tried(text):
    text = F.regexp_replace(text, r"[ \t]+$", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in S.DATE_FORMATS], F.when(text.rlike("^[0-9]{1,15}$"), F.timestamp_seconds(text.try_cast("long"))))


def test_times_of_any_shape(spark):
    days = ["2024-02-29", "2023-02-29", "20240229", "2024-2-29", "+12024-01-01", "+2024-01-01", "-0044-03-15", "-00440315", "+120240101", "12024-01-01", "0000-00-00", "1234567890", "20241301", "7", "x"]
    times = ["", " 00", " 0000", " 000000", " 23:59", " 23:59:59", " 24:00", " 2:30", " 23:60:00", "T00:00:00", "  00", "\t", " \t ", "\n", " \n"]
    df = spark.createDataFrame([(d + t,) for d in days for t in times] + [(None,), ("",), (" ",)], "t string")
    rows = df.select("t", S.parse_time(F.col("t")).cast("string").alias("got"), every_format_tried(F.col("t")).cast("string").alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == [] and sum(r.got is not None for r in rows) > 40


def test_formats_that_dont_fit_are_not_tried(spark):
    df = spark.range(0, 150_000, 1, 4).select(F.date_format(F.timestamp_seconds(F.col("id") * 7919), "dd.MM.yyyy HH:mm").alias("t")).cache()
    assert df.count() == 150_000
    assert seconds(df, S.parse_time(F.col("t"))) * 2 < seconds(df, every_format_tried(F.col("t")))
    df.unpersist()


def printed(size, base):
    names = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB") if base == 1024 else ("B", "kB", "MB", "GB", "TB", "PB", "EB")
    whole = lambda value, k: (value + base**k // 2) // base**k
    down = size // base**2
    if whole(size, 2) < 10_000:
        n, u = (size, 0) if whole(size, 1) < 10 else (whole(size, 1), 1) if whole(size, 1) < 10_000 else (whole(size, 2), 2)
    else:
        n, u = (whole(down, 1), 3) if whole(down, 2) < 10 else (whole(down, 2), 4) if whole(down, 2) < 10_000 else (whole(down, 3), 5) if whole(down, 3) < 10_000 else (whole(down, 4), 6)
    return f"{n // base} {names[u + 1]}" if n > 0 and n % base == 0 and u < 6 else f"{n} {names[u]}"


@pytest.mark.parametrize("base", [1024, 1000])
@pytest.mark.parametrize("kind", ["long", "decimal(20,0)"])
def test_sizes_at_every_limit(spark, base, kind):
    top = 1 << 63 if kind == "long" else 1 << 64
    near = {c * base**k - h + d for k in range(7) for c in (1, 10, base, 9999, 10_000) for h in (0, base**k // 2) for d in (-(base**2), -1, 0, 1, base**2)}
    sizes = sorted(x for x in near | {0, top - 1} if -top < x < top)
    df = spark.createDataFrame([(str(x),) for x in sizes] + [(None,)], "v string").select(F.col("v").cast(kind).alias("v"))
    got = {r.v: r.t for r in df.select("v", S.print_size(F.col("v"), base).alias("t")).collect()}
    assert got.pop(None) is None and len(got) == len(sizes)
    assert [(v, t) for v, t in got.items() if t != (printed(int(v), base) if v >= 0 else f"{v} B")] == []


def test_sizes_are_printed_about_as_fast_as_numbers(spark):
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") * F.col("id") * 7919).alias("v")).cache()
    assert df.count() == 200_000
    assert seconds(df, S.print_size(F.col("v"))) < 10 * seconds(df, F.col("v").cast("string"))
    df.unpersist()


def parsed(text, first, later):
    number = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
    total, at = 0.0, 0
    term = re.compile(rf"({number})(?:/({number}))?([{''.join(S.UNITS)}]?)")
    for i in range(100):
        sign = re.compile(r"\s*([+-])\s*").match(text, at) if i else None
        m = term.match(text, sign.end() if sign else at) if sign or not i else None
        factor = first if i == 0 else later
        if m:
            share = float(m[2]) if m[2] and float(m[2]) > 0 else 1.0
            total += float(m[1]) / share * S.UNITS.get(m[3], factor) * (-1 if sign and sign[1] == "-" else 1)
            at = m.end()
        elif sign and sign.end() == len(text):
            total += factor * (-1 if sign[1] == "-" else 1)
            at = len(text)
        else:
            return None
        if not text[at:].strip():
            return math.floor(total) if total >= 0 else None
    raise ValueError(text)


@pytest.mark.parametrize("first, later", [(1, 1), (1000, 7)])
def test_sizes_of_many_terms(spark, first, later):
    r = random.Random(8)
    number = lambda: r.choice(["0", "1", "12", "1.5", ".25", "3.", "0.0", "4096"])
    term = lambda: number() + (f"/{number()}" if r.random() < 0.3 else "") + r.choice(["", "", "b", "k", "K", "M", "s", "u", "x"])
    texts = ["".join(x for i in range(r.randint(1, 4)) for x in ((r.choice(["+", "-", " + ", "- "]) if i else ""), term())) + r.choice(["", "", " ", "+", " - "]) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", "+", "-1", " 1", "1 K", "/2"]] + [(None,)], "t string")
    rows = df.select("t", S.parse_size(F.col("t"), first, later).alias("got")).collect()
    assert [(x.t, x.got) for x in rows if x.got != (None if x.t is None else parsed(x.t, first, later))] == [] and sum(x.got is not None for x in rows) > 500


def test_terms_of_a_size_are_summed_once(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("t")).select(S.parse_size(F.col("t")).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
