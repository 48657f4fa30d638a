from collections import defaultdict

from pyspark.sql import functions as F

from millrace.operators import extents, order


def rows():
    return [(k, i * 7919 % 1000, i % 5) for i in range(1000) for k in [None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 4}"]]


def test_numbers_and_sums_by_key(spark):
    df = spark.createDataFrame(rows(), "k string, at int, v int").withColumn("part", F.lit("x"))
    want, sums = {}, {}
    count, total = defaultdict(int), defaultdict(int)
    for k, at, v in sorted(rows(), key=lambda r: r[1]):
        want[at], sums[at] = count[k], total[k]
        count[k] += 1
        total[k] += v
    got = order.numbered(df, ["k"], [F.col("at")], "nth").collect()
    assert {r["at"]: r.nth for r in got} == want and len(got) == 1000 and {r.part for r in got} == {"x"}
    got = order.running(df, ["k"], [F.col("at")], F.col("v"), "before").collect()
    assert {r["at"]: r.before for r in got} == sums and len(got) == 1000


def test_numbers_and_sums_of_all(spark):
    df = spark.createDataFrame(rows(), "k string, at int, v int")
    assert all(r.nth == r["at"] for r in order.numbered(df, [], [F.col("at")], "nth").collect())
    by = sorted(rows(), key=lambda r: -r[1])
    got = {r["at"]: r.before for r in order.running(df, [], [F.col("at").desc()], F.col("v"), "before").collect()}
    assert all(got[at] == sum(r[2] for r in by[:i]) for i, (_, at, _) in list(enumerate(by))[::50])
    assert order.numbered(df.limit(0), ["k"], [F.col("at")], "nth").count() == 0


def test_extents_of_any_size_compose(spark):
    a = spark.createDataFrame([(1, 0, 0, 10**12), (1, 10**13, 10**12 + 5, 7), (2, 0, -50, 100)], "g int, src long, mid long, size long")
    b = spark.createDataFrame([(1, 3, 1000, 4), (1, 10**12 - 2, 5000, 10), (1, 10**12 + 8, 5010, 100), (2, -60, 0, 20), (2, -40, 20, 20)], "g int, mid long, dst long, size long")
    got = sorted(map(tuple, extents.compose(a, b, ["g"]).collect()))
    assert got == [(1, 3, 1000, 4), (1, 10**12 - 2, 5000, 2), (1, 10**13, 5007, 7), (2, 0, 10, 30)]
