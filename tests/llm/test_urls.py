import random

from millrace.llm import urls


def test_cascade_is_exact(spark):
    r = random.Random(1)
    universe = [f"host{i}" for i in range(5000)] * 2
    listed = [f"host{i}" for i in r.sample(range(6000), 700)] * 2
    keys = lambda x: spark.createDataFrame([(k,) for k in x] + [(None,)], "key string")
    for limit in (32, 0):  # sent whole, and block by block
        cascade = urls.Cascade(keys(universe), keys(listed), limit)
        assert all(x.sent == (limit > 0) for x in cascade.levels)
        got = cascade.contains(keys(universe), "key", "found").collect()
        assert len(got) == 10001 and all(x.found == (x.key in set(listed)) for x in got)
    assert len(urls.Cascade(keys(universe), keys(listed)).levels) > 1


def test_many_keys_and_blocks(spark):
    universe = spark.range(400_000).selectExpr("concat('host', id) AS key", "id % 3 = 0 AS want")
    cascade = urls.Cascade(universe, universe.where("want").select("key"))
    assert len(cascade.levels) > 5 and cascade.levels[0].blocks > 20
    assert cascade.contains(universe, "key", "found").where("found <> want").count() == 0


def test_nothing_listed_or_seen(spark):
    some = spark.createDataFrame([("a",)], "key string")
    none = some.limit(0)
    assert not urls.Cascade(some, none).contains(some, "key", "found").first().found
    assert urls.Cascade(none, some).contains(none, "key", "found").count() == 0


def test_judgement(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme.com/en/": ("", "", None, "allow"),
        "http://EXAMPLE.com": ("example.com", "", None, "allow"),
        "http://Example.COM/": ("example.com", "/", "com/", "allow"),
        "x\nhttp://a.example.com/en/1?x://y": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/#b": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://b.www.example.com/en/": ("b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://spam-farm.example.org/es/": ("spam-farm.example.org", "/es/", None, "block"),
        "http://spam-farm.example.com/es/": ("spam-farm.example.com", "/es/", "com/", "allow"),
        "http://ÄB.org?q": ("Äb.org", "", None, "allow"),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    listed = spark.createDataFrame([(h,) for h in urls.listed_hosts()], "key string")
    got = urls.judge(pages, listed).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert urls.judge(pages.limit(0), listed).count() == 0
