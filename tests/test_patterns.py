"""Globs and rules against direct evaluation."""

import random
import re

from pyspark.sql import functions as F

from millrace.functions import patterns as P


def fits(glob: str, text: str, ends: bool) -> bool:
    """Whether a glob of *, **, ?, # and letters fits text from its start: all of it, or a beginning."""
    if not glob:
        return not text if ends else True
    if glob == "$":
        return not text or (text[0] == "$" and fits("", text[1:], ends))
    if glob.startswith("**"):
        return any(fits(glob[2:], text[i:], ends) for i in range(len(text) + 1))
    if glob[0] == "*":
        return any(fits(glob[1:], text[i:], ends) for i in range(len(text) + 1) if "/" not in text[:i])
    if glob[0] == "#":
        n = re.match("[0-9]*", text).end()
        return any(fits(glob[1:], text[i:], ends) for i in range(1, n + 1))
    return bool(text) and (text[0] == glob[0] or glob[0] == "?" and text[0] != "/") and fits(glob[1:], text[1:], ends)


def expected(glob: str, text: str) -> bool:
    if not glob:
        return True
    if glob.startswith("/"):
        return fits(glob[1:], text, glob.endswith("$"))
    return bool(text) and any(fits(glob, text[i:], True) for i in range(len(text)))


def test_globs(spark):
    r = random.Random(2)
    globs = ["".join(r.choice(["a", "b", "/", "*", "**", "?", "#", "1"]) for _ in range(r.randint(0, 5))) + r.choice(["", "", "$"]) for _ in range(120)]
    texts = ["".join(r.choice("ab/12$") for _ in range(r.randint(0, 7))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.select("t", *[P.glob_matches(F.col("t"), g).alias(f"g{i}") for i, g in enumerate(globs)]).collect()
    for x in row:
        for i, g in enumerate(globs):
            assert x[f"g{i}"] == expected(g, x.t), (g, x.t)


def test_classes_and_alternatives(spark):
    cases = {("[+0-9].x", "12.x"): True, ("[^+a].x", "ab.x"): True, ("[^+a].x", "aa.x"): False, ("a{b,c}d", "xacd"): True, ("a,b", "a,b"): True, ("a b", "a\tb"): True, ("a b", "axb"): False, ("[*ab]c", "c"): True}
    df = spark.range(1)
    for (glob, text), want in cases.items():
        assert df.select(P.glob_matches(F.lit(text), glob)).first()[0] == want, (glob, text)


def run_rules(rules, text):
    at = 0
    while at < len(rules):
        sign, skip, glob = rules[at]
        hit = expected(glob, text)
        if skip:
            at += 1 + (skip if hit == (sign == "+") else 0)
        elif hit:
            return sign == "+"
        else:
            at += 1
    last = [s for s, skip, _ in rules if not skip]
    return not last or last[-1] == "-"


def test_path_rules(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("ab/1") for _ in range(r.randint(1, 5))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for _ in range(25):
        rules = [(r.choice("+-"), r.choice((0, 0, 0, 1, 2)), r.choice(["a", "b*", "*/", "/a", "#", "**a"])) for _ in range(r.randint(0, 6))]
        for x in df.select("t", P.path_rules(F.col("t"), rules).alias("k")).collect():
            assert x.k == run_rules(rules, x.t), (rules, x.t)


def test_id_patterns():
    assert P.widen_id("r+01") == "R...01" and P.widen_id("RABC01") == "RABC01" and P.widen_id("*") == "......"
