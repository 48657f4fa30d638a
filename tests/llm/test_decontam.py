import re

import pytest
from cases import ODD, SF, documents, frame, prose

from millrace.llm import decontam


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows, items):
    out = set()
    for item, text in items:
        w = words(text)
        n = min(5, len(w))
        want = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for doc, body in rows:
            b = words(body)
            both = want & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if w else set()
            if want and 100 * len(both) >= 75 * len(want):
                out.add((doc, item, len(want), len(both)))
    return out


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_documents(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = documents(spark)
    rows += [(1000 + i, f"{rows[i][1]} ... {t.upper()} !! {rows[i + 1][1]}") for i, (_, t) in enumerate(items)]
    got = decontam.contained_items(frame(spark, rows), items_frame(spark, items)).drop("th").collect()
    assert {tuple(r) for r in got} == brute(rows, items) and len(got) >= len(items)


@pytest.mark.parametrize("seed", [1, 2])
def test_partly_contained_items_of_all_sizes(spark, seed):
    texts = prose(40, seed, vocabulary=3000)
    items = [(i, " ".join(t.split()[: 3 + i * i % 300])) for i, t in texts[:30]] + [(100, "two words"), (101, ""), (102, None), (103, "?!")]
    rows = []
    for i, t in items:
        w = (t or "").split()
        for cut in (0.6, 0.74, 0.78, 0.9):
            rows.append((len(rows), " ".join([*texts[35][1].split(), *w[: int(len(w) * cut)], *texts[36][1].split(), *w[int(len(w) * cut) :: 2]])))
    rows += ODD
    got = decontam.contained_items(frame(spark, rows), items_frame(spark, items)).drop("th").collect()
    assert {tuple(r) for r in got} == brute(rows, items)


def test_empty_tables(spark):
    some, none = items_frame(spark, [(1, "a b c d e f")]), items_frame(spark, [])
    assert decontam.contained_items(frame(spark, []), some).count() == 0
    assert decontam.contained_items(frame(spark, ODD), none).count() == 0
