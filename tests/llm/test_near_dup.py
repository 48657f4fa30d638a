from collections import defaultdict

import numpy as np
import pytest
from cases import ODD, documents, frame, prose

from millrace.llm import near_dup


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((x for x in least[root(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [prose(150, seed=3), documents, ODD], ids=["prose", "documents", "odd"])
def test_against_brute_force(spark, rows):
    rows = rows(spark) if callable(rows) else rows
    out = near_dup.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_large_bucket_of_near_copies(spark):
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in r.choice(120, 3, replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((1000 - i, " ".join(words)))
    out = near_dup.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_estimates_follow_similarity():
    r = np.random.default_rng(1)
    for j in (0.3, 0.75, 0.95):
        n = 600
        both = int(2 * n * j / (1 + j))
        pairs = []
        for _ in range(60):
            x = r.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            pairs.append((np.unique(x[:n]), np.unique(x[n - both :])))
        a, b = near_dup.sketch([p[0] for p in pairs]), near_dup.sketch([p[1] for p in pairs])
        got = near_dup.estimate(a, b, np.full(60, n), np.full(60, n))
        assert abs(got.mean() - j) < 0.02 and got.std() < 0.07


def test_sketches_merge():
    r = np.random.default_rng(2)
    x = np.unique(r.integers(0, 2**63, 500).astype(np.uint64))
    whole, parts = near_dup.sketch([x])[0], near_dup.sketch([x[:200], x[200:]])
    assert (whole == parts.max(axis=0)).all()


def test_empty_table(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
