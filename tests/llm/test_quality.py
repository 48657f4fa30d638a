import re
from collections import Counter

import pytest
from cases import ODD, documents, frame, prose

from millrace.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stutters = sum(a == b for a, b in zip(words, words[1:]))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), stutters


REPEATS = [(1, "a b c d e f g h " * 5), (2, "x\n" * 30), (3, "q w e r t y u i o q w e r t y u i o p a s d f"), (4, "#$% " * 30), (5, "a\x0bb\x0cc\x1cd\u00a0e f")]


@pytest.mark.parametrize("rows", [documents, ODD, prose(60), REPEATS], ids=["documents", "odd", "prose", "repeats"])
def test_measures(spark, rows):
    rows = rows(spark) if callable(rows) else rows
    out = quality.ledger(frame(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_stutters) for r in out), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=str)


def test_policies_and_ablations(spark):
    ledger = quality.ledger(frame(spark, documents(spark) + REPEATS))
    v1, v2 = (quality.apply_policy(ledger, v) for v in ("v1", "v2"))
    assert v1.where("kept").count() >= v2.where("kept").count() > 0
    rows = [r.failed & quality.mask(quality.POLICIES["v2"]) for r in ledger.collect()]
    for r in quality.ablations(ledger).collect():
        bit = quality.mask((r.rule,))
        assert r.failed == sum(bool(x & bit) for x in rows) and r.failed_alone == sum(x == bit for x in rows)


def test_kept_documents_keep_their_columns(spark):
    df = frame(spark, documents(spark))
    out = quality.keep_documents(df)
    assert out.columns == df.columns and 0 < out.count() < df.count()
    assert quality.keep_documents(df.limit(0)).count() == 0
