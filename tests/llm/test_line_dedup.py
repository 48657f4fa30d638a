import random

import pytest
from cases import ODD, documents, frame, prose

from millrace.llm import line_dedup


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1] <= 1


def brute(rows):
    """{(doc_id, text): removed lines}, by pairs of every line that has a word."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = [], {}
    for doc_id, text in order:
        gone = []
        for pos, line in enumerate(text.split("\n")):
            words = [w.decode() for w in line.encode().split()]
            chars = list(" ".join(words))
            if not words:
                continue

            def same(x):
                by_words = len(words) >= 8 and len(x) >= 8 and near(words, x)
                other = list(" ".join(x))
                by_chars = len(words) <= 8 and len(x) <= 8 and len(chars) >= 8 and len(other) >= 8 and near(chars, other)
                return words == x or by_words or by_chars

            if any(same(x) for x in seen):
                gone.append(pos)
            seen.append(words)
        out[doc_id, text] = gone
    return out


def short(n, seed=3):
    """Lines of 1 to 9 short words or unspaced characters, and copies with a character changed."""
    r = random.Random(seed)
    lines = []
    for _ in range(n):
        if lines and r.random() < 0.5:
            line, at = r.choice(lines), r.randrange(20)
            line = r.choice((line, line[:at] + line[at + 1 :], line[:at] + r.choice("ab 中") + line[at + 1 :], line[:at] + r.choice("ab 文") + line[at:]))
        elif r.random() < 0.3:
            line = "".join(r.choice("中文字漢𠀀") for _ in range(r.randint(1, 30)))
        else:
            line = " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 9)))
        lines.append(line)
    return [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(n // 4)]


def found(df):
    return {(r.doc_id, r.before): list(r.lines_removed) for r in df.collect() if r.before is not None}


@pytest.mark.parametrize("rows", [prose(60), documents, ODD, short(400)], ids=["prose", "documents", "odd", "short"])
def test_against_brute_force(spark, rows):
    rows = rows(spark)[:60] if callable(rows) else rows
    df = frame(spark, rows)
    out = line_dedup.dedup_lines(df.withColumn("before", df.text))
    assert found(out) == brute(rows)
    for r in out.collect():
        if r.before is None:
            assert r.text is None and r.lines_total == 0
        else:
            assert r.text == "\n".join(x for i, x in enumerate(r.before.split("\n")) if i not in r.lines_removed)
    assert out.count() == len(rows)


def test_one_template_in_most_lines(spark):
    rows = [(i, f"this line is number {i} of a very common template\nown words {i * 7} {i * 13} a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(300)]
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert {r.doc_id: list(r.lines_removed) for r in out.collect()} == {i: [0] * (i > 0) for i in range(300)}


def test_clashing_columns_and_empty_table(spark):
    df = frame(spark, [(1, "a b c"), (2, "a b c\nd")]).selectExpr("*", "1 AS d", "2 AS _D", "3 AS t", "4 AS r", "5 AS lines_removed")
    got = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [(r.text, r.lines_removed, r.d, r._D, r.t, r.r) for r in got] == [("a b c", [], 1, 2, 3, 4), ("d", [0], 1, 2, 3, 4)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_long_text(spark):
    text = "\n".join(f"line {i} " + "x" * 40 for i in range(5000)) + "\n" + "y " * 100_000
    got = line_dedup.dedup_lines(frame(spark, [(1, text), (2, "new\n" + text)])).orderBy("doc_id").collect()
    assert got[1].text == "new" and len(got[1].lines_removed) == 5001
