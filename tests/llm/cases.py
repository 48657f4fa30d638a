"""Small tables for the operators' tests."""

import random

SF = "/root/testdata/sf0.001"

#: doc_id, text: nulls, empty, white space, ties, repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \n\t\n "), (4, "one"), (5, "one two three four"), (5, "one two three four"), (None, "alpha beta gamma delta epsilon"),
    (None, None), (6, "A b C d E f G h I j"), (7, "a B c D e F g H i J"), (8, "one two İ é́ <|endoftext|> \U0001f600"),
]


def frame(spark, rows, clash=True):
    """rows as a DataFrame; clash adds columns that an operator may use for itself."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        for name in ("words", "lines", "th", "pos", "at", "key", "shard", "size", "start", "ids", "group", "n", "h1"):
            df = df.withColumn(name, F.lit("x"))
    return df


def prose(n, seed=1, vocabulary=400):
    """n texts of some lines, with copies, near copies and shared lines."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 24)))
    common = [line() for _ in range(6)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.15:
            text = r.choice(out)
        elif out and r.random() < 0.3:
            ws = r.choice(out).split(" ")
            for _ in range(r.choice((1, 1, 1, 3, 8))):
                at = r.randrange(len(ws))
                kind = r.randrange(3)
                if kind == 0:
                    ws[at] = r.choice(words)
                elif kind == 1:
                    ws.insert(at, r.choice(words))
                elif len(ws) > 1:
                    del ws[at]
            text = " ".join(ws)
        else:
            text = "\n".join(r.choice(common) if r.random() < 0.2 else line() for _ in range(r.randint(1, 12)))
        out.append(text)
    return list(enumerate(out))


def documents(spark):
    return [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
