import pytest
import test_decontam
import test_line_dedup
import test_near_dup
import test_tokens
from cases import SF, frame
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import tokens
from millrace.shared import saved


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    quality, lines, near, clean = kept
    rows = [(r.doc_id, r.text) for r in quality.values()]
    want = {}
    for (doc_id, text), gone in test_line_dedup.brute(rows).items():
        rest = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        if not gone or rest.split():
            want[doc_id] = rest
    assert {d: r.text for d, r in lines.items()} == want
    assert all(r.n_chars == len(r.text) for r in lines.values())
    rows = [(r.doc_id, r.text) for r in lines.values()]
    assert set(near) == {x[0] for x in test_near_dup.brute(rows) if x[3]}
    rows = [(r.doc_id, r.text) for r in near.values()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == set(near) - {x[0] for x in test_decontam.brute(rows, items)}
    packed = corpus_pipeline.run(spark, SF)
    whole = Tokenizer.from_file(tokens.default_path())
    rows = [(r.doc_id, r.text) for r in clean.values()]
    test_tokens.check_packing(packed.collect(), rows, lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 1], 2048, 8)


LONG = " ".join(f"word{i % 5000} and{i}" for i in range(30_000))
WORDS = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the silent river bank at dusk"


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s.__name__)
def test_stage_on_odd_rows(spark, stage):
    rows = [(1, None), (2, ""), (3, WORDS), (3, WORDS), (None, WORDS), (None, WORDS), (4, WORDS.upper()), (5, LONG), (None, None)]
    docs = frame(spark, rows).selectExpr("*", "1 AS d", "2 AS t", "3 AS gone_id", "4 AS whole_row", "5 AS lines_removed", "0L AS n_chars")
    assert stage(spark, docs.limit(0), SF).count() == 0
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    odd = [(1, None), (2, ""), (None, None)]
    want = {
        "quality_rules": [x for x in rows if x not in odd],
        "dedup_lines": [*odd, (3, WORDS), (3, WORDS), (4, WORDS.upper()), (5, LONG)],
        "near_dedup": [*odd, (3, WORDS), (5, LONG)],
        "decontaminate": rows,
    }[stage.__name__]
    assert got == sorted(want, key=str)
    assert all((r.d, r.t, r.gone_id, r.whole_row, r.lines_removed) == (1, 2, 3, 4, 5) for r in out.collect())


def test_short_lines_and_scripts_without_spaces(spark):
    rows = [(1, "All rights reserved.\nLes.\n今日は天気がとても良いです\n1."), (2, "All rights reserved\nLes.\n今日は天気がとても悪いです\n2."), (3, "Les.\nall quite other words")]
    df = frame(spark, rows, clash=False).selectExpr("*", "0L AS n_chars")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}
    assert got == {1: (rows[0][1], 42), 2: ("2.", 2), 3: ("all quite other words", 21)}
