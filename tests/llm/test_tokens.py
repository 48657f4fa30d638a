import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD, documents, frame
from tokenizers import Tokenizer

from millrace.llm import packing, token_orc, tokens


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_encode_as_whole_texts(whole):
    r = random.Random(3)
    signs = "aAbéÉ .,;'\n\t ß*|1İσΣ́µª  \x1c<|>"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["it's we'll don'T.", "a <|endoftext|> b <|ENDOFTEXT|>.", "x" * 500 + " " + "é" * 300 + ".", "a*. b", "", " "]
    ids, ends = tokens.encoder(tokens.default_path()).encode(pa.array(texts))
    for text, got in zip(texts, np.split(ids, ends[:-1])):
        assert got.tolist() == whole(text), text


def test_other_vocabularies_take_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.by_pieces(tokens.default_path()) and not tokens.by_pieces(path)
    t = Tokenizer.from_file(path)
    texts = ["One two.  Three", "", " \n a", "é" * 300]
    ids, ends = tokens.Encoder(path).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def test_token_files_against_whole_encoding(spark, tmp_path, whole):
    rows = documents(spark) + ODD
    out = str(tmp_path / "tokens")
    token_orc.write_tokens(frame(spark, rows), out)
    files = token_orc.read_tokens(spark, out)
    got = sorted(token_orc.with_starts(files).collect(), key=lambda r: r.start)
    assert [x.doc_id for x in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    start = 0
    for x in got:
        assert x.start == start and x.n_tokens == len(x.ids)
        start += len(x.ids)
    assert sorted((str(x.doc_id), x.ids) for x in got) == sorted((str(d), whole(t)) for d, t in rows)
    crcs = {(x.doc_id, x.ids_crc32) for x in token_orc.digests(files).collect()}
    assert crcs == {(d, crc(whole(t))) for d, t in rows}
    # A lookup by document id reaches the ORC reader.
    one = files.where("doc_id = 17")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString()


def test_lookup_reads_one_row_group(spark, tmp_path):
    out = str(tmp_path / "tokens")
    docs = spark.range(20_000).selectExpr("id * 3 AS doc_id", "concat('text number ', id) AS text")
    token_orc.write_tokens(docs, out)
    files = token_orc.read_tokens(spark, out)
    for doc_id, most in ((30_000, 2000), (30_001, 0)):  # the second lies in a group's range: its Bloom filter says no
        one = files.where(f"doc_id = {doc_id}")
        plan = one._jdf.queryExecution().executedPlan()
        assert len(one._jdf.queryExecution().executedPlan().executeCollect()) == (doc_id % 3 == 0)
        while not plan.metrics().contains("numFiles"):
            plan = plan.children().head()
        assert plan.metrics().apply("numOutputRows").value() <= most
    jvm = spark.sparkContext._jvm
    path = next(str(p) for p in (tmp_path / "tokens").glob("*.orc") if p.stat().st_size > 1000)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(conf)).rows()
    stripe = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(conf)).getStripes().get(0)
    footer = rows.readStripeFooter(stripe)
    kinds = {footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    assert "DIRECT_V2" in {footer.getColumns(i).getKind().toString() for i in range(footer.getColumnsCount())}


def check_packing(pieces, rows, whole, capacity, blocks):
    want = sorted((str(d), whole(t)) for d, t in rows)
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in want)
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.length > 0 and p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= capacity
    assert len(filled) * capacity - sum(filled.values()) < capacity * blocks
    by_id = {d: ids for d, ids in want if sum(x == d for x, _ in want) == 1}
    for p in pieces:
        if str(p.doc_id) in by_id:
            ids = by_id[str(p.doc_id)]
            assert p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length])


@pytest.mark.parametrize("block", [1 << 20, 5000])
def test_packing(spark, whole, block):
    rows = documents(spark)
    pieces = packing.pack(frame(spark, rows).coalesce(1), block_tokens=block).collect()
    total = sum(p.length for p in pieces)
    check_packing(pieces, rows, whole, 2048, total // block + 1)


def test_packing_odd_rows(spark, whole):
    pieces = packing.pack(frame(spark, ODD).coalesce(1), capacity=8).collect()
    check_packing(pieces, ODD, whole, 8, 1)
    assert packing.pack(frame(spark, [])).count() == 0


def test_costs_are_balanced():
    lengths = np.random.default_rng(1).lognormal(5.5, 1, 3000).astype(np.int64).clip(1, 2000)
    cost, tokens_in = {}, {}
    for _, _, n, s in packing.pack_block(lengths, 2048):
        cost[s] = cost.get(s, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
        tokens_in[s] = tokens_in.get(s, 0) + n
    # Sequences without a document of over half their room differ little in cost.
    usual = np.array(sorted(cost.values()))
    assert usual.std() / usual.mean() < 0.1
