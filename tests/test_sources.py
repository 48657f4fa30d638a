import zlib

from pyspark.sql import functions as F

from millrace.functions import binary as B
from millrace.functions import scalars as S
from millrace.operators import extents
from millrace.sources import files, text


def test_titles(spark, tmp_path):
    one, two = tmp_path / "one.txt", tmp_path / "two.txt"
    one.write_text("# list\nRABC01 = First\nRABC02=Second\nrabc = Short\nXYZ1 = Gone\nno line\n")
    two.write_text("RABC02 = Later = better\nXYZ1 =\nRABC0 * =\nRABC03 = Kept\n")
    got = {r.id: r.title for r in text.read_titles(spark, [str(one), str(two)]).collect()}
    assert got == {"RABC": "Short", "RABC03": "Kept"}


def test_settings_arguments_sections(spark, tmp_path):
    path = tmp_path / "setup.txt"
    path.write_text("a = 1\n# b = 2\nb-x = two words \na=3\n\n")
    assert {r.name: r.value for r in text.read_settings(spark, [str(path)]).collect()} == {"a": "3", "b-x": "two words"}
    assert text.read_arguments(spark, str(path)).count() == 4
    df = spark.createDataFrame([("X", 1, None)], "id string, n int, t string")
    text.write_sections(df, str(tmp_path / "out"), "id", ["n", "t"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["[X]", "n=1", "t=", ""]


def test_files(spark, tmp_path):
    for name, data in {"a.bin": b"PAR1xx", "sub/b.bin": b"\x1f\x8b00", "sub/deep/c.bin": b"zz", ".hidden": b"0", "a.bin.1": b"123", "a.bin.2": b"4"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.listing(spark, str(tmp_path))
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(found) == ["a.bin", "a.bin.1", "a.bin.2", "b.bin", "c.bin"]
    assert names(files.listing(spark, str(tmp_path), max_depth=2)) == ["a.bin", "a.bin.1", "a.bin.2", "b.bin"]
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: r.type for r in files.with_type(content).collect()}
    assert kinds["a.bin"] == "parquet" and kinds["b.bin"] == "gzip" and kinds["c.bin"] == "other"
    parts = {(r.part, r.start) for r in files.pieces(found.where(F.col("path").contains("a.bin"))).collect()}
    assert parts == {(0, 0), (1, 6), (2, 9)}


def test_sizes_and_times(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.parse_size(F.lit("1.5K+3"))) == 1539 and one(S.parse_size(F.lit("2m"))) == 2_000_000
    assert one(S.parse_size(F.lit("1/4M"))) == 262144 and one(S.parse_size(F.lit("x"))) is None
    assert one(S.parse_size(F.lit("3+4"), 1000, 10)) == 3040
    assert one(S.print_size(F.lit(10000).cast("long"))) == "10 KiB" and one(S.print_size(F.lit(9999).cast("long"))) == "10 KiB" and one(S.print_size(F.lit(9727).cast("long"))) == "9727 B"
    assert one(S.print_size(F.lit(1 << 20).cast("long"))) == "1 MiB" and one(S.print_size(F.lit(10**7).cast("long"), 1000)) == "10 MB"
    assert one(S.parse_size(F.lit("1M-1K"))) == 1_047_552 and one(S.parse_size(F.lit("1K-2K"))) is None
    assert str(one(S.parse_time(F.lit("86400")))) .startswith("1970-01-02") and one(S.parse_time(F.lit("junk"))) is None
    assert one(S.print_time(F.lit(None).cast("timestamp"), "minute")) == "---------- --:--"


def test_bytes(spark):
    df = spark.createDataFrame([(b"abc", "aéŁĀ\u1e9e"), (b"\0\0", ""), (None, None)], "d binary, t string")
    got = df.select(B.adler32("d").alias("a"), B.base_letters(F.col("t")).alias("b"), B.zero_blocks(F.col("d")).alias("z")).collect()
    assert [r.a for r in got] == [zlib.adler32(b"abc"), zlib.adler32(b"\0\0"), None]
    assert [r.b for r in got] == ["aéŁA\u1e9e", "", None] and [r.z for r in got] == [False, True, None]


def test_phantoms(spark):
    a, b = (extents.phantoms(spark, 50, 3, 100).collect() for _ in range(2))
    assert a == b and all(1 <= r.size <= 100 for r in a) and a[7].id == "PHT007"
