import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import checksums as C


def test_published_vectors():
    data = [b"\0" * 32, b"\xff" * 32, bytes(range(32)), bytes(range(31, -1, -1)), b"123456789", b"", None]
    assert [int(x) for x in C.crc(data)] == [0x8A9136AA, 0x62A8AB43, 0x46DD794E, 0x113FDB5C, 0xE3069283, 0, 0]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=2000), st.integers(0, 2000))
def test_combining_any_split_equals_the_whole(data, at):
    a, b, whole = C.crc([data[:at], data[at:], data])
    assert int(C.combine(np.array([a]), np.array([b]), np.array([len(data[at:])]))[0]) == int(whole)


def test_column_combine_tail_and_verify(spark):
    data = os.urandom(5000)
    df = spark.createDataFrame([(1, i, bytearray(data[i * 700 : (i + 1) * 700])) for i in range(8)], "f int, i int, p binary")
    got = C.crc32c_combine(df.select("f", "i", C.crc32c(F.col("p")).alias("checksum"), F.octet_length("p").alias("len")), ["f"], "i").first()
    assert bytes(got.checksum) == C.crc_bytes(data) and got.len == 5000
    t = df.filter("i = 0").select("p", C.tail_checksum(F.col("p"), 100).alias("c"))
    row = t.select("c.*", C.verify("p", "c").alias("ok")).first()
    assert (row.algo, row.offset, row.len, row.ok) == (1, 600, 100, True) and bytes(row.value) == C.crc_bytes(data[600:700])


def test_shifted_checksums_of_parts_make_up_the_whole(spark):
    data, rows, at = os.urandom(90_000), [], 0
    for n in (0, 1, 2, 255, 256, 70_000, 0, 19_486):
        rows.append((1, at, bytearray(data[at : at + n]), n))
        at += n
    df = spark.createDataFrame(rows, "f int, at long, p binary, len long").repartition(5)
    parts = df.select("f", "len", C.crc_value(C.crc32c(F.col("p"))).alias("v"), (F.lit(at) - F.col("at") - F.col("len")).alias("after"))
    got = C.crc32c_of_parts(parts, ["f"], F.col("v"), F.col("after")).first()
    assert at == len(data) and bytes(got.checksum) == C.crc_bytes(data) and got.len == at
    far = spark.range(1).select(C.shifted(F.lit(0x12345678), F.lit(1 << 40)).alias("v")).first().v
    assert far == int(C._apply(C._zeros(40), np.array([0x12345678], np.uint32))[0])


@pytest.mark.parametrize("checksum, ok", [((0, 0, 0, b""), True), ((0, 0, 3, b""), False), ((1, 0, 9, b"abcd"), False), ((1, 0, 5, b"abcd"), False)])
def test_verify_rules(spark, checksum, ok):
    df = spark.createDataFrame([(bytearray(b"hello"), checksum)], "p binary, c struct<algo:int,offset:long,len:long,value:binary>")
    assert df.select(C.verify("p", "c")).first()[0] is ok


def test_every_benchmark_row_has_the_checksum_of_its_bytes(spark, tmp_path):
    import __spark_entry__ as entry

    def bytewise(data):
        value = 0xFFFFFFFF
        for byte in data:
            value ^= byte
            for _ in range(8):
                value = value >> 1 ^ (0x82F63B78 if value & 1 else 0)
        return value ^ 0xFFFFFFFF

    odd = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "Zürich — 東京 😀"), (4, "ÿ")], "item_id long, text string")
    odd.write.parquet(f"{tmp_path}/benchmark.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        rows = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
        got = entry.queries()["content_checksums_utf8"](spark, folder).collect()
        assert sorted((r.item_id, r.crc32c) for r in got) == sorted((r.item_id, bytewise((r.text or "").encode())) for r in rows)
