"""The log of line items: its checksums are those of its payloads, which no shuffle carries; checksums of many lengths."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import checksums as C
from tidemark.operators.audit import chunked_outcomes
from tidemark.streaming import apply as AP


def test_checksums_of_the_log_are_its_payloads(spark, sf):
    log = AP.log_from_orders(spark, sf).filter("stream_id < 20")
    sums = log.filter("payload is not null").select((C.crc32c(F.col("payload")) == F.col("checksum")).alias("right"), (F.hex("checksum") == "00000000").alias("damaged"), F.octet_length("payload").alias("n")).collect()
    assert sums and all(r.n == 10000 and r.right != r.damaged for r in sums) and any(r.right for r in sums)
    files = log.filter("file_crc is not null").select("file_crc", F.encode(F.concat(*[F.expr(f"repeat(substring(md5(concat(file_id, ':', {i})), 1, 10), 1000)") for i in range(7)]), "utf-8").alias("b")).collect()
    assert files and [int(x) for x in C.crc([bytes(r.b) for r in files])] == [r.file_crc for r in files]


def test_no_shuffle_carries_payloads(spark, sf):
    plan = AP.log_from_orders(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Window [row_number")]
    assert "repeat(" in above and "repeat(" not in plan[len(above) :] and re.search("Window", plan)


def test_checksums_of_any_lengths_together():
    def slow(p: bytes) -> int:
        reg = 0xFFFFFFFF
        for b in p:
            reg = int(C._TABLE[(reg ^ b) & 0xFF]) ^ (reg >> 8)
        return reg ^ 0xFFFFFFFF

    r = random.Random(5)
    texts = [r.randbytes(n) for n in (0, 1, 255, 256, 257, 511, 512, 513, 769, 5000)] + [b"\0" * 300, b"123456789"]
    for step in (1, 700, 4 << 20):
        assert [int(x) for x in C.crc([*texts, None], step)] == [*map(slow, texts), 0]
    assert len(C.crc([])) == 0


def _slow(p: bytes) -> int:
    reg = 0xFFFFFFFF
    for b in p:
        reg = int(C._TABLE[(reg ^ b) & 0xFF]) ^ (reg >> 8)
    return reg ^ 0xFFFFFFFF


def test_long_payloads_advance_by_their_last_bytes_alone(monkeypatch):
    r, steps, take = random.Random(7), [], np.take
    texts = [r.randbytes(10000) for _ in range(9)] + [r.randbytes(n) for n in (1000, 1024, 1025, 65535, 65536, 65537, 140000)] + [bytearray(3), b""]
    monkeypatch.setattr(C.np, "take", lambda *a, **b: steps.append(1) or take(*a, **b))
    same = C.crc(texts[:9])
    assert len(steps) <= C.LANE // 2  # not half the lane's length for each lane, as lanes are folded
    assert same.tolist() == [_slow(t) for t in texts[:9]] and C.crc(texts).tolist() == [_slow(bytes(t)) for t in texts]


def test_folding_keeps_the_register():
    r = random.Random(8)
    for width in range(C.LANE, 12 * C.LANE, C.LANE):
        rows = np.frombuffer(r.randbytes(3 * width), np.uint8).reshape(3, width)
        short = C._folded(rows.copy())
        assert short.shape == (3, C.LANE) and C._registers(list(rows)).tolist() == [C._registers([s.tobytes()])[0] for s in short]


def test_log_is_dealt_by_rows_and_sums_are_made_once(spark, sf):
    log = AP.log_from_orders(spark, sf)
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [stream_id" in plan and "encode(" not in plan
    rest = chunked_outcomes(log)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_xor" not in rest and "min_by" not in rest and "ArrowEvalPython" not in rest


def test_shifted_sums_of_nulls_and_ends(spark):
    rows = spark.createDataFrame([(5, 0), (5, -3), (5, None), (None, 4), (0, 7), (0xFFFFFFFF, 70000)], "v long, n long")
    want = [5, 5, 5, None, 0, int(C.combine(np.array([0xFFFFFFFF]), np.zeros(1), np.array([70000]))[0])]
    assert [r.s for r in rows.coalesce(1).select(C.shifted(F.col("v"), F.col("n")).alias("s")).collect()] == want
