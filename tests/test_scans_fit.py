"""The scans that matching takes: none where no send needs one, windows for short keys, ranges for long ones."""

import pytest

from tidemark import more_queries as MQ
from tidemark import queries as Q
from tidemark.operators import acks as A
from tidemark.operators.ranges import Keyed, Ranges, fitting


def test_sends_of_chunks_need_no_scan_of_reports(spark, sf):
    plan = A.match_acks(*Q._sends(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_the_scan_fits_the_longest_key(spark):
    rows = spark.range(100).selectExpr("id % 10 k", "id")
    assert fitting([rows, rows], ["k"], 20) is Keyed and fitting([rows, rows], ["k"], 19) is Ranges and fitting([rows.filter("false")], ["k"]) is Keyed


@pytest.mark.parametrize("log", [MQ._log, MQ._log_twice])
def test_either_scan_finds_the_same_reports(spark, sf, monkeypatch, log):
    sends, acks = (d.filter("stream_id < 300") for d in log(spark, sf))
    took, found = [], []
    for scan in (Keyed, Ranges):
        monkeypatch.setattr(A, "fitting", lambda parts, keys, scan=scan: took.append(scan) or scan)
        out = A.release_sends(sends, acks)
        found.append(sorted((r.stream_id, r.seq, r.kind, r.sent_tick, r.ack_tick or -1) for r in out.collect()))
    assert took == [Keyed, Ranges] and found[0] == found[1] and len(found[0]) > 100
