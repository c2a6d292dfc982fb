"""Merged reports against a loop that holds the counts, as a sender of reports does."""

import random
from collections import Counter, defaultdict

import pytest

from tidemark.operators import acks as A
from tidemark.operators import batches as B

COLUMNS = "line_id int, stream_id long, arrival long, next_seq long, file_id long, offset long, durable_offset long, n_received long, flush boolean"


def fold(rows, limit, coupled, interval):
    """rows (line, stream, arrival, n, flush) in order of (line, arrival, stream): the counts that wait, by line and stream."""
    out, waiting, numbers, ticks = Counter(), defaultdict(int), defaultdict(int), {}
    for line, stream, at, n, flush in rows:
        own = line if coupled else (line, stream)

        def end(of):
            numbers[of] += 1
            for k in [k for k in waiting if (k[0] if coupled else k) == of]:
                del waiting[k]

        if interval and own in ticks and ticks[own] != at // interval:
            end(own)
        ticks[own] = at // interval if interval else 0
        waiting[line, stream] += n
        out[line, stream, numbers[own]] += n
        if flush or (limit and waiting[line, stream] >= limit):
            end(own)
            ticks.pop(own, None)
    return +out


@pytest.mark.parametrize("limit, coupled, interval, forced", [(20, True, None, 0.1), (20, True, 9, 0.0), (7, False, None, 0.0), (0, True, 11, 0.2), (13, False, 5, 0.1)])
def test_batches_equal_a_loop(spark, limit, coupled, interval, forced):
    r = random.Random(limit)
    rows = [(line, r.randrange(3), at, r.choice([0, 1, 1, 5, 12]), r.random() < forced) for line, n in ((1, 260), (2, 25), (3, 1)) for at in range(n)]
    df = spark.createDataFrame([(line, s, at, at, 1, 1, 1, n, f) for line, s, at, n, f in r.sample(rows, len(rows))], COLUMNS)
    got = A.ack_batches(df, limit, coupled, interval).collect()
    numbers = defaultdict(set)
    for x in got:
        numbers[x.line_id if coupled else (x.line_id, x.stream_id)].add(x.batch)
    # A loop numbers every flush; so does the operator.
    want = fold(rows, limit, coupled, interval)
    assert Counter({(x.line_id, x.stream_id, x.batch): x.received for x in got if x.received}) == want


@pytest.mark.parametrize("limit, coupled, interval, forced", [(20, True, None, 0.1), (20, True, 9, 0.0), (7, False, None, 0.0), (0, True, 11, 0.2), (13, False, 5, 0.1), (5000, True, None, 0.0)])
def test_batches_over_the_borders_of_blocks(spark, limit, coupled, interval, forced):
    r = random.Random(limit)
    rows = [(line, r.randrange(3), at, r.choice([0, 1, 1, 5, 12]), r.random() < forced) for line, n in ((1, 400), (2, 25), (3, 1), (4, 2), (5, 90)) for at in range(n)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "line_id int, stream_id long, arrival long, n long, _flush boolean")
    keys = ["line_id"] if coupled else ["line_id", "stream_id"]
    got = Counter()
    for x in B.numbered(df, keys, ["arrival", "stream_id"], limit, interval, bits=3).collect():
        got[x.line_id, x.stream_id, x.batch] += x.n
    assert +got == fold(rows, limit, coupled, interval)


def test_equal_reports_never_fall_into_step(spark):
    """Batches that begin at different places never meet: each block must tell what follows every place."""
    df = spark.range(5000).selectExpr("1 line_id", "0L stream_id", "id arrival", "1L n", "false _flush")
    assert {x.arrival: x.batch for x in B.numbered(df, ["line_id"], ["arrival"], 7, None, bits=6).collect()} == {i: i // 7 for i in range(5000)}


def test_the_number_of_flushes_adds_no_jobs(spark):
    """Long chains of flushes took a round of joins for each doubling, and statistics as large as the product of all before."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(n: int) -> int:
        spark.sparkContext.setJobGroup(f"batches-{n}", "")
        df = spark.range(n).selectExpr("1 line_id", "id % 2 stream_id", "id arrival", "id next_seq", "1L file_id", "0L offset", "0L durable_offset", "1L n_received")
        assert A.coupled_ack_batches(df, 2).count() > n // 2
        return len(tracker.getJobIdsForGroup(f"batches-{n}"))

    try:
        assert jobs(3000) == jobs(30)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_line_with_all_reports_is_many_tasks(spark):
    df = spark.range(3000).selectExpr("1 line_id", "id % 2 stream_id", "id arrival", "id next_seq", "1L file_id", "0L offset", "0L durable_offset", "1L n_received")
    got = {(r.stream_id, r.batch): (r.received, r.next_seq) for r in A.coupled_ack_batches(df, 20).collect()}
    # Stream 0 is first at 20, one report before stream 1.
    assert got[0, 0] == (20, 38) and got[1, 0] == (19, 37) and sum(n for n, _ in got.values()) == 3000
    assert A.ack_batches(df.filter("false")).count() == 0
