import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import acks as A
from tidemark.operators import diff as D
from tidemark.operators import gaps as G
from tidemark.operators import lines as L
from tidemark.operators import manifest as M
from tidemark.plans import transfer as T

SUM = (1, 0, 4, b"abcd")


def entries(spark, rows):
    """rows: (stream, seq, file_id, kind, name, size[, link, checksum])."""
    full = [(1, s, "r", q, f, k, n, (rest + [""])[0] if rest else "", z, (rest[1] if len(rest) > 1 else SUM)) for s, q, f, k, n, z, *rest in rows]
    return spark.createDataFrame(full, schemas.ENTRIES)


def outcome(spark, sender, receiver):
    return tuple(D.manifest_diff(entries(spark, sender), entries(spark, receiver)).first())[1:4]


@pytest.mark.parametrize(
    "receiver, expected",
    [
        ([(1, 1, 1, 1, "a", 10), (1, 2, 2, 1, "b", 20), (1, 3, 3, 1, "c", 5)], ("IN_SYNC", 0, 0)),
        ([(1, 1, 1, 1, "a", 10), (1, 2, 2, 1, "b", 20), (1, 3, 3, 1, "c", 5), (1, 4, 4, 1, "extra", 1)], ("IN_SYNC", 0, 0)),
        ([(1, 1, 1, 1, "a", 10)], ("CREATE", 2, 0)),
        ([], ("CREATE", 1, 0)),
        ([(1, 1, 1, 1, "a", 10), (1, 2, 2, 1, "b", 7)], ("RESUME", 2, 7)),
        ([(1, 1, 1, 1, "a", 10), (1, 2, 3, 1, "c", 5)], ("CONFLICT", 0, 0)),  # an entry missing in the middle
        ([(1, 1, 1, 1, "a", 11)], ("CONFLICT", 0, 0)),
        ([(1, 1, 1, 1, "a", 10, "", (1, 0, 4, b"xxxx"))], ("CONFLICT", 0, 0)),
    ],
)
def test_diff_is_positional(spark, receiver, expected):
    assert outcome(spark, [(1, 1, 1, 1, "a", 10), (1, 2, 2, 1, "b", 20), (1, 3, 3, 1, "c", 5)], receiver) == expected


def test_links_compare_by_target_and_one_conflict_rejects_all(spark):
    s = entries(spark, [(1, 1, 9, 3, "l", 0, "x"), (2, 1, 1, 1, "a", 3)])
    r = entries(spark, [(1, 1, 9, 3, "l", 0, "y"), (2, 1, 1, 1, "a", 3)])
    diff = D.manifest_diff(s, r)
    assert {x.reason for x in D.diff_reply(diff).collect()} == {9}
    assert {x.stream_id: (x.action, x.reason) for x in D.diff_reply(diff, all_or_nothing=False).collect()} == {1: (None, 9), 2: (0, None)}


def test_reply_to_tasks_and_messages(spark):
    e = entries(spark, [(1, 1, 1, 1, "a", 10), (1, 2, 2, 1, "bb", 100), (1, 3, 3, 2, "d", 0), (1, 4, 4, 1, "big", 70), (1, 5, 5, 1, "empty", 0)])
    starts = spark.createDataFrame([(1, 1, 2, 40)], "stream_id long, action int, start_file_id long, start_offset long")
    tasks = D.apply_reply(e, starts)
    assert [(t.file_id, t.action, t.start_offset) for t in tasks.orderBy("seq").collect()] == [(2, 1, 40), (3, 2, 0), (4, 2, 0), (5, 2, 0)]
    plan = [(m.file_id, m.ordinal, m.msg_type, m.offset, m.len) for m in T.message_plan(tasks, 32, 50).orderBy("seq", "ordinal").collect()]
    # A resumed file goes in segments however large; the large new one in chunks, the last first.
    assert plan == [
        (2, 1, 4, 40, 32), (2, 2, 4, 72, 28), (3, 0, 3, None, None), (4, 0, 7, None, None), (4, 1, 8, 64, 6), (4, 2, 8, 0, 32), (4, 3, 8, 32, 32), (4, 4, 9, None, None), (5, 0, 3, None, None),
    ]
    with pytest.raises(PySparkException, match="start entry"):
        D.apply_reply(e, spark.createDataFrame([(1, 1, 77, 0)], starts.schema)).collect()
    with pytest.raises(PySparkException, match="lacks a stream"):
        D.apply_reply(e, starts.filter("false")).collect()


def test_scan_order_and_wide_sequence(spark):
    names = [("10.file", 1), ("2.file", 1), ("b", 1), ("a/1.file", 1), ("3.file", 2), ("Z", 1)]
    rows = spark.createDataFrame([(1, k, n) for n, k in names], "stream_id long, kind int, name string")
    rows = M.identified(rows)
    order = [r.name for r in M.sequenced(rows).orderBy("seq").collect()]
    assert order == ["2.file", "10.file", "3.file", "Z", "a/1.file", "b"]
    many = M.identified(spark.range(500).select((F.col("id") % 2).alias("stream_id"), F.lit(1).alias("kind"), F.concat(F.lit("n"), "id").alias("name")))
    a, b = (dict(((r.stream_id, r.name), r.seq) for r in f(many).collect()) for f in (M.sequenced, lambda m: M.sequenced_wide(m, 7)))
    assert a == b


def test_manifest_round_trip(spark, tmp_path):
    e = entries(spark, [(1, 1, 1, 1, "a", 10), (2, 1, 2, 3, "l", 0, "t")])
    M.save_manifest(e, f"{tmp_path}/m")
    key = lambda r: (r.stream_id, r.seq)
    back = M.load_manifest(spark, f"{tmp_path}/m").select(*e.columns)
    assert sorted(back.collect(), key=key) == sorted(e.collect(), key=key) == sorted(M.flat(M.nested(e)).collect(), key=key)
    assert M.filter_names(entries(spark, [(1, 1, 1, 1, "a.log", 1), (1, 2, 2, 2, "d", 0), (1, 3, 3, 1, "b.txt", 1)]), "log$").count() == 2


def test_snapshot_changes_and_lookup(spark):
    old = spark.createDataFrame([("same", 1, 1), ("grown", 1, 1), ("cut", 5, 1), ("dated", 1, 1), ("gone", 1, 1)], "path string, size long, mtime long")
    new = spark.createDataFrame([("same", 1, 1), ("grown", 2, 1), ("cut", 4, 1), ("dated", 1, 2), ("new", 1, 1)], old.schema)
    assert {r.path: r.change for r in D.snapshot_changes(old, new).collect()} == {"grown": "APPENDED", "cut": "MODIFIED", "dated": "MODIFIED", "gone": "REMOVED", "new": "CREATED"}
    assert [r.path for r in D.removed_paths(old, new).collect()] == ["gone"]
    e = entries(spark, [(1, 1, 1, 1, "a", 10)])
    wanted = spark.createDataFrame([(1, 1), (1, 8)], "stream_id long, file_id long")
    assert {r.file_id: r.name for r in D.entry_lookup(wanted, e).collect()} == {1: "a", 8: "8.file"}
    assert D.existing_targets(wanted.withColumn("name", F.lit("a")), e).count() == 2
    m = spark.createDataFrame([(1, 0, 0, None), (1, 1, 10, SUM), (1, 1, 9, SUM), (1, 5, 1, SUM), (1, 1, 10, (1, 0, 4, b"zzzz"))], f"stream_id long, prev_file_id long, prev_final_size long, prev_checksum {schemas.CHECKSUM}")
    assert sorted(str(r.verdict) for r in D.predecessor_barrier(m, e).collect()) == ["CHECKSUM_MISMATCH", "None", "None", "PREV_FILE_INCOMPLETE", "PREV_FILE_INCOMPLETE"]


def test_gaps_stop_at_the_highest_chunk(spark):
    r = spark.createDataFrame([(1, i, 10, n) for n, i in enumerate([1, 2, 5, 5, 8])], "file_id long, chunk_index long, chunk_count long, arrival long")
    assert [(g.first, g.last) for g in G.missing_ranges(r, ["file_id"]).orderBy("first").collect()] == [(0, 0), (3, 4), (6, 7)]
    assert [(g.first, g.last) for g in G.missing_ranges(r, ["file_id"], 1).collect()] == [(0, 0)]
    assert G.missing_ranges(r.filter("false"), ["file_id"]).count() == 0
    assert [(c.received, c.complete) for c in G.completeness(r, ["file_id"]).collect()] == [(4, False)]
    assert G.duplicates(r, ["file_id"]).filter("duplicate").count() == 1


def test_promotion_of_reported_gaps(spark):
    chunks = spark.createDataFrame([(1, i, 3) for i in range(3)], "file_id long, chunk_index long, chunk_count long")
    none = chunks.select("file_id", "chunk_index").filter("false")
    sent = lambda *rows: spark.createDataFrame(list(rows), "file_id long, chunk_index long, sent_tick long")
    work = lambda hinted, acked, sent_, now: [r.chunk_index for r in G.resend_worklist(chunks, hinted, acked, sent_, now, 10, ["file_id"]).orderBy("turn").collect()]
    assert work(none, none, spark.createDataFrame([], "file_id long, chunk_index long, sent_tick long"), 1) == [2, 0, 1]
    acked = spark.createDataFrame([(1, 2)], "file_id long, chunk_index long")
    hints = spark.createDataFrame([(1, 0, 1)], "file_id long, first long, last long")
    hinted = G.hinted_chunks(hints, chunks.select("file_id", "chunk_count").distinct(), acked, ["file_id"])
    assert work(hinted, acked, sent((1, 2, 1), (1, 0, 2)), 3) == [1]
    assert work(hinted, acked, sent((1, 2, 1), (1, 0, 2), (1, 1, 3)), 5) == []
    assert work(hinted, acked, sent((1, 2, 1), (1, 0, 2), (1, 1, 3)), 12) == [0]
    order = spark.createDataFrame([(1, 0, 1), (1, 1, 9), (1, 2, 2), (1, 3, 0)], "file_id long, position long, chunk_index long")
    ranked = lambda o: [r.chunk_index for r in G.chunk_order(chunks, o, ["file_id"]).orderBy("rank").collect()]
    assert ranked(order) == [1, 2, 0] and ranked(order.filter("position < 3")) == [2, 0, 1]


SEND = "line_id int, kind int, stream_id long, file_id long, seq long, offset long, end_offset long, chunk_index long, bytes long, sent_tick long"
ACK = "line_id int, stream_id long, file_id long, arrival long, next_seq long, offset long, durable_offset long, received_chunks array<struct<seq:long,file_id:long,chunk_index:long>>"


def test_ack_rules(spark):
    sends = spark.createDataFrame([(1, 8, 1, 42, 3, 0, 0, 2, 5, 1), (1, 3, 1, 42, 3, 0, 0, 0, 5, 1), (1, 4, 1, 42, 5, 0, 100, 0, 5, 1), (2, 3, 1, 42, 3, 0, 0, 0, 5, 1), (1, 3, 1, 42, 3, 0, 0, 0, 5, 9)], SEND)
    acks = spark.createDataFrame([(1, 1, 42, 4, 3, 50, 0, [(3, 42, 2)]), (1, 1, 42, 6, 4, 50, 100, []), (1, 1, 42, 12, 4, 50, 100, [])], ACK)
    got = {(r.line_id, r.kind, r.sent_tick): r.ack_tick for r in A.match_acks(sends, acks).collect()}
    assert got == {(1, 8, 1): 4, (1, 3, 1): 6, (1, 4, 1): 6, (2, 3, 1): None, (1, 3, 9): 12}
    free = {(r.line_id, r.kind, r.sent_tick): r.ack_tick for r in A.release_sends(sends, acks).collect()}
    assert free[(2, 3, 1)] == 6 and free[(1, 8, 1)] == 4  # the list releases the chunk
    samples = A.latency_samples(A.release_sends(sends, acks)).filter("kind = 3").collect()
    assert [(s.sent_tick, s.rtt) for s in samples] == [(9, 3)]
    flight = {r.line_id: (r.open_sends, r.inflight_bytes, r.completed_bytes) for r in A.inflight(A.match_acks(sends, acks), 7).collect()}
    assert flight == {1: (0, 0, 15), 2: (1, 5, 0)}
    lost = A.lost_sends(A.match_acks(sends, acks), spark.createDataFrame([(2, 5), (1, 20)], "line_id int, tick long"))
    assert [(r.line_id, r.lost_tick) for r in lost.collect()] == [(2, 5)]
    assert A.retransmit_queue([sends, sends], sends.filter("line_id = 2")).count() == 1
    tried = A.attempts(sends.filter("kind = 3 and line_id = 1"), 1).orderBy("sent_tick").collect()
    assert [(t.attempt, t.retransmit, t.exhausted) for t in tried] == [(1, False, False), (2, True, True)]
    assert A.unacked(sends, sends.filter("kind = 3")).count() == 2


def test_merged_reports_count_anew_after_a_flush(spark):
    acks = spark.createDataFrame([(1, 1, k, k, 7, k, k, n) for k, n in enumerate([15, 15, 15, 15, 25, 3, 3])], "line_id int, stream_id long, arrival long, next_seq long, file_id long, offset long, durable_offset long, n_received long")
    assert [(r.batch, r.received, r.next_seq) for r in A.ack_batches(acks, 20).orderBy("batch").collect()] == [(0, 30, 1), (1, 30, 3), (2, 25, 4), (3, 6, 6)]
    assert A.ack_batches(acks, 0).count() == 1


def test_combined_checksums(spark):
    from tidemark.functions.checksums import crc_bytes, register_all

    register_all(spark)
    data = [b"", b"a", b"bcd" * 999, b"", b"xyz", b"12"]
    rows = spark.createDataFrame([(k, bytearray(d), len(d)) for k, d in enumerate(data)], "k int, payload binary, len long").repartition(3)
    got = rows.selectExpr("k", "crc32c(payload) as c", "len").groupBy().agg(F.expr("crc32c_combine(c, len, k)").alias("c")).first().c
    assert bytes(got) == crc_bytes(b"".join(data))


def test_coupled_ack_batches(spark):
    acks = spark.createDataFrame([(1, s, 1, a, a, 0, 0, [(1, 1, a)]) for a, s in enumerate([7, 8, 7, 7, 8])], ACK)
    got = [(r.stream_id, r.batch, r.received) for r in A.coupled_ack_batches(acks, 3).orderBy("batch", "stream_id").collect()]
    assert got == [(7, 0, 3), (8, 0, 1), (8, 1, 1)]  # the third chunk of 7 flushes 8 too


def test_smoothed_timeout_equals_a_loop(spark):
    xs = [20, 31, 7, 100, 55, 1]
    s, v = xs[0], max(1, xs[0] // 2)
    for x in xs[1:]:
        v = max(1, (3 * v + abs(s - x)) // 4)
        s = max(1, (7 * s + x) // 8)
    row = A.smoothed_timeout(spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, order int, x long"), ["k"]).first()
    assert (row.srtt, row.rttvar, row.timeout) == (s, v, min(max(s + max(1, 4 * v), 50), 800))


def test_rate_audit_equals_a_bucket(spark):
    import random

    random.seed(3)
    sends, tick = [], 0
    for i in range(300):
        tick += random.choice([0, 0, 1, 1, 2, 9])
        sends.append((1, tick, i, random.randint(1, 40)))
    tokens, last, want = 100, 0, []
    for _, t, _, b in sends:
        tokens = min(100, tokens + 12 * (t - last)) - b
        last = t
        want.append(tokens)
    got = L.rate_audit(spark.createDataFrame(sends, "line_id int, tick long, order long, bytes long"), 12, 100).orderBy("order").collect()
    assert [r.tokens for r in got] == want and any(r.violation for r in got)


def test_silence_state_and_escalation(spark):
    ev = spark.createDataFrame([(1, 1, 1, "send"), (1, 7, 2, "tick"), (2, 1, 1, "send"), (2, 5, 2, "report"), (2, 7, 3, "tick"), (3, 9, 1, "tick")], "line_id int, tick long, order long, event string")
    last = {r.line_id: r.stale for r in L.silence(ev, 5).filter("event = 'tick'").collect()}
    assert last == {1: True, 2: False, 3: False}
    state = spark.createDataFrame([(1, 1, "connect"), (1, 2, "disconnect"), (1, 3, "report"), (2, 1, "report"), (2, 2, "disconnect"), (2, 3, "disconnect")], "line_id int, order long, event string")
    assert {r.line_id: (r.connected, r.negotiated, r.healthy, r.failures) for r in L.line_state(state).collect()} == {1: (True, True, True, 0), 2: (False, False, False, 2)}
    rec = spark.createDataFrame([(1, i, c == "r", c == "p") for i, c in enumerate("rrprrrr")], "k int, order int, recovery boolean, progress boolean")
    assert [(r.attempt, r.final) for r in A.escalation(rec, "k").filter("recovery").orderBy("order").collect()] == [(1, False), (2, False), (1, False), (2, False), (3, False), (4, True)]


def test_chunks_round_trip(spark):
    import os

    data = {i: os.urandom(n) for i, n in enumerate([1, 100, 101, 5000])}
    files = spark.createDataFrame([(1, i, i, bytearray(d)) for i, d in data.items()], "stream_id long, seq long, file_id long, payload binary")
    back = T.assemble(T.chunk_payloads(files, 100).repartition(5))
    assert {r.file_id: bytes(r.payload) for r in back.collect()} == data


def test_names_of_codes(spark):
    df = spark.createDataFrame([(4, 1), (99, 2)], "reason int, kind int")
    assert [(r.reason_name, r.kind_name) for r in schemas.with_names(df, "reason", "kind").collect()] == [("BAD_CHECKSUM", "REGULAR_FILE"), (None, "DIRECTORY")]
