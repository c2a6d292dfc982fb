import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.checksums import crc, crc_bytes
from tidemark.operators.diff import manifest_diff
from tidemark.schemas import MSG_TYPES, REASONS
from tidemark.sources import capture, sink, tree
from tidemark.streaming import apply as AP
from tidemark.streaming import flows as FL

BASE = dict.fromkeys(AP.FIELDS)


def run(messages, threshold=65536):
    import pandas as pd

    files = {}
    rows = [BASE | {"stream_id": 1, "session": 1, "arrival": i, "compression": 0, "checksum_algo": 1} | m for i, m in enumerate(messages)]
    for m in rows:
        m["msg_type"] = MSG_TYPES[m["msg_type"]]
        if m["payload"] is not None:
            m["raw_len"] = len(m["payload"]) if m["raw_len"] is None else m["raw_len"]
            m["checksum"] = crc_bytes(m["payload"]) if m["checksum"] is None else m["checksum"]
    out = AP.Stream(None, files.get, files.__setitem__, threshold).run(pd.DataFrame(rows))
    names = {v: k for k, v in REASONS.items()}
    return [o if o != "rejected" else names[int(r)] for o, r in zip(out["outcome"], out["reason"], strict=True)], files


def create(seq, name, size=0, **more):
    return {"msg_type": "CREATE", "seq": seq, "file_id": seq, "kind": 1, "name": name, "final_size": size} | more


def data(seq, offset, payload, size=0, **more):
    return {"msg_type": "DATA", "seq": seq, "file_id": seq, "offset": offset, "payload": payload, "final_size": size} | more


def chunked(body, step=65536, **more):
    begin = {"msg_type": "FILE_BEGIN", "seq": 1, "file_id": 1, "name": "big", "final_size": len(body), "chunk_size": step, "chunk_count": -(-len(body) // step), "file_crc": int(crc([body])[0])} | more
    parts = [{"msg_type": "CHUNK", "seq": 1, "file_id": 1, "chunk_index": i, "offset": i * step, "payload": body[i * step : (i + 1) * step]} for i in range(-(-len(body) // step))]
    return begin, parts, {"msg_type": "FILE_COMMIT", "seq": 1, "file_id": 1}


def test_append_rules():
    got, files = run([create(1, "a", 5), data(1, 0, b"hello", 5, checksum=b"xxxx"), data(1, 0, b"hello", 6), data(1, 1, b"hello", 5), data(1, 0, b"hel", 5), data(1, 3, b"loo", 5), data(1, 3, b"lo", 5), create(1, "a", 5), create(3, "c"), create(2, "a"), create(2, "../x"), create(2, "d", kind=7), create(2, "empty"), create(3, "b", 1, session=9)])
    assert got == ["accepted", "BAD_CHECKSUM", "SIZE_CONFLICT", "BAD_OFFSET", "accepted", "BAD_OFFSET", "accepted", "ignored", "BAD_SEQ", "FILE_EXISTS", "BAD_CREATE", "BAD_CREATE", "accepted", "BAD_SESSION"]
    assert files["a"] == {"size": 5, "crc": int(crc([b"hello"])[0])}


def test_predecessor_rules():
    got, _ = run([create(1, "a"), create(2, "b", prev_file_id=9, prev_final_size=0), create(2, "b", prev_file_id=1, prev_final_size=3), create(2, "b", prev_file_id=1, prev_final_size=0, prev_crc=5), create(2, "b", prev_file_id=1, prev_final_size=0, prev_crc=0)])
    assert got == ["accepted", "PREV_FILE_INCOMPLETE", "PREV_FILE_INCOMPLETE", "CHECKSUM_MISMATCH", "accepted"]


def test_chunk_rules():
    body = bytes(65 + i % 26 for i in range(65537))
    begin, (c0, c1), commit = chunked(body)
    got, files = run([c0, commit, begin, begin, c1, c1, commit, c0 | {"offset": 5}, c0 | {"payload": b"x"}, c0 | {"chunk_index": 7}, c0 | {"checksum": b"xxxx"}, c0 | {"compression": 1}, c0 | {"file_id": 3}, c0, commit, commit])
    assert got == ["BAD_CHUNK", "BAD_COMMIT", "accepted", "ignored", "accepted", "ignored", "BAD_COMMIT", "BAD_OFFSET", "BAD_CHUNK", "BAD_CHUNK", "BAD_CHECKSUM", "DECODE_ERROR", "BAD_FILE_ORDER", "accepted", "accepted", "ignored"]
    assert files["big"]["size"] == 65537
    wrong, parts, commit = chunked(body, file_crc=1)
    assert run([wrong, *parts, commit])[0][-1] == "CHECKSUM_MISMATCH"
    small, _, _ = chunked(body[:65536])
    assert run([small])[0] == ["BAD_CHUNK"]


def test_stream_equals_batch_under_any_split(spark, sf, tmp_path):
    log = AP._complete(AP.log_from_orders(spark, sf)).filter("session % 7 = 0").cache()
    want = sorted(map(tuple, AP.apply_batch(log).collect()))
    edges = sorted(log.agg(F.percentile_approx("arrival", [0.3, 0.6])).first()[0])
    for i, rows in enumerate([log.filter(F.col("arrival") <= edges[0]), log.filter((F.col("arrival") > edges[0]) & (F.col("arrival") <= edges[1])), log.filter(F.col("arrival") > edges[1])]):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        time.sleep(1.1 if i < 2 else 0)  # files are taken in order of their times
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    query = AP.apply_stream(source).writeStream.format("memory").queryName("applied").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("applied").collect())) == want and len({w[4] for w in want}) == 3


def test_streams_of_duplicates_alarms_and_differences(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "send"), (2, "2024-01-01 00:00:00", "send"), (2, "2024-01-01 00:00:01", "done")], "line_id int, ts string, event string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/ev")
    time.sleep(1.1)
    rows.limit(1).withColumn("line_id", F.lit(9)).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:01:00"))).withColumn("event", F.lit("report")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ev")
    ev = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ev")
    q = FL.silence_alarm(ev).writeStream.format("memory").queryName("alarms").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.line_id, r.open_sends) for r in spark.table("alarms").collect()] == [(1, 1)]
    chunks = rows.select("ts", F.lit(1).alias("stream_id"), F.lit(1).alias("seq"), F.lit(1).alias("file_id"), F.lit(0).alias("chunk_index"))
    chunks.write.parquet(f"{tmp_path}/ch")
    once = FL.distinct_chunks(spark.readStream.schema(chunks.schema).parquet(f"{tmp_path}/ch"))
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1
    msgs = rows.select("ts", F.lit(1).alias("stream_id"), F.lit(4).alias("seq"), F.lit(2).alias("file_id"), F.lit(7).alias("end_offset"))
    assert [(r.next_seq, r.messages) for r in FL.reports(msgs, "1 minute").collect()] == [(5, 3)]
    from tidemark import views as V

    src = V.src_entries(spark, "/root/testdata/sf0.001")
    src.write.parquet(f"{tmp_path}/m")
    got = []
    FL.rediff(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/m"), lambda: V.dst_entries(src), lambda d, n: got.extend(r.outcome for r in d.orderBy("stream_id").collect()), f"{tmp_path}/c3").awaitTermination()
    assert got == ["IN_SYNC", "CREATE", "RESUME", "CONFLICT"]


def test_tree_copy_until_in_sync(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    (src / "sub" / "empty").mkdir(parents=True)
    dst.mkdir()
    (src / "big.bin").write_bytes(bytes((5 + 31 * i) % 251 for i in range(150 * 1024)))
    (src / "sub" / "small.txt").write_text("hello")
    (src / "2.file").write_bytes(b"22")
    (src / ".dot").write_bytes(b"")
    os.symlink("small.txt", src / "sub" / "link")
    (src / tree.TEMP).mkdir()
    (src / tree.TEMP / "x").write_text("never seen")
    scan = tree.scan_tree(spark, str(src), 1).cache()
    got = {r.name: (r.kind, r.size, r.seq) for r in scan.collect()}
    assert set(got) == {"2.file", ".dot", "big.bin", "sub", "sub/empty", "sub/small.txt", "sub/link"} and got["2.file"][2] == 1 and got["sub/link"][0] == 3
    assert scan.filter("name = '.dot'").first().checksum.algo == 0
    diff = lambda: manifest_diff(scan, tree.scan_tree(spark, str(dst), 1)).first().outcome
    assert diff() == "CREATE" and tree.scan_tree(spark, str(tmp_path / "none"), 1).count() == 0
    sink.make_entries(scan.withColumn("root", F.lit(str(dst))))
    files = scan.filter("kind = 1")
    full = tree.with_checksums(files.select("root", "name", "kind", "size", "file_id"), None)
    ranges = full.withColumn("offset", F.explode(F.expr("sequence(0L, greatest(size - 1, 0L), 65536L)"))).withColumn("len", F.least(F.lit(65536), F.col("size") - F.col("offset")))
    chunks = tree.read_ranges(ranges).withColumn("file_checksum", F.when(F.col("size") > 0, F.col("checksum.value")))
    sink.write_files(spark, chunks.repartition(3), str(dst))
    assert diff() == "IN_SYNC" and (dst / "big.bin").read_bytes() == (src / "big.bin").read_bytes() and os.readlink(dst / "sub" / "link") == "small.txt"
    with pytest.raises(Exception, match="FILE_EXISTS"):
        sink.write_files(spark, chunks, str(dst))
    with open(src / "big.bin", "ab") as f:
        f.write(b"more")
    scan = tree.scan_tree(spark, str(src), 1)
    seg = spark.createDataFrame([(str(dst), "big.bin", 150 * 1024, bytearray(b"more"))], "root string, name string, offset long, payload binary")
    assert diff() == "RESUME"
    sink.append_segments(seg)
    assert diff() == "IN_SYNC"
    sink.append_segments(seg)  # again, as by a task that was lost: nothing is written twice
    assert diff() == "IN_SYNC"
    for other in (seg.withColumn("payload", F.lit(b"else")), seg.withColumn("offset", F.col("offset") + 9)):
        with pytest.raises(Exception, match="BAD_OFFSET"):
            sink.append_segments(other)
    with open(dst / "big.bin", "r+b") as f:
        f.truncate(150 * 1024 + 2)  # half of the segment is there
    sink.append_segments(seg)
    assert diff() == "IN_SYNC"
    sink.make_entries(scan.filter("kind = 3").withColumn("root", F.lit(str(dst))))
    two = tree.scan_roots(spark, [(2, str(src / "sub")), (2, str(dst))], regex="txt$")
    assert {(r.stream_id, r.name) for r in two.collect()} == {(2, "small.txt"), (2, "empty")}


def test_sinks_stay_below_their_root(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    os.symlink(tmp_path, root / "out")
    chunk = lambda name: spark.createDataFrame([(1, name, 2, None, 0, bytearray(b"ab"))], "file_id long, name string, size long, file_checksum binary, offset long, payload binary")
    for name in ("../escaped.txt", "/escaped.txt", "a/../../escaped.txt", "", "out/escaped.txt", "./x", "a/"):
        with pytest.raises(Exception, match="UNSAFE_NAME"):
            sink.write_files(spark, chunk(name), str(root))
        with pytest.raises(Exception, match="UNSAFE_NAME"):
            sink.append_segments(chunk(name).withColumn("root", F.lit(str(root))))
        for kind in (2, 3):
            with pytest.raises(Exception, match="UNSAFE_NAME"):
                sink.make_entries(chunk(name).select(F.lit(str(root)).alias("root"), "name", F.lit(kind).alias("kind"), F.lit("x").alias("link_target")))
    assert sorted(os.listdir(tmp_path)) == ["root"] and not set(os.listdir(root)) - {"out", tree.TEMP}


def test_a_file_with_missing_or_wrong_chunks_is_not_committed(spark, tmp_path):
    data = os.urandom(300)
    rows = [(1, "a/whole", 300, bytearray(crc_bytes(data)), k, bytearray(data[k : k + 100])) for k in (0, 100, 200)]
    make = lambda rows: spark.createDataFrame(rows, "file_id long, name string, size long, file_checksum binary, offset long, payload binary")
    for bad in (rows[:2], rows[1:], [*rows, rows[1]], [(*rows[0][:5], bytearray(100)), *rows[1:]]):
        with pytest.raises(Exception, match="CHECKSUM_MISMATCH"):
            sink.write_files(spark, make(bad), str(tmp_path))
        assert not (tmp_path / "a").exists()
    sink.write_files(spark, make(rows), str(tmp_path))
    assert (tmp_path / "a" / "whole").read_bytes() == data


def test_capture_with_bad_frames(spark, tmp_path):
    q = lambda *v: struct.pack("<" + "q" * len(v), *v)
    blob = lambda b: struct.pack("<I", len(b)) + b
    frame = lambda kind, body, magic=capture.MAGIC: struct.pack("<IBBHI", magic, 1, kind, 12, len(body)) + body
    none = b"\0" + q(0, 0) + blob(b"")
    good = [
        frame(3, q(1, 2, 3) + b"\1" + blob(b"name") + blob(b"") + q(5, 0, 0) + none),
        frame(8, q(1, 2, 3, 0, 0) + struct.pack("<II", 2, 2) + b"\0\1" + blob(b"abcd") + blob(b"xy")),
        frame(5, q(1, 2, 3, 4, 5, 6) + struct.pack("<I", 1) + q(1, 2, 3) + struct.pack("<I", 1) + q(1, 2, 3, 4)),
        frame(2, q(7) + struct.pack("<I", 1) + q(1) + blob(b"r") + struct.pack("<I", 1) + q(3, 1) + b"\1" + blob(b"n") + blob(b"") + q(9) + none),
        frame(9, q(1, 2, 3)),
        frame(6, q(1, 2, 3, 4, 5, 6, 7) + b"\4" + blob(b"why")),
    ]
    bad = [frame(9, q(1, 2)), frame(9, q(1, 2, 3) + b"x"), frame(77, b""), frame(9, q(1, 2, 3), magic=5)]
    (tmp_path / "a.cap").write_bytes(b"".join([*good, *bad]) + b"\1\2\3")
    (tmp_path / "b.cap").write_bytes(os.urandom(200))
    messages, quarantine = capture.read_capture(spark, f"{tmp_path}/*.cap")
    rows = messages.orderBy("arrival").collect()
    assert [r.msg_type for r in rows] == [3, 8, 5, 2, 9, 6] and rows[1].payload == b"xy" and rows[2].missing_ranges[0].last == 4 and rows[3].streams[0].entries[0].name == "n" and rows[5].reason == 4
    assert quarantine.filter("path like '%a.cap'").count() == 5 and quarantine.filter("path like '%b.cap'").count() >= 1


def _capture(r, n, largest):
    """Frames of chunks, among them bad bodies and payloads that hold what looks like headers."""
    q = lambda *v: struct.pack("<" + "q" * len(v), *v)
    head = lambda kind, n_, magic=capture.MAGIC: struct.pack("<IBBHI", magic, 1, kind, 12, n_)
    out = []
    for k in range(n):
        payload = r.randbytes(r.randrange(largest)) + head(9, r.randrange(2 * largest)) * r.randrange(3) + r.randbytes(r.randrange(20))
        body = q(1, 2, k, 0, 0) + struct.pack("<II", len(payload), len(payload)) + b"\0\1" + struct.pack("<I", 4) + b"abcd" + struct.pack("<I", len(payload)) + payload
        out.append(head(8, len(body), r.choice([capture.MAGIC] * 9 + [5])) + body[: len(body)])
    return b"".join(out)


def test_ranges_of_a_capture_begin_where_a_serial_parse_does():
    import random

    r = random.Random(8)
    whole = _capture(r, 60, 300)
    broken = bytearray(whole)
    broken[len(whole) // 2 : len(whole) // 2 + 40] = r.randbytes(40)
    for data in (whole, bytes(broken), whole[:-5], whole + b"\1" * 30, r.randbytes(3000), b"", b"x"):
        want = list(capture.frames(data))
        for step in (64, 500, 4096):
            leads = dict(p for start in range(0, len(data), step) for p in capture.exits(data[start : start + step + capture.HEADER], start, step, len(data)))
            got, at = [], 0 if data else None
            while at is not None:
                start = at - at % step
                got += list(capture.frames(data[at:], at, start + step, at, len(data)))
                at = leads.get(at)
            assert got == want, step


def test_a_large_capture_is_parsed_in_ranges(spark, tmp_path):
    import random

    r = random.Random(9)
    data = _capture(r, 60, 200_000)
    broken = data[: 4 << 20] + r.randbytes(4000) + data[(4 << 20) + 4000 :]
    (tmp_path / "a.cap").write_bytes(data)
    (tmp_path / "b.cap").write_bytes(broken)
    (tmp_path / "c.cap").write_bytes(b"")
    messages, quarantine = capture.read_capture(spark, f"{tmp_path}/*.cap", step=1 << 20)
    for name, raw in (("a", data), ("b", broken)):
        want = list(capture.frames(raw))
        got = {x.arrival: x.file_id for x in messages.filter(f"path like '%{name}.cap'").select("arrival", "file_id").collect()}
        assert got == {k: m["file_id"] for k, (_, m, _) in enumerate(want) if m}
        bad = {(x.arrival, x.at, x.error) for x in quarantine.filter(f"path like '%{name}.cap'").collect()}
        assert bad == {(k, at, e) for k, (at, _, e) in enumerate(want) if e} and bad
