"""Outcomes by joins against the rules applied message by message."""

import random

from pyspark.sql import functions as F

from tidemark.functions.checksums import crc, crc_bytes
from tidemark.operators.audit import chunked_outcomes
from tidemark.schemas import MSG_TYPES
from tidemark.streaming import apply as AP


def outcomes(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def test_a_log_of_orders(spark, sf):
    log = AP.log_from_orders(spark, sf).filter("stream_id % 5 = 0")
    assert outcomes(chunked_outcomes(log)) == outcomes(AP.apply_batch(log))


def test_random_logs_with_every_fault(spark):
    r, rows = random.Random(3), []
    for stream in range(14):
        arrival = 0
        for seq in [s for s in range(1, 7) if not (stream == 3 and s == 3)]:
            size, step = r.choice([25, 30, 31]), 10
            body, count = r.randbytes(size), -(-size // 10)
            own = {"msg_type": "FILE_BEGIN", "file_id": 100 * stream + seq, "name": f"f{seq}", "final_size": size, "chunk_size": step, "chunk_count": count, "file_crc": int(crc([body])[0])}
            fine = r.random() < 0.75
            batch = [own] if fine or r.random() < 0.5 else [own | r.choice([{"final_size": 5}, {"chunk_count": 9}, {"name": "../x"}]), own]
            if r.random() < 0.2:
                batch.append(own)
            good = [{"msg_type": "CHUNK", "file_id": own["file_id"], "chunk_index": i, "offset": i * step, "raw_len": len(body[i * step : (i + 1) * step]), "checksum_algo": 1, "checksum": bytearray(crc_bytes(body[i * step : (i + 1) * step])), "payload": bytearray(body[i * step : (i + 1) * step])} for i in range(count)]
            wrong = [c | r.choice([{"offset": 3}, {"chunk_index": 50}, {"checksum": bytearray(b"0000")}, {"raw_len": 2}, {"payload": bytearray(b"x"), "raw_len": 1}, {"file_id": 1}, {"checksum_algo": 2}]) for c in good if r.random() < 0.4]
            some = good + wrong + [c for c in good if r.random() < 0.3]
            r.shuffle(some)
            end = {"msg_type": "FILE_COMMIT", "file_id": own["file_id"]}
            if not fine and r.random() < 0.4:
                own["file_crc"] = 1
            batch += some if fine or r.random() < 0.6 else some[: len(some) // 2]
            batch += [end] * r.choice([1, 1, 2]) + ([good[0]] if r.random() < 0.3 else [])
            if r.random() < 0.2:
                batch.insert(0, good[0])
            for m in batch:
                arrival += 1
                rows.append(dict.fromkeys(("name", "final_size", "chunk_size", "chunk_count", "file_crc", "chunk_index", "offset", "raw_len", "checksum_algo", "checksum", "payload")) | m | {"stream_id": stream, "seq": seq, "arrival": arrival, "msg_type": MSG_TYPES[m["msg_type"]]})
    kind = "stream_id long, arrival long, msg_type int, seq long, file_id long, name string, final_size long, chunk_size long, chunk_count long, file_crc long, chunk_index long, offset long, raw_len long, checksum_algo int, checksum binary, payload binary"
    names = [c.split()[0] for c in kind.split(", ")]
    log = spark.createDataFrame([tuple(m[n] for n in names) for m in rows], kind).repartition(5)
    got, want = outcomes(chunked_outcomes(log, 20)), outcomes(AP.apply_batch(log, 20))
    assert [g for g, w in zip(got, want, strict=True) if g != w] == []
    assert len({w[5] for w in want}) >= 8 and {w[4] for w in want} == {"accepted", "ignored", "rejected"}
    assert chunked_outcomes(log.filter(F.lit(False))).count() == 0
