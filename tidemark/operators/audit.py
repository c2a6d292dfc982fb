"""Outcomes of a stored log of chunked transfers, by joins and aggregates.

For logs in which a stream's messages come in order of their sequence numbers, as one line delivers them. Then what
happens to an entry depends on its own messages alone, and whether its turn comes, on the entries before it: so
checks of geometry, payload checksums, repeats, completeness and whole checksums are columns and aggregates of the entry, and the turn is the
first entry of the stream that isn't completed. No task folds a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checksums import crc32c, crc32c_of_parts, crc_value
from tidemark.functions.names import is_safe_name
from tidemark.operators.ranges import Ranges
from tidemark.schemas import MSG_TYPES, REASONS
from tidemark.shared import written

BEGIN, CHUNK, COMMIT = (MSG_TYPES[k] for k in ("FILE_BEGIN", "CHUNK", "FILE_COMMIT"))
_ENTRY = ["stream_id", "seq"]


def _reason(name: str) -> Column:
    return F.lit(REASONS[name])


def chunked_outcomes(messages: DataFrame, threshold: int = 65536) -> DataFrame:
    """stream_id, arrival, msg_type, seq, outcome, reason, expected_seq, file_id, offset of messages FILE_BEGIN, CHUNK and FILE_COMMIT (stream_id, arrival, msg_type, seq, file_id,
    name, final_size, chunk_size, chunk_count, file_crc, chunk_index, offset, raw_len, checksum_algo, checksum, payload).

    The first check that fails decides, as where messages are applied one by one; of a beginning and chunks of one entry, the first good ones count.
    """
    size = F.octet_length("payload").cast("long")
    good_sum = (F.col("raw_len") == size) & (F.col("checksum_algo") == 1) & (crc32c(F.col("payload")) == F.col("checksum"))
    sized = (F.col("final_size") > threshold) & (F.col("chunk_size") > 0) & (F.col("chunk_count") == F.ceil(F.col("final_size") / F.col("chunk_size")))
    small = [c for c in messages.columns if c != "payload"]
    log = written(messages.select(*small, F.coalesce(size, F.lit(0).cast("long")).alias("_n"), F.coalesce(good_sum, F.lit(False)).alias("_sum"), (F.col("raw_len") == size).alias("_whole"), crc_value(F.col("checksum")).alias("_crc")), "audit-log")
    begins = log.filter(F.col("msg_type") == BEGIN).withColumn("_fault", F.when(~F.coalesce(sized, F.lit(False)), _reason("BAD_CHUNK")).when(~is_safe_name("name"), _reason("BAD_CREATE")))
    opened = begins.filter("_fault is null").groupBy(*_ENTRY).agg(F.min_by(F.struct("arrival", "file_id", "final_size", "chunk_size", "chunk_count", "file_crc"), "arrival").alias("o"))
    opened = written(opened, "audit-opened")  # this, what is done and what is closed: a row an entry, read several times below
    chunks = log.filter(F.col("msg_type") == CHUNK).join(opened, _ENTRY, "left")
    length = F.least(F.col("o.chunk_size"), F.col("o.final_size") - F.col("chunk_index") * F.col("o.chunk_size"))
    geometry = (
        F.when(F.col("o").isNull() | (F.col("o.arrival") > F.col("arrival")), _reason("BAD_CHUNK"))
        .when(F.col("file_id") != F.col("o.file_id"), _reason("BAD_FILE_ORDER"))
        .when(~F.col("chunk_index").between(0, F.col("o.chunk_count") - 1), _reason("BAD_CHUNK"))
        .when(F.col("offset") != F.col("chunk_index") * F.col("o.chunk_size"), _reason("BAD_OFFSET"))
        .when(F.col("_n") != length, _reason("BAD_CHUNK"))
    )
    chunks = chunks.withColumn("_fault", geometry)
    firsts = chunks.filter("_fault is null and _sum").groupBy(*_ENTRY, "chunk_index").agg(F.min("arrival").alias("_first"), F.min_by(F.struct("_crc", "offset", F.col("_n").alias("len")), "arrival").alias("part"))
    firsts = written(firsts, "audit-chunks")
    parts = firsts.join(opened, _ENTRY).select(*_ENTRY, "part.len", "part._crc", (F.col("o.final_size") - F.col("part.offset") - F.col("part.len")).alias("after"))
    whole = crc32c_of_parts(parts, _ENTRY, F.col("_crc"), F.col("after")).select(*_ENTRY, crc_value(F.col("checksum")).alias("whole"))
    done = firsts.groupBy(*_ENTRY).agg(F.count("*").alias("chunks"), F.max("_first").alias("full")).join(whole, _ENTRY).join(opened, _ENTRY)
    right = F.coalesce(F.col("whole") == F.col("o.file_crc"), F.lit(False))
    done = done.withColumn("full", F.when(F.col("chunks") == F.col("o.chunk_count"), F.col("full"))).withColumn("right", right)
    done = written(done.select(*_ENTRY, "full", "right"), "audit-done")
    commits = log.filter(F.col("msg_type") == COMMIT).join(opened, _ENTRY, "left").join(done, _ENTRY, "left")
    fault = (
        F.when(F.col("o").isNull() | (F.col("o.arrival") > F.col("arrival")), _reason("BAD_COMMIT"))
        .when(F.col("file_id") != F.col("o.file_id"), _reason("BAD_FILE_ORDER"))
        .when(F.col("full").isNull() | (F.col("full") > F.col("arrival")), _reason("BAD_COMMIT"))
        .when(~F.col("right"), _reason("CHECKSUM_MISMATCH"))
    )
    commits = commits.withColumn("_fault", fault)
    closed = commits.filter("_fault is null").groupBy(*_ENTRY).agg(F.min("arrival").alias("closed"), F.first("o.final_size").alias("closed_size"))
    closed = written(closed, "audit-closed")

    again = F.lit(False).alias("_again")
    common = ["stream_id", "arrival", "msg_type", "seq", "file_id", "_fault"]
    own = begins.join(opened, _ENTRY, "left").select(*common, F.coalesce(F.col("o.arrival") < F.col("arrival"), F.lit(False)).alias("_again"))
    summed = F.when(~F.coalesce(F.col("_whole"), F.lit(False)), _reason("DECODE_ERROR")).when(~F.col("_sum"), _reason("BAD_CHECKSUM"))
    judged = chunks.join(firsts.select(*_ENTRY, "chunk_index", "_first"), [*_ENTRY, "chunk_index"], "left")
    judged = judged.withColumn("_again", F.col("_fault").isNull() & F.coalesce(F.col("_first") < F.col("arrival"), F.lit(False)))
    judged = judged.withColumn("_fault", F.when(F.col("_fault").isNull() & ~F.col("_again"), summed).otherwise(F.col("_fault")))
    every = own.union(judged.select(*common, "_again")).union(commits.select(*common, again))

    # Entries in their turn: the first of a stream that is missing or isn't completed stops all after it.
    entries = log.select(*_ENTRY).distinct().join(closed, _ENTRY, "left")
    placed = Ranges(entries, ["stream_id"], ["seq"]).with_running("_place", "sum", F.lit(1).cast("long")).done()
    stops = placed.groupBy("stream_id").agg(F.coalesce(F.min(F.when(F.col("closed").isNull() | (F.col("seq") != F.col("_place")), F.col("_place"))), F.count("*") + 1).alias("turn"))
    sizes = closed.select("stream_id", (F.col("seq") + 1).alias("expected_seq"), F.col("closed_size").alias("_at"))
    out = every.join(closed, _ENTRY, "left").join(stops, "stream_id")
    after = F.coalesce(F.col("arrival") > F.col("closed"), F.lit(False)) & (F.col("seq") < F.col("turn"))
    early = F.col("seq") > F.col("turn")
    out = out.withColumn("_ignored", ~early & (after | (F.col("_fault").isNull() & F.col("_again"))))
    out = out.withColumn("reason", F.when(early, _reason("BAD_SEQ")).when(~F.col("_ignored"), F.col("_fault")))
    out = out.withColumn("outcome", F.when(F.col("_ignored"), "ignored").when(F.col("reason").isNotNull(), "rejected").otherwise("accepted"))
    expected = F.when(early | (F.col("seq") == F.col("turn")), F.col("turn")).when(F.col("arrival") >= F.col("closed"), F.col("seq") + 1).otherwise(F.col("seq"))
    out = out.withColumn("expected_seq", expected.cast("long")).join(sizes, ["stream_id", "expected_seq"], "left")
    return out.select("stream_id", "arrival", F.col("msg_type").cast("int").alias("msg_type"), "seq", "outcome", F.col("reason").cast("int").alias("reason"), "expected_seq", "file_id", F.coalesce("_at", F.lit(0).cast("long")).alias("offset"))
