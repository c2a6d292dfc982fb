"""From entries to send to the messages that carry them, with their cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checksums import crc32c
from tidemark.functions.names import CHUNK_SIZE, CHUNK_THRESHOLD, chunk_count, chunk_span, use_chunks, wire_bytes
from tidemark.schemas import MSG_TYPES


def chunk_rows(entries: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """A row for each chunk of each entry: chunk_index, offset, len. Empty entries have none."""
    n = chunk_count("size", chunk_size)
    rows = entries.withColumn("chunk_count", n).filter("chunk_count > 0").withColumn("chunk_index", F.explode(F.expr("sequence(0L, chunk_count - 1)")))
    offset, length = chunk_span("chunk_index", "size", chunk_size)
    return rows.withColumn("offset", offset).withColumn("len", length)


def segment_rows(entries: DataFrame, segment: int = CHUNK_SIZE) -> DataFrame:
    """A row for each append segment from start_offset to size; none where they are equal."""
    starts = F.when(F.col("start_offset") < F.col("size"), F.sequence("start_offset", F.col("size") - 1, F.lit(segment).cast("long")))
    rows = entries.withColumn("offset", F.explode(starts))
    return rows.withColumn("len", F.least(F.lit(segment).cast("long"), F.col("size") - F.col("offset")))


def message_plan(tasks: DataFrame, chunk_size: int = CHUNK_SIZE, threshold: int = CHUNK_THRESHOLD) -> DataFrame:
    """stream_id, seq, file_id, ordinal, msg_type, chunk_index, offset, len, wire_bytes for tasks (entries with action and start_offset).

    A created file over the threshold is BEGIN, its chunks (the last first), COMMIT; a smaller one is
    CREATE and its segments. A resumed file is segments alone. Directories and links are one CREATE.
    """
    file, fresh = F.col("kind") == 1, F.col("action") == 2
    chunked = file & fresh & use_chunks("size", threshold)
    keep = ["stream_id", "seq", "file_id", "name", "link_target", "size", "start_offset"]

    def part(rows: DataFrame, msg: str, ordinal) -> DataFrame:
        for c in ("chunk_index", "offset", "len"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("long"))
        return rows.select("stream_id", "seq", "file_id", ordinal.cast("long").alias("ordinal"), F.lit(MSG_TYPES[msg]).alias("msg_type"), "chunk_index", "offset", "len", "name", "link_target")

    big = tasks.filter(chunked).select(*keep, chunk_count("size", chunk_size).alias("n"))
    small = tasks.filter(fresh & ~chunked).select(*keep, "kind")
    chunks = chunk_rows(big, chunk_size)
    last = F.col("chunk_index") == F.col("chunk_count") - 1
    segments = segment_rows(tasks.filter(file & ~chunked).select(*keep, "action"), chunk_size)
    every = (
        part(big, "FILE_BEGIN", F.lit(0))
        .union(part(chunks, "CHUNK", F.when(last, 1).otherwise(F.col("chunk_index") + 2)))
        .union(part(big, "FILE_COMMIT", F.col("n") + 1))
        .union(part(small, "CREATE", F.lit(0)))
        .union(part(segments, "DATA", (F.col("offset") - F.col("start_offset")) / chunk_size + 1))
    )
    return every.withColumn("wire_bytes", wire_bytes("msg_type")).drop("name", "link_target")


def chunk_payloads(files: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Checksummed chunk rows of files (stream_id, seq, file_id, payload). Bytes are cut after the rows are made, so no shuffle carries a payload."""
    rows = chunk_rows(files.withColumn("size", F.octet_length("payload").cast("long")), chunk_size)
    cut = rows.withColumn("payload", F.substring("payload", F.col("offset").cast("int") + 1, F.col("len").cast("int")))
    return cut.select(
        "stream_id", "seq", "file_id", "chunk_index", "offset", F.col("len").alias("raw_len"), F.lit(0).alias("compression"), F.lit(1).alias("checksum_algo"), crc32c(F.col("payload")).alias("checksum"), "payload",
    )


def assemble(chunks: DataFrame) -> DataFrame:
    """stream_id, file_id, payload, from chunks in order; for files that fit a row. Larger ones go through the tree sink."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", F.hex("payload").alias("hex"))))
    return chunks.groupBy("stream_id", "file_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["hex"]), "")).alias("payload"))
