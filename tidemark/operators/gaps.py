"""Received chunks: gaps, completeness, duplicates, and what to send next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE = ["stream_id", "seq", "file_id"]


def duplicates(received: DataFrame, by: list[str] = FILE) -> DataFrame:
    """received with duplicate: whether an earlier arrival of the same chunk exists."""
    w = Window.partitionBy(*by, "chunk_index").orderBy("arrival")
    return received.withColumn("duplicate", F.row_number().over(w) > 1)


def missing_ranges(received: DataFrame, by: list[str] = FILE, max_ranges: int = 64) -> DataFrame:
    """by, first, last: gaps below the highest received chunk, the first max_ranges of each file. A lost tail is not reported."""
    w = Window.partitionBy(*by).orderBy("chunk_index")
    seen = received.select(*by, "chunk_index").distinct().withColumn("prev", F.lag("chunk_index", 1, -1).over(w))
    gaps = seen.filter("chunk_index - prev > 1").select(*by, (F.col("prev") + 1).alias("first"), (F.col("chunk_index") - 1).alias("last"))
    return gaps.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("first"))).filter(F.col("_k") <= max_ranges).drop("_k")


def completeness(received: DataFrame, by: list[str] = FILE) -> DataFrame:
    """by, received, expected, complete: distinct chunks within range against chunk_count."""
    ok = received.filter("chunk_index >= 0 and chunk_index < chunk_count")
    return ok.groupBy(*by).agg(F.count_distinct("chunk_index").alias("received"), F.max("chunk_count").cast("long").alias("expected")).withColumn("complete", F.col("received") == F.col("expected"))


def hinted_chunks(hints: DataFrame, files: DataFrame, acked: DataFrame, by: list[str] = FILE) -> DataFrame:
    """by, chunk_index: unacked chunks inside reported gaps (first, last), clamped to the file's chunk_count."""
    h = hints.join(files.select(*by, "chunk_count"), by)
    h = h.withColumn("last", F.least("last", F.col("chunk_count") - 1)).filter("first <= last")
    rows = h.select(*by, F.explode(F.sequence("first", "last")).alias("chunk_index")).distinct()
    return rows.join(acked.select(*by, "chunk_index"), [*by, "chunk_index"], "left_anti")


def chunk_order(chunks: DataFrame, order: DataFrame | None = None, by: list[str] = FILE) -> DataFrame:
    """chunks with rank: the last chunk first, then from 0; or by a supplied order (by, position, chunk_index).

    A supplied order counts only for files of which, without indices out of range, it has every chunk once.
    """
    tail_first = F.when(F.col("chunk_index") == F.col("chunk_count") - 1, 0).otherwise(F.col("chunk_index") + 1)
    if order is None:
        return chunks.withColumn("rank", tail_first.cast("long"))
    n = chunks.select(*by, "chunk_count").distinct()
    valid = order.join(n, by).filter("chunk_index >= 0 and chunk_index < chunk_count")
    full = valid.groupBy(*by).agg(F.count("*").alias("_n"), F.count_distinct("chunk_index").alias("_d"), F.max("chunk_count").alias("_c")).filter("_n = _c and _d = _c").select(*by)
    place = valid.join(full, by, "left_semi").withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("position")) - 1).select(*by, "chunk_index", "_rank")
    return chunks.join(place, [*by, "chunk_index"], "left").withColumn("rank", F.coalesce("_rank", tail_first).cast("long")).drop("_rank")


def resend_worklist(chunks: DataFrame, hinted: DataFrame, acked: DataFrame, sent: DataFrame, now, timeout: int, by: list[str] = FILE) -> DataFrame:
    """by, chunk_index, priority, turn: unacked chunks in the order to send, priority ones first, by index.

    A chunk sent before (sent: by, chunk_index, sent_tick) is sent again only if it has priority and its send is older than the timeout.
    """
    keys = [*by, "chunk_index"]
    open_ = chunk_order(chunks).join(acked.select(*keys).distinct(), keys, "left_anti")
    marked = open_.join(hinted.select(*keys).distinct().withColumn("priority", F.lit(True)), keys, "left").withColumn("priority", F.coalesce("priority", F.lit(False)))
    marked = marked.join(sent.groupBy(*keys).agg(F.max("sent_tick").alias("sent_tick")), keys, "left")
    now = F.lit(now) if isinstance(now, int) else now
    due = marked.filter(F.col("sent_tick").isNull() | (F.col("priority") & (now - F.col("sent_tick") >= timeout)))
    turn = Window.partitionBy(*by).orderBy(F.desc("priority"), F.when(F.col("priority"), F.col("chunk_index")).otherwise(F.col("rank")))
    return due.withColumn("turn", F.row_number().over(turn)).select(*keys, "priority", "turn")


def expired_sends(sends: DataFrame, now: int, timeout: int, most: int = 32) -> DataFrame:
    """The oldest sends of age timeout or more, at most ``most`` in one pass, by tick and key."""
    return sends.filter(F.lit(now) - F.col("sent_tick") >= timeout).orderBy("sent_tick", "stream_id", "seq", "file_id", "offset", "chunk_index").limit(most)
