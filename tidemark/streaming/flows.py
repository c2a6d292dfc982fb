"""Streams of messages, reports and snapshots: duplicates, progress, silence, sessions, new differences."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.diff import manifest_diff
from tidemark.shared import shared_folder


def distinct_chunks(chunks: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A chunk stream without repeats of (stream, seq, file, index) that come within the watermark."""
    return chunks.withWatermark(time, late).dropDuplicatesWithinWatermark(["stream_id", "seq", "file_id", "chunk_index"])


def reports(messages: DataFrame, every: str = "50 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Progress of each stream for each interval, from accepted messages (ts, stream_id, seq, file_id, end_offset)."""
    rows = messages.withWatermark("ts", late).groupBy(F.window("ts", every), "stream_id")
    return rows.agg((F.max("seq") + 1).alias("next_seq"), F.max_by("file_id", "ts").alias("file_id"), F.max_by("end_offset", "ts").alias("offset"), F.count("*").alias("messages"))


class ProgressReports(StatefulProcessor):
    """Reports a stream's progress when so many chunks have come since the last report, or at the next multiple of the interval, whichever is first.

    Time is the messages' own: a message of a later interval proves that the timer is due, and where none comes, the
    watermark does. So the reports don't depend on how the messages fall into batches, as long as those of a stream come in order.
    """

    def __init__(self, batch: int, every_ms: int):
        self.batch, self.every_ms = batch, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", "chunks long, next_seq long, file_id long, offset long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending = self.state.get()  # None where there is none; each call is a round trip to the state store
        before, out = pending[4] if pending else None, []
        for ms, seq, file_id, end, chunks in self._ordered(rows):
            due = (ms // self.every_ms + 1) * self.every_ms
            if pending and pending[4] < due:
                out.append((key[0], *pending, "TIMER"))
                pending = None
            count, highest = (pending[0], pending[1]) if pending else (0, 0)
            pending = (count + chunks, max(highest, seq + 1), file_id, end, due)
            if self.batch and pending[0] >= self.batch:
                out.append((key[0], *pending, "COUNT"))
                pending = None
        self._keep(pending, before)
        yield self._reports(out)

    def _ordered(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, ...]]:
        """A stream's messages by time and number, as plain integers: most streams have few, for which frames cost more than they hold."""
        frames = list(rows)
        columns = [np.concatenate([f[c].to_numpy() for f in frames]) for c in ("ms", "seq", "file_id", "end_offset", "chunks")]
        order = np.lexsort((columns[1], columns[0]))
        return zip(*(c[order].astype(np.int64).tolist() for c in columns), strict=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending = self.state.get()
        if pending is None:
            yield self._reports([])
            return
        self.state.clear()
        yield self._reports([(key[0], *pending, "TIMER")])

    def _keep(self, pending: tuple | None, before: int | None) -> None:
        if before is not None and (pending is None or pending[4] != before):
            self.handle.deleteTimer(before)
        if pending is None:
            if before is not None:
                self.state.clear()
            return
        if pending[4] != before:
            self.handle.registerTimer(pending[4])
        self.state.update(pending)

    def _reports(self, out: list[tuple]) -> pd.DataFrame:
        names = ["stream_id", "chunks", "next_seq", "file_id", "offset", "due_ms", "cause"]
        return pd.DataFrame(dict(zip(names, zip(*out, strict=True), strict=True)) if out else {}, columns=names)

    def close(self) -> None:
        pass


def progress_reports(messages: DataFrame, batch: int = 20, every_ms: int = 50, late: str = "10 seconds") -> DataFrame:
    """stream_id, chunks, next_seq, file_id, offset, due_ms, cause (COUNT or TIMER) from a stream of accepted messages (ts, stream_id, seq, file_id, end_offset, chunks)."""
    rows = messages.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    kind = "stream_id long, chunks long, next_seq long, file_id long, offset long, due_ms long, cause string"
    return rows.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=ProgressReports(batch, every_ms), outputStructType=kind, outputMode="Append", timeMode="EventTime")


@contextlib.contextmanager
def keyed_timers(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which state with timers needs; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(out: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream until it has read all that there is, and gives its rows; a batch that runs again replaces its own. With a folder, a stream goes on where it was, and gives its earlier rows too."""
    spark = out.sparkSession
    own = folder or f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{own}/result/batch={number}")

    with keyed_timers(spark):
        query = out.writeStream.outputMode("append").option("checkpointLocation", f"{own}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).option("basePath", f"{own}/result").parquet(f"{own}/result/*").select(out.columns)


def counted_progress(spark: SparkSession, folder: str, files: str) -> DataFrame:
    """Progress of each line for each third message, or by the day, from a stream over the events files; of the days that ended a day before the last event."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    one = F.lit(1).cast("long")
    messages = events.select("ts", F.col("user_id").cast("long").alias("stream_id"), F.col("event_id").cast("long").alias("seq"), one.alias("file_id"), F.col("event_id").cast("long").alias("end_offset"), one.alias("chunks"))
    reports_ = run_to_end(progress_reports(messages, 3, 86_400_000, "1 day"))
    last = spark.read.parquet(f"{folder}/{files}").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last"))
    ended = reports_.join(F.broadcast(last), F.col("due_ms") <= F.col("last") - 86_400_000)  # one row
    return ended.select("stream_id", "due_ms", "chunks", "next_seq", "cause")


def sessions(activity: DataFrame, key: str, gap: str = "750 milliseconds", time: str = "ts") -> DataFrame:
    """key, start, end, events of each session: activity with no pause of ``gap`` in it. For streams, set a watermark beforehand."""
    rows = activity.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def progress_by_window(spark: SparkSession, folder: str, files: str) -> DataFrame:
    """Runs a stream over the events files in a folder until it has read all; line_id, day, messages, reports, upto of the final result."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    line = (F.col("user_id") % 4 + 1).cast("int").alias("line_id")
    days = events.groupBy(line, F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("messages"), F.count_if(F.col("event_type") == "view").alias("reports"), F.max("event_id").alias("upto"))
    own = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{own}/result")

    out = days.select("line_id", F.unix_seconds("w.start").alias("day"), "messages", "reports", "upto")
    query = out.writeStream.outputMode("complete").option("checkpointLocation", f"{own}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{own}/result")


class SilenceAlarm(StatefulProcessor):
    """Raises one alarm for a line whose sends have been open, without a report, for longer than the timeout, in the events' own time.

    Quiet counts from the later of the last report and the send that found the line idle. An event after the timeout proves it as the watermark does, so
    alarms don't depend on how the events fall into batches.
    """

    def __init__(self, timeout_ms: int = 3000):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("line", "open long, since long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_, since, due = self.state.get() if self.state.exists() else (0, 0, -1)  # due: the timer's time, -1 for none
        before, out = due, []
        for event, ms in pd.concat(list(rows)).sort_values(["ms", "order"])[["event", "ms"]].itertuples(index=False):
            if 0 <= due <= ms:
                if open_ > 0:
                    out.append((key[0], since, open_))
                due = -1
            if event == "report" or (event == "send" and open_ == 0):
                since, due = int(ms), int(ms) + self.timeout_ms + 1
            open_ = max(0, open_ + {"send": 1, "done": -1}.get(event, 0))
        if before >= 0 and before != due:
            self.handle.deleteTimer(before)
        if due >= 0 and before != due:
            self.handle.registerTimer(due)
        self.state.update((open_, since, due))
        yield self._alarms(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_, since, _ = self.state.get()
        self.state.update((open_, since, -1))
        yield self._alarms([(key[0], since, open_)] if open_ > 0 else [])

    def _alarms(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["line_id", "since_ms", "open_sends"])

    def close(self) -> None:
        pass


def silence_alarm(events: DataFrame, timeout_ms: int = 3000, late: str = "1 second") -> DataFrame:
    """Alarms (line_id, since_ms, open_sends) from a stream of (line_id, ts, event: send, done, report, and what proves that time goes on); events of one millisecond come by ``order``, if they have it."""
    order = F.col("order").cast("long") if "order" in events.columns else F.lit(0).cast("long")
    rows = events.select(F.col("line_id").cast("int"), "ts", "event", order.alias("order"), F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    return rows.groupBy("line_id").transformWithStateInPandas(statefulProcessor=SilenceAlarm(timeout_ms), outputStructType="line_id int, since_ms long, open_sends long", outputMode="Append", timeMode="EventTime")


def rediff(snapshots: DataFrame, target: Callable[[], DataFrame], emit: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """For each new manifest that a stream of entries brings, the difference to the target as it then is.

    A micro-batch is the debounce: changes that come while one runs are taken together in the next.
    """

    def compare(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("stream_id").agg(F.max("manifest_id").alias("manifest_id"))
        emit(manifest_diff(batch.join(latest, ["stream_id", "manifest_id"], "left_semi"), target()), number)

    out = snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(compare)
    return (out.trigger(availableNow=True) if once else out).start()
