"""Sends against progress reports and rejections: matching, release, latency, retries, escalation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.batches import numbered
from tidemark.operators.ranges import Keyed, Ranges, fitting
from tidemark.schemas import MSG_TYPES, REASONS

SEND_KEY = ["stream_id", "file_id", "seq", "kind", "offset", "chunk_index"]
CREATE, DATA, BEGIN, CHUNK, COMMIT = (MSG_TYPES[k] for k in ("CREATE", "DATA", "FILE_BEGIN", "CHUNK", "FILE_COMMIT"))


def _first_report(sends: DataFrame, acks: DataFrame, on_line: bool) -> DataFrame:
    """sends with ack_tick: the first report after the send that completes it.

    A report's values are running values; where one falls, a session has started again, and what was open in the one before is
    lost with it. So a key's reports are cut into epochs without falls, and a send belongs to the epoch of the first report after it. In an epoch the
    report looked for is the later of two: the first after the send, and the first high enough. Both are running minima
    over sends and reports together, so no send is paired with more than one report; a stream's are dealt into ranges where one has many, a file's on a line are few.
    Reports of keys without a send that could need them are left out first.
    """
    line = ["line_id"] if on_line else []
    cols = sends.columns
    s = sends.withColumn("_send", F.struct(*line, *SEND_KEY, "sent_tick"))
    reports = acks.select(*line, "stream_id", "file_id", F.col("arrival").alias("tick"), "next_seq", F.greatest("offset", "durable_offset").alias("reach"), "received_chunks")
    listed = reports.select(*line, "stream_id", "tick", F.inline("received_chunks"))
    by_chunk = s.filter(F.col("kind") == CHUNK).join(listed, [*line, "stream_id", "seq", "file_id", "chunk_index"]).filter("tick > sent_tick").select("_send", "tick")

    def reached(who: DataFrame, need: str, value: str, keys: list[str], reports: DataFrame = reports) -> DataFrame:
        """(_send, tick): the first report after the send, in its epoch, with value >= need."""
        none = F.lit(None).cast(s.schema["_send"].dataType).alias("_send")
        needed = reports.select(*keys, F.col("tick").alias("at"), F.col(value).alias("v")).filter("v is not null").join(who.select(*keys), keys, "left_semi")
        scan = Keyed if "file_id" in keys else fitting([needed, who], keys)
        said = scan(needed, keys, ["at", "v"])
        said.with_running("_last", "last", F.col("v"), before=True)
        said = said.with_running("_epoch", "sum", F.coalesce(F.col("_last") > F.col("v"), F.lit(False)).cast("long")).done()
        says = said.select(*keys, "at", "_epoch", "v", F.lit(0).alias("asks"), none)
        asks = who.select(*keys, F.col("sent_tick").alias("at"), F.lit(None).cast("long").alias("_epoch"), F.col(need).alias("v"), F.lit(1).alias("asks"), "_send")
        later = scan(says.union(asks), keys, ["-at", "-asks"]).with_running("_after", "min", F.when(F.col("asks") == 0, F.col("at"))).with_running("_own", "min", F.col("_epoch")).done()
        asks = later.filter("asks = 1 and _own is not null").select(*keys, "_own", "v", F.lit(None).cast("long").alias("at"), "asks", "_send", "_after")
        says = said.select(*keys, F.col("_epoch").alias("_own"), "v", "at", F.lit(0).alias("asks"), none, F.lit(None).cast("long").alias("_after"))
        high = scan(says.union(asks), [*keys, "_own"], ["-v", "asks"]).with_running("_high", "min", F.col("at")).done()
        return high.filter("asks = 1 and _high is not null").select("_send", F.greatest("_high", "_after").alias("tick"))

    file = [*line, "stream_id", "file_id"]
    after = s.withColumn("need", F.col("seq") + 1)
    if on_line:
        ordered = reached(after.filter(F.col("kind").isin(CREATE, DATA, BEGIN, COMMIT)), "need", "next_seq", file)
    else:
        ordered = reached(after, "need", "next_seq", ["stream_id"], reports.filter("next_seq <> 0"))
    data = reached(s.filter((F.col("kind") == DATA) & (F.col("end_offset") != 0)), "end_offset", "reach", file)
    done = ordered.union(data).union(by_chunk)
    done = done.groupBy("_send").agg(F.min("tick").alias("ack_tick"))
    return s.join(done, "_send", "left").select(*cols, "ack_tick")


def match_acks(sends: DataFrame, acks: DataFrame) -> DataFrame:
    """sends with ack_tick, by the reports on the send's own line.

    A chunk is done when a report lists it; CREATE, BEGIN and COMMIT when next_seq of their file
    passes them; DATA also when an offset reaches its end.
    """
    return _first_report(sends, acks, on_line=True)


def release_sends(sends: DataFrame, acks: DataFrame) -> DataFrame:
    """sends with ack_tick whatever the line: next_seq of the stream releases every kind (0 releases none), offsets release DATA of their file, lists release chunks. Gives latency samples."""
    return _first_report(sends, acks, on_line=False)


def latency_samples(released: DataFrame) -> DataFrame:
    """released sends of which latency (from the last send of a key) is positive."""
    last = Window.partitionBy(*SEND_KEY).orderBy(F.desc("sent_tick"))
    rows = released.filter("ack_tick is not null").withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    return rows.withColumn("rtt", F.col("ack_tick") - F.col("sent_tick")).filter("rtt > 0")


def resolve_rejects(rejects: DataFrame, sends: DataFrame, chunk_size: int) -> DataFrame:
    """rejects (with reject_id) with the sent packet's key each refers to, null where none is known.

    Candidate keys are tried in an order that depends on the reason; each is one row, and the best
    one that was sent wins.
    """
    index = (F.col("offset") / chunk_size).cast("long") if chunk_size else F.lit(0).cast("long")
    zero = F.lit(0).cast("long")

    def key(kind: int, seq: str):
        return F.struct(F.lit(kind).alias("kind"), F.col(seq).alias("seq"), (F.col("offset") if kind == DATA else zero).alias("offset"), (index if kind == CHUNK else zero).alias("chunk_index"))

    ordered = lambda s: [key(CREATE, s), key(DATA, s)]
    first = {
        ("BAD_SEQ",): [*ordered("expected_seq"), key(BEGIN, "expected_seq"), key(COMMIT, "expected_seq"), key(CHUNK, "expected_seq")],
        ("BAD_CHECKSUM", "BAD_OFFSET"): [key(CHUNK, "got_seq"), *ordered("got_seq")],
        ("BAD_CHUNK",): [key(BEGIN, "got_seq"), key(CHUNK, "got_seq")],
        ("BAD_COMMIT",): [key(COMMIT, "got_seq")],
    }
    rest = [*ordered("got_seq"), key(BEGIN, "got_seq"), key(COMMIT, "got_seq"), key(CHUNK, "got_seq")]
    tries = F.array(*rest)
    for reasons, keys in first.items():
        tries = F.when(F.col("reason").isin([REASONS[r] for r in reasons]), F.array(*keys, *rest)).otherwise(tries)
    # A first try needs a sequence number; so does the last one.
    rows = rejects.filter("file_id <> 0").select("reject_id", "stream_id", "file_id", F.posexplode(tries).alias("priority", "k")).select("reject_id", "stream_id", "file_id", "priority", "k.*").filter("seq <> 0")
    known = sends.select(*SEND_KEY).distinct()
    found = rows.join(known, SEND_KEY, "left_semi").groupBy("reject_id").agg(F.min_by(F.struct("kind", "seq", "offset", "chunk_index"), "priority").alias("sent"))
    return rejects.join(found, "reject_id", "left")


def retransmit_queue(causes: list[DataFrame], open_sends: DataFrame) -> DataFrame:
    """Keys to send again: each once however many causes name it, and only while its send is open."""
    every = causes[0].select(*SEND_KEY)
    for c in causes[1:]:
        every = every.union(c.select(*SEND_KEY))
    return every.dropDuplicates().join(open_sends.select(*SEND_KEY), SEND_KEY, "left_semi")


def unacked(sends: DataFrame, acked: DataFrame) -> DataFrame:
    return sends.join(acked.select(*SEND_KEY), SEND_KEY, "left_anti")


def lost_sends(matched: DataFrame, disconnects: DataFrame) -> DataFrame:
    """Sends still open on a line when it disconnects: matched (with ack_tick) with lost_tick, the first disconnect after the send.

    An as-of join by one running minimum over sends and disconnects of a line, not by pairs.
    """
    cols = matched.columns
    s = matched.withColumn("_gone", F.lit(None).cast("long")).withColumn("_at", F.col("sent_tick"))
    d = disconnects.select("line_id", F.col("tick").alias("_gone"), F.col("tick").alias("_at"))
    every = s.unionByName(d, allowMissingColumns=True)
    # From the latest on; of equal ticks the sends come first, so that none sees a disconnect of its own tick.
    every = every.withColumns({"_last": F.col("_gone").isNotNull(), "_tie": F.xxhash64(*cols)})
    out = Ranges(every, ["line_id"], ["-_at", "_last", "_tie"]).with_running("lost_tick", "min", F.col("_gone")).done().filter(F.col("_gone").isNull())
    return out.filter("lost_tick is not null and (ack_tick is null or ack_tick > lost_tick)").select(*cols, "lost_tick")


def ack_batches(acks: DataFrame, batch: int = 20, coupled: bool = False, interval: int | None = None) -> DataFrame:
    """Merged reports: line_id, stream_id, batch, arrival, next_seq, file_id, offset, durable_offset, received.

    Scalars are those of the latest report, received chunks add up. A stream's batch ends with the report that brings
    its chunks to ``batch`` (0: never), with a report whose ``flush`` is true, if acks have that column (those that follow CREATE, BEGIN and
    COMMIT), and with the last one before a multiple of ``interval`` in arrival; then all counts start anew. With ``coupled``, for lines that carry several streams, a
    flush ends the batches of all the line's streams. Within a line, reports of equal arrival come by stream. acks may hold n_received or received_chunks.
    """
    n = F.col("n_received") if "n_received" in acks.columns else F.size("received_chunks")
    flush = F.coalesce("flush", F.lit(False)) if "flush" in acks.columns else F.lit(False)
    rows = acks.select("line_id", "stream_id", "arrival", "next_seq", "file_id", "offset", "durable_offset", n.cast("long").alias("n"), flush.alias("_flush"))
    rows = numbered(rows, ["line_id"] if coupled else ["line_id", "stream_id"], ["arrival", "stream_id"], batch, interval)
    latest = [F.max_by(c, "arrival").alias(c) for c in ("next_seq", "file_id", "offset", "durable_offset")]
    return rows.groupBy("line_id", "stream_id", "batch").agg(F.max("arrival").alias("arrival"), *latest, F.sum("n").alias("received"))


def coupled_ack_batches(acks: DataFrame, batch: int = 20, interval: int | None = None) -> DataFrame:
    """ack_batches for lines with several streams."""
    return ack_batches(acks, batch, coupled=True, interval=interval)


def stream_progress(accepted: DataFrame) -> DataFrame:
    """stream_id, next_seq, file_id, offset: where each stream stands after its accepted messages (arrival, seq, file_id, end_offset)."""
    return accepted.groupBy("stream_id").agg((F.max("seq") + 1).alias("next_seq"), F.max_by("file_id", "arrival").alias("file_id"), F.max_by("end_offset", "arrival").alias("offset"))


def inflight(matched: DataFrame, at: int) -> DataFrame:
    """line_id, open_sends, inflight_bytes, completed_bytes at a tick."""
    sent = matched.filter(F.col("sent_tick") <= at)
    open_ = F.col("ack_tick").isNull() | (F.col("ack_tick") > at)
    return sent.groupBy("line_id").agg(F.count_if(open_).alias("open_sends"), F.coalesce(F.sum(F.when(open_, F.col("bytes"))), F.lit(0)).alias("inflight_bytes"), F.coalesce(F.sum(F.when(~open_, F.col("bytes"))), F.lit(0)).alias("completed_bytes"))


def attempts(sends: DataFrame, max_retries: int) -> DataFrame:
    """sends with attempt, retransmit, exhausted; retries count for a key in order of ticks."""
    w = Window.partitionBy(*SEND_KEY).orderBy("sent_tick")
    return sends.withColumn("attempt", F.row_number().over(w)).withColumn("retransmit", F.col("attempt") > 1).withColumn("exhausted", F.col("attempt") >= max_retries + 1)


def escalation(events: DataFrame, by: str, limit: int = 3) -> DataFrame:
    """events (by, order, recovery, progress) with attempt and final: recoveries since the last progress; one past the limit is final."""
    rows = Ranges(events, [by], ["order"]).with_running("_all", "sum", F.col("recovery").cast("int"))
    rows = rows.with_running("_then", "max", F.when(F.col("progress"), F.col("_all") - F.col("recovery").cast("int"))).done()
    rows = rows.withColumn("attempt", F.col("_all") - F.coalesce("_then", F.lit(0))).drop("_all", "_then")
    return rows.withColumn("final", F.col("recovery") & (F.col("attempt") > limit))


def smoothed_timeout(samples: DataFrame, by: list[str], fallback: int = 100) -> DataFrame:
    """by, srtt, rttvar, timeout from samples (by, order, x): a fold in order of ``order``, in whole numbers.

    A step depends on the rounded result of the one before, so a key's samples pass one task; they pass it sorted, in
    Arrow batches, and only the running state is held, however many there are.
    """

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s, v = None, 0, 0
        for batch in batches:
            done = []
            for *own, x in zip(*(batch.column(c).to_pylist() for c in (*by, "x")), strict=True):
                if own != key:
                    if key is not None:
                        done.append((*key, s, v))
                    key, s, v = own, 0, 0
                if s == 0:
                    s, v = x, max(1, x // 2)
                else:
                    s, v = max(1, (7 * s + x) // 8), max(1, (3 * v + abs(s - x)) // 4)
            yield folded(done)
        yield folded([] if key is None else [(*key, s, v)])

    rows = samples.select(*by, "order", F.col("x").cast("long").alias("x"))
    sorted_ = rows.repartition(*by).sortWithinPartitions(*by, "order").select(*by, "x")
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([*((c, kinds[t]) for c, t in sorted_.dtypes if c in by), ("srtt", pa.int64()), ("rttvar", pa.int64())])
    folded = lambda done: pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema)
    out = sorted_.mapInArrow(fold, ", ".join(f"`{c}` {t}" for c, t in sorted_.dtypes if c in by) + ", srtt long, rttvar long")
    timeout = F.least(F.greatest(F.col("srtt") + F.greatest(F.lit(1), 4 * F.col("rttvar")), F.lit(fallback // 2)), F.lit(fallback * 8))
    return out.withColumn("timeout", timeout.cast("long"))


def all_complete(streams: DataFrame) -> DataFrame:
    return streams.agg(F.bool_and("complete").alias("complete"))
