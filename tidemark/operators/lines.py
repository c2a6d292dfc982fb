"""Transfer lines: rate limits, silence, state; and audits of a stored message log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import Ranges


def expected_seq(log: DataFrame) -> DataFrame:
    """log (stream_id, arrival, seq, completes) with expected and gate (STALE, NOW or FUTURE): the highest seq completed before, plus one."""
    rows = Ranges(log, ["stream_id"], ["arrival"]).with_running("expected", "max", F.when(F.col("completes"), F.col("seq")), before=True).done()
    rows = rows.withColumn("expected", F.coalesce("expected", F.lit(0)) + 1)
    return rows.withColumn("gate", F.when(F.col("seq") < F.col("expected"), "STALE").when(F.col("seq") > F.col("expected"), "FUTURE").otherwise("NOW"))


def rate_audit(sends: DataFrame, refill: int, cap: int) -> DataFrame:
    """sends (line_id, tick, order, bytes) with tokens left after each send and violation (below 0).

    The bucket starts full, gets ``refill`` a tick up to ``cap``. Its deficit has a closed form: the
    running bytes less refill * tick, plus the running maximum of refill * tick less the bytes before.
    """
    due = F.lit(refill) * F.col("tick")
    rows = Ranges(sends, ["line_id"], ["tick", "order"]).with_running("c", "sum", F.col("bytes"))
    rows = rows.with_running("m", "max", due - (F.col("c") - F.col("bytes"))).done()
    tokens = F.lit(cap) - (F.col("c") - due + F.col("m"))
    return rows.withColumn("tokens", tokens.cast("long")).withColumn("violation", F.col("tokens") < 0).drop("c", "m")


def silence(events: DataFrame, timeout: int = 300) -> DataFrame:
    """events (line_id, tick, order, event: send, done, report) with quiet_ticks and stale.

    Quiet counts from the later of the last report and the send that found the line idle, while sends are open.
    """
    change = F.when(F.col("event") == "send", 1).when(F.col("event") == "done", -1).otherwise(0)
    rows = Ranges(events, ["line_id"], ["tick", "order"]).with_running("open", "sum", change)
    starts = (F.col("event") == "report") | ((F.col("event") == "send") & (F.col("open") == 1))
    rows = rows.with_running("since", "max", F.when(starts, F.col("tick"))).done()
    rows = rows.withColumn("quiet_ticks", F.when(F.col("open") > 0, F.col("tick") - F.col("since")).otherwise(F.lit(0)))
    return rows.withColumn("stale", F.col("quiet_ticks") > timeout).drop("since")


def line_state(events: DataFrame) -> DataFrame:
    """line_id, connected, negotiated, healthy, stale, failures from the last of its events (line_id, order, event).

    A report sets all flags right, even after a disconnect; failures are disconnects since the last report. Aggregates alone, so that a line's events meet in no task.
    """
    state = events.filter(F.col("event").isin("connect", "negotiated", "disconnect", "report", "silent"))
    last = state.groupBy("line_id").agg(
        F.max_by("event", F.when(F.col("event") != "silent", F.col("order"))).alias("last"),
        F.max_by("event", "order").alias("newest"),
        F.max(F.when(F.col("event") == "report", F.col("order"))).alias("r"),
        F.max(F.when(F.col("event").isin("report", "negotiated"), F.col("order"))).alias("n"),
        F.max(F.when(F.col("event") == "disconnect", F.col("order"))).alias("d"),
    )
    broken = state.filter("event = 'disconnect'").join(last.select("line_id", "r"), "line_id").filter("r is null or order > r")
    fails = broken.groupBy("line_id").agg(F.count("*").alias("failures"))
    on = F.col("last") != "disconnect"
    return last.join(fails, "line_id", "left").select(
        "line_id", on.alias("connected"), (on & F.coalesce(F.col("n") > F.coalesce("d", F.lit(-1)), F.lit(False))).alias("negotiated"),
        (on & F.col("last").isin("report", "negotiated")).alias("healthy"), (F.col("newest") == "silent").alias("stale"), F.coalesce("failures", F.lit(0)).cast("long").alias("failures"),
    )


def run_metrics(state: DataFrame, flight: DataFrame) -> DataFrame:
    """One row of totals over all lines."""
    count = lambda c: F.count_if(F.col(c)).alias(c)
    joined = state.join(flight, "line_id", "left")
    return joined.agg(F.count("*").alias("lines"), *[count(c) for c in ("connected", "negotiated", "healthy", "stale")], F.coalesce(F.sum("open_sends"), F.lit(0)).alias("pending_sends"), F.coalesce(F.sum("inflight_bytes"), F.lit(0)).alias("inflight_bytes"))


def append_continuity(segments: DataFrame) -> DataFrame:
    """segments (stream_id, file_id, arrival, offset, len, final_size) with fault: OFFSET where one doesn't start at the end of the last, OVERFLOW where it passes the final size."""
    w = Window.partitionBy("stream_id", "file_id").orderBy("arrival")
    end = F.col("offset") + F.col("len")
    rows = segments.withColumn("_end", F.coalesce(F.lag(end).over(w), F.lit(0)))
    return rows.withColumn("fault", F.when(F.col("offset") != F.col("_end"), "OFFSET").when(end > F.col("final_size"), "OVERFLOW")).drop("_end")
