"""The replication operators' queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import views as V
from tidemark.functions import checksums as C
from tidemark.functions import names as N
from tidemark.operators import acks as A
from tidemark.operators import audit as AU
from tidemark.operators import diff as D
from tidemark.operators import gaps as G
from tidemark.operators import lines as L
from tidemark.operators import manifest as M
from tidemark.operators.ranges import Ranges
from tidemark.plans import transfer as T
from tidemark.schemas import is_recoverable, with_names
from tidemark.shared import settle
from tidemark.streaming import apply as AP
from tidemark.streaming import flows as FL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SIZE, OVER = 1024, 2048  # chunk size and threshold for documents, few of which exceed the defaults


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SRC = f"with {V.SRC_SQL}"
_BOTH = f"with {V.SRC_SQL}, {V.DST_SQL}"
_PAIRS = """,
pairs as (select s.stream_id, s.seq, s.file_id, s.name, d.size as at, case when d.seq is null then 'CREATE' when d.file_id <> s.file_id or d.name <> s.name then 'IDENTITY' when d.size > s.size then 'LARGER' when d.size < s.size then 'RESUME' when d.sum <> s.sum then 'CHECKSUM' end as o
  from src s left join dst d using (stream_id, seq)),
firsts as (select stream_id, min(seq) filter (where o is not null) as seq from pairs group by stream_id),
diff as (select f.stream_id, case when p.o is null then 'IN_SYNC' when p.o in ('CREATE', 'RESUME') then p.o else 'CONFLICT' end as outcome, case when p.o in ('CREATE', 'RESUME') then p.file_id else 0 end as start_file_id, case when p.o = 'RESUME' then p.at else 0 end as start_offset,
  case when p.o not in ('CREATE', 'RESUME') then p.o || ' ' || p.name end as conflict from firsts f left join pairs p on p.stream_id = f.stream_id and p.seq = f.seq)
"""


@_query(f"{_SRC} select stream_id, name, file_id from src")
def manifest_ids(spark, sf_dir):
    """Stable ids of a manifest's entries."""
    return V.src_entries(spark, sf_dir).select("stream_id", "name", "file_id")


@_query(f"{_SRC} select stream_id, file_id, seq from src")
def manifest_sequence(spark, sf_dir):
    """Entries numbered in scan order, by a range sort, so that a stream may have any number of them."""
    return M.sequenced_wide(V.unsequenced(spark, sf_dir)).select("stream_id", "file_id", "seq")


@_query(f"{_SRC} select stream_id, 1 as kind, count(*) as entries, sum(size)::bigint as bytes from src group by stream_id union all select stream_id, null, count(*), sum(size)::bigint from src group by stream_id union all select null, null, count(*), sum(size)::bigint from src")
def manifest_totals(spark, sf_dir):
    return M.totals(V.src_entries(spark, sf_dir))


def _diff(spark, sf_dir):
    src = V.src_entries(spark, sf_dir)
    return src, D.manifest_diff(src, V.dst_entries(src))


@_query(f"{_BOTH}{_PAIRS} select * from diff")
def manifest_diff(spark, sf_dir):
    return _diff(spark, sf_dir)[1]


@_query(f"{_BOTH}{_PAIRS} select stream_id, null::int as action, start_file_id, start_offset, 9 as reason from diff where exists (select 1 from diff where outcome = 'CONFLICT') union all select stream_id, case outcome when 'RESUME' then 1 when 'CREATE' then 2 else 0 end, start_file_id, start_offset, null from diff where not exists (select 1 from diff where outcome = 'CONFLICT')")
def manifest_reply(spark, sf_dir):
    """The reply to the whole manifest: one conflict rejects it."""
    return D.diff_reply(_diff(spark, sf_dir)[1])


@_query(f"{_BOTH}{_PAIRS}, r as (select stream_id, case outcome when 'RESUME' then 1 when 'CREATE' then 2 when 'IN_SYNC' then 0 end as action, case when outcome = 'CONFLICT' then 9 end as reason from diff) select *, case action when 0 then 'IN_SYNC' when 1 then 'RESUME_EXISTING' when 2 then 'CREATE_MISSING' end as action_name, case reason when 9 then 'SIZE_CONFLICT' end as reason_name, coalesce(reason in (2, 3, 4, 9, 10, 14, 15), false) as recoverable from r")
def stream_replies(spark, sf_dir):
    """The reply stream by stream, with the codes' names."""
    reply = with_names(D.diff_reply(_diff(spark, sf_dir)[1], all_or_nothing=False), "action", "reason")
    return reply.select("stream_id", "action", "reason", "action_name", "reason_name", F.coalesce(is_recoverable(F.col("reason")), F.lit(False)).alias("recoverable"))


def _plan(spark, sf_dir):
    src, diff = _diff(spark, sf_dir)
    starts = D.diff_reply(diff.filter("outcome <> 'CONFLICT'"), all_or_nothing=False)
    held = src.join(F.broadcast(starts.select("stream_id")), "stream_id", "left_semi")
    return T.message_plan(settle(D.apply_reply(held, starts)), SIZE, OVER)  # the plan reads its tasks five times


_PLAN = f"""{_BOTH}{_PAIRS},
tasks as (select s.stream_id, s.seq, s.file_id, s.name, s.size, case when s.seq = p.seq and p.o = 'RESUME' then p.at else 0 end as start_offset, s.seq = p.seq and p.o = 'RESUME' as resumed
  from src s join firsts f using (stream_id) join pairs p on p.stream_id = f.stream_id and p.seq = f.seq and p.o in ('CREATE', 'RESUME') where s.seq >= f.seq),
big as (select *, (size + {SIZE - 1}) // {SIZE} as n from tasks where not resumed and size > {OVER}),
ch as (select *, unnest(range(0, n)) as i from big),
sg as (select *, unnest(range(start_offset, size, {SIZE})) as off from tasks where resumed or size <= {OVER}),
plan as (
  select stream_id, seq, file_id, 0 as ordinal, 7 as msg_type, null::bigint as chunk_index, null::bigint as "offset", null::bigint as len, 126 + strlen(name) as wire_bytes from big
  union all select stream_id, seq, file_id, case when i = n - 1 then 1 else i + 2 end, 8, i, i * {SIZE}, least({SIZE}, size - i * {SIZE}), 74 + least({SIZE}, size - i * {SIZE}) from ch
  union all select stream_id, seq, file_id, n + 1, 9, null, null, null, 36 from big
  union all select stream_id, seq, file_id, 0, 3, null, null, null, 90 + strlen(name) from tasks where not resumed and size <= {OVER}
  union all select stream_id, seq, file_id, (off - start_offset) // {SIZE} + 1, 4, null, off, least({SIZE}, size - off), 74 + least({SIZE}, size - off) from sg)
"""


@_query(f"{_PLAN} select * from plan")
def transfer_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@_query(f"{_PLAN} select stream_id, msg_type, count(*) as messages, sum(coalesce(len, 0))::bigint as payload_bytes, sum(wire_bytes)::bigint as wire_bytes from plan group by all")
def transfer_cost(spark, sf_dir):
    """What must be transferred between two manifests, for each stream and kind of message, and at what cost."""
    return _plan(spark, sf_dir).groupBy("stream_id", "msg_type").agg(F.count("*").alias("messages"), F.sum(F.coalesce("len", F.lit(0))).alias("payload_bytes"), F.sum("wire_bytes").alias("wire_bytes"))


@_query("""with d as (select doc_id % 10 as m, source || '/' || doc_id as path, strlen(coalesce(text, ''))::bigint as size from documents),
o as (select path, size as old_size, 1 as om from d where m <> 0), n as (select path, case m when 2 then size + 7 when 3 then size // 2 else size end as new_size, case m when 4 then 2 else 1 end as nm from d where m <> 1),
j as (select case when old_size is null then 'CREATED' when new_size is null then 'REMOVED' when new_size > old_size then 'APPENDED' when new_size <> old_size or om <> nm then 'MODIFIED' end as change, path, old_size, new_size from o full join n using (path))
select * from j where change is not null""")
def snapshot_changes(spark, sf_dir):
    return D.snapshot_changes(*V.snapshots(spark, sf_dir))


_FILE = ["file_id"]


@_query("""with s as (select distinct l_orderkey as file_id, l_linenumber - 1 as i from lineitem where l_returnflag <> 'R'), g as (select file_id, i, lag(i, 1, -1) over (partition by file_id order by i) as p from s)
select file_id, (p + 1)::bigint as "first", (i - 1)::bigint as "last" from g where i - p > 1""")
def chunk_gaps(spark, sf_dir):
    return G.missing_ranges(V.received(spark, sf_dir).filter("not lost"), _FILE)


@_query("select l_orderkey as file_id, count(distinct l_linenumber) as received, 7::bigint as expected, count(distinct l_linenumber) = 7 as complete from lineitem where l_returnflag <> 'R' and l_linenumber between 1 and 7 group by 1")
def chunk_completeness(spark, sf_dir):
    return G.completeness(V.received(spark, sf_dir).filter("not lost"), _FILE)


@_query("""with r as (select l_orderkey as file_id, (l_linenumber - 1)::bigint as chunk_index, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) > 1 as duplicate from lineitem)
select file_id, chunk_index, duplicate, count(*) as copies from r group by all""")
def chunk_duplicates(spark, sf_dir):
    return G.duplicates(V.received(spark, sf_dir), _FILE).groupBy("file_id", "chunk_index", "duplicate").agg(F.count("*").alias("copies"))


_NOW, _WAIT = 10400, 200


@_query(f"""with li as (select l_orderkey as file_id, (l_linenumber - 1)::bigint as i, l_returnflag = 'R' as lost, (l_shipdate::date - date '1970-01-01')::bigint as tick from lineitem),
a as (select distinct file_id, i from li where not lost), g as (select file_id, i, lag(i, 1, -1::bigint) over (partition by file_id order by i) as p from a),
h as (select file_id, unnest(range(p + 1, i)) as i from g where i - p > 1),
c as (select file_id, unnest(range(0::bigint, 7::bigint)) as i from (select distinct file_id from li)),
s as (select file_id, i, max(tick) as tick from li where lost group by all),
o as (select c.file_id, c.i, h.i is not null as priority from c left join h using (file_id, i) left join s using (file_id, i) where not exists (select 1 from a where a.file_id = c.file_id and a.i = c.i) and (s.tick is null or (h.i is not null and {_NOW} - s.tick >= {_WAIT})))
select file_id, i as chunk_index, priority, row_number() over (partition by file_id order by priority desc, case when priority then i when i = 6 then 0 else i + 1 end) as turn from o""")
def resend_worklist(spark, sf_dir):
    """Chunks to send next: reported gaps first, then the last chunk, then the others in order."""
    li = V.received(spark, sf_dir)
    acked = li.filter("not lost").select("file_id", "chunk_index")
    files = li.select("file_id", "chunk_count").distinct()
    gaps = G.missing_ranges(li.filter("not lost"), _FILE)
    chunks = files.withColumn("chunk_index", F.explode(F.expr("sequence(0L, chunk_count - 1)")))
    sent = li.filter("lost").select("file_id", "chunk_index", V.day("arrival.l_shipdate").alias("sent_tick"))
    return G.resend_worklist(chunks, G.hinted_chunks(gaps, files, acked, _FILE), acked, sent, _NOW, _WAIT, _FILE)


def _sends(spark, sf_dir):
    """A send for each key, the last one, and a report for each shipping day of a line, stream and file."""
    rows = V.sends(spark, sf_dir)
    keys = ["line_id", *A.SEND_KEY]
    sends = rows.groupBy(*keys).agg(F.max("sent_tick").alias("sent_tick"), F.max("bytes").alias("bytes"), F.max("end_offset").alias("end_offset"))
    listed = F.collect_set(F.struct("seq", "file_id", "chunk_index")).alias("received_chunks")
    zero = F.lit(0).cast("long")
    acks = rows.groupBy("line_id", "stream_id", "file_id", F.col("report_tick").alias("arrival")).agg(listed).withColumns({"next_seq": zero, "offset": zero, "durable_offset": zero})
    return sends, acks


_MATCHED = f"""with {V.SENDS_SQL}, s as (select line_id, stream_id, file_id, chunk_index, max(sent_tick) as sent_tick, max(bytes) as bytes from sends group by all),
m as (select s.*, (select min(report_tick) from sends r where r.line_id = s.line_id and r.file_id = s.file_id and r.stream_id = s.stream_id and r.chunk_index = s.chunk_index and r.report_tick > s.sent_tick) as ack_tick from s)
"""


@_query(f"{_MATCHED} select line_id, stream_id, file_id, chunk_index::bigint as chunk_index, sent_tick, ack_tick from m")
def ack_latency(spark, sf_dir):
    """Each send with the first report that lists its chunk."""
    return A.match_acks(*_sends(spark, sf_dir)).select("line_id", "stream_id", "file_id", "chunk_index", "sent_tick", "ack_tick")


@_query(f"{_MATCHED} select line_id, count(*) filter (where ack_tick is null or ack_tick > 9500) as open_sends, coalesce(sum(bytes) filter (where ack_tick is null or ack_tick > 9500), 0)::bigint as inflight_bytes, coalesce(sum(bytes) filter (where ack_tick <= 9500), 0)::bigint as completed_bytes from m where sent_tick <= 9500 group by line_id")
def inflight_by_line(spark, sf_dir):
    return A.inflight(A.match_acks(*_sends(spark, sf_dir)), 9500)


@_query("""with r as (select (l_suppkey % 4 + 1)::int as line_id, l_orderkey as stream_id, row_number() over (partition by l_suppkey % 4, l_orderkey order by l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as arrival, l_linenumber as next_seq, l_quantity::bigint as off from lineitem),
b as (select *, (arrival - 1) // 3 as batch from r)
select line_id, stream_id, batch, max(arrival) as arrival, arg_max(next_seq, arrival)::bigint as next_seq, 1::bigint as file_id, arg_max(off, arrival) as "offset", arg_max(off, arrival) as durable_offset, count(*) as received from b group by all""")
def ack_batches(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = (F.col("l_suppkey") % 4 + 1).cast("int")
    order = Window.partitionBy(line, "l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    one, size = F.lit(1).cast("long"), F.col("l_quantity").cast("long")
    acks = li.select(line.alias("line_id"), F.col("l_orderkey").alias("stream_id"), F.row_number().over(order).cast("long").alias("arrival"), F.col("l_linenumber").cast("long").alias("next_seq"), one.alias("file_id"), size.alias("offset"), size.alias("durable_offset"), one.alias("n_received"))
    return A.ack_batches(acks, 3)


@_query(f"""{_MATCHED}, samples as (select line_id, stream_id, list((ack_tick - sent_tick)::bigint order by sent_tick, file_id, chunk_index) as xs from m where ack_tick is not null group by all),
f as (select line_id, stream_id, list_reduce(list_transform(xs, lambda t: {{'s': t, 'v': greatest(1, t // 2)}}), lambda a, b: {{'s': greatest(1, (7 * a.s + b.s) // 8), 'v': greatest(1, (3 * a.v + abs(a.s - b.s)) // 4)}}) as r from samples)
select line_id, stream_id, r.s::bigint as srtt, r.v::bigint as rttvar, least(greatest(r.s + greatest(1, 4 * r.v), 50), 800)::bigint as timeout from f""")
def rtt_timeout(spark, sf_dir):
    """Smoothed latency and timeout for each stream of a line."""
    m = A.match_acks(*_sends(spark, sf_dir)).filter("ack_tick is not null")
    samples = m.select("line_id", "stream_id", F.struct("sent_tick", "file_id", "chunk_index").alias("order"), (F.col("ack_tick") - F.col("sent_tick")).alias("x"))
    return A.smoothed_timeout(samples, ["line_id", "stream_id"])


@_query("""with s as (select (l_suppkey % 100)::int as line_id, (l_shipdate::date - date '1970-01-01')::bigint as tick, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as o, l_quantity::bigint as bytes from lineitem),
c as (select *, sum(bytes) over w as c from s window w as (partition by line_id order by tick, o)), m as (select *, max(6 * tick - (c - bytes)) over (partition by line_id order by tick, o) as m from c),
t as (select line_id, tick, bytes, (200 - (c - 6 * tick + m))::bigint as tokens from m)
select line_id, count(*) as sends, count(*) filter (where tokens < 0) as violations, min(tokens) as least, sum(tokens)::bigint as total from t group by line_id""")
def rate_limit_audit(spark, sf_dir):
    """Sends of a hundred lines against a bucket of 200 that gets 6 a day."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    sends = li.select((F.col("l_suppkey") % 100).cast("int").alias("line_id"), V.day("l_shipdate").alias("tick"), order.alias("order"), F.col("l_quantity").cast("long").alias("bytes"))
    return L.rate_audit(sends, 6, 200).groupBy("line_id").agg(F.count("*").alias("sends"), F.count_if("violation").alias("violations"), F.min("tokens").alias("least"), F.sum("tokens").alias("total"))


_EV = f"with {V.EVENTS_SQL}"


@_query(f"""{_EV}, e as (select * from ev where event <> 'send'), l as (select line_id, arg_max(event, "order") as last, max("order") filter (where event in ('report', 'negotiated')) as n, max("order") filter (where event = 'disconnect') as d, max("order") filter (where event = 'report') as r from e group by 1)
select line_id, last <> 'disconnect' as connected, last <> 'disconnect' and coalesce(n > coalesce(d, -1), false) as negotiated, last in ('report', 'negotiated') as healthy, false as stale, (select count(*) from e where e.line_id = l.line_id and event = 'disconnect' and "order" > coalesce(r, -1)) as failures from l""")
def line_state(spark, sf_dir):
    return L.line_state(V.line_events(spark, sf_dir))


@_query(f"""{_EV}, k as (select line_id, tick, "order", case event when 'send' then 'send' when 'report' then 'report' when 'click' then 'done' else 'other' end as event from ev),
o as (select *, sum(case when event = 'send' then 1 else 0 end) over w as open from k window w as (partition by line_id order by tick, "order")),
s as (select *, max(case when event = 'report' or (event = 'send' and open = 1) then tick end) over (partition by line_id order by tick, "order") as since from o),
q as (select *, case when open > 0 then tick - since else 0 end as quiet from s)
select line_id, count(*) as events, count(*) filter (where quiet > 300) as stale, max(quiet)::bigint as longest from q group by 1""")
def line_silence(spark, sf_dir):
    ev = V.line_events(spark, sf_dir)
    known = ev.withColumn("event", F.when(F.col("event").isin("send", "report"), F.col("event")).otherwise("other"))
    return L.silence(known, 300).groupBy("line_id").agg(F.count("*").alias("events"), F.count_if(F.coalesce("stale", F.lit(False))).alias("stale"), F.max("quiet_ticks").alias("longest"))


@_query(f"""with lines as ({SQL['line_state']}), flight as ({SQL['inflight_by_line']})
select count(*) as lines, count(*) filter (where connected) as connected, count(*) filter (where negotiated) as negotiated, count(*) filter (where healthy) as healthy, count(*) filter (where stale) as stale, coalesce(sum(open_sends), 0)::bigint as pending_sends, coalesce(sum(inflight_bytes), 0)::bigint as inflight_bytes from lines left join flight using (line_id)""")
def run_metrics(spark, sf_dir):
    return L.run_metrics(line_state(spark, sf_dir), inflight_by_line(spark, sf_dir))


@_query(f"""{_EV}, s as (select *, lead("order") over w as nxt from ev where event in ('send', 'report') window w as (partition by line_id order by "order")),
a as (select line_id, "order" as sent_tick, (select min("order") from ev r where r.line_id = s.line_id and r.event = 'report' and r."order" > s."order") as ack_tick, (select min("order") from ev r where r.line_id = s.line_id and r.event = 'disconnect' and r."order" > s."order") as lost_tick from ev s where event = 'send')
select line_id, sent_tick, lost_tick from a where lost_tick is not null and (ack_tick is null or ack_tick > lost_tick)""".replace("""s as (select *, lead("order") over w as nxt from ev where event in ('send', 'report') window w as (partition by line_id order by "order")),\n""", ""))
def lost_sends(spark, sf_dir):
    """Sends still open when their line disconnects; a line's next report acknowledges all."""
    ev = V.line_events(spark, sf_dir)
    reports = Ranges(ev, ["line_id"], ["order"]).with_running("ack_tick", "min", F.when(F.col("event") == "report", F.col("order")), before=True, back=True).done()
    sends = reports.filter("event = 'send'").select("line_id", F.col("order").alias("sent_tick"), "ack_tick")
    return A.lost_sends(sends, ev.filter("event = 'disconnect'").select("line_id", F.col("order").alias("tick"))).select("line_id", "sent_tick", "lost_tick")


def _rejects(spark, sf_dir):
    """Every tenth line item rejects a packet; the sends are the others, their kind by part."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit(1).cast("long").alias("stream_id"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"))
    kind = F.element_at(F.array(*[F.lit(k) for k in (3, 4, 7, 8, 9)]), (F.col("p") % 5 + 1).cast("int"))
    zero = F.lit(0).cast("long")
    sends = li.filter("p % 10 <> 0").select("stream_id", "file_id", F.col("n").alias("seq"), kind.alias("kind"), F.when(kind == 4, F.col("n") * 10).otherwise(zero).alias("offset"), F.when(kind == 8, F.col("n") % 3).otherwise(zero).alias("chunk_index"))
    reason = F.element_at(F.array(*[F.lit(k) for k in (2, 3, 4, 14, 15, 6)]), (F.col("p") % 60 / 10).cast("int") + 1)
    rejects = li.filter("p % 10 = 0").select("stream_id", "file_id", "n", "p").distinct()
    rejects = rejects.select(F.concat_ws("/", "file_id", "n", "p").alias("reject_id"), "stream_id", "file_id", F.col("n").alias("got_seq"), F.when(F.col("n") > 1, F.col("n") - 1).otherwise(zero).alias("expected_seq"), (F.col("n") * 10).alias("offset"), reason.alias("reason"))
    return rejects, sends


@_query("""with li as (select l_orderkey as file_id, l_linenumber::bigint as n, l_partkey as p from lineitem),
s as (select distinct file_id, n as seq, [3, 4, 7, 8, 9][p % 5 + 1] as kind, case when p % 5 = 1 then n * 10 else 0 end as off, case when p % 5 = 3 then n % 3 else 0 end as i from li where p % 10 <> 0),
r as (select distinct file_id || '/' || n || '/' || p as reject_id, file_id, n as got, case when n > 1 then n - 1 else 0 end as exp, n * 10 as off, [2, 3, 4, 14, 15, 6][(p % 60) // 10 + 1] as reason from li where p % 10 = 0),
t as (select *, unnest(case reason when 2 then [(1, 3, exp), (2, 4, exp), (3, 7, exp), (4, 9, exp), (5, 8, exp)] when 3 then [(1, 8, got), (2, 3, got), (3, 4, got)] when 4 then [(1, 8, got), (2, 3, got), (3, 4, got)] when 14 then [(1, 7, got), (2, 8, got)] when 15 then [(1, 9, got)] else [] end || [(11, 3, got), (12, 4, got), (13, 7, got), (14, 9, got), (15, 8, got)]) as k from r),
f as (select t.reject_id, arg_min(t.k[2], t.k[1]) as kind, arg_min(t.k[3], t.k[1]) as seq from t join s on s.file_id = t.file_id and s.kind = t.k[2] and s.seq = t.k[3] and t.k[3] <> 0 and s.off = case when t.k[2] = 4 then t.off else 0 end and s.i = case when t.k[2] = 8 then t.off // 25 else 0 end group by 1)
select r.reject_id, r.reason, r.reason in (2, 3, 4, 9, 10, 14, 15) as recoverable, f.kind::int as kind, f.seq from r left join f using (reject_id)""")
def reject_resolution(spark, sf_dir):
    """The sent packet that each rejection refers to, in chunks of 25 bytes."""
    out = A.resolve_rejects(*_rejects(spark, sf_dir), chunk_size=25)
    return out.select("reject_id", "reason", is_recoverable(F.col("reason")).alias("recoverable"), F.col("sent.kind").alias("kind"), F.col("sent.seq").alias("seq"))


@_query(f"""{_EV}, e as (select *, sum(case when event = 'report' then 1 else 0 end) over (partition by line_id order by "order") as epoch from ev),
a as (select *, sum(case when event = 'disconnect' then 1 else 0 end) over (partition by line_id, epoch order by "order") as attempt from e)
select line_id, "order", attempt::bigint as attempt, event = 'disconnect' and attempt > 3 as final from a where event = 'disconnect'""")
def failure_escalation(spark, sf_dir):
    """Recoveries (a line's disconnects) since its last report; the fourth is final."""
    ev = V.line_events(spark, sf_dir).select("line_id", "order", (F.col("event") == "disconnect").alias("recovery"), (F.col("event") == "report").alias("progress"))
    return A.escalation(ev, "line_id").filter("recovery").select("line_id", "order", "attempt", "final")


@_query("""with s as (select l_orderkey as file_id, (l_linenumber - 1)::bigint as i, (l_shipdate::date - date '1970-01-01')::bigint as t, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_quantity) as attempt from lineitem)
select attempt, attempt > 1 as retransmit, attempt >= 3 as exhausted, count(*) as sends from s group by all""")
def send_attempts(spark, sf_dir):
    """How often chunks were sent, with a limit of two retries."""
    li = V.received(spark, sf_dir).select("stream_id", "file_id", "seq", F.lit(8).alias("kind"), F.lit(0).cast("long").alias("offset"), "chunk_index", F.struct("arrival.l_shipdate", "arrival.l_partkey", "arrival.l_suppkey", "arrival.l_quantity").alias("sent_tick"))
    return A.attempts(li, 2).groupBy(F.col("attempt").cast("long").alias("attempt"), "retransmit", "exhausted").agg(F.count("*").alias("sends"))


_URLS = "u as (select page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') as path from pages)"


@_query(f"with {_URLS}, p as (select page_id, path, ltrim(path, '/') as rel from u) select page_id, path <> '' and not list_bool_or(list_transform(regexp_split_to_array(path, '/+'), lambda x: x in ('', '.', '..'))) as absolute_ok, rel <> '' and not list_bool_or(list_transform(regexp_split_to_array(rel, '/+'), lambda x: x in ('', '.', '..'))) as relative_ok from p")
def path_safety(spark, sf_dir):
    """Whether pages' paths may be written below a target root, as they are and without the leading slash."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    return p.select("page_id", N.is_safe_name("path").alias("absolute_ok"), N.is_safe_name(F.ltrim(F.col("path"), F.lit("/"))).alias("relative_ok"))


@_query(f"with {_URLS}, p as (select page_id, list_filter(regexp_split_to_array(path, '/+'), lambda x: x not in ('', '.', '..')) as parts from u) select page_id, case when len(parts) = 0 then '/mnt' else '/mnt/' || array_to_string(parts, '/') end as root from p")
def mount_paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    return p.select("page_id", N.mounted_root(F.lit("/mnt"), "path").alias("root"))


_TABLE = "t(i, c, k) as (select i, i::bigint, 0 from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 2197175160) else c >> 1 end, k + 1 from t where k < 8), tab as (select list(c order by i) as l from t where k = 8)"
_HEX = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, {}), lambda a, x: xor(l[(xor(a, x) & 255) + 1], a >> 8)), 4294967295)::bigint"
_TEXT = "coalesce(text, '')"


@_query(f"with recursive {_TABLE}, b as (select conv_id, turn, {_HEX.format(_TEXT)} as bytes from conversations) select conv_id, turn, {_CRC.format('bytes')} as crc32c from b, tab")
def content_checksums(spark, sf_dir):
    """CRC32C of the UTF-8 bytes of every turn, null as empty."""
    b = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return b.select("conv_id", "turn", C.crc_value(C.crc32c(F.encode(F.coalesce("text", F.lit("")), "utf-8"))).alias("crc32c"))


def content_checksums_utf8(spark, sf_dir):
    """CRC32C of the UTF-8 bytes of every benchmark text, null as empty."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select("item_id", C.crc_value(C.crc32c(F.encode(F.coalesce("text", F.lit("")), "utf-8"))).alias("crc32c"))


@_query(f"with recursive {_TABLE}, b as (select source, count(*) as parts, string_agg({_TEXT}, '' order by doc_id) as whole from documents group by source), h as (select source, parts, strlen(whole)::bigint as len, {_HEX.format('whole')} as bytes from b) select source, parts, len, {_CRC.format('bytes')} as crc32c from h, tab")
def file_checksums(spark, sf_dir):
    """CRC32C of each source's documents, one after another, from checksums of the halves of each."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"))
    half = F.floor(F.octet_length("payload") / 2).cast("int")
    cut = rows.select("source", "doc_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.substring("payload", F.lit(1), half).alias("b")), F.struct(F.lit(1).alias("k"), F.substring("payload", half + 1, F.octet_length("payload")).alias("b")))).alias("s"))
    cut = cut.select("source", (F.col("doc_id") * 2 + F.col("s.k")).alias("at"), C.crc32c(F.col("s.b")).alias("checksum"), F.octet_length("s.b").alias("len"))
    n = rows.groupBy("source").agg(F.count("*").alias("parts"))
    return C.crc32c_combine(cut, ["source"], "at").join(n, "source").select("source", "parts", "len", C.crc_value(F.col("checksum")).alias("crc32c"))


@_query(f"select doc_id, md5({_TEXT}) as md5, (strlen({_TEXT}) + {SIZE - 1}) // {SIZE} as chunks, (strlen({_TEXT}) + {SIZE - 1}) // {SIZE} as verified from documents")
def chunk_roundtrip(spark, sf_dir):
    """Documents cut into checksummed chunks, shuffled, and put together again; an empty one has no chunks. verified counts the chunks whose payload has their checksum."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit(1).cast("long").alias("stream_id"), F.lit(1).cast("long").alias("seq"), F.col("doc_id").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"))
    chunks = settle(T.chunk_payloads(rows, SIZE))
    checked = chunks.select("file_id", (C.crc32c(F.col("payload")) == F.col("checksum")).alias("ok"))
    counts = checked.groupBy("file_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("ok")).alias("verified"))
    whole = T.assemble(chunks).select("file_id", F.md5("payload").alias("md5")).join(counts, "file_id")
    found, zero = rows.select("file_id").join(whole, "file_id", "left"), F.lit(0).cast("long")
    return found.select(F.col("file_id").alias("doc_id"), F.coalesce("md5", F.md5(F.lit(b""))).alias("md5"), F.coalesce("chunks", zero).alias("chunks"), F.coalesce("verified", zero).alias("verified"))


@_query("""with f as (select o_custkey as stream_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as seq, o_orderkey as file_id from orders),
m as (select stream_id, seq, file_id, 7 as msg_type, -1 as place, null as p, null as i, false as damaged from f union all select stream_id, seq, file_id, 9, 1099511627776, null, null, false from f
  union all select stream_id, seq, file_id, 8, (l_linenumber - 1) * 1000 + l_suppkey % 1000, l_partkey, l_linenumber - 1, l_returnflag = 'R' from lineitem join f on l_orderkey = file_id),
a as (select *, row_number() over (partition by stream_id order by seq, place, p nulls first, i nulls first) as arrival from m),
v as (select stream_id, seq, i, min(arrival) filter (where not damaged) as earliest from a where msg_type = 8 group by all),
e as (select f.stream_id, f.seq, count(v.earliest) = 7 as complete from f left join v using (stream_id, seq) group by all),
t as (select stream_id, coalesce(min(seq) filter (where not complete), max(seq) + 1) as turn from e group by all)
select a.stream_id, a.arrival, a.msg_type, a.seq,
  case when a.seq > turn then 'rejected' when a.msg_type = 7 then 'accepted' when a.msg_type = 9 then case when complete then 'accepted' else 'rejected' end when v.earliest < a.arrival then 'ignored' when damaged then 'rejected' else 'accepted' end as outcome,
  case when a.seq > turn then 2 when a.msg_type = 9 and not complete then 15 when a.msg_type = 8 and damaged and not coalesce(v.earliest < a.arrival, false) then 4 end as reason,
  (case when a.seq >= turn then turn when a.msg_type = 9 then a.seq + 1 else a.seq end)::bigint as expected_seq, a.file_id, case when (case when a.seq >= turn then turn when a.msg_type = 9 then a.seq + 1 else a.seq end) > 1 then 70000 else 0 end as "offset"
from a join t using (stream_id) join e using (stream_id, seq) left join v on v.stream_id = a.stream_id and v.seq = a.seq and v.i = a.i""")
def apply_log(spark, sf_dir):
    """Outcomes of a transfer log derived from line items: a stream for each customer, a file for each order."""
    return AU.chunked_outcomes(AP.log_from_orders(spark, sf_dir))


@_query(f"""with {V.EVENTS_SQL} select line_id, epoch(time_bucket(interval '1 day', ts))::bigint as day, count(*) as messages, count(*) filter (where event = 'report') as reports, max("order") as upto from ev group by all""")
def stream_progress(spark, sf_dir):
    """Progress of lines by day, computed by a stream over the events file until it has read all."""
    return FL.progress_by_window(spark, sf_dir, "events.parquet")


@_query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, epoch_us(min(ts)) as start_us, count(*) as events from s group by user_id, k""")
def transfer_sessions(spark, sf_dir):
    """Activity of users in sessions that end after six quiet hours."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return FL.sessions(ev, "user_id", "6 hours").select("user_id", F.unix_micros("start").alias("start_us"), "events")


@_query("""with s as (select l_orderkey as file_id, l_linenumber as n, l_quantity::bigint as len, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as a, (l_linenumber - 1) * 25 as off from lineitem),
e as (select *, coalesce(lag(off + len) over (partition by file_id order by a), 0) as e from s)
select file_id, count(*) filter (where off <> e) as offset_faults, count(*) filter (where off = e and off + len > 100) as overflows from e group by 1""")
def segment_continuity(spark, sf_dir):
    """Segments that don't start where the last one ended, or pass the final size."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    arrival = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    seg = li.select(F.lit(1).alias("stream_id"), F.col("l_orderkey").alias("file_id"), arrival.alias("arrival"), ((F.col("l_linenumber") - 1) * 25).cast("long").alias("offset"), F.col("l_quantity").cast("long").alias("len"), F.lit(100).alias("final_size"))
    return L.append_continuity(seg).groupBy("file_id").agg(F.count_if(F.col("fault") == "OFFSET").alias("offset_faults"), F.count_if(F.col("fault") == "OVERFLOW").alias("overflows"))


@_query("""with l as (select o_custkey as stream_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as arrival, (o_orderkey % 5 + 1)::bigint as seq, o_orderstatus = 'F' as completes from orders),
e as (select *, coalesce(max(case when completes then seq end) over (partition by stream_id order by arrival rows between unbounded preceding and 1 preceding), 0) + 1 as expected from l)
select case when seq < expected then 'STALE' when seq > expected then 'FUTURE' else 'NOW' end as gate, completes, count(*) as messages from e group by all""")
def sequence_gate(spark, sf_dir):
    """Messages of a stored log that are stale or ahead of the expected sequence number."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    log = o.select(F.col("o_custkey").alias("stream_id"), F.row_number().over(w).alias("arrival"), (F.col("o_orderkey") % 5 + 1).alias("seq"), (F.col("o_orderstatus") == "F").alias("completes"))
    return L.expected_seq(log).groupBy("gate", "completes").agg(F.count("*").alias("messages"))
