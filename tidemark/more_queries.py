"""Further queries of the replication operators over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import views as V
from tidemark.functions import checksums as C
from tidemark.functions import names as N
from tidemark.operators import acks as A
from tidemark.operators import diff as D
from tidemark.operators import manifest as M
from tidemark.operators.ranges import Ranges
from tidemark.queries import _BOTH, _CRC, _HEX, _PLAN, _SRC, _TABLE, _diff, _query, content_checksums_utf8
from tidemark.shared import settle, shared_folder
from tidemark.streaming import flows as FL


@_query(f"{_PLAN} select stream_id, seq, file_id, case when resumed then 1 else 2 end as action, start_offset from tasks")
def reply_tasks(spark, sf_dir):
    """The entries to send after a reply, with what to do at each."""
    src, diff = _diff(spark, sf_dir)
    starts = D.diff_reply(diff.filter("outcome <> 'CONFLICT'"), all_or_nothing=False)
    held = src.join(starts.select("stream_id"), "stream_id", "left_semi")
    return D.apply_reply(held, starts).select("stream_id", "seq", "file_id", "action", "start_offset")


@_query(f"{_SRC}, w as (select *, case seq % 3 when 0 then file_id else -seq end as wanted from src where seq % 3 <> 2) select stream_id, seq, case seq % 3 when 0 then name else (18446744073709551616::hugeint - seq)::varchar || '.file' end as name from w")
def entry_names(spark, sf_dir):
    """Names of wanted entries; those that don't exist are named by their ids."""
    src = V.src_entries(spark, sf_dir)
    wanted = src.filter("seq % 3 <> 2").select("stream_id", "seq", F.when(F.col("seq") % 3 == 0, F.col("file_id")).otherwise(-F.col("seq")).alias("file_id"))
    return D.entry_lookup(wanted, src).select("stream_id", "seq", "name")


@_query(f"{_SRC} select stream_id, seq, case when seq = 1 then null when seq % 11 = 0 or seq % 5 = 0 then 'PREV_FILE_INCOMPLETE' when seq % 7 = 0 then 'CHECKSUM_MISMATCH' end as verdict from src")
def predecessor_verdicts(spark, sf_dir):
    """Messages that name a predecessor: by seq, some name one that is absent, of another size or of another checksum."""
    src = V.src_entries(spark, sf_dir)
    before = src.select("stream_id", (F.col("seq") + 1).alias("seq"), F.col("file_id").alias("prev_file_id"), F.col("size").alias("prev_final_size"), F.col("checksum").alias("prev_checksum"))
    named = src.select("stream_id", "seq").join(before, ["stream_id", "seq"], "left")
    messages = named.select(
        "stream_id", "seq", F.when(F.col("seq") % 11 == 0, F.lit(-1)).otherwise(F.coalesce("prev_file_id", F.lit(0))).cast("long").alias("prev_file_id"),
        (F.col("prev_final_size") + (F.col("seq") % 5 == 0).cast("long")).alias("prev_final_size"),
        F.col("prev_checksum").withField("len", F.col("prev_checksum.len") + (F.col("seq") % 7 == 0).cast("long")).alias("prev_checksum"),
    )
    return D.predecessor_barrier(messages, src).select("stream_id", "seq", "verdict")


@_query(f"{_BOTH} select s.stream_id, s.name from src s where exists (select 1 from dst d where d.stream_id = s.stream_id and d.name = s.name)")
def existing_targets(spark, sf_dir):
    """Planned creations whose target is there already."""
    src = V.src_entries(spark, sf_dir)
    return D.existing_targets(src.select("stream_id", "name"), V.dst_entries(src))


@_query("select source || '/' || doc_id as path from documents where doc_id % 10 = 1")
def removed_paths(spark, sf_dir):
    return D.removed_paths(*V.snapshots(spark, sf_dir)).select("path")


@_query(f"{_BOTH} select stream_id, name, size from src where stream_id % 2 = 1 union all select stream_id, name, size from dst where stream_id % 2 = 0")
def united_streams(spark, sf_dir):
    """One manifest of two: streams with odd ids as the sender has them, the others as the receiver has them."""
    src = V.src_entries(spark, sf_dir)
    return M.union_streams(src.filter("stream_id % 2 = 1"), V.dst_entries(src)).select("stream_id", "name", "size")


@_query(f"{_SRC} select distinct stream_id, root from src")
def stream_roots(spark, sf_dir):
    return M.distinct_roots(V.src_entries(spark, sf_dir))


@_query(f"{_SRC} select stream_id, seq, file_id, name, size, sum as md5 from src")
def manifest_stored(spark, sf_dir):
    """A manifest nested, made flat again, saved by stream and loaded."""
    path = f"{shared_folder(spark)}/tidemark/manifest-{uuid.uuid4().hex}"
    M.save_manifest(M.flat(M.nested(V.src_entries(spark, sf_dir))), path)
    return M.load_manifest(spark, path).select("stream_id", "seq", "file_id", "name", "size", F.lower(F.hex("checksum.value")).alias("md5"))


def _log(spark, sf_dir):
    """Of each order, a send for each line number n, at tick 10 n, its kind by the part; a report after each at tick 12 n."""
    rows = settle(spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("n")).agg(F.min("l_partkey").alias("p")))
    kind = F.element_at(F.array(*[F.lit(k) for k in (3, 4, 7, 8, 9)]), (F.col("p") % 5 + 1).cast("int"))
    zero, file = F.lit(0).cast("long"), F.col("o") * 10 + F.col("n") % 2
    rows = rows.select((F.col("o") % 2).cast("int").alias("line_id"), F.col("o").alias("stream_id"), file.alias("file_id"), "n", kind.alias("kind"))
    chunk = F.when(F.col("kind") == 8, F.col("n") % 3).otherwise(zero)
    sends = rows.select(
        "line_id", "kind", "stream_id", "file_id", F.col("n").alias("seq"), F.when(F.col("kind") == 4, F.col("n") * 10 - 10).otherwise(zero).alias("offset"),
        F.when(F.col("kind") == 4, F.col("n") * 10).otherwise(zero).alias("end_offset"), chunk.alias("chunk_index"), (F.col("n") * 10).alias("sent_tick"),
    )
    listed = F.when(F.col("kind") == 8, F.array(F.struct(F.col("n").alias("seq"), "file_id", chunk.alias("chunk_index")))).otherwise(F.array().cast("array<struct<seq:bigint,file_id:bigint,chunk_index:bigint>>"))
    acks = rows.select("line_id", "stream_id", "file_id", (F.col("n") * 12).alias("arrival"), F.col("n").alias("next_seq"), (F.col("n") * 10 - 10).alias("offset"), zero.alias("durable_offset"), listed.alias("received_chunks"))
    return sends, acks


_LOG = """with b as (select l_orderkey as o, l_linenumber::bigint as n, [3, 4, 7, 8, 9][min(l_partkey) % 5 + 1] as kind from lineitem group by all),
j as (select s.o, s.n, s.kind, 12 * r.n as tick, r.n > s.n as seq_ok, s.n % 2 = r.n % 2 as same_file, s.kind = 4 and r.n > s.n as off_ok, s.kind = 8 and r.n = s.n as listed from b s join b r on s.o = r.o where 12 * r.n > 10 * s.n)"""


@_query(f"{_LOG} select b.o as stream_id, b.n as seq, b.kind, (select min(tick) from j where j.o = b.o and j.n = b.n and ((same_file and seq_ok and j.kind <> 8) or (same_file and off_ok) or listed)) as ack_tick from b")
def matched_sends(spark, sf_dir):
    """Sends of all kinds with the report on their line that completes them."""
    return A.match_acks(*_log(spark, sf_dir)).select("stream_id", "seq", "kind", "ack_tick")


@_query(f"{_LOG} select b.o as stream_id, b.n as seq, b.kind, (select min(tick) from j where j.o = b.o and j.n = b.n and (seq_ok or (same_file and off_ok) or listed)) as ack_tick from b")
def released_sends(spark, sf_dir):
    """Sends of all kinds with the report that releases them."""
    return A.release_sends(*_log(spark, sf_dir)).select("stream_id", "seq", "kind", "ack_tick")


_TWICE = """with b as (select l_orderkey as o, l_linenumber::bigint as n, [3, 4, 7, 8, 9][min(l_partkey) % 5 + 1] as kind from lineitem group by all),
s as (select *, pass, 10 * n + 100 * pass as sent from b, (values (0), (1)) v(pass)),
r as (select o, n, n % 2 as file, case when kind = 8 then n end as listed, 12 * n + 100 * pass as tick, n as v, 10 * n - 10 as reach from s where pass = 1 or n % 3 <> 0),
rs as (select *, sum(fall) over (partition by o order by tick, v rows unbounded preceding) as epoch from (select *, case when lag(v) over (partition by o order by tick, v) > v then 1 else 0 end as fall from r)),
rf as (select *, sum(fall) over (partition by o, file order by tick, reach rows unbounded preceding) as epoch from (select *, case when lag(reach) over (partition by o, file order by tick, reach) > reach then 1 else 0 end as fall from r)),
e as (select s.*, (select min(epoch) from rs where rs.o = s.o and rs.tick > s.sent) as es, (select min(epoch) from rf where rf.o = s.o and rf.file = s.n % 2 and rf.tick > s.sent) as ef from s)"""


def _log_twice(spark, sf_dir):
    """The log of _log, of which a third of the reports is missing, and after it the same sends and all their reports again: the values of the reports fall where it starts again."""
    sends, acks = _log(spark, sf_dir)
    again = lambda df, tick: df.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(tick, F.col(tick) + 100 * F.col("pass"))
    return again(sends, "sent_tick").drop("pass"), again(acks, "arrival").filter("pass = 1 or next_seq % 3 <> 0").drop("pass")


@_query(f"""{_TWICE} select o as stream_id, n as seq, kind, sent as sent_tick, least((select min(tick) from rs where rs.o = e.o and rs.epoch = e.es and rs.tick > e.sent and rs.v > e.n),
  case when kind = 4 then (select min(tick) from rf where rf.o = e.o and rf.file = e.n % 2 and rf.epoch = e.ef and rf.tick > e.sent and rf.reach >= 10 * e.n) end,
  case when kind = 8 then (select min(tick) from r where r.o = e.o and r.listed = e.n and r.tick > e.sent) end)::bigint as ack_tick from e""")
def restarted_sends(spark, sf_dir):
    """Sends of two sessions with the report of their own that releases them."""
    return A.release_sends(*_log_twice(spark, sf_dir)).select("stream_id", "seq", "kind", "sent_tick", "ack_tick")


@_query(f"{_LOG}, r as (select b.o, b.n, b.kind, (select min(tick) from j where j.o = b.o and j.n = b.n and (seq_ok or (same_file and off_ok) or listed)) as t from b) select kind, (t - 10 * n)::bigint as rtt, count(*) as samples from r where t is not null group by all")
def latency_samples(spark, sf_dir):
    released = A.release_sends(*_log(spark, sf_dir))
    return A.latency_samples(released).groupBy("kind", "rtt").agg(F.count("*").alias("samples"))


@_query("""with b as (select distinct l_orderkey as stream_id, l_linenumber::bigint as seq from lineitem) select stream_id, seq from b where (seq % 2 = 0 or stream_id % 3 = 0) and seq % 4 <> 0""")
def retransmit_queue(spark, sf_dir):
    """Sends that are lost or rejected, each once, and only those that no report has completed."""
    sends, _ = _log(spark, sf_dir)
    open_ = A.unacked(sends, sends.filter("seq % 4 = 0"))
    return A.retransmit_queue([sends.filter("seq % 2 = 0"), sends.filter("stream_id % 3 = 0")], open_).select("stream_id", "seq")


@_query("""with b as (select l_orderkey as o, l_linenumber::bigint as n, [3, 4, 7, 8, 9][min(l_partkey) % 5 + 1] as kind from lineitem group by all),
s as (select o as stream_id, n as seq, o * 10 + n % 2 as file_id, case kind when 4 then n * 10 - 10 else 0 end as off, case kind when 8 then n % 3 else 0 end as i, 10 * n as sent_tick from b)
select stream_id, seq, sent_tick from s where 100 - sent_tick >= 50 order by sent_tick, stream_id, seq, file_id, off, i limit 32""")
def expired_sends(spark, sf_dir):
    """The 32 oldest sends that wait for 50 ticks or more: the pass's limit is a part of the rule."""
    from tidemark.operators.gaps import expired_sends as expired

    return expired(_log(spark, sf_dir)[0], 100, 50).select("stream_id", "seq", "sent_tick")


@_query("""with b as (select l_orderkey as o, l_linenumber::bigint as n, min(l_partkey)::bigint as p from lineitem group by all)
select (o % 100)::bigint as stream_id, max(n) + 1 as next_seq, arg_max(o, o * 10 + n)::bigint as file_id, arg_max(p, o * 10 + n)::bigint as "offset" from b group by 1""")
def accepted_progress(spark, sf_dir):
    """Where each of a hundred streams stands after its accepted messages."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("long").alias("seq")).agg(F.min("l_partkey").cast("long").alias("end_offset"))
    return A.stream_progress(rows.select((F.col("file_id") % 100).cast("long").alias("stream_id"), (F.col("file_id") * 10 + F.col("seq")).alias("arrival"), "seq", "file_id", "end_offset"))


@_query("select bool_and(f) as complete from (select bool_or(o_orderstatus = 'F') as f from orders group by o_custkey)")
def streams_complete(spark, sf_dir):
    """Whether every customer has a closed order."""
    streams = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("complete"))
    return A.all_complete(streams)


@_query("""with r as (select l_suppkey % 4 + 1 as line_id, l_orderkey as stream_id, row_number() over (partition by l_suppkey % 4, l_orderkey order by l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as arrival, l_linenumber as next_seq, l_quantity::bigint as n from lineitem),
l as (select line_id, stream_id, list({'t': n, 'k': 0::bigint, 'ks': [0::bigint]} order by arrival) as xs from r group by all),
f as (select line_id, stream_id, list_reduce(xs, lambda a, b: case when a.t >= 40 then {'t': b.t, 'k': a.k + 1, 'ks': list_append(a.ks, a.k + 1)} else {'t': a.t + b.t, 'k': a.k, 'ks': list_append(a.ks, a.k)} end).ks as ks from l)
select r.line_id::int as line_id, r.stream_id, f.ks[r.arrival] as batch, max(r.arrival) as arrival, arg_max(r.next_seq, r.arrival)::bigint as next_seq, sum(r.n)::bigint as received from r join f using (line_id, stream_id) group by 1, 2, 3""")
def merged_reports(spark, sf_dir):
    """Reports of many chunks merged to batches of forty: the count starts anew after each flush."""
    from pyspark.sql import Window

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = (F.col("l_suppkey") % 4 + 1).cast("int")
    order = Window.partitionBy(line, "l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    size = F.col("l_quantity").cast("long")
    acks = li.select(line.alias("line_id"), F.col("l_orderkey").alias("stream_id"), F.row_number().over(order).cast("long").alias("arrival"), F.col("l_linenumber").cast("long").alias("next_seq"), F.lit(1).cast("long").alias("file_id"), size.alias("offset"), size.alias("durable_offset"), size.alias("n_received"))
    return A.ack_batches(acks, 40).select("line_id", "stream_id", "batch", "arrival", "next_seq", "received")


@_query("""with e as (select user_id as stream_id, event_id as seq, (epoch_us(ts) // 1000) as ms from events),
d as (select *, (ms // 86400000 + 1) * 86400000 as due_ms from e),
n as (select *, (row_number() over (partition by stream_id, due_ms order by ms, seq) - 1) // 3 as k from d)
select stream_id::bigint as stream_id, due_ms::bigint as due_ms, count(*) as chunks, max(seq)::bigint + 1 as next_seq, case when count(*) = 3 then 'COUNT' else 'TIMER' end as cause
from n where due_ms <= (select max(ms) from e) - 86400000 group by stream_id, due_ms, k""")
def counted_progress(spark, sf_dir):
    """Progress reports by number of messages or by the clock, whichever is first, out of a stream."""
    return FL.counted_progress(spark, sf_dir, "events.parquet")


_ARRIVALS = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
_LINES = f"""with r as (select (l_suppkey % 100)::int as line_id, (l_orderkey % 3)::bigint as stream_id, row_number() over (partition by l_suppkey % 100 order by {_ARRIVALS}) as arrival, l_linenumber::bigint as next_seq, (l_quantity::bigint) % 9 as n, l_partkey % 13 = 0 as flush from lineitem),
l as (select line_id, list({{'s': stream_id, 'n': n, 'f': flush, 'a': arrival, 't': [0::bigint, 0::bigint, 0::bigint], 'k': 0::bigint, 'ks': [0::bigint]}} order by arrival) as xs from r group by all),
g as (select line_id, list_prepend({{'s': 0::bigint, 'n': 0::bigint, 'f': false, 'a': 0::bigint, 't': [0::bigint, 0::bigint, 0::bigint], 'k': 0::bigint, 'ks': []::bigint[]}}, xs) as xs from l),"""
_FOLD = """f as (select line_id, list_reduce(xs, lambda p, b: {{'s': b.s, 'n': b.n, 'f': b.f, 'a': b.a,
    't': case when p.f or list_max(p.t) >= 20 or {timer} then [case when b.s = 0 then b.n else 0 end, case when b.s = 1 then b.n else 0 end, case when b.s = 2 then b.n else 0 end]
      else [p.t[1] + case when b.s = 0 then b.n else 0 end, p.t[2] + case when b.s = 1 then b.n else 0 end, p.t[3] + case when b.s = 2 then b.n else 0 end] end,
    'k': p.k + case when p.a > 0 and (p.f or list_max(p.t) >= 20 or {timer}) then 1 else 0 end, 'ks': list_append(p.ks, p.k + case when p.a > 0 and (p.f or list_max(p.t) >= 20 or {timer}) then 1 else 0 end)}}).ks as ks from g)
select r.line_id, r.stream_id, f.ks[r.arrival] as batch, max(r.arrival) as arrival, arg_max(r.next_seq, r.arrival) as next_seq, sum(r.n)::bigint as received from r join f using (line_id) group by all"""


def _line_reports(spark, sf_dir):
    """Reports of three streams on each of a hundred lines; one in thirteen follows a message after which the line is flushed."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.withColumn("line_id", (F.col("l_suppkey") % 100).cast("int"))
    rows = Ranges(rows, ["line_id"], _ARRIVALS.split(", ")).with_running("arrival", "sum", F.lit(1).cast("long")).done()
    return rows.select("line_id", (F.col("l_orderkey") % 3).alias("stream_id"), "arrival", F.col("l_linenumber").cast("long").alias("next_seq"), *[F.lit(1).cast("long").alias(c) for c in ("file_id", "offset", "durable_offset")], (F.col("l_quantity").cast("long") % 9).alias("n_received"), (F.col("l_partkey") % 13 == 0).alias("flush"))


@_query(f"{_LINES} {_FOLD.format(timer='false')}")
def coupled_reports(spark, sf_dir):
    """Reports merged to batches of twenty on lines that carry several streams: a flush, by number or as asked for, ends all of a line's batches."""
    return A.coupled_ack_batches(_line_reports(spark, sf_dir)).select("line_id", "stream_id", "batch", "arrival", "next_seq", "received")


@_query(f"{_LINES} {_FOLD.format(timer='p.a // 7 <> b.a // 7')}")
def timed_reports(spark, sf_dir):
    """As coupled_reports, with a flush of every line at each seventh tick besides."""
    return A.coupled_ack_batches(_line_reports(spark, sf_dir), interval=7).select("line_id", "stream_id", "batch", "arrival", "next_seq", "received")


UTF8_SQL = f"with recursive {_TABLE}, b as (select item_id, {_HEX.format('''coalesce(text, '')''')} as bytes from benchmark) select item_id, {_CRC.format('bytes')} as crc32c from b, tab"

_query(UTF8_SQL)(content_checksums_utf8)


@_query(f"with recursive {_TABLE}, b as (select source, string_agg(coalesce(text, ''), '' order by doc_id) as whole from documents group by source), h as (select source, strlen(whole)::bigint as len, {_HEX.format('whole')} as bytes from b) select source, len, {_CRC.format('bytes')} as crc32c from h, tab")
def joined_checksums(spark, sf_dir):
    """CRC32C of each source's documents, one after another, combined from the documents' own."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"))
    parts = rows.select("source", F.col("doc_id").alias("at"), C.crc32c(F.col("payload")).alias("checksum"), F.octet_length("payload").alias("len"))
    return C.crc32c_combine(parts, ["source"], "at").select("source", "len", C.crc_value(F.col("checksum")).alias("crc32c"))


@_query(f"with recursive {_TABLE}, b as (select item_id, {_HEX.format('''coalesce(text, '')''')} as bytes from benchmark), x as (select item_id, len(bytes) as n, list_slice(bytes, greatest(len(bytes) - 63, 1), len(bytes)) as bytes from b) select item_id, case when n = 0 then 0 else 1 end as algo, greatest(n - 64, 0)::bigint as \"offset\", least(n, 64)::bigint as len, case when n > 0 then {_CRC.format('bytes')} end as crc32c, item_id % 3 <> 1 or n = 0 as verified from x, tab")
def tail_checksums(spark, sf_dir):
    """Checksums of benchmark texts' last 64 bytes, verified against the text, of which every third lost its last byte."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"))
    rows = settle(b.withColumn("sum", C.tail_checksum(F.col("payload"), 64)))
    kept = F.when(F.col("item_id") % 3 == 1, F.substring("payload", F.lit(1), F.octet_length("payload") - 1)).otherwise(F.col("payload"))
    ok = C.verify(F.col("held"), F.col("sum"))
    return rows.withColumn("held", kept).select("item_id", "sum.algo", "sum.offset", "sum.len", F.when(F.col("sum.algo") == 1, C.crc_value(F.col("sum.value"))).alias("crc32c"), ok.alias("verified"))


@_query("""with d as (select doc_id, case doc_id % 5 when 0 then doc_id || '.file' when 1 then '000' || doc_id || '.file' when 2 then 'x' || doc_id || '.file' when 3 then '1844674407370955161' || (doc_id % 10) || '.file' else doc_id || '.txt' end as name from documents),
n as (select *, case when doc_id % 5 in (0, 1) then doc_id::hugeint when doc_id % 5 = 3 and doc_id % 10 <= 5 then 18446744073709551610::hugeint + doc_id % 10 end as u from d)
select doc_id, name, case when u > 9223372036854775807 then (u - 18446744073709551616::hugeint)::bigint else u::bigint end as file_id, u::varchar || '.file' as back from n""")
def numeric_names(spark, sf_dir):
    """Numeric ids of file names, and the names of these ids."""
    i = F.col("doc_id").cast("string")
    forms = [F.concat(i, F.lit(".file")), F.concat(F.lit("000"), i, F.lit(".file")), F.concat(F.lit("x"), i, F.lit(".file")), F.concat(F.lit("1844674407370955161"), (F.col("doc_id") % 10).cast("string"), F.lit(".file")), F.concat(i, F.lit(".txt"))]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.element_at(F.array(*forms), (F.col("doc_id") % 5 + 1).cast("int")).alias("name"))
    rows = rows.withColumn("file_id", N.numeric_file_id("name"))
    return rows.withColumn("back", N.file_name_for_id("file_id"))


@_query("select s_suppkey, case when s_suppkey % 3 = 0 then s_name end as known, coalesce(case when s_suppkey % 3 = 0 then s_name end, '/data/' || s_suppkey) as own_root, coalesce(case when s_suppkey % 3 = 0 then s_name end, '/data') as root from supplier")
def fallback_roots(spark, sf_dir):
    """Roots of streams: their own where one is known, else the default, with and without the stream's id."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("known"))
    return s.select("s_suppkey", "known", N.stream_root("known", "s_suppkey", "/data").alias("own_root"), N.stream_root("known", "s_suppkey", "/data", use_id=False).alias("root"))
