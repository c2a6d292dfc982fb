"""Queries of the operators on trees and streams over the driver's tables, with their SQL.

The trees are made of the tables' rows, in the shared folder, which must be a mounted one here, as for every tree.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import views as V
from tidemark.functions import checksums as C
from tidemark.functions import names as N
from tidemark.operators import manifest as M
from tidemark.queries import _BOTH, _CRC, _HEX, _PAIRS, _TABLE, _TEXT, _query
from tidemark.shared import settle, shared_folder, written
from tidemark.sources import feed, sink, tree
from tidemark.streaming import flows as FL


def _folder(spark: SparkSession, name: str) -> str:
    shared = shared_folder(spark)
    if not re.match("file:|/", shared):
        raise ValueError(f"a tree needs a folder that is mounted, not {shared}")
    path = f"{re.sub('^file:/*', '/', shared)}/tidemark-{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _files(rows: DataFrame, step: int = 65536) -> DataFrame:
    """Chunks for the sink from (file_id, name, payload)."""
    whole = rows.select("file_id", "name", F.octet_length("payload").cast("long").alias("size"), C.crc32c(F.col("payload")).alias("file_checksum"), "payload")
    cut = whole.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(step).cast("long"))))
    return cut.withColumn("payload", F.substring("payload", F.col("offset").cast("int") + 1, F.lit(step)))


@_query(f"with recursive {_TABLE}, b as (select source || '/' || doc_id || '.txt' as name, {_HEX.format(_TEXT)} as bytes from documents) select name, len(bytes)::bigint as size, case when len(bytes) > 0 then {_CRC.format('bytes')} end as crc32c from b, tab")
def tree_files(spark, sf_dir):
    """Documents written as files, and scanned: names, sizes, checksums."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = _folder(spark, "files")
    sink.write_files(spark, _files(docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("name"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"))), root)
    found = tree.scan_tree(spark, root, 9001).filter("kind = 1")
    return found.select("name", "size", F.when(F.col("checksum.algo") == 1, C.crc_value(F.col("checksum.value"))).alias("crc32c"))


@_query("""with d as (select doc_id % 10 as m, source || '/' || doc_id as path, strlen(coalesce(text, ''))::bigint as size from documents),
o as (select path, size as old_size, 1 as om from d where m <> 0), n as (select path, case m when 2 then size + 7 when 3 then size // 2 else size end as new_size, case m when 4 then 2 else 1 end as nm from d where m <> 1),
j as (select case when old_size is null then 'CREATED' when new_size is null then 'REMOVED' when new_size > old_size then 'APPENDED' when new_size <> old_size or om <> nm then 'MODIFIED' end as change, path, old_size, new_size from o full join n using (path))
select * from j where change is not null""")
def tree_changes(spark, sf_dir):
    """The change feed of a tree of documents that is changed by every kind of change: by doc_id mod 10, 0 comes, 1 goes, 2 grows, 3 shrinks, 4 gets another time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select((F.col("doc_id") % 10).alias("m"), F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"))
    rows = written(rows.withColumn("size", F.octet_length("payload").cast("long")), "tree-documents")
    root, kept, own = (_folder(spark, n) for n in ("changing", "listings", "feed"))
    sink.write_files(spark, _files(rows.filter("m <> 0")), root)
    seen = FL.run_to_end(feed.watch_tree(spark, root, kept, buckets=8), f"file://{own}")
    first = seen.agg(F.max("at")).first()[0] or 0

    def change(some) -> None:
        for r in some:
            path = sink.below(root, r["name"])
            if r["m"] == 1:
                os.unlink(path)
            elif r["m"] == 4:
                os.utime(path, (1, 1))
            elif r["size"] // 2 != r["size"]:
                os.truncate(path, r["size"] // 2)

    sink.write_files(spark, _files(rows.filter("m = 0")), root)
    sink.append_segments(rows.filter("m = 2").select(F.lit(root).alias("root"), "name", F.col("size").alias("offset"), F.lit(b"further").alias("payload")))
    rows.filter("m in (1, 3, 4)").select("m", "name", "size").foreachPartition(change)
    later = FL.run_to_end(feed.watch_tree(spark, root, kept, buckets=8), f"file://{own}")
    return later.filter(F.col("at") > first).select("change", "path", "old_size", "new_size")


@_query("""with d as (select doc_id, case doc_id % 5 when 0 then doc_id || '.file' when 1 then '000' || doc_id || '.file' when 2 then 'x' || doc_id || '.file' when 3 then '1844674407370955161' || (doc_id % 10) || '.file' else 'dir/' || doc_id || '.file' end as name from documents),
n as (select *, case when doc_id % 5 in (0, 1) then doc_id::hugeint when doc_id % 5 = 3 and doc_id % 10 <= 5 then 18446744073709551610::hugeint + doc_id % 10 end as u from d)
select doc_id, name, u is not null as numeric, row_number() over (order by case when u < 9223372036854775808 then 0 else 1 end, case when u < 9223372036854775808 then u end, encode(name), doc_id) as seq from n""")
def numeric_sequence(spark, sf_dir):
    """Entries of which some have numeric names: these come first, by number, if their top bit is clear; names below a directory have none."""
    i = F.col("doc_id").cast("string")
    forms = [F.concat(i, F.lit(".file")), F.concat(F.lit("000"), i, F.lit(".file")), F.concat(F.lit("x"), i, F.lit(".file")), F.concat(F.lit("1844674407370955161"), (F.col("doc_id") % 10).cast("string"), F.lit(".file")), F.concat(F.lit("dir/"), i, F.lit(".file"))]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.element_at(F.array(*forms), (F.col("doc_id") % 5 + 1).cast("int")).alias("name"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("stream_id"))
    entries = M.sequenced_wide(M.identified(rows), by=["doc_id"])
    numeric = (F.instr("name", "/") == 0) & N.numeric_file_id("name").isNotNull()
    return entries.select("doc_id", "name", numeric.alias("numeric"), "seq")


@_query("select distinct l_orderkey as file_id, (l_linenumber - 1)::bigint as chunk_index from lineitem")
def distinct_intake(spark, sf_dir):
    """Chunks from a stream in which many come again, each once."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    one = F.lit(1).cast("long")
    chunks = rows.select(F.to_timestamp(F.col("l_shipdate").cast("date")).alias("ts"), one.alias("stream_id"), one.alias("seq"), F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") - 1).cast("long").alias("chunk_index"))
    return FL.run_to_end(FL.distinct_chunks(chunks, late="36500 days")).select("file_id", "chunk_index")


_QUIET = 7_200_000


@_query(f"""with e as (select user_id::int as line_id, event_id as o, epoch_us(ts) // 1000 as ms, case event_type when 'purchase' then 1 when 'signup' then -1 else 0 end as d, event_type from events),
s as (select *, sum(d) over w as s from e window w as (partition by line_id order by ms, o rows unbounded preceding)),
p as (select *, s - least(0, min(s) over w) as open from s window w as (partition by line_id order by ms, o rows unbounded preceding)),
b as (select *, coalesce(lag(open) over w, 0) as open_before, lag(ms) over w as before, lead(ms) over w as next from p window w as (partition by line_id order by ms, o)),
t as (select *, case when event_type = 'view' or (event_type = 'purchase' and open_before = 0) then ms end as start from b),
q as (select *, max(start) over w as since_after, max(start) over (partition by line_id order by ms, o rows between unbounded preceding and 1 preceding) as since from t window w as (partition by line_id order by ms, o rows unbounded preceding)),
a as (select line_id, since as since_ms, open_before as open_sends from q where since is not null and ms - since > {_QUIET} and before - since <= {_QUIET} and open_before > 0
  union all select line_id, since_after, open from q where next is null and since_after is not null and open > 0 and ms - since_after <= {_QUIET})
select line_id, since_ms::bigint as since_ms, open_sends::bigint as open_sends from a where since_ms + {_QUIET} + 1 < (select max(ms) from e) - 86400000""")
def silence_alarms(spark, sf_dir):
    """Alarms of lines that were silent for over two hours with sends open, out of a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.when(F.col("event_type") == "purchase", "send").when(F.col("event_type") == "signup", "done").when(F.col("event_type") == "view", "report").otherwise("other")
    events = rows.select(F.col("user_id").cast("int").alias("line_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"), F.col("event_id").alias("order"))
    alarms = FL.run_to_end(FL.silence_alarm(events, _QUIET, "1 day"))
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last"))
    return alarms.join(F.broadcast(last), F.col("since_ms") + _QUIET + 1 < F.col("last") - 86_400_000).drop("last")  # one row


@_query(f"{_BOTH}{_PAIRS} select * from diff")
def streamed_differences(spark, sf_dir):
    """The difference to the target for a manifest that a stream brings."""
    src = V.src_entries(spark, sf_dir)
    path, found = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}", []
    src.write.parquet(f"{path}/manifests")
    target = settle(V.dst_entries(src))

    def emit(difference: DataFrame, number: int) -> None:
        difference.write.mode("overwrite").parquet(f"{path}/differences/batch={number}")
        found.append(difference.schema)

    FL.rediff(spark.readStream.schema(src.schema).parquet(f"{path}/manifests"), lambda: target, emit, f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(found[0]).option("basePath", f"{path}/differences").parquet(f"{path}/differences/*").select(found[0].fieldNames())
