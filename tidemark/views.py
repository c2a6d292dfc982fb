"""Stand-ins for manifests, transfer logs and snapshots over the driver's tables; the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.manifest import identified, sequenced_wide


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of documents: a stream for each language, names source/doc_id.txt. The checksum is MD5 here, as DuckDB has it too."""
    docs = _table(spark, sf_dir, "documents")
    langs = Window.orderBy("lang")
    streams = docs.select("lang").distinct().withColumn("stream_id", (9000 + F.row_number().over(langs)).cast("long"))
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.join(F.broadcast(streams), "lang").select(
        F.lit(1).cast("long").alias("manifest_id"), "stream_id", F.col("lang").alias("root"), F.lit(1).alias("kind"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("name"), F.lit("").alias("link_target"),
        F.octet_length(text).cast("long").alias("size"),
        F.struct(F.lit(1).alias("algo"), F.lit(0).cast("long").alias("offset"), F.octet_length(text).cast("long").alias("len"), F.unhex(F.md5(text)).alias("value")).alias("checksum"),
    )
    return identified(rows)


def src_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These entries as a manifest, with their sequence numbers."""
    return sequenced_wide(unsequenced(spark, sf_dir))


def dst_entries(src: DataFrame) -> DataFrame:
    """The receiver's manifest: the first stream equal, the second without its last fifth, the third so too with its last file halved, the fourth without its middle entry."""
    counts = src.groupBy("stream_id").agg(F.count("*").alias("n"))
    rows = src.join(counts, "stream_id").withColumn("kept", F.floor(F.col("n") * 4 / 5)).select(*src.columns, "n", "kept")
    which = (F.col("stream_id") - 9001) % 4
    middle = F.floor(F.col("n") / 2) + 1
    rows = rows.filter((which == 0) | (which.isin(1, 2) & (F.col("seq") <= F.col("kept"))) | ((which == 3) & (F.col("seq") != middle)))
    half = (which == 2) & (F.col("seq") == F.col("kept"))
    rows = rows.withColumn("size", F.when(half, F.floor(F.col("size") / 2)).otherwise(F.col("size")).cast("long"))
    return rows.withColumn("seq", F.when((which == 3) & (F.col("seq") > middle), F.col("seq") - 1).otherwise(F.col("seq"))).drop("n", "kept")


SRC_SQL = """
lang_ids as (select lang, 9000 + row_number() over (order by lang) as stream_id from (select distinct lang from documents)),
raw as (select stream_id, lang as root, source || '/' || doc_id || '.txt' as name, strlen(coalesce(text, ''))::bigint as size, md5(coalesce(text, '')) as sum from documents join lang_ids using (lang)),
hashed as (select *, (list_reduce(list_prepend(1469598103934665603::uhugeint, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::uhugeint)),
    lambda a, b: (xor(a, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) | 9223372036854775808::uhugeint) as h from raw),
src as (select stream_id, root, name, size, sum, (h::hugeint - 18446744073709551616::hugeint)::bigint as file_id, row_number() over (partition by stream_id order by name) as seq from hashed)
"""
DST_SQL = """
counted as (select *, count(*) over (partition by stream_id) as n, (stream_id - 9001) % 4 as which from src),
dst as (select stream_id, name, file_id, sum, case when which = 2 and seq = n * 4 // 5 then size // 2 else size end as size, case when which = 3 and seq > n // 2 + 1 then seq - 1 else seq end as seq
  from counted where which = 0 or (which in (1, 2) and seq <= n * 4 // 5) or (which = 3 and seq <> n // 2 + 1))
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of documents: by doc_id mod 10, 0 is new, 1 gone, 2 enlarged, 3 shrunk, 4 re-dated."""
    rows = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("m"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    old = rows.filter("m <> 0").select("path", "size", F.lit(1).alias("mtime"))
    grown = F.when(F.col("m") == 2, F.col("size") + 7).when(F.col("m") == 3, F.floor(F.col("size") / 2)).otherwise(F.col("size")).cast("long")
    return old, rows.filter("m <> 1").select("path", grown.alias("size"), F.when(F.col("m") == 4, 2).otherwise(1).alias("mtime"))


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of orders' files that arrived: line items not returned. Seven chunks a file; arrival by all other columns."""
    li = _table(spark, sf_dir, "lineitem")
    arrival = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return li.select(
        F.lit(1).cast("long").alias("stream_id"), F.lit(1).cast("long").alias("seq"), F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") - 1).cast("long").alias("chunk_index"), F.lit(7).cast("long").alias("chunk_count"),
        (F.col("l_suppkey") % 4 + 1).cast("int").alias("line_id"), arrival.alias("arrival"), (F.col("l_returnflag") == "R").alias("lost"), F.col("l_quantity").cast("long").alias("bytes"),
    )


def day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A send for each line item: sent on the order's day, reported on the shipping day where that is later."""
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    both = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return both.select(
        (F.col("l_suppkey") % 4 + 1).cast("int").alias("line_id"), F.lit(8).alias("kind"), F.col("o_custkey").alias("stream_id"), F.col("l_orderkey").alias("file_id"), F.lit(1).cast("long").alias("seq"), F.lit(0).cast("long").alias("offset"),
        F.lit(0).cast("long").alias("end_offset"), (F.col("l_linenumber") - 1).cast("long").alias("chunk_index"), F.col("l_quantity").cast("long").alias("bytes"), day("o_orderdate").alias("sent_tick"), day("l_shipdate").alias("report_tick"), F.col("l_partkey").alias("part"),
    )


SENDS_SQL = """
sends as (select (l_suppkey % 4 + 1)::int as line_id, o_custkey as stream_id, l_orderkey as file_id, l_linenumber - 1 as chunk_index, l_quantity::bigint as bytes, l_partkey as part,
  (o_orderdate::date - date '1970-01-01')::bigint as sent_tick, (l_shipdate::date - date '1970-01-01')::bigint as report_tick from lineitem join orders on l_orderkey = o_orderkey)
"""


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as events of four lines, in order of event_id; a tick is a minute."""
    kind = F.when(F.col("event_type") == "error", "disconnect").when(F.col("event_type") == "signup", "connect").when(F.col("event_type") == "click", "negotiated").when(F.col("event_type") == "view", "report").when(F.col("event_type") == "purchase", "send")
    return _table(spark, sf_dir, "events").select((F.col("user_id") % 4 + 1).cast("int").alias("line_id"), F.col("event_id").alias("order"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("tick"), kind.alias("event"), F.coalesce(F.col("value"), F.lit(0.0)).alias("value"), "ts")


EVENTS_SQL = """
ev as (select (user_id % 4 + 1)::int as line_id, event_id as "order", epoch_us(ts) // 60000000 as tick, case event_type when 'error' then 'disconnect' when 'signup' then 'connect' when 'click' then 'negotiated' when 'view' then 'report' when 'purchase' then 'send' end as event, coalesce(value, 0) as value, ts from events)
"""
