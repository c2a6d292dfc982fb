"""Manifests: order of entries, sequence numbers, totals, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.names import entry_id
from tidemark.operators.ranges import Ranges
from tidemark.schemas import ENTRIES


def entry_order() -> list[Column]:
    """Top-level files with a numeric id first, by id, then all others by name; equal ids by name."""
    numeric = (F.col("kind") == 1) & (F.col("file_id") >= 0)
    return [F.when(numeric, 0).otherwise(1), F.when(numeric, F.col("file_id")), F.col("name")]


def identified(entries: DataFrame) -> DataFrame:
    """entries with file_id from kind and name."""
    return entries.withColumn("file_id", entry_id("kind", "name"))


def sequenced(entries: DataFrame) -> DataFrame:
    """entries with seq 1..n in each stream, in the order of a scan.

    One window for each stream; ``sequenced_wide`` is for streams that no task should hold.
    """
    return entries.withColumn("seq", F.row_number().over(Window.partitionBy("stream_id").orderBy(*entry_order())).cast("long"))


def sequenced_wide(entries: DataFrame, partitions: int | None = None, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """As sequenced, for streams of any size: ranges of all entries in order, and counts of the ranges before. Entries of equal names come by the further columns ``by``."""
    ranked = entries.withColumns({f"_o{i}": c for i, c in enumerate(entry_order())})
    ranges = Ranges(ranked, ["stream_id"], ["_o0", "_o1", "_o2", *by], partitions).with_running("seq", "sum", F.lit(1).cast("long"))
    return ranges.done().select(*entries.columns, *([] if "seq" in entries.columns else ["seq"]))


def manifest_order(entries: DataFrame) -> DataFrame:
    """Streams by id, entries by seq, then id."""
    return entries.orderBy("stream_id", "seq", "file_id")


def filter_names(entries: DataFrame, regex: str) -> DataFrame:
    """Files and links whose name the regex finds; directories always stay. Apply before checksums.

    Java syntax; use only what POSIX extended expressions have for the same result there.
    """
    return entries.filter((F.col("kind") == 2) | F.col("name").rlike(regex))


def union_streams(*manifests: DataFrame) -> DataFrame:
    """Streams of several manifests in one; the first manifest that has a stream gives it."""
    ranked = [m.withColumn("_m", F.lit(i)) for i, m in enumerate(manifests)]
    every = ranked[0]
    for m in ranked[1:]:
        every = every.unionByName(m, allowMissingColumns=True)
    first = every.groupBy("stream_id").agg(F.min("_m").alias("_m"))
    return every.join(first, ["stream_id", "_m"], "left_semi").drop("_m")


def distinct_roots(entries: DataFrame) -> DataFrame:
    return entries.select("stream_id", "root").dropDuplicates()


def totals(entries: DataFrame) -> DataFrame:
    """stream_id, kind, entries, bytes, with grouped totals (null stream, null kind)."""
    return entries.rollup("stream_id", "kind").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def nested(entries: DataFrame) -> DataFrame:
    """One row for each stream with its entries as an ordered array; a stream's entries must fit a row."""
    item = F.struct("seq", "file_id", "kind", "name", "link_target", "size", "checksum")
    return entries.groupBy("manifest_id", "stream_id", "root").agg(F.array_sort(F.collect_list(item)).alias("entries"))


def flat(nested_: DataFrame) -> DataFrame:
    rows = nested_.select("manifest_id", "stream_id", "root", F.inline("entries"))
    return rows.select(*[c.split()[0] for c in ENTRIES.replace("struct<algo:int,offset:bigint,len:bigint,value:binary>", "struct").split(", ")])


def save_manifest(entries: DataFrame, path: str) -> None:
    entries.write.partitionBy("stream_id").mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(path)
