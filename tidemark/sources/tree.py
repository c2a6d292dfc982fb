"""File trees as tables: scanning, checksums, reading ranges. Writing is in ``sink``.

``tree`` reads local paths, so executors must see the tree through a shared mount.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.checksums import TAIL, crc, crc32c_of_parts, crc_bytes
from tidemark.operators.manifest import filter_names, identified, sequenced_wide
from tidemark.sources.feed import TEMP
from tidemark.sources.frontier import list_trees

SHORT = 1 << 20  # ranges of up to so many bytes are summed together, longer ones in parts
LISTING = "name string, kind int, link_target string, size bigint, mtime bigint"


def listing(root: str, under: str = "", exclude_top: tuple[str, ...] = (), deep: bool = True) -> Iterator[tuple]:
    """(name, kind, link_target, size, mtime) below root/under; links aren't followed, what can't be read is skipped."""
    try:
        found = sorted(os.scandir(os.path.join(root, under)), key=lambda e: e.name)
    except OSError:
        return
    for e in found:
        if not under and (e.name in exclude_top or e.name == TEMP):
            continue
        name = f"{under}/{e.name}" if under else e.name
        try:
            name.encode()
            st = e.stat(follow_symlinks=False)
            if stat.S_ISLNK(st.st_mode):
                yield name, 3, os.readlink(e.path), 0, st.st_mtime_ns
            elif stat.S_ISDIR(st.st_mode):
                yield name, 2, "", 0, st.st_mtime_ns
                if deep:
                    yield from listing(root, name, exclude_top)
            elif stat.S_ISREG(st.st_mode):
                yield name, 1, "", st.st_size, st.st_mtime_ns
        except (OSError, UnicodeEncodeError):
            continue


class _Part(InputPartition):
    def __init__(self, root: str, under: str, deep: bool):
        self.root, self.under, self.deep = root, under, deep


class _TreeReader(DataSourceReader):
    """The driver lists the top level only; each of its directories is a partition, read by a task."""

    def __init__(self, options):
        self.root, self.exclude = options["path"], tuple(filter(None, options.get("exclude", "").split("/")))

    def partitions(self):
        tops = [n for n, kind, *_ in listing(self.root, "", self.exclude, deep=False) if kind == 2]
        return [_Part(self.root, "", False), *(_Part(self.root, t, True) for t in tops)]

    def read(self, partition):
        yield from listing(partition.root, partition.under, self.exclude, partition.deep)


class TreeSource(DataSource):
    """spark.read.format("tree").option("exclude", "a/b").load(root). For changes see ``feed``, for trees of uneven shape ``frontier``."""

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return _TreeReader(self.options)


def _scanned(spark: SparkSession, roots: list[tuple[int, str]], regex: str | None = None, exclude_top: tuple[str, ...] = (), checksum: bool = True, max_len: int = TAIL) -> DataFrame:
    rows = list_trees(spark.createDataFrame(roots, "stream_id long, root string"), (TEMP, *exclude_top)).drop("mtime")
    rows = filter_names(rows, regex) if regex else rows
    rows = sequenced_wide(identified(rows.withColumn("manifest_id", F.lit(1).cast("long"))))
    rows = with_checksums(rows, max_len) if checksum else rows.withColumn("checksum", F.lit(None).cast("struct<algo:int,offset:bigint,len:bigint,value:binary>"))
    return rows.select("manifest_id", "stream_id", "root", "seq", "file_id", "kind", "name", "link_target", "size", "checksum")


def scan_tree(spark: SparkSession, root: str, stream_id: int, **how) -> DataFrame:
    """A stream's manifest entries, in order, with checksums of their last max_len bytes. An absent root has none.

    ``how``: regex (names are filtered before any byte is read), exclude_top, checksum, max_len.
    """
    return _scanned(spark, [(stream_id, root)], **how)


def scan_roots(spark: SparkSession, roots: list[tuple[int, str]], base: str | None = None, **how) -> DataFrame:
    """Entries of several roots (stream_id, root), listed together. Of equal stream ids the first is taken. Without roots, numeric directories of base are streams, else base is stream 9001."""
    once: dict[int, str] = {}
    for stream_id, root in roots:
        once.setdefault(stream_id, root)
    if not once and base:
        dirs = [d for d in sorted(os.listdir(base)) if d.isdigit() and os.path.isdir(os.path.join(base, d))] if os.path.isdir(base) else []
        once = {int(d): os.path.join(base, d) for d in dirs} or {9001: base}
    if not once:
        raise ValueError("no roots are given")
    return _scanned(spark, sorted(once.items()), **how)


def with_checksums(entries: DataFrame, max_len: int | None = TAIL, step: int = 8 << 20) -> DataFrame:
    """entries (root, name, kind, size) with the checksum of each file's last max_len bytes (None: whole); algorithm 0 when empty.

    Files are read in ranges of ``step`` bytes, dealt out evenly, whose checksums combine: a large file is many tasks'.
    """
    files = entries.filter("kind = 1 and size > 0").select("root", "name", "size").distinct()
    first = F.greatest(F.col("size") - max_len, F.lit(0)).cast("long") if max_len else F.lit(0).cast("long")
    ranges = files.withColumn("offset", F.explode(F.sequence(first, F.col("size") - 1, F.lit(step).cast("long"))))
    ranges = ranges.withColumn("len", F.least(F.lit(step), F.col("size") - F.col("offset")).cast("long"))
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, short, held = [0] * batch.num_rows, {}, 0
            for i, (root, name, offset, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "name", "offset", "len")), strict=True)):
                with open(os.path.join(root, name), "rb") as f:
                    f.seek(offset)
                    if length > SHORT:
                        found[i] = int.from_bytes(read_crc(f, length), "little")
                        continue
                    short[i], held = f.read(length), held + length
                if len(short[i]) != length:
                    raise OSError("a file ended before its size")
                if held >= SHORT:
                    _many(short, found)
                    short, held = {}, 0
            _many(short, found)
            yield batch.append_column("value", pa.array(found, pa.int64()))

    schema = "root string, name string, size bigint, offset bigint, len bigint, value bigint"
    read = ranges.repartition(n, "root", "name", "offset").mapInArrow(add, schema)
    whole = crc32c_of_parts(read, ["root", "name", "size"], F.col("value"), F.col("size") - F.col("offset") - F.col("len"))
    whole = whole.select(F.col("root").alias("_root"), F.col("name").alias("_name"), F.col("checksum").alias("_value"), F.col("len").alias("_len"), F.col("size").alias("_size"))
    joined = entries.join(whole, (F.col("root") == F.col("_root")) & (F.col("name") == F.col("_name")) & (F.col("size") == F.col("_size")) & (F.col("kind") == 1), "left")
    there, zero = F.col("_value").isNotNull(), F.lit(0).cast("long")
    checksum = F.struct(F.when(there, 1).otherwise(0).alias("algo"), F.when(there, F.col("size") - F.col("_len")).otherwise(zero).alias("offset"), F.when(there, F.col("_len")).otherwise(zero).alias("len"), F.coalesce("_value", F.lit(b"")).alias("value"))
    return joined.withColumn("checksum", checksum).select(*[c for c in entries.columns if c != "checksum"], "checksum")


def _many(held: dict[int, bytes], found: list[int]) -> None:
    """The checksums of short ranges, all at once, in their places."""
    for i, value in zip(held, crc(list(held.values())).tolist(), strict=True):
        found[i] = value


def read_crc(f, n: int, step: int = 1 << 20) -> bytes:
    total, done = b"\0\0\0\0", 0
    while done < n:
        block = f.read(min(step, n - done))
        if not block:
            raise OSError("a file ended before its size")
        total, done = _joined(total, crc_bytes(block), len(block)), done + len(block)
    return total


def read_ranges(ranges: DataFrame) -> DataFrame:
    """ranges (root, name, offset, len, ...) with payload, read last, so that no shuffle carries it. A range outside its file is an error."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                root, name, offset, n = (row.column(c)[0].as_py() for c in ("root", "name", "offset", "len"))
                with open(os.path.join(root, name), "rb") as f:
                    f.seek(offset)
                    data = f.read(n)
                if len(data) != n:
                    raise ValueError(f"range {offset}+{n} is outside {name}")
                yield row.append_column("payload", pa.array([data], pa.binary()))

    return ranges.mapInArrow(read, ", ".join(f"`{c}` {t}" for c, t in ranges.dtypes) + ", payload binary")


def _joined(first: bytes, then: bytes, n: int) -> bytes:
    """The checksum of two runs of bytes from theirs; n is the length of the second."""
    import numpy as np

    from tidemark.functions.checksums import combine

    a, b = (np.array([int.from_bytes(x, "little")], np.uint32) for x in (first, then))
    return int(combine(a, b, np.array([n]))[0]).to_bytes(4, "little")
