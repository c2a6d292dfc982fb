"""Tree listings by Spark jobs, level by level.

Each job lists the directories of one level, many at once, and writes the names that it found; the next
job takes up their directories. Names alone are read so, as the directory gives them; sizes, times and link
targets are read last, from names dealt out evenly. So a directory with very many names costs one task
only the reading of its names, and neither the driver nor a task holds a listing.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import written

_BATCH = 4096  # names of an Arrow batch
_FOUND = "stream_id bigint, root string, name string, kind int"
_LISTED = _FOUND + ", link_target string, size bigint, mtime bigint"
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _batches(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))])
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _names(skip: frozenset[str]):
    """The names in each directory, with 2 for a directory, 3 for a link and 1 for a file; what else there is, and what can't be read, is skipped."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for stream_id, root, name, _ in _rows(batches):
            try:
                with os.scandir(os.path.join(root, name)) as entries:
                    for e in entries:
                        if not name and e.name in skip:
                            continue
                        try:
                            e.name.encode()
                            kind = 3 if e.is_symlink() else 2 if e.is_dir(follow_symlinks=False) else 1 if e.is_file(follow_symlinks=False) else 0
                        except (OSError, UnicodeEncodeError):
                            continue
                        if kind:
                            yield stream_id, root, f"{name}/{e.name}" if name else e.name, kind
            except OSError:
                continue

    return lambda batches: _batches(found(batches), _FOUND)


def _details(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read() -> Iterator[tuple]:
        for stream_id, root, name, kind in _rows(batches):
            path = os.path.join(root, name)
            try:
                st = os.lstat(path)
                target = os.readlink(path) if kind == 3 else ""
                target.encode()
            except (OSError, UnicodeEncodeError):  # gone since
                continue
            if kind == (3 if stat.S_ISLNK(st.st_mode) else 2 if stat.S_ISDIR(st.st_mode) else 1):
                yield stream_id, root, name, kind, target, st.st_size if kind == 1 else 0, st.st_mtime_ns

    return _batches(read(), _LISTED)


def list_trees(roots: DataFrame, skip_top: Iterable[str] = (), per_task: int = 20_000) -> DataFrame:
    """stream_id, root, name, kind, link_target, size, mtime below each of the roots (stream_id, root); links aren't followed, ``skip_top`` names
    aren't entered at the top. About ``per_task`` names, or 64 directories, are a task's."""
    spark = roots.sparkSession
    frontier = roots.select(F.col("stream_id").cast("long"), "root", F.lit("").alias("name"), F.lit(2).alias("kind"))
    levels, directories = [], roots.count()
    while directories:
        tasks = max(1, -(-directories // 64))
        level = written(frontier.repartition(tasks).mapInArrow(_names(frozenset(skip_top)), _FOUND), "tree-level")
        levels.append(level)
        frontier = level.filter("kind = 2")
        directories = frontier.count()
    if not levels:
        return spark.createDataFrame([], _LISTED)
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    return every.repartition(max(1, -(-every.count() // per_task))).mapInArrow(_details, _LISTED)
