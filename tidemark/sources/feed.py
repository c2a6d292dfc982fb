"""The change feed of a tree: a stream whose offsets name stored listings.

``spark.readStream.format("tree_changes")`` gives (change, path, old_size, new_size, at) for regular files. An
offset names a listing of the tree, kept in a folder as one sorted file for each bucket of paths; a batch is
the merge of two listings, bucket by bucket, each in a task. Whoever first reads a bucket of a new listing makes it, and its
file appears whole or not at all, so a batch that runs again, after a lost task or a restart, gives the
same changes. The driver handles offsets only: it lists neither the tree nor a listing. As listings are compared, removals count, and so do
files that arrive with an old time.

A bucket is chosen by the hash of a path's first two parts. Each task reads the names of these two levels,
and walks the directories that are its own; it holds one directory's names on each level at a time.
"""

from __future__ import annotations

import json
import os
import shutil
import stat
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Name of the directory for unfinished files; listings never enter it.
TEMP = ".tidemark-tmp"
CHANGES = "change string, path string, old_size bigint, new_size bigint, at bigint"
State = tuple[str, int, int]  # path, size, time


def _sorted_entries(path: str) -> list[os.DirEntry]:
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:  # gone, or not to be read
        return []


def _state(e: os.DirEntry, name: str) -> Iterator[State]:
    try:
        name.encode()
        st = e.stat(follow_symlinks=False)
        if stat.S_ISREG(st.st_mode):
            yield name, st.st_size, st.st_mtime_ns
    except (OSError, UnicodeEncodeError):
        return


def _walk(path: str, name: str) -> Iterator[State]:
    for e in _sorted_entries(path):
        below = f"{name}/{e.name}"
        if e.is_dir(follow_symlinks=False):
            yield from _walk(e.path, below)
        else:
            yield from _state(e, below)


def bucket_listing(root: str, bucket: int, buckets: int, exclude: tuple[str, ...] = ()) -> Iterator[State]:
    """The regular files of one bucket, in order of their paths' parts; links aren't followed."""
    own = lambda name: zlib.crc32(name.encode("utf-8", "surrogateescape")) % buckets == bucket
    for top in _sorted_entries(root):
        if top.name == TEMP or top.name in exclude:
            continue
        if not top.is_dir(follow_symlinks=False):
            yield from _state(top, top.name) if own(top.name) else ()
            continue
        for e in _sorted_entries(top.path):
            name = f"{top.name}/{e.name}"
            if own(name):
                yield from _walk(e.path, name) if e.is_dir(follow_symlinks=False) else _state(e, name)


def merged(old: Iterator[State], new: Iterator[State]) -> Iterator[tuple[str, str, int | None, int | None]]:
    """(change, path, old size, new size) of two listings in order."""
    parts = lambda s: s[0].split("/")
    a, b = next(old, None), next(new, None)
    while a or b:
        if b is None or (a is not None and parts(a) < parts(b)):
            yield "REMOVED", a[0], a[1], None
            a = next(old, None)
        elif a is None or parts(b) < parts(a):
            yield "CREATED", b[0], None, b[1]
            b = next(new, None)
        else:
            if b[1] > a[1]:
                yield "APPENDED", a[0], a[1], b[1]
            elif b[1:] != a[1:]:
                yield "MODIFIED", a[0], a[1], b[1]
            a, b = next(old, None), next(new, None)


class _Bucket(InputPartition):
    def __init__(self, number: int, start: dict, end: dict):
        self.number, self.start, self.end = number, start, end


class _FeedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.folder = options["path"], options["snapshots"]
        self.buckets, self.exclude = int(options.get("buckets", "32")), tuple(filter(None, options.get("exclude", "").split("/")))
        self.last = 0

    def initialOffset(self) -> dict:
        return {"at": 0, "buckets": self.buckets}

    def latestOffset(self) -> dict:
        """A new listing, made when its buckets are read. Later than any before, whatever the clock says."""
        self.last = max(time.time_ns(), self.last + 1, *(at + 1 for at in self._kept()))
        return {"at": self.last, "buckets": self.buckets}

    def partitions(self, start: dict, end: dict) -> list[_Bucket]:
        if start["buckets"] != end["buckets"]:
            raise ValueError(f"the stored listings have {start['buckets']} buckets, not {end['buckets']}")
        return [_Bucket(k, start, end) for k in range(end["buckets"])]

    def read(self, partition: _Bucket) -> Iterator[tuple]:
        start, end = partition.start["at"], partition.end["at"]
        path = self._file(end, partition.number)
        if not os.path.exists(path):
            self._store(path, bucket_listing(self.root, partition.number, self.buckets, self.exclude))
        for change in merged(self._load(start, partition.number), self._load(end, partition.number)):
            yield (*change, end)

    def commit(self, end: dict) -> None:
        """Listings before the last one are no longer needed."""
        for at in self._kept():
            if at < end["at"]:
                shutil.rmtree(os.path.join(self.folder, str(at)), ignore_errors=True)

    def _kept(self) -> list[int]:
        return [int(n) for n in (os.listdir(self.folder) if os.path.isdir(self.folder) else []) if n.isdigit()]

    def _file(self, at: int, bucket: int) -> str:
        return os.path.join(self.folder, str(at), f"{bucket}.jsonl")

    def _store(self, path: str, rows: Iterator[State]) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{path}.{os.getpid()}-{time.time_ns()}"
        with open(temp, "w", encoding="utf-8") as f:
            for row in rows:
                f.write(json.dumps(row) + "\n")
        try:
            os.link(temp, path)  # fails where another attempt was first, whose listing then counts
        except FileExistsError:
            pass
        finally:
            os.unlink(temp)

    def _load(self, at: int, bucket: int) -> Iterator[State]:
        if at == 0:
            return
        with open(self._file(at, bucket), encoding="utf-8") as f:
            for line in f:
                yield tuple(json.loads(line))


class ChangeFeed(DataSource):
    """spark.readStream.format("tree_changes").option("snapshots", folder).option("buckets", 32).option("exclude", "a/b").load(root)"""

    @classmethod
    def name(cls):
        return "tree_changes"

    def schema(self):
        return CHANGES

    def streamReader(self, schema):
        return _FeedReader(self.options)


def watch_tree(spark: SparkSession, root: str, snapshots: str, buckets: int = 32, exclude_top: tuple[str, ...] = ()) -> DataFrame:
    """A stream of changes (change, path, old_size, new_size, at) below root. ``snapshots`` is a folder outside root that all executors
    share; it belongs to one stream. The trigger's interval is the debounce: what changes within one is one change."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("tree_changes").option("snapshots", snapshots).option("buckets", buckets).option("exclude", "/".join(exclude_top)).load(root)
