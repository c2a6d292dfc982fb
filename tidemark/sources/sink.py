"""Files, links and directories below a root, written by Spark jobs.

Files are committed in two phases. Tasks write chunks into unfinished files of a folder that belongs to the
job; Spark combines and checks their sizes and checksums; then a plan of all names is written, and after
it a mark that the plan is whole. Only then do tasks give the files their names, by hard links, which
never replace a file. Whatever is killed, ``recover`` finishes a job whose plan is marked, however many of its names are there, and discards any
other, of which nothing was visible. A name that is taken undoes the whole plan: a file is the job's own if it is
the same file as the unfinished one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.functions.checksums import crc, crc32c_of_parts
from tidemark.shared import written
from tidemark.sources.feed import TEMP

_CHUNK = "file_id bigint, name string, size bigint, file_checksum binary, offset bigint, payload binary"
_PLAN, _MARK = "plan.jsonl", "planned"


def below(root: str, name: str) -> str:
    """The path of a name below root. A name that leads elsewhere, by its parts or by a link on its way or at its end, is an error."""
    parts = re.split("/+", name or "")
    if not name or any(p in ("", ".", "..") or "\0" in p for p in parts):
        raise ValueError(f"UNSAFE_NAME {name!r}")
    path = root
    for p in parts:
        path = os.path.join(path, p)
        if os.path.islink(path):
            raise ValueError(f"UNSAFE_NAME {name!r}: {path} is a link")
    return os.path.join(root, name)


def _part(job: str, name: str) -> str:
    return os.path.join(job, hashlib.sha1(name.encode()).hexdigest() + ".part")


def _put(job: str, root: str, name: str, offset: int, payload: bytes) -> None:
    below(root, name)
    fd = os.open(_part(job, name), os.O_WRONLY | os.O_CREAT | os.O_NOFOLLOW)
    try:
        os.pwrite(fd, payload, offset)
        os.fsync(fd)
    finally:
        os.close(fd)


def _give_name(job: str, root: str, name: str) -> None:
    """Does nothing where the name is given already, as by a task that was lost."""
    path, part = below(root, name), _part(job, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    try:
        os.link(part, path, follow_symlinks=False)
    except FileExistsError:
        if not os.path.samefile(part, path):
            raise FileExistsError(f"FILE_EXISTS {name}") from None


def _take_name(job: str, root: str, name: str) -> None:
    path, part = below(root, name), _part(job, name)
    if os.path.exists(path) and os.path.samefile(part, path):
        os.unlink(path)


def _for_each_name(names: DataFrame, act: Callable[[str], None]) -> None:
    names.select("name").foreachPartition(lambda rows: [act(r["name"]) for r in rows] and None)


def _plan(spark: SparkSession, job: str) -> DataFrame:
    return spark.read.schema("name string").json(f"file://{job}/{_PLAN}")


def _publish(spark: SparkSession, job: str, root: str) -> None:
    """Gives all planned names, or none."""
    names = _plan(spark, job)
    try:
        _for_each_name(names, lambda name: _give_name(job, root, name))
    except Exception:
        _for_each_name(names, lambda name: _take_name(job, root, name))
        shutil.rmtree(job, ignore_errors=True)
        raise
    shutil.rmtree(job)


def recover(spark: SparkSession, root: str, older_s: float = 0) -> None:
    """Finishes the jobs below root whose plan is marked, and discards the unfinished files of others that began ``older_s`` seconds ago or earlier. Call it when none of these runs."""
    temp = os.path.join(root, TEMP)
    for name in sorted(os.listdir(temp)) if os.path.isdir(temp) else []:
        job = os.path.join(temp, name)
        if os.path.exists(os.path.join(job, _MARK)):
            _publish(spark, job, root)
        elif time.time() - os.lstat(job).st_mtime >= older_s:
            shutil.rmtree(job, ignore_errors=True) if os.path.isdir(job) else os.unlink(job)


def _begin(root: str) -> str:
    job = os.path.join(root, TEMP, uuid.uuid4().hex)
    os.makedirs(job)
    return job


def write_files(spark: SparkSession, chunks: DataFrame, root: str) -> None:
    """Files from chunks (file_id, name, size, file_checksum, offset, payload): all of them become visible, or none.

    Chunks are dealt by file and offset, so a large file is many tasks'. Each file must be there without gap or overlap, of its size and, if it has one, of its checksum,
    and its name must be free. Jobs on one root don't disturb each other; ``recover`` cleans up after those that were killed.
    """
    job = _begin(root)
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                payloads = batch.column("payload").to_pylist()
                for name, offset, payload in zip(*(batch.column(c).to_pylist() for c in ("name", "offset")), payloads, strict=True):
                    _put(job, root, name, offset, payload)
                crcs = crc(payloads).tolist()  # all at once: short payloads cost little more than their bytes
                lengths = pa.array([len(p) for p in payloads], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("size"), batch.column("file_checksum"), batch.column("offset"), lengths, pa.array(crcs, pa.int64())], names=["name", "size", "file_checksum", "offset", "len", "value"])

        dealt = chunks.select(*[c.split()[0] for c in _CHUNK.split(", ")]).repartitionByRange(n, "name", "offset").sortWithinPartitions("name", "offset")
        runs = written(dealt.mapInArrow(put, "name string, size bigint, file_checksum binary, offset bigint, len bigint, value bigint"), "sink-runs")
        bad = _faults(runs).limit(1).collect()
        if bad:
            raise ValueError(f"CHECKSUM_MISMATCH {bad[0]['name']}")
        names = runs.select("name").distinct()
        names.write.mode("overwrite").json(f"file://{job}/{_PLAN}")
        mark = os.path.join(job, _MARK)
        with open(mark + ".new", "w") as f:
            f.write(json.dumps({"root": root}))
            f.flush()
            os.fsync(f.fileno())
        os.rename(mark + ".new", mark)
    except BaseException:
        shutil.rmtree(job, ignore_errors=True)
        raise
    _publish(spark, job, root)


def _faults(runs: DataFrame) -> DataFrame:
    """name of each file whose chunks (offset, len, value) aren't the whole of it once, or haven't its checksum.

    Chunks tile a file if their sizes sum up to its own, and their beginnings and its end are their ends and 0; these sets are compared by sums of hashes.
    """
    hashed = lambda c: F.xxhash64(c).cast("decimal(38,0)")
    files = ["name", "size", "file_checksum"]
    sums = runs.groupBy(*files).agg(F.sum("len").alias("n"), F.sum(hashed(F.col("offset")) - hashed(F.col("offset") + F.col("len"))).alias("ends"))
    whole = crc32c_of_parts(runs, files, F.col("value"), F.greatest(F.col("size") - F.col("offset") - F.col("len"), F.lit(0).cast("long")))
    both = sums.join(whole.select(*[F.col(c).alias(f"_{c}") for c in files], "checksum"), F.expr("name = _name and size <=> _size and file_checksum <=> _file_checksum"))
    tiled = (F.col("n") == F.col("size")) & (F.col("ends") == hashed(F.lit(0).cast("long")) - hashed(F.col("size")))
    same = F.col("file_checksum").isNull() | (F.col("size") == 0) | (F.col("file_checksum") == F.col("checksum"))
    return both.filter(~F.coalesce(tiled & same, F.lit(False))).select("name")


class _Done(WriterCommitMessage):
    def __init__(self, names: list[tuple]):
        self.names = names


class _TreeWriter(DataSourceWriter):
    """As write_files, for writes that come by the data source's name: a Python data source commits on the driver, so this is for files in moderate number."""

    def __init__(self, options):
        self.root = options["path"]
        self.job = _begin(self.root)

    def write(self, iterator):
        sizes: dict[tuple, int] = {}
        for row in iterator:
            r = row.asDict()
            _put(self.job, self.root, r["name"], r["offset"], bytes(r["payload"]))
            key = (r["name"], r["size"], None if r["file_checksum"] is None else bytes(r["file_checksum"]))
            sizes[key] = sizes.get(key, 0) + len(r["payload"])
        return _Done([(*k, n) for k, n in sizes.items()])

    def commit(self, messages):
        wanted: dict[tuple, int] = {}
        for *key, n in (p for m in messages if m for p in m.names):
            wanted[tuple(key)] = wanted.get(tuple(key), 0) + n
        given = []
        try:
            for (name, size, checksum), n in wanted.items():
                if n != size or os.path.getsize(_part(self.job, name)) != size or (checksum is not None and size and _crc_of(_part(self.job, name)) != checksum):
                    raise ValueError(f"CHECKSUM_MISMATCH {name}")
            for name, *_ in wanted:
                _give_name(self.job, self.root, name)
                given.append(name)
        except BaseException:
            for name in given:
                _take_name(self.job, self.root, name)
            raise
        shutil.rmtree(self.job)

    def abort(self, messages):
        shutil.rmtree(self.job, ignore_errors=True)


def _crc_of(path: str) -> bytes:
    from tidemark.sources.tree import read_crc

    with open(path, "rb") as f:
        return read_crc(f, os.path.getsize(path))


class TreeSink(DataSource):
    """df.write.format("tree_sink").mode("append").save(root), df of (file_id, name, size, file_checksum, offset, payload)."""

    @classmethod
    def name(cls):
        return "tree_sink"

    def schema(self):
        return _CHUNK

    def writer(self, schema, overwrite):
        return _TreeWriter(self.options)


def append_segments(segments: DataFrame) -> None:
    """Appends segments (root, name, offset, payload) in order; each must start at its file's length. Bytes of a segment
    that are there already, as after a task that was lost, must be equal and aren't written again."""

    def append(rows) -> None:
        for r in rows:
            data, offset = bytes(r["payload"]), r["offset"]
            fd = os.open(below(r["root"], r["name"]), os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o666)
            with os.fdopen(fd, "r+b") as f:
                at = os.fstat(fd).st_size
                there = b""
                if offset < at:
                    f.seek(offset)
                    there = f.read(len(data))
                if offset > at or data[: len(there)] != there:
                    raise ValueError(f"BAD_OFFSET {r['name']}: {offset} at length {at}")
                f.seek(at)
                f.write(data[len(there) :])

    segments.repartition("root", "name").sortWithinPartitions("root", "name", "offset").foreachPartition(append)


def make_entries(entries: DataFrame) -> None:
    """Creates directories, then links, of entries (root, name, kind, link_target). A target that exists is an error, but
    for directories and for links that are as wanted, as after a task that was lost."""

    def directory(rows) -> None:
        for r in rows:
            os.makedirs(below(r["root"], r["name"]), exist_ok=True)

    def link(rows) -> None:
        for r in rows:
            path = os.path.join(r["root"], r["name"])
            if os.path.islink(path) and os.readlink(path) == r["link_target"]:
                below(r["root"], os.path.dirname(r["name"]) or "x")
                continue
            path = below(r["root"], r["name"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            os.symlink(r["link_target"], path)

    entries.filter("kind = 2").foreachPartition(directory)
    entries.filter("kind = 3").foreachPartition(link)
