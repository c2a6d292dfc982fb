"""Stored captures of length-prefixed frames as typed message rows; bad frames go to quarantine."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.ranges import chain
from tidemark.schemas import MESSAGES
from tidemark.shared import settle, written

# The frame header.
MAGIC, VERSION, HEADER, MOST = 0x59495359, 1, 12, 1 << 20


class Fields:
    """Little-endian fields of a body, in order."""

    def __init__(self, body: bytes):
        self.body, self.at = body, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.body):
            raise ValueError(f"a field needs {n} bytes, {len(self.body) - self.at} are left")
        self.at += n
        return self.body[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def blob(self) -> bytes:
        return self.take(self.number("I"))

    def text(self) -> str:
        return self.blob().decode()

    def checksum(self) -> dict:
        return {"algo": self.number("B"), "offset": self.number("q"), "len": self.number("q"), "value": self.blob()}

    def many(self, one) -> list:
        return [one() for _ in range(self.number("I"))]


def _entry(f: Fields) -> dict:
    return {"file_id": f.number("q"), "seq": f.number("q"), "kind": f.number("B"), "name": f.text(), "link_target": f.text(), "size": f.number("q"), "checksum": f.checksum()}


#: Each message's fields in order: a struct code, or s text, b bytes, c checksum. ``len`` is the payload's announced length.
_LAYOUT = {
    3: "stream_id:q seq:q file_id:q kind:B name:s link_target:s final_size:q prev_file_id:q prev_final_size:q prev_checksum:c",
    4: "stream_id:q seq:q file_id:q offset:q final_size:q raw_len:I len:I compression:B checksum_algo:B checksum:b payload:b",
    6: "stream_id:q got_seq:q expected_seq:q file_id:q offset:q expected_file_id:q expected_offset:q reason:B detail:s",
    7: "stream_id:q seq:q file_id:q name:s final_size:q chunk_size:q chunk_count:q file_checksum:c prev_file_id:q prev_final_size:q prev_checksum:c",
    8: "stream_id:q seq:q file_id:q chunk_index:q offset:q raw_len:I len:I compression:B checksum_algo:B checksum:b payload:b",
    9: "stream_id:q seq:q file_id:q",
    5: "stream_id:q next_seq:q file_id:q offset:q durable_offset:q recv_window_bytes:q",
    1: "node_id:s role:B min_version:H max_version:H feature_flags:q required_feature_flags:q chunk_size:I max_inflight_bytes:q",
    2: "manifest_id:q",
    10: "manifest_id:q",
}


def decode(kind: int, body: bytes) -> dict:
    """The fields of a message; raises ValueError where the body doesn't fit its type."""
    if kind not in _LAYOUT:
        raise ValueError(f"no message has type {kind}")
    f, out = Fields(body), {"msg_type": kind}
    for item in _LAYOUT[kind].split():
        name, code = item.split(":")
        out[name] = f.text() if code == "s" else f.blob() if code == "b" else f.checksum() if code == "c" else f.number(code)
    if kind == 5:
        out["received_chunks"] = f.many(lambda: {k: f.number("q") for k in ("seq", "file_id", "chunk_index")})
        out["missing_ranges"] = f.many(lambda: {k: f.number("q") for k in ("seq", "file_id", "first", "last")})
    elif kind == 1:
        out["supported_compression"], out["supported_checksum"] = f.many(lambda: f.number("B")), f.many(lambda: f.number("B"))
    elif kind == 2:
        out["streams"] = f.many(lambda: {"stream_id": f.number("q"), "root": f.text(), "entries": f.many(lambda: _entry(f))})
    elif kind == 10:
        out["starts"] = f.many(lambda: {"stream_id": f.number("q"), "action": f.number("B"), "start_file_id": f.number("q"), "start_offset": f.number("q")})
    if f.at != len(body):
        raise ValueError(f"{len(body) - f.at} bytes follow the last field")
    if "len" in out and out.pop("len") != len(out["payload"]):
        raise ValueError("the payload is not as long as it says")
    return out


def frame_size(head: bytes, left: int) -> int:
    """Bytes of the frame that starts with ``head``, of ``left`` bytes to the capture's end. EOFError where that can't be told, and so nothing after it."""
    if left < HEADER:
        raise EOFError(f"{left} bytes are left, a header has {HEADER}")
    header, n = struct.unpack_from("<HI", head, 6)
    if header != HEADER:
        raise EOFError(f"a header of {header} bytes, expected {HEADER}")
    if header + n > MOST:
        raise EOFError(f"a frame of {header + n} bytes, at most {MOST} are allowed")
    if header + n > left:
        raise EOFError(f"a body of {n} bytes, {left - header} are left")
    return header + n


def frames(data: bytes, at: int = 0, upto: int | None = None, base: int = 0, size: int | None = None) -> Iterator[tuple[int, dict | None, str | None]]:
    """(offset, message, error) of each frame that starts in [at, upto). A body that fails is one bad frame; a header that fails ends the capture, as what
    follows can't be told. ``data`` are the bytes from ``base`` on of a capture of ``size``, and hold the last of these frames whole."""
    size = len(data) if size is None else size
    while at < (size if upto is None else min(upto, size)):
        head = data[at - base : at - base + HEADER]
        try:
            n = frame_size(head, size - at)
        except EOFError as e:
            yield at, None, str(e)
            return
        try:
            magic, version, kind = struct.unpack_from("<IBB", head)
            if magic != MAGIC:
                raise ValueError(f"a frame starts with {magic:#x}, expected {MAGIC:#x}")
            if version != VERSION:
                raise ValueError(f"frame version {version}, expected {VERSION}")
            yield at, decode(kind, data[at - base + HEADER : at - base + n]), None
        except ValueError as e:
            yield at, None, str(e)
        at += n


def exits(data: bytes, start: int, step: int, size: int) -> Iterator[tuple[int, int]]:
    """(entry, exit) of the range of ``step`` bytes at ``start``: where the frames lead that would start at each place at which an earlier range's frames can end.

    ``data`` are the range's bytes and a header's more. A place is followed to the first frame beyond the range; places
    that lead to no frame, or to the capture's end, are left out.
    """
    raw = np.frombuffer(data, np.uint8)
    n = min(step, size - start)
    m = max(0, min(n, len(raw) - HEADER + 1))  # places with a whole header
    high = MOST >> 16  # the length's two upper bytes are this at most
    places = np.flatnonzero((raw[6 : 6 + m] == HEADER) & (raw[7 : 7 + m] == 0) & (raw[10 : 10 + m] <= high) & (raw[11 : 11 + m] == 0))
    sizes = HEADER + sum(raw[places + 8 + k].astype(np.int64) << (8 * k) for k in range(4))
    fits = (sizes <= MOST) & (places + sizes <= size - start)
    places, after = places[fits], (places + sizes)[fits].tolist()
    leads: dict[int, int] = {}
    for at, to in zip(reversed(places.tolist()), reversed(after), strict=True):
        out = to if to >= n else leads.get(to, -1)
        if out >= 0:
            leads[at] = out
    for at, to in leads.items():
        if (at == 0 if start == 0 else at < MOST) and start + to < size:
            yield start + at, start + to


class _Files:
    """Bytes of files by their URI, the last one kept open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, n: int) -> bytes:
        if uri != self.uri:
            system, path = fs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(n, offset)


def read_capture(spark: SparkSession, path: str, step: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(messages, quarantine) of capture files, frames numbered in each, as a parse from its first byte on gives them.

    A capture is read in ranges of ``step`` bytes (a frame's limit at least). As nothing marks a frame's start, a first pass finds, for every place of a range at which a frame
    may start, the place in a later range to which the chain of lengths leads from there; the chain from the first byte on, followed by doubling,
    says where each range really begins, and a second pass decodes it.
    """
    if step < MOST:
        raise ValueError(f"a range has {MOST} bytes at least")
    wanted = spark.createDataFrame([], MESSAGES)
    names = [f.name for f in wanted.schema.fields if f.name not in ("arrival", "line_id")]
    schema = f"path string, start bigint, k bigint, at bigint, error string, {MESSAGES.split(', ', 2)[2]}"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    rows_of = lambda batch: batch.to_pylist()  # noqa: E731  a few numbers for each range

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for row in (r for batch in batches for r in rows_of(batch)):
            found = list(exits(files.read(row["path"], row["start"], step + HEADER), row["start"], step, row["length"]))
            yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(found), pa.string()), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], names=["path", "node", "to"])

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for row in (r for batch in batches for r in rows_of(batch)):
            upto = row["start"] + step
            data = files.read(row["path"], row["at"], upto + MOST - row["at"])
            held, size = [], 0
            for k, (at, message, error) in enumerate(frames(data, row["at"], upto, row["at"], row["length"])):
                held.append({"path": row["path"], "start": row["start"], "k": k, "at": at, "error": error, **(message or {})})
                size += len((message or {}).get("payload") or b"") + 1000
                if size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = settle(spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0"))
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))))
    jumps = ranges.repartition(n, "path", "start").mapInArrow(follow, "path string, node bigint, to bigint")
    entries = chain(jumps, ["path"]).withColumnRenamed("_at", "at").union(files.select("path", F.lit(0).cast("long")))
    entries = entries.join(files, "path").withColumn("start", F.col("at") - F.col("at") % step)
    parsed = written(entries.repartition(n, "path", "start").mapInArrow(parse, schema), "capture")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = parsed.groupBy("path", "start").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = parsed.join(counts, ["path", "start"]).withColumn("arrival", F.col("before") + F.col("k"))
    return numbered.filter("error is null").select("path", "arrival", *names), numbered.filter("error is not null").select("path", "arrival", "at", "error")
