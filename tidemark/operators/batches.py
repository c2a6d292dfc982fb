"""Numbers of merged reports' batches: counts that start anew after each flush, over keys of any length.

Rows are dealt into ranges of (key, order), and these are read in blocks of a fixed number of rows. What an earlier block leaves open in a key changes where
the first flush of the next block falls, and nothing else: from each place on where that flush can be, the block alone tells the flushes
that follow. So a block is summed up by its possible first flushes, with the number of flushes after each and the counts that wait at the block's end;
these summaries, at most limit rows a stream and block, are put together key by key, and a second reading numbers the rows. Work grows with the rows, whatever the number of flushes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import settle

BITS = 17  # a block has two to the power of this rows at most


def _blocks(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.Table]:
    """The rows of each block (_row without its last bits), of a range in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("_row").to_numpy() >> bits
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column("_row")[0].as_py() >> bits != int(block[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _plain(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's numbers, and where it is null."""
    held = table.column(column).combine_chunks().cast(pa.int64())
    return pc.fill_null(held, 0).to_numpy(zero_copy_only=False), pc.is_null(held).to_numpy(zero_copy_only=False)


class _Block:
    """A block's rows: where keys begin, and for each row where a batch that starts with it ends (-1: not in this block)."""

    def __init__(self, table: pa.Table, keys: list[str], limit: int, interval: int | None):
        n = table.num_rows
        self.rows, self.limit = n, limit
        fresh = np.zeros(n, bool)
        fresh[0] = True
        for k in keys:
            for values in _plain(table, k):
                fresh[1:] |= values[1:] != values[:-1]
        self.starts = np.flatnonzero(fresh)
        self.ends = np.append(self.starts[1:], n)
        key = np.cumsum(fresh) - 1
        self.n, self.stream, gone = _plain(table, "n")[0], *_plain(table, "stream_id")
        self.stream_null = gone
        self.forced = _plain(table, "_flush")[0].astype(bool)
        self.tick = _plain(table, "arrival")[0] // interval if interval else np.zeros(n, np.int64)
        self.forced[:-1] |= (self.tick[1:] != self.tick[:-1]) & ~fresh[1:]
        none = n  # past the block
        end = np.where(self.forced, np.arange(n), none)
        if limit:
            by = np.lexsort((np.arange(n), self.stream, gone, key))
            total = np.cumsum(self.n[by])
            new = np.ones(n, bool)
            new[1:] = (key[by][1:] != key[by][:-1]) | (self.stream[by][1:] != self.stream[by][:-1]) | (gone[by][1:] != gone[by][:-1])
            last = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
            at = np.searchsorted(total, total - self.n[by] + limit)  # the first with as much, of this stream or a later one
            own = np.maximum(at, np.arange(n))
            reach = np.where(own < last, by[np.minimum(own, n - 1)], none)
            end[by] = np.minimum(end[by], reach)
        to = np.minimum.accumulate(end[::-1])[::-1]
        self.to = np.where(to < self.ends[key], to, -1)

    def name(self, i: int) -> int | None:
        return None if self.stream_null[i] else int(self.stream[i])

    def sums(self, a: int, b: int) -> list[tuple[int | None, int]]:
        """The counts of streams in rows a to b."""
        there = (self.n[a:b] != 0) & ~self.stream_null[a:b]
        values, which = np.unique(self.stream[a:b][there], return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, which, self.n[a:b][there])
        unnamed = int(self.n[a:b][self.stream_null[a:b]].sum())
        return [*zip(values.tolist(), total.tolist(), strict=True), *([(None, unnamed)] if unnamed else [])]

    def summary(self, a: int, b: int) -> dict:
        """Of a key's rows a to b: head (the rows at which a flush can be the first), for each what follows it, and the tails that wait at the end."""
        stop = int(self.to[a])
        of_head = np.arange(a, stop + 1 if stop >= 0 else b)
        of_head = of_head[(self.n[of_head] != 0) | self.forced[of_head]] if self.limit else of_head[self.forced[of_head]]
        followed, marks, tails = self._followed(of_head, a, b), [], []
        for i in of_head.tolist():
            marks.append((self.name(i), int(self.n[i]), bool(self.forced[i]), *followed[i]))
        waits = sorted({m[3] for m in marks})
        for q, until in zip(waits, [*waits[1:], b], strict=False):
            tails.append((q, self.sums(q, until)))
        return {"head": marks, "tails": tails, "all": self.sums(a, b) if self.limit else [], "end": b, "ticks": [int(self.tick[a]), int(self.tick[b - 1])]}

    def _followed(self, first: np.ndarray, a: int, b: int) -> dict[int, tuple[int, int]]:
        """For each first flush: where the rows that no later flush ends begin, and the number of flushes from it on."""
        if not len(first):
            return {}
        to, begin = self.to[a:b].tolist(), int(first[0]) + 1 - a
        rest, count = [b - a] * (b - a + 1), [0] * (b - a + 1)
        for i in range(b - a - 1, begin - 1, -1):
            t = to[i]
            if t < 0:
                rest[i] = i
            else:
                rest[i], count[i] = rest[t + 1 - a], count[t + 1 - a] + 1
        return {i: (rest[i + 1 - a] + a, count[i + 1 - a] + 1) for i in first.tolist()}

    def numbers(self, entry: dict | None) -> np.ndarray:
        """For each row the flushes of its key before it; entry is what comes in for the first key."""
        marks, ends, to = np.zeros(self.rows, np.int64), self.ends.tolist(), self.to.tolist()
        offset = np.zeros(self.rows, np.int64)
        for k, (i, end) in enumerate(zip(self.starts.tolist(), ends, strict=True)):
            if k == 0 and entry:
                offset[:end] = entry["count"]
                i = self._first(dict(entry["waits"]), end)
                if i < end:
                    marks[i] = 1
                i += 1
            while i < end and to[i] >= 0:
                marks[to[i]] = 1
                i = to[i] + 1
        before = np.cumsum(marks) - marks
        return before - np.repeat(before[self.starts], self.ends - self.starts) + offset

    def _first(self, waits: dict, end: int) -> int:
        stop = int(self.to[0])
        for i in range(stop + 1 if stop >= 0 else end):
            own = waits[self.name(i)] = waits.get(self.name(i), 0) + int(self.n[i])
            if self.forced[i] or (self.limit and own >= self.limit):
                return i
        return end


def _entries(pieces: list[tuple[int, dict]], limit: int, interval: int | None) -> Iterator[tuple[int, str]]:
    """(block, entry) for a key's pieces in order: the counts that wait when it begins, and the flushes before."""
    waits, fresh, tick, count = {}, True, None, 0
    for block, p in pieces:
        if interval and not fresh and tick != p["ticks"][0]:
            waits, fresh, count = {}, True, count + 1
        yield block, json.dumps({"waits": list(waits.items()), "count": count})
        reached = dict(waits)
        for stream, n, forced, rest, flushes in p["head"]:
            reached[stream] = reached.get(stream, 0) + n
            if forced or (limit and reached[stream] >= limit):
                waits = {}
                for q, sums in p["tails"]:
                    for s, m in sums if q >= rest else ():
                        waits[s] = waits.get(s, 0) + m
                fresh, count = rest == p["end"], count + flushes
                break
        else:
            for s, m in p["all"]:
                waits[s] = waits.get(s, 0) + m
            fresh = False
        tick = p["ticks"][1]


def numbered(rows: DataFrame, keys: list[str], order: list[str], limit: int, interval: int | None, bits: int = BITS) -> DataFrame:
    """rows (keys, stream_id, arrival, n, _flush, ...) with batch: how many flushes of the key come before each.

    A flush comes with a row whose _flush is true or that brings its stream's n since the last flush to limit (0: never), and after the last row before a multiple of interval in arrival.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *(c for c in order if c not in keys)]
    # A row's number holds its range and its place there, so that blocks are the same whenever they are read.
    kept = settle(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()))
    read = [*keys, *(c for c in ("stream_id", "arrival", "n", "_flush", "_row") if c not in keys)]
    kinds = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c in keys)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, bits):
            block = _Block(table, keys, limit, interval)
            at = sorted({0, len(block.starts) - 1})  # keys between these are whole
            spans = [(int(block.starts[k]), int(block.ends[k])) for k in at]
            first = table.take(pa.array([a for a, _ in spans])).select(keys).combine_chunks()
            found = [json.dumps(block.summary(a, b)) for a, b in spans]
            number = table.column("_row")[0].as_py() >> bits
            yield pa.RecordBatch.from_arrays([*(first.column(k).combine_chunks() for k in keys), pa.array([number] * len(spans), pa.int64()), pa.array(found)], names=[*keys, "_block", "piece"])

    def resolved(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("_block")
        told = [(b, json.loads(p)) for b, p in zip(pieces["_block"].tolist(), pieces["piece"], strict=True)]
        return pd.DataFrame(list(_entries(told, limit, interval))[1:], columns=["_block", "entry"])  # a key's first piece has nothing before it

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, bits):
            entry = table.column("entry")[0].as_py()
            batch = _Block(table, keys, limit, interval).numbers(json.loads(entry) if entry else None)
            yield from table.drop_columns(["entry", "_row"]).append_column("batch", pa.array(batch)).to_batches()

    pieces = kept.select(*read).mapInArrow(summed, f"{kinds}, _block long, piece string")
    entries = pieces.groupBy(*keys).applyInPandas(resolved, "_block long, entry string").select(F.shiftleft("_block", bits).alias("_row"), "entry")
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c != "_row") + ", batch long"
    return kept.join(F.broadcast(entries), "_row", "left").select(*[c for c in kept.columns if c != "_row"], "_row", "entry").mapInArrow(told, schema)
