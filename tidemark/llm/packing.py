"""Best-fit packing of token ids, after Martello and Toth's dominance reduction.

A document is its ids and one end id; longer ones are cut into full pieces and a rest. The packing
needs only how many pieces have each length, at most ``room`` numbers whatever the input, so it is
planned on that table: sets of one, two or three lengths that provably dominate every other set
with their longest member are fixed for as many sequences as there are pieces for; what remains is
packed best-fit decreasing, in bulk. Pieces then find their sequence and place from their rank
among the pieces of their length.

Defined cases: a null or empty text is the end id alone; repeated rows are packed again; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, settle, sliced, stash
from tidemark.llm.tokens import encoder

Group = tuple[tuple[tuple[int, int], ...], int]  # ((length, times in a sequence), ...), number of sequences


def pieces(docs: DataFrame, room: int, end: int, vocabulary: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth (among the part's pieces of that length)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, words = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64), encoder(vocabulary)
        for batch in sliced(batches, limit=1 << 23):
            out = []
            ids, sizes = words.encode(batch.column("text"), end)
            data, at = memoryview(ids.astype("<u4").tobytes()), 0
            for doc_id, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                for start in range(0, size, room):
                    n = min(room, size - start)
                    out.append((doc_id, start // room, start, n, zlib.crc32(data[4 * (at + start) : 4 * (at + start + n)]), part, seen[n]))
                    seen[n] += 1
                at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        words.clear()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


def reduced(counts: dict[int, int], room: int) -> tuple[list[Group], dict[int, int]]:
    """Sequences that the dominance criterion fixes, and the counts that it leaves."""
    left = {k: n for k, n in counts.items() if n}
    fixed: list[Group] = []

    def fix(*lengths: int) -> None:
        uses = {k: lengths.count(k) for k in lengths}
        times = min(left[k] // n for k, n in uses.items())
        fixed.append((tuple(uses.items()), times))
        for k, n in uses.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]

    for longest in sorted(left, reverse=True):
        while left.get(longest):
            gap = room - longest
            spare = {k: n - (k == longest) for k, n in left.items() if n > (k == longest)}
            small: list[int] = []  # the three smallest others
            for k in sorted(spare):
                small += [k] * min(3 - len(small), spare[k])
                if len(small) == 3:
                    break
            if not small or small[0] > gap:  # nothing fits beside it
                fix(longest)
                continue
            one = max(k for k in spare if k <= gap)
            if one == gap or len(small) < 2 or small[0] + small[1] > gap:  # no pair beside it holds more
                fix(longest, one)
                continue
            if len(small) == 3 and sum(small) <= gap:
                break
            best, most = (0, 0), 0  # the best pair beside it, and the largest smaller member of any pair
            fits = sorted(k for k in spare if k <= gap)
            for b in fits:
                a = max((k for k in fits if k <= gap - b and k >= b and (k != b or spare[b] > 1)), default=0)
                if a:
                    most = max(most, b)
                    best = max(best, (a + b, a))
            a, b = best[1], best[0] - best[1]
            if one >= a + b:
                fix(longest, one)
            elif a == one and most <= b:
                fix(longest, a, b)
            else:
                break
    return fixed, left


def best_fit(left: dict[int, int], room: int) -> list[Group]:
    """Best-fit decreasing on counts: the fullest sequence with room takes pieces until it has none."""
    open_: dict[int, list[Group]] = {}
    for length in sorted(left, reverse=True):
        count = left[length]
        for gap in range(length, room + 1):
            while count and gap in open_:
                content, times = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                fit = gap // length
                full = min(times, count // fit)
                for content_, n, k in ((content, full, fit), (content, int(full < times and 0 < count - full * fit < fit), count - full * fit)):
                    if n:
                        open_.setdefault(gap - k * length, []).append(((*content_, (length, k)), n))
                        count -= n * k
                        times -= n
                if times:
                    open_.setdefault(gap, []).append((content, times))
            if not count:
                break
        if count:
            fit = room // length
            for n, k in ((count // fit, fit), (int(count % fit > 0), count % fit)):
                if n:
                    open_.setdefault(room - k * length, []).append((((length, k),), n))
    return [g for groups in open_.values() for g in groups]


def ranges(groups: list[Group]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, sequence, pieces in a sequence, offset), by first rank."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for content, times in groups:
        offset = 0
        for length, k in content:
            out.setdefault(length, []).append((used.get(length, 0), base, k, offset))
            used[length] = used.get(length, 0) + times * k
            offset += length * k
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def best_fit_packing(docs: DataFrame, room: int = 2048, end: int = 0, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, room, end, vocabulary or public_tokenizers.path("word_bpe_49k.json")), "pieces")
    parts = settle(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    fixed, left = reduced(counts, room)
    plan = spark.sparkContext.broadcast(ranges(fixed + best_fit(left, room)))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    n = int(length[own[0]])
                    first, base, k, at = plan.value[n].T
                    row = np.searchsorted(first, rank[own], "right") - 1
                    bin_, slot = np.divmod(rank[own] - first[row], k[row])
                    sequence[own], offset[own] = base[row] + bin_, at[row] + slot * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ranked = cut.join(starts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents, packed."""
    return best_fit_packing(docs)


QUERIES = {"op4_dominance_packing": op4_dominance_packing}
SQL: dict[str, str] = {}
