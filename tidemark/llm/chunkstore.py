"""Content-defined chunks: cut points by a rolling gear hash, digests, a store that keeps each chunk once.

The store is one Parquet table with two kinds of rows, in directories by ``kind``:

- ``doc``: a document's recipe, that is, the ordered list of its chunks' digests, lengths and
  whether the chunk is shared, the bytes of the chunks that are its own, and the root of the Merkle
  tree over the digests;
- ``chunk``: a chunk that several documents share, once, by digest.

Which chunks are shared is found by a Spark aggregation over digests alone. Writing tasks learn it
from a bitmap of ``1 << BITS`` bits over the digests' hashes, whose size doesn't grow; a chunk that
it takes for shared by accident is stored in a row of its own, which is right too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import seeds, sliced, stash

#: Bits of the bitmap of shared digests: 8 MB.
BITS = 26
BLOCK = 1 << 15
SALTS = 64
_RECIPE = "array<struct<digest:binary,len:int,shared:boolean>>"
_GEAR = seeds(256, "gear").astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash at every byte, over the last 32 bytes: h[i] = 2 * h[i - 1] + G[b[i]], in five doublings.

    Blocks that fit a core's cache are hashed one by one, each with the 31 bytes before it."""
    out = np.empty(len(data), np.uint32)
    for a in range(0, len(data), BLOCK):
        lead = min(a, 31)
        h = _GEAR[data[a - lead : a + BLOCK]]
        for step in (1, 2, 4, 8, 16):
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        out[a : a + BLOCK] = h[lead:]
    return out


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: int, least: int, bits: int, most: int) -> list[list[int]]:
    """For each payload data[start:end], the ends of its chunks. A cut follows a byte whose hash has
    ``bits`` zero bits, at least ``least`` and at most ``most`` bytes after the last, on whole units.

    ``least`` is over 32, so that bytes before a payload never matter.
    """
    hits = np.flatnonzero((gear(data) >> np.uint32(32 - bits)) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    out = []
    for a, b, lo, hi in zip(starts, ends, np.searchsorted(hits, starts), np.searchsorted(hits, ends, "right"), strict=True):
        own, at = [], a
        for h in hits[lo:hi]:
            h = a + (h - a + unit - 1) // unit * unit
            while h - at > most:
                at += most
                own.append(at)
            if h - at >= least and h < b:
                own.append(h)
                at = h
        while b - at > most:
            at += most
            own.append(at)
        if b > at:
            own.append(b)
        out.append(own)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    """Root over the digests in order: pairs are hashed together, an odd last one moves up."""
    level = digests or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def payload_chunks(payloads: list[bytes], unit: int, least: int, bits: int, most: int) -> list[list[bytes]]:
    """The chunks of each payload, in order."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.cumsum([len(p) for p in payloads]) if payloads else np.zeros(0, np.int64)
    starts = ends - np.array([len(p) for p in payloads], np.int64)
    whole = data.tobytes()
    out = []
    for a, own in zip(starts, cuts(data, starts, ends, unit, least, bits, most), strict=True):
        parts, at = [], int(a)
        for e in own:
            parts.append(whole[at:e])
            at = int(e)
        out.append(parts)
    return out


def _slot(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<u8") >> np.uint64(64 - BITS)


def shared_bitmap(digests: DataFrame) -> bytes:
    """Bitmap of the digests that occur in more than one row of digests (one column, digest)."""
    several = digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = _slot(batch.column("digest").to_pylist()).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["at", "word"])

    # No more rows than the bitmap has words, whatever the input.
    found = several.mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return bitmap.tobytes()


def cut_and_digested(payloads: list[bytes], *args: int) -> tuple[pa.Array, pa.Array]:
    """For each payload, its chunks' lengths and digests: columns ``lens`` and ``digests`` that spare ``write`` the cutting."""
    each = payload_chunks(payloads, *args)
    ends = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
    chunks = list(chain.from_iterable(each))
    return pa.ListArray.from_arrays(ends, pa.array(list(map(len, chunks)), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(list(map(digest, chunks)), pa.binary()))


def write(docs: DataFrame, keys: list[str], payload_of: Callable[[pa.RecordBatch], list[bytes]], path: str, unit: int = 1, least: int = 512, bits: int = 11, most: int = 8192, order: Column | None = None, then: tuple[str, ...] = ()) -> None:
    """Writes the payloads of docs into a store at path; ``keys`` are kept in the document rows.

    ``payload_of`` makes a batch's payloads; docs with ``lens`` and ``digests`` are cut already. With
    ``order``, document rows are dealt by that column (a partition number) and sorted by the keys and ``then``.
    """
    spark = docs.sparkSession
    args = (unit, least, bits, most)
    column = "text" if "text" in docs.columns else "payload"
    known = "digests" in docs.columns

    def cut(part: pa.RecordBatch) -> tuple[list[bytes], pa.Array, pa.Array]:
        """Payloads, and the lengths and digests of each one's chunks."""
        payloads = payload_of(part)
        return payloads, *((part.column("lens"), part.column("digests")) if known else cut_and_digested(payloads, *args))

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column):
            yield pa.RecordBatch.from_arrays([pa.array([d for ds in cut(part)[2].to_pylist() for d in set(ds)], pa.binary())], ["digest"])

    every = docs.select(F.explode(F.array_distinct("digests")).alias("digest")) if known else docs.mapInArrow(digests, "digest binary")
    bitmap = spark.sparkContext.broadcast(shared_bitmap(every))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    head = "".join(f"{k} {kinds[k].simpleString()}, " for k in keys)

    def split(part: pa.RecordBatch) -> tuple[list[bytes], pa.Array, np.ndarray, np.ndarray, pa.Array]:
        """Payloads, their recipes, the place of each one's first chunk among all (with the end), flags of shared chunks, digests."""
        bits_ = np.frombuffer(bitmap.value, np.uint64)
        payloads, lens, each = cut(part)
        first = np.cumsum([0, *pc.list_value_length(each).to_pylist()])
        lens, ds = lens.flatten(), each.flatten()
        at = _slot(ds.to_pylist())
        flags = ((bits_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        recipes = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([ds, lens, pa.array(flags)], ["digest", "len", "shared"]))
        return payloads, recipes, first, flags, ds

    def parted(payload: bytes, lens: list[int]) -> list[bytes]:
        ends = list(accumulate(lens))
        return [payload[e - n : e] for e, n in zip(ends, lens, strict=True)]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column):
            own, recipes, first, flags, ds = split(part)
            n_shared = np.diff(np.insert(np.cumsum(flags), 0, 0)[first])
            for k in np.flatnonzero(n_shared).tolist():
                lens = recipes[k].values.field("len").to_pylist()
                own[k] = b"".join(c for c, f in zip(parted(own[k], lens), flags[first[k] : first[k + 1]].tolist(), strict=True) if not f)
            ds, edges = ds.to_pylist(), first.tolist()
            roots = [ds[a] if b - a == 1 else merkle_root(ds[a:b]) for a, b in pairwise(edges)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keys), recipes, pa.array(own, pa.binary()), pa.array(roots, pa.binary()), pa.array(n_shared, pa.int32())],
                [*keys, "recipe", "own", "root", "n_shared"],
            )

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column):
            payloads, recipes, first, flags, _ = split(part)
            once = {}
            for k in np.flatnonzero(np.diff(np.insert(np.cumsum(flags), 0, 0)[first])).tolist():
                recipe = recipes[k].values
                once |= {d: c for d, c, f in zip(recipe.field("digest").to_pylist(), parted(payloads[k], recipe.field("len").to_pylist()), flags[first[k] : first[k + 1]].tolist(), strict=True) if f}
            yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.binary()), pa.array(list(once.values()), pa.binary())], ["digest", "bytes"])

    out = docs.mapInArrow(rows, f"{head}recipe {_RECIPE}, own binary, root binary, n_shared int")
    if order is not None:
        out = out.withColumn("_part", order)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartitionById(n, F.col("_part").cast("int")).sortWithinPartitions(*keys, *then).drop("_part")
    out.write.option("compression", "zstd").parquet(f"{path}/kind=doc")
    # Equal digests are stored once. A digest that very many tasks send meets in two steps: first among SALTS
    # groups of tasks, then what these have left.
    chunks = docs.mapInArrow(shared, "digest binary, bytes binary").withColumn("salt", F.spark_partition_id() % SALTS)
    chunks = chunks.groupBy("digest", "salt").agg(F.first("bytes").alias("bytes")).groupBy("digest").agg(F.first("bytes").alias("bytes"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/kind=chunk")


def read(spark, path: str, keys: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(document rows, shared chunks) of a store."""
    docs = spark.read.schema(f"{schema}, recipe {_RECIPE}, own binary, root binary, n_shared int").parquet(f"{path}/kind=doc")
    return docs, spark.read.schema("digest binary, bytes binary").parquet(f"{path}/kind=chunk")


def rebuilt(docs: DataFrame, chunks: DataFrame, keys: list[str], describe: Callable[[list[bytes], pa.ListArray], list[pa.Array]], schema: str, names: list[str]) -> DataFrame:
    """Payloads from a store, verified, described by ``describe(payloads, recipes)`` as columns.

    Documents without shared chunks are rebuilt where they are read. For the others, only the
    shared chunks travel: recipes meet them by digest, and a document's chunks are then gathered with
    its own bytes. Wrong digests, a wrong root or a missing chunk raise.
    """
    kinds = dict(docs.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in keys)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "own"):
            recipes = part.column("recipe")
            edges = np.cumsum([0, *pc.list_value_length(recipes).to_pylist()]).tolist()
            digests, lens, flags = (x.to_pylist() for x in recipes.flatten().flatten())
            payloads = []
            for (a, b), own, others, root in zip(pairwise(edges), part.column("own").to_pylist(), part.column("foreign").to_pylist(), part.column("root").to_pylist(), strict=True):
                lent = {o["digest"]: o["bytes"] for o in others or ()}
                pieces, at = [], 0
                for d, n, f in zip(digests[a:b], lens[a:b], flags[a:b], strict=True):
                    piece = lent.get(d) if f else own[at : at + n]
                    at += 0 if f else n
                    if piece is None or digest(piece) != d:
                        raise ValueError("a stored chunk is missing or differs from its digest")
                    pieces.append(piece)
                if (digests[a] if b - a == 1 else merkle_root(digests[a:b])) != root:
                    raise ValueError("a recipe differs from its Merkle root")
                payloads.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *describe(payloads, recipes)], [*keys, *names])

    cols = list(dict.fromkeys([*keys, "recipe", "own", "root"]))
    alone = docs.filter("n_shared = 0").select(*cols, F.expr("cast(null as array<struct<digest:binary,bytes:binary>>)").alias("foreign"))
    mixed = docs.filter("n_shared > 0")
    # A document is named by its keys and root: repeated rows are one to the join, and come back as often.
    name = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys], F.hex("root")), 256)
    wanted = mixed.select(name.alias("name"), F.explode(F.expr("array_distinct(transform(filter(recipe, c -> c.shared), c -> c.digest))")).alias("digest")).distinct()
    lent = wanted.join(chunks, "digest").groupBy("name").agg(F.collect_list(F.struct("digest", "bytes")).alias("foreign"))
    joined = mixed.withColumn("name", name).join(lent, "name", "left").select(*cols, "foreign")
    return alone.unionByName(joined).mapInArrow(finish, f"{head}{schema}")


def edges_of(rows: DataFrame, key: str, ranges: int) -> list:
    """Edges that part the key into about equal ranges."""
    found = rows.filter(F.col(key).isNotNull()).agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10000).alias("q")).first()["q"] if ranges > 1 else []
    return sorted(set(found or []))


def prefix_sums(rows: DataFrame, key: str, value: str, edges: list, then: tuple[str, ...] = ()) -> DataFrame:
    """rows, computed once, with ``part`` (range of the key) and ``start``: the sum of value over all rows before, by key, value and ``then``.

    Sums within a range start from the sums of the ranges before."""
    dealt = stash(rows.withColumn("part", range_of(key, edges)), "prefix-sums")
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = dealt.groupBy("part").agg(F.sum(value).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).select("part", "before")
    inner = Window.partitionBy("part").orderBy(F.asc_nulls_first(key), value, *then).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("before")


def range_of(key: str, edges: list) -> Column:
    """Number of the range of the key between sorted edges; null comes first."""
    if not edges:
        return F.lit(0)
    return F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(key))))
