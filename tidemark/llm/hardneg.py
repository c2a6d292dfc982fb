"""Hard negatives from candidate blocks in the order of a Hilbert curve, with zone maps.

Rows become integer vectors. Their place on a Hilbert curve through the dimensions of largest variance
orders the table, so that near rows lie in one block. A block is a Parquet row: its vectors packed as
bytes, and beside them, in columns of their own, the least and largest value of each dimension (the zone
map). Anchors are packed in the same order.

The inner product of an anchor and any row of a block lies between two sums over the zone map
(interval arithmetic: of each dimension the smaller and the larger product). A first pass over the zone maps
alone finds for each anchor the blocks that can hold one of its first positives, given those of its own block; only these
are read. A second pass finds the blocks whose bounds meet one of the anchor's score windows. Packs and blocks meet in
groups of bounded size, a pack with a range of the curve, so neither a common vector nor a common label
makes a task large. All of it is exact: bounds only skip blocks that can't matter. Where no direction
stands out, as with vectors that are spread evenly in many dimensions, every bound stays wide and every block is read.

Defined cases: rows without vec_id, label or vector, or with a null, a NaN or an infinity in it, take no
part; shorter vectors count as filled up with zeros; rows that repeat a vec_id are rows of their own, as
anchors and as candidates, and an anchor's own row alone is not its positive; a positive score below 0 has an
empty window; integers beyond 2^31, or inner products beyond 64 bits, raise; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stash
from tidemark.llm.whitening import as_integers, usable

CURVE_DIMS, CURVE_BITS = 15, 4  # of the curve; together at most 63
BLOCK = 512  # rows of a block at most
RANGE = 65_536  # rows of a range of the curve, about
PACK = 16_384  # anchors of a pack at most
_CHUNK = 2048  # anchors that meet a block at once
_TYPES = {2: np.int16, 4: np.int32}
_PACKED = "n int, dims int, width int, ids binary, labels binary, x binary"
_MET = "pack long, anchor int, window int, anchor_id long, positive_id long, positive_score long, score long, id long"


def curve_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates below 2^bits, a row each."""
    x = cells.astype(np.int64).T.copy()
    for bit in reversed(range(1, bits)):
        high, low = 1 << bit, (1 << bit) - 1
        for row in x:  # nothing is swapped for the first
            turned = (row & high) != 0
            swap = np.where(turned, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(turned, low, swap)
            row ^= swap
    for before, row in zip(x[:-1], x[1:], strict=True):
        row ^= before
    flips = np.zeros_like(x[0])
    for bit in reversed(range(1, bits)):
        flips ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= flips
    key = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for row in x:
            key = key << 1 | (row >> bit & 1)
    return key


@dataclass
class Packed:
    """Rows of a block or a pack."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Packed:
        x = np.frombuffer(row["x"], _TYPES[row["width"]]).reshape(row["n"], row["dims"])
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), x)

    def row(self) -> dict:
        width = 2 if not self.x.size or np.abs(self.x).max() < 1 << 15 else 4
        return {"n": len(self.ids), "dims": self.x.shape[1], "width": width, "ids": self.ids.astype(np.int64).tobytes(), "labels": self.labels.astype(np.int64).tobytes(), "x": self.x.astype(_TYPES[width]).tobytes()}


def _exact(bound: int) -> type:
    """The fastest number type in which sums up to the bound are exact."""
    if bound >= 1 << 63:
        raise OverflowError("inner products beyond 64 bits")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def _peak(x: np.ndarray) -> int:
    return int(np.abs(x.astype(np.int64)).max()) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact."""
    kind = _exact(a.shape[1] * _peak(a) * _peak(b))
    return a.astype(kind) @ b.astype(kind).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of a with any vector between low and high (a row for each block)."""
    kind = _exact(a.shape[1] * _peak(a) * max(_peak(low), _peak(high)))
    up, down = np.maximum(a, 0).astype(kind), np.minimum(a, 0).astype(kind)
    low, high = low.astype(kind).T, high.astype(kind).T
    return up @ low + down @ high, up @ high + down @ low


class Firsts:
    """The first ``most`` (score, id) of each slot, larger scores first, ties by smaller id; offers may come in any order."""

    def __init__(self, slots: int, most: int, least: np.ndarray):
        self.most, self.least = most, least.copy()  # what a further offer must score
        self.kept = np.zeros((3, 0), np.int64)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(slot):
            self.waiting.append(np.array([slot, score.astype(np.int64), ids]))
            self.n += len(slot)
            if self.n > 20_000 + self.kept.shape[1]:
                self.settle()

    def settle(self) -> np.ndarray:
        if self.waiting:
            rows = np.concatenate([self.kept, *self.waiting], axis=1)
            rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
            first = np.flatnonzero(np.diff(rows[0], prepend=-1))
            rank = np.arange(rows.shape[1]) - np.repeat(first, np.diff(np.append(first, rows.shape[1])))
            self.kept = rows[:, rank < self.most]
            full = rows[:, rank == self.most - 1]
            self.least[full[0]] = np.maximum(self.least[full[0]], full[1])
            self.waiting, self.n = [], 0
        return self.kept


def _records(rows: Iterable[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x of the rows that take part; where vec_id is divisible by 7 the label is the next of ten."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    label = F.col("label").cast("long")
    return rows.select(F.col("vec_id").cast("long"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), as_integers("embedding").alias("x"))


def blocks(rows: DataFrame, every: int) -> tuple[DataFrame, int, int]:
    """The written blocks (part, block, low, high, anchors, and the packed rows), their ranges' number, and the number of anchors."""
    spark = rows.sparkSession
    rows = stash(rows, "hard-rows")
    d, n, anchors = rows.agg(F.max(F.size("x")), F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    d = d or 0
    moments = [f(F.coalesce(F.get("x", i), F.lit(0)).cast("double")) for i in range(d) for f in (F.avg, F.stddev_pop)]
    moments = np.array(rows.agg(*moments).first() if d and n else [], float).reshape(-1, 2)
    axes = np.sort(np.argsort(-moments[:, 1], kind="stable")[:CURVE_DIMS])
    mean, spread = moments[axes, 0], np.maximum(moments[axes, 1], 1e-9)

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _filled(batch.column("x"), d)
            cells = np.clip((x[:, axes] - mean) / spread * 2 ** (CURVE_BITS - 2) + 2 ** (CURVE_BITS - 1), 0, 2**CURVE_BITS - 1).astype(np.int64)
            yield batch.append_column("key", pa.array(curve_keys(cells, CURVE_BITS) if len(axes) else np.zeros(len(x), np.int64)))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for rows_ in _regrouped(batches, BLOCK):
            x = _filled(rows_.column("x"), d)
            if _peak(x) >= 1 << 31:
                raise OverflowError("vectors hold integers beyond 32 bits")
            held = Packed(rows_.column("vec_id").to_numpy(), rows_.column("label").to_numpy(), x)
            found = {"part": part, "block": part << 24 | block, "low": x.min(0).tolist(), "high": x.max(0).tolist(), "anchors": int((held.ids % every == 0).sum())}
            yield _records([found | held.row()], _arrow(schema))
            block += 1

    # Ranges are smaller than RANGE only where there would be fewer of them than the session's shuffles have partitions.
    parts = max(-(-n // RANGE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * BLOCK))), 1)
    schema = f"part long, block long, low array<long>, high array<long>, anchors int, {_PACKED}"
    ordered = rows.mapInArrow(keyed, "vec_id long, label long, x array<long>, key long")
    # The hash deals out rows with equal vectors.
    ordered = ordered.withColumn("tie", F.xxhash64("vec_id")).repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie", "vec_id")
    out = stash(ordered.select("vec_id", "label", "x").mapInArrow(packed, schema), "hard-blocks")
    return out, (out.agg(F.max("part")).first()[0] or 0) + 1, anchors


def _filled(column: pa.Array, d: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def _regrouped(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows, the last one smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table.slice(0, size).combine_chunks().to_batches()[0]
            held = table.slice(size).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packs(blocks_: DataFrame, anchors: int, every: int, most: int) -> DataFrame:
    """The written packs of anchors (pack, home: each one's block, place: in it, least: what a positive must score, and the packed rows)."""

    def taken(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = Packed.of(row)
                at = np.flatnonzero(held.ids % every == 0)
                scores = products(held.x[at], held.x)
                own = held.labels[at][:, None] == held.labels[None, :]
                own[np.arange(len(at)), at] = False
                for k, a in enumerate(at.tolist()):
                    near = np.sort(scores[k, own[k]])[::-1]
                    least = int(near[most - 1]) if len(near) >= most else -(1 << 63)
                    yield _records([{"block": row["block"], "place": a, "least": least, "id": int(held.ids[a]), "label": int(held.labels[a]), "x": held.x[a].astype(np.int64).tolist()}], _arrow(single))

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in enumerate(_regrouped(batches, PACK)):
            column = lambda name, rows=rows: rows.column(name).to_numpy()
            x = rows.column("x")
            held = Packed(column("id"), column("label"), x.flatten().to_numpy().reshape(len(x), -1))
            extra = {"pack": TaskContext.get().partitionId() << 24 | k, "home": column("block").tobytes(), "place": column("place").astype(np.int64).tobytes(), "least": column("least").tobytes()}
            yield _records([extra | held.row()], _arrow(schema))

    single = "block long, place int, least long, id long, label long, x array<long>"
    schema = f"pack long, home binary, place binary, least binary, {_PACKED}"
    each = stash(blocks_.filter("anchors > 0").select("block", *_columns()).mapInArrow(taken, single), "hard-anchors")
    ordered = each.repartitionByRange(max(1, -(-anchors // PACK)), "block", "place").sortWithinPartitions("block", "place")
    found = stash(ordered.mapInArrow(gathered, schema), "hard-packs")
    # Dense numbers: packs are few.
    numbered = found.select("pack").withColumn("number", F.row_number().over(Window.orderBy("pack")).cast("long") - 1)
    return stash(found.join(numbered, "pack").drop("pack").withColumnRenamed("number", "pack"), "hard-numbered")


def _columns() -> list[str]:
    return [c.split()[0] for c in _PACKED.split(", ")]


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _met(left: DataFrame, right: DataFrame, work: Callable[[dict, Iterable[dict]], Iterator[dict]], schema: str, *keys: str) -> DataFrame:
    """work(pack, its rows of the right side) for each group; a pack is one row of the left side."""

    def each(pack: pa.Table, found: pa.Table) -> pa.Table:
        rows = (row for batch in found.to_batches(max_chunksize=16) for row in batch.to_pylist())
        out = list(work(pack.to_pylist()[0], rows)) if pack.num_rows and found.num_rows else []
        return pa.concat_tables([pa.Table.from_batches([b]) for b in out]) if out else _arrow(schema).empty_table()

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(each, schema)


def needed(packs_: DataFrame, blocks_: DataFrame, count: int, parts: int, wanted: Callable[[dict, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """pack, part, block, who (a bit for each anchor): the blocks that anchors must read, from zone maps alone. ``wanted`` says from a
    pack and the least and largest product of each anchor and block which pairs can matter."""
    step = 16  # ranges of which a pack meets the zone maps at once
    left = packs_.withColumn("zone", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((parts - 1) // step).cast("long"))))
    right = blocks_.select("part", "block", "low", "high", F.floor(F.col("part") / step).alias("zone"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("pack"))

    def work(pack: dict, rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
        x, found = Packed.of(pack).x, list(rows)
        for k in range(0, len(found), 64):
            some = found[k : k + 64]
            least, most = bounds(x, *(np.array([r[side] for r in some], np.int64) for side in ("low", "high")))
            who = wanted(pack, least, most)
            yield _records(({"pack": pack["pack"], "part": r["part"], "block": r["block"], "who": np.packbits(who[:, j]).tobytes()} for j, r in enumerate(some) if who[:, j].any()), _arrow(schema))

    schema = "pack long, part long, block long, who binary"
    return stash(_met(left, right, work, schema, "pack", "zone"), "hard-needs")


def _read(packs_: DataFrame, blocks_: DataFrame, needs: DataFrame, work: Callable[[dict, Iterable[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """work(pack, its needed blocks of one range of the curve, with who needs them)."""
    right = needs.join(blocks_.select("block", *_columns()), "block")
    left = packs_.join(needs.groupBy("pack", "part").count().select("pack", F.col("part").alias("part")), "pack")
    return _met(left, right, work, schema, "pack", "part")


def _who(row: dict, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(row["who"], np.uint8), count=n))


def positives(packs_: DataFrame, blocks_: DataFrame, count: int, parts: int, most: int) -> DataFrame:
    """pack, anchor (its place there), window (0 on), anchor_id, id, score of each anchor's first rows of its label."""

    def work(pack: dict, rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
        held, home, place = Packed.of(pack), _longs(pack["home"]), _longs(pack["place"])
        best = Firsts(len(held.ids), most, _longs(pack["least"]))
        for row in rows:
            block, who = Packed.of(row), _who(row, len(held.ids))
            for some in np.split(who, range(_CHUNK, len(who), _CHUNK)):
                scores = products(held.x[some], block.x)
                hit = (scores >= best.least[some][:, None]) & (held.labels[some][:, None] == block.labels[None, :])
                own = np.flatnonzero(home[some] == row["block"])
                hit[own, place[some[own]]] = False
                a, b = np.nonzero(hit)
                best.offer(some[a], scores[a, b], block.ids[b])
        slot, score, ids = best.settle()
        yield pa.RecordBatch.from_arrays([np.full(len(slot), pack["pack"]), slot.astype(np.int32), held.ids[slot], score, ids], schema=_arrow(schema))

    schema = "pack long, anchor int, anchor_id long, score long, id long"
    needs = needed(packs_, blocks_, count, parts, lambda pack, least, largest: largest >= _longs(pack["least"])[:, None])
    found = _read(packs_, blocks_, needs, work, schema)
    order = Window.partitionBy("pack", "anchor").orderBy(F.desc("score"), "id")
    return stash(found.withColumn("window", F.row_number().over(order) - 1).filter(F.col("window") < most), "hard-positives")


def hard_negatives(vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    blocks_, parts, anchors = blocks(prepared(vectors), every)
    if not anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    packs_ = packs(blocks_, anchors, every, n_positives)
    count = packs_.count()
    found = positives(packs_, blocks_, count, parts, n_positives)
    of_pack = found.groupBy("pack").agg(F.collect_list(F.struct("anchor", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("windows"))  # n_positives * PACK at most
    with_windows = stash(packs_.join(of_pack, "pack").drop("home", "place", "least"), "hard-windows")

    def windows(pack: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor and window: positive's id and score, least and largest score of a negative."""
        ids, score = np.zeros((2, pack["n"], n_positives), np.int64)
        least, largest = np.ones((pack["n"], n_positives), np.int64), np.zeros((pack["n"], n_positives), np.int64)  # empty
        for w in pack["windows"]:
            at, p = (w["anchor"], w["window"]), w["positive_score"]
            ids[at], score[at], least[at], largest[at] = w["positive_id"], p, -(-low * p // 100), high * p // 100
        return ids, score, least, largest

    def meets(pack: dict, under: np.ndarray, over: np.ndarray) -> np.ndarray:
        _, _, least, largest = windows(pack)
        return np.any([(least[:, k] <= largest[:, k])[:, None] & (least[:, k][:, None] <= over) & (under <= largest[:, k][:, None]) for k in range(n_positives)], axis=0)

    def work(pack: dict, rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
        held = Packed.of(pack)
        ids, score, least, largest = windows(pack)
        best = Firsts(least.size, n_negatives, least.ravel())
        for row in rows:
            block, who = Packed.of(row), _who(row, len(held.ids))
            for some in np.split(who, range(_CHUNK, len(who), _CHUNK)):
                scores = products(held.x[some], block.x)
                other = held.labels[some][:, None] != block.labels[None, :]
                for k in range(n_positives):
                    slot = some * n_positives + k
                    a, b = np.nonzero((scores >= best.least[slot][:, None]) & (scores <= largest[some, k][:, None]) & other)
                    best.offer(slot[a], scores[a, b], block.ids[b])
        slot, found, negative = best.settle()
        a, k = np.divmod(slot, n_positives)
        yield pa.RecordBatch.from_arrays([np.full(len(slot), pack["pack"]), a.astype(np.int32), k.astype(np.int32), held.ids[a], ids[a, k], score[a, k], found, negative], schema=_arrow(_MET))

    needs = needed(with_windows, blocks_, count, parts, meets)
    met = _read(with_windows, blocks_, needs, work, _MET)
    order = Window.partitionBy("pack", "anchor", "window").orderBy(F.desc("score"), "id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hilbert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_hilbert_zones": op13_hilbert_zones}
SQL = {
    "op13_hilbert_zones": """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda v: floor(256 * v::double)::bigint) as x
      from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0),
e as (select vec_id, label, unnest(x) as v, unnest(range(len(x))) as i from r),
a as (select * from e where vec_id % 50 = 0),
s as (select a.vec_id as anchor_id, e.vec_id as id, a.label = e.label as same, sum(a.v * e.v)::bigint as score from a join e on a.i = e.i group by a.vec_id, e.vec_id, a.label = e.label),
p as (select anchor_id, id as positive_id, score as positive_score from s where same and id <> anchor_id qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id)::int as rank
      from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
""",
}
