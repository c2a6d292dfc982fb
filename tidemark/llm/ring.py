"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``nodes`` points of the ring; a document belongs to the first point clockwise of
its hash. No shard takes more than its capacity, ``(1 + slack) * rows / shards``: of a shard's own
documents those first on the ring stay, the others continue clockwise to the next shard with room.
With slack 0 the capacities add up to the rows, so that counts differ by one at most.

The walk needs only the number of documents in each cell of the ring (at most ``CELLS + shards *
nodes``, whatever the input), so the driver plans on counts; documents find their shard and slot
from their place in their cell.

Defined cases: a null or empty text has size 1; rows that repeat a doc_id share a place on the
ring and are ordered by text checksum and size; a row without doc_id has its text's place; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, stash

#: Even cells of the ring besides the virtual nodes' arcs: no cell holds more than about 1 / CELLS of distinct ids.
CELLS = 4096
TOP = 1 << 32


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, in ring order."""
    return sorted((xxhash.xxh3_64_intdigest(f"shard {s} node {k}".encode()) % TOP, s) for s in range(shards) for k in range(nodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-(-int(rows * (1 + slack)) // shards) + 1] * shards


def plan(counts: dict[int, int], edges: list[int], shards: int, nodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, first, end, shard, slot): documents first..end of a cell go to the shard, from that slot on."""
    points = ring(shards, nodes)
    places = [p for p, _ in points]
    room = capacities(sum(counts.values()), shards, slack)
    slot, out, over = [0] * shards, [], []
    for cell in sorted(counts):  # at home as far as there is room
        n, at = counts[cell], bisect.bisect_left(places, edges[cell + 1] - 1) % len(points)
        home = points[at][1]
        stay = min(n, room[home])
        if stay:
            out.append((cell, 0, stay, home, slot[home]))
            slot[home] += stay
            room[home] -= stay
        if stay < n:
            over.append((cell, stay, n, at))
    for cell, first, end, at in over:  # the others continue clockwise
        while first < end:
            at = (at + 1) % len(points)
            s = points[at][1]
            if take := min(end - first, room[s]):
                out.append((cell, first, first + take, s, slot[s]))
                slot[s] += take
                room[s] -= take
                first += take
    return out


def place(docs: DataFrame, shards: int = 16, nodes: int = 128, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs."""
    spark = docs.sparkSession
    edges = sorted({p + 1 for p, _ in ring(shards, nodes)} | {k * TOP // CELLS for k in range(CELLS + 1)})
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), text)), 32).alias("at"))
    bounds = np.array(edges)

    def cells(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy(), "right") - 1)

    rows = stash(rows.withColumn("cell", F.pandas_udf(cells, "long")("at")), "ring")
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    by_cell = defaultdict(list)
    for cell, first, end, shard, slot in plan(counts, edges, shards, nodes, slack):
        by_cell[cell].append((first, end, shard, slot))
    shared = spark.sparkContext.broadcast({c: sorted(p) for c, p in by_cell.items()})

    def assign(batches):
        for batch in batches:
            cell, nth = batch.column("cell").to_numpy(), batch.column("nth").to_numpy()
            shard, slot = np.zeros(len(cell), np.int32), np.zeros(len(cell), np.int64)
            for c in np.unique(cell):
                own = np.flatnonzero(cell == c)
                parts = shared.value[int(c)]
                k = np.searchsorted(np.array([p[1] for p in parts]), nth[own], "right")
                shard[own] = np.array([p[2] for p in parts])[k]
                slot[own] = np.array([p[3] - p[0] for p in parts])[k] + nth[own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(shard), pa.array(slot)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    order = Window.partitionBy("cell").orderBy("at", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", (F.row_number().over(order) - 1).cast("long"))
    kind = dict(rows.dtypes)["doc_id"]
    return numbered.mapInArrow(assign, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_bounded_ring": op10_bounded_ring}
SQL: dict[str, str] = {}
