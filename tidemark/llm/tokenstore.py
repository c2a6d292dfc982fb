"""Token ids in a content-addressed store.

Documents are encoded, each with an end id; their id streams (unsigned 16-bit while the vocabulary
allows, else 32-bit) are cut by a rolling hash on whole ids. Unique chunks are stored once, documents
as recipes with a Merkle root, in ascending order of doc_id: file after file and row after row (see
chunkstore). A manifest row for each file range, whose leaf is a hash over the range's documents in
order, and a Merkle root over these rows verify the whole: reading computes starts, leaves and root
again from the rows read back, and raises where they differ or rows are missing.

Defined cases: a null or empty text is the end id alone; repeated rows are stored again, in order of
their length and root; a null doc_id comes first; other columns are ignored; an empty table is an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunkstore
from tidemark.llm.common import documents, sliced, stash, stash_path
from tidemark.llm.tokens import encoder

_ROOT = "root binary, width int, edges array<bigint>"
PIECE = 1 << 18  # tokens of a range that are hashed together: at most so many documents


def width_of(vocabulary: str, end: int) -> int:
    """Bytes of an id: 2 while all ids fit, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(end, *Tokenizer.from_file(vocabulary).get_vocab().values()) < 1 << 16 else 4


def leaves(rows: DataFrame) -> DataFrame:
    """part, start, n_tokens, n_docs, leaf: a hash over each range's documents (doc_id, start, n_tokens, root) in order, piece by piece."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "doc_id", "n_tokens", F.hex("root").alias("root"))))
    text = F.transform(ordered, lambda d: F.concat_ws(":", d["start"].cast("string"), F.coalesce(d["doc_id"].cast("string"), F.lit("null")), d["n_tokens"].cast("string"), d["root"]))
    pieces = rows.groupBy("part", F.floor(F.col("start") / PIECE).alias("piece")).agg(F.sha2(F.array_join(text, "\n"), 256).alias("hash"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "hash"))), lambda p: p["hash"]), "\n"), 256)
    return pieces.groupBy("part").agg(F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"), whole.alias("leaf"))


def root_of(manifest: DataFrame) -> bytes:
    """The Merkle root over a manifest's rows, in order; there is a row for each range, whatever the input."""
    return chunkstore.merkle_root([chunkstore.digest(repr(tuple(r)).encode()) for r in manifest.select("part", "start", "n_tokens", "n_docs", "leaf").orderBy("part").collect()])


def encoded(docs: DataFrame, end: int, vocabulary: str, width: int, chunking: tuple[int, ...]) -> DataFrame:
    """doc_id, n_tokens, payload (ids with the end id, unsigned little-endian of ``width`` bytes), and its chunks' lens and digests."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for part in sliced(batches, limit=1 << 23):
            ids, sizes = words.encode(part.column("text"), end)
            if len(ids) and int(ids.max()) >> (8 * width):
                raise ValueError(f"an id doesn't fit {width} bytes")
            data, ends = ids.astype(f"<u{width}").tobytes(), np.cumsum(sizes) * width
            payloads = [data[e - n : e] for e, n in zip(ends.tolist(), (sizes * width).tolist(), strict=True)]
            lens, digests = chunkstore.cut_and_digested(payloads, *chunking)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(payloads, pa.binary()), lens, digests], ["doc_id", "n_tokens", "payload", "lens", "digests"])
        words.clear()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, n_tokens long, payload binary, lens array<int>, digests array<binary>")


def write_ids(docs: DataFrame, path: str, end: int = 2, vocabulary: str | None = None) -> None:
    """Stores the ids of docs (doc_id, text) at path, with a manifest."""
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    width = width_of(vocabulary, end)
    chunking = (width, 512, 10, 8192)
    ids = stash(encoded(docs, end, vocabulary, width, chunking), "ids")
    edges = chunkstore.edges_of(ids, "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunkstore.write(ids, ["doc_id", "n_tokens"], lambda part: part.column("payload").to_pylist(), path, *chunking, order=chunkstore.range_of("doc_id", edges), then=("root",))
    rows = spark.read.parquet(f"{path}/kind=doc").select("doc_id", "n_tokens", "root")
    leaves(chunkstore.prefix_sums(rows, "doc_id", "n_tokens", edges, ("root",))).coalesce(1).write.parquet(f"{path}/manifest")
    root = root_of(spark.read.parquet(f"{path}/manifest"))
    spark.createDataFrame([(bytearray(root), width, edges)], _ROOT).coalesce(1).write.parquet(f"{path}/root")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the ids read back and verified."""
    stored = spark.read.schema(_ROOT).parquet(f"{path}/root").collect()
    if len(stored) != 1:
        raise ValueError("the store has no root")
    root, width, edges = stored[0]

    def describe(payloads: list[bytes], recipes: pa.ListArray) -> list[pa.Array]:
        return [pa.array([zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()) for p in payloads], pa.int64()), pa.array([len(p) // width for p in payloads], pa.int64())]

    docs, chunks = chunkstore.read(spark, path, ["doc_id", "n_tokens", "root"], "doc_id bigint, n_tokens bigint")
    found = chunkstore.rebuilt(docs, chunks, ["doc_id", "n_tokens", "root"], describe, "ids_crc32 long, found long", ["ids_crc32", "found"])
    # Lengths, starts and the manifest come anew from what was read: a document that is missing, swapped or changed changes its range's leaf.
    rows = chunkstore.prefix_sums(found.select("doc_id", F.col("found").alias("n_tokens"), "root", "ids_crc32"), "doc_id", "n_tokens", edges, ("root",))
    if any(root_of(m) != bytes(root) for m in (spark.read.parquet(f"{path}/manifest"), leaves(rows))):
        raise ValueError("the ids read back differ from the manifest's root")
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stash_path(spark, "ids-store")
    write_ids(documents(spark, sf_dir), path)
    return read_ids(spark, path)


QUERIES = {"op7_content_store": op7_content_store}
SQL: dict[str, str] = {}
