"""Media payloads in content-defined chunks.

A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, are the payload. It is
cut by a rolling gear hash; chunks are deduplicated by their SHA-256 and stored once, documents as
ordered chunk lists (see chunkstore). Reading back rebuilds each payload from its chunk list,
verifies every chunk and the Merkle root, and computes features from the bytes read.

The stored form of a document is its chunk list with the chunks: for each, its length (4 bytes,
little-endian), digest and bytes, as read back; ``media_bytes`` and ``media_sha256`` are of that.

Defined cases: a null text is an empty one, whose payload is 576 bytes of 255; equal texts give equal
values; repeated rows come back as often; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunkstore
from tidemark.llm.common import documents, stash_path

UNIT = 576


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def stored_form(payload: bytes, recipe: list[dict]) -> bytes:
    parts, at = [], 0
    for c in recipe:
        parts += [struct.pack("<I", c["len"]), c["digest"], payload[at : at + c["len"]]]
        at += c["len"]
    return b"".join(parts)


def feature(payload: np.ndarray, lengths: list[int]) -> str:
    """Chunks, their mean length, mean sample and the entropy of the samples in bits."""
    share = np.bincount(payload, minlength=256) / len(payload)
    share = share[share > 0]
    return f"chunks={len(lengths)};mean_chunk={np.mean(lengths):.1f};mean={payload.mean():.3f};entropy={-(share * np.log2(share)).sum():.4f}"


def write_media(docs: DataFrame, path: str) -> None:
    """Stores the payloads of docs (doc_id, text) at path."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    chunkstore.write(rows, ["doc_id", "n_bytes"], lambda part: [padded(t) for t in part.column("text").to_pylist()], path)


def read_media(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """doc_id, n_bytes and features of every stored payload, computed from the bytes read back."""

    def describe(payloads: list[bytes], recipes: pa.ListArray) -> list[pa.Array]:
        recipes = recipes.to_pylist()
        forms = [stored_form(p, r) for p, r in zip(payloads, recipes, strict=True)]
        return [
            pa.array([len(p) for p in payloads], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
            pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
            pa.array([len(f) for f in forms], pa.int64()),
            pa.array([hashlib.sha256(f).hexdigest() for f in forms], pa.string()),
            pa.array([feature(np.frombuffer(p, np.uint8), [c["len"] for c in r]) for p, r in zip(payloads, recipes, strict=True)], pa.string()),
        ]

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    docs, chunks = chunkstore.read(spark, path, ["doc_id", "n_bytes"], f"doc_id {kind}, n_bytes bigint")
    return chunkstore.rebuilt(docs, chunks, ["doc_id", "n_bytes"], describe, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", names)


def op1_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stash_path(spark, "media")
    write_media(documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text"), path)
    return read_media(spark, path)


QUERIES = {"op1_content_chunks": op1_content_chunks}
SQL: dict[str, str] = {}
