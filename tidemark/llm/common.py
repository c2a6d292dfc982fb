"""Helpers that the training-data operators share: shared folder, batch slicing, word hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in every contract of this package: space and \x09 to \x0D.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back when it ends, and not whenever the driver happens to collect its garbage: an operator
    of many steps else keeps those of all steps on the disk. The session's own setting comes back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a written table in the shared folder; columns are compressed, unlike in checkpoint()."""
    spark = df.sparkSession
    path = stash_path(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """checkpoint() for small tables, in the same shared folder."""
    shared_folder(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # a DataFrame of its own: one made before keeps the setting of then


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside gets Arrow batches of at most ``rows`` documents: texts are long, and JVM and worker each hold batches whole.
    The session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that one slice holds about ``limit`` bytes of ``column``, at least one row. Between batches, Arrow gives
    back what memory it keeps for later: workers live on from stage to stage."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pa.default_memory_pool().release_unused()
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // limit
        edges = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
    pa.default_memory_pool().release_unused()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; bytes.lower and bytes.split work on ASCII alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 100_000, seed: int = 0):
        super().__init__()
        self.bound, self.seed = bound, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, on whole arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def seeds(n: int, label: str) -> np.ndarray:
    """``n`` odd 64-bit constants, the same on every machine."""
    return np.array([xxhash.xxh3_64_intdigest(f"{label}{i}".encode()) | 1 for i in range(n)], np.uint64)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def n_words(text: str) -> Column:
    """Number of words of a text column, null as none."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
