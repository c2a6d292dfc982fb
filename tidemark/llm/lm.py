"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered from the training documents by Spark aggregations. Each
n-gram with count c enters the filter once for every level 1 .. 1 + floor(log c), to base 1.5; a
reader probes level after level until one is missing, and takes the middle of the counts that the
last level stands for. The filter is blocked: all probes of an n-gram lie in one block, so blocks are built in
parallel from n-grams dealt by block. It has ``BITS_PER_LEVEL`` bits for each level of each
n-gram at every input, so its error doesn't grow. Workers get it by broadcast in ranges of blocks of
``RANGE_BITS`` (128 MB): with several, a worker gathers the keys of ``GROUP`` tokens and holds one range after another.

The probability of word w after v is ``a * p(w) + (1 - a) * c(v, w) / c(v)`` with the add-one estimate
p(w) = (c(w) + 1) / (N + V + 1) of the base model; a document starts after an end token.

The base score needs exact counts. Words that make up at least ``1 / HEAD`` of the training tokens
(so at most HEAD words) are broadcast; occurrences of rarer ones meet their counts in a join, which
no frequent word can skew.

Defined cases: a null or empty text is one end token; equal rows score alike, and each counts in
training; a null doc_id counts as remainder 0, so in training; without training documents every
probability is that of N = V = 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, documents, mix, remainder, sliced, stash, stash_path

END = b" "  # the end token: no word holds a blank
BLOCK_BITS = 1 << 16
BITS_PER_LEVEL, RANGE_BITS, PROBES = 8, 1 << 30, 3
GROUP = 2_000_000
BASE, LEVELS = 1.5, 80
_LOW = np.ceil(BASE ** np.arange(LEVELS + 1) - 1e-9)  # least count of level k + 1
_MIDDLE = np.concatenate([[0.0], (_LOW[:-1] + np.maximum(_LOW[:-1], _LOW[1:] - 1)) / 2])
HEAD = 500_000
_STEP = np.uint64(0x9FB21C651E98DF25)


@dataclass
class Tokens:
    """The tokens of some texts, each text with its end: places in the distinct words, whose last is the end."""

    words: list[bytes]
    hashes: np.ndarray
    places: np.ndarray
    sizes: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = lists.flatten().dictionary_encode()
    places = flat.indices.to_numpy() if len(flat) else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    if b"" in words:  # before or after all words
        filled = places != words.index(b"")
        places, doc = places[filled], doc[filled]
    n = np.bincount(doc, minlength=len(lists))
    words.append(END)
    return Tokens(words, hashes_of(words), np.insert(places, np.cumsum(n), len(words) - 1), n + 1)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; a text's first token follows an end."""
    before = np.roll(hashes, 1)
    before[np.cumsum(sizes) - sizes] = np.uint64(xxhash.xxh3_64_intdigest(END))
    with np.errstate(over="ignore"):
        return mix(before * _STEP + hashes)


def counted(docs: DataFrame) -> DataFrame:
    """key, word, n over all training documents: a row for each word, and one for each pair of words, without word."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            keys = np.concatenate([hashes_of(list(seen)), pairs])
            word = pa.concat_arrays([pa.array(list(seen), pa.binary()), pa.nulls(len(pairs), pa.binary())])
            out = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), word, pa.array(np.concatenate([np.fromiter(seen.values(), np.int64, len(seen)), n]))], ["key", "word", "n"])
            seen.clear()
            held.clear()
            return out

        for part in sliced(batches, limit=1 << 22):
            t = tokens_of(part.column("text"))
            for word, n in zip(t.words, np.bincount(t.places, minlength=len(t.words)).tolist(), strict=True):
                if n:
                    seen[word] += n
            held.append(pair_keys(t.hashes[t.places], t.sizes))
            if len(seen) > 500_000 or sum(map(len, held)) > 4_000_000:
                yield flush()
        if seen:
            yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "key long, word binary, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))


class Filter:
    """Log-frequency Bloom filter over 64-bit keys, or the range of its blocks that starts at ``first``."""

    def __init__(self, words: np.ndarray, first: int = 0, blocks: int | None = None):
        self.words, self.first, self.blocks = words, np.uint64(first), np.uint64(blocks or len(words) * 64 // BLOCK_BITS)

    @staticmethod
    def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
        return (keys >> np.uint64(33)) % np.uint64(blocks)

    @staticmethod
    def places(keys: np.ndarray, level: int) -> list[np.ndarray]:
        """Bits within the block of each probe of a level."""
        with np.errstate(over="ignore"):
            h = mix(keys + np.uint64(level) * _STEP)
        return [(h >> np.uint64(16 * k)) & np.uint64(BLOCK_BITS - 1) for k in range(PROBES)]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Estimated counts, 0 for keys that the filter doesn't hold."""
        return _MIDDLE[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level found of each key; all keys must lie in this range."""
        base = (self.block_of(keys, int(self.blocks)) - self.first) * np.uint64(BLOCK_BITS // 64)
        level = np.zeros(len(keys), np.uint8)
        alive = np.arange(len(keys))
        for k in range(1, LEVELS + 1):
            ok = np.ones(len(alive), bool)
            for place in self.places(keys[alive], k):
                ok &= ((self.words[(base[alive] + (place >> np.uint64(6))).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
            alive = alive[ok]
            if not len(alive):
                break
            level[alive] = k
        return level


def _loaded(part: Broadcast) -> np.ndarray:
    """A broadcast's value, read anew and not kept where Spark left it in a file."""
    return part.load_from_path(part._path) if getattr(part, "_path", None) else part.value


def looked_up(keys: np.ndarray, ranges: list[Broadcast], blocks: int, per: int) -> np.ndarray:
    """Levels of keys in a filter of ``blocks`` blocks, of which each range holds ``per``; one range is held at a time."""
    if len(ranges) == 1:
        return Filter(ranges[0].value).levels(keys)
    own = Filter.block_of(keys, blocks) // np.uint64(per)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(len(ranges) + 1, dtype=np.uint64))
    out = np.zeros(len(keys), np.uint8)
    for k, part in enumerate(ranges):
        at = order[edges[k] : edges[k + 1]]
        if len(at):
            out[at] = Filter(_loaded(part), k * per, blocks).levels(keys[at])
    return out


def build_filter(entries: DataFrame) -> np.ndarray:
    """The words of a whole filter over entries (key, n)."""
    return np.concatenate(list(filter_ranges(entries)[2]))


def filter_ranges(entries: DataFrame, range_bits: int = RANGE_BITS) -> tuple[int, int, Iterator[np.ndarray]]:
    """The blocks of a filter over entries (key, n), sized for all their levels; the blocks of a range; the words of one range
    after another. Each block is built in one task, of constant size."""
    levels = entries.agg(F.sum(F.floor(F.log("n") / math.log(BASE)) + 1)).first()[0] or 0
    blocks, per = max(1, -(-BITS_PER_LEVEL * int(levels) // BLOCK_BITS)), max(1, range_bits // BLOCK_BITS)
    dealt = entries.select("key", F.col("n").cast("long").alias("n")).repartition(F.expr(f"pmod(shiftrightunsigned(key, 33), {blocks})"))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All blocks of a partition at once: they take less room than the entries that they come from."""
        known: dict[int, int] = {}
        bits = np.zeros(0, bool)
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            names, at = np.unique(Filter.block_of(keys, blocks).astype(np.int64), return_inverse=True)
            at = np.array([known.setdefault(k, len(known)) for k in names.tolist()], np.int64)[at] * BLOCK_BITS
            if len(known) * BLOCK_BITS > len(bits):
                bits = np.concatenate([bits, np.zeros(max(len(bits), len(known) * BLOCK_BITS - len(bits)), bool)])
            top = np.searchsorted(_LOW, batch.column("n").to_numpy(), "right")
            for level in range(1, int(top.max(initial=0)) + 1):
                alive = top >= level
                for place in Filter.places(keys[alive], level):
                    bits[at[alive] + place.astype(np.int64)] = True
        for k, name in enumerate(known):
            block = np.packbits(bits[k * BLOCK_BITS : (k + 1) * BLOCK_BITS], bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([block], pa.binary())], ["block", "bits"])

    built = dealt.mapInArrow(build, "block long, bits binary")
    if blocks > per:  # built once, read range by range
        path = stash_path(entries.sparkSession, "filter")
        built.withColumn("range", F.floor(F.col("block") / per)).write.partitionBy("range").parquet(path)
        built = entries.sparkSession.read.schema("block long, bits binary, range long").parquet(path)

    def filled() -> Iterator[np.ndarray]:
        for first in range(0, blocks, per):
            out = np.zeros(min(per, blocks - first) * BLOCK_BITS // 8, np.uint8)
            for row in (built.filter(F.col("range") == first // per) if blocks > per else built).toLocalIterator():
                at = (row["block"] - first) * BLOCK_BITS // 8
                out[at : at + BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
            yield out.view(np.uint64)

    return blocks, per, filled()


def scored(docs: DataFrame, train: DataFrame, alone: float = 0.85, least: int = 1, range_bits: int = RANGE_BITS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    ``alone`` is the share a of the single word's probability. ``least`` is the count from which word pairs enter the filter; rarer ones are left to the words.
    ``range_bits`` bounds a broadcast, and changes no score.
    """
    spark = docs.sparkSession
    with bounded_batches(spark):
        counts = stash(counted(train), "ngrams")
    words = counts.filter("word is not null").select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = {bytes(r["word"]): r["n"] for r in words.filter(F.col("n") * HEAD >= total).collect()}  # at most HEAD words
    entries = counts.filter(F.col("word").isNotNull() | (F.col("n") >= least)).select("key", "n")
    blocks, per, filled = filter_ranges(entries, range_bits)
    ranges = [spark.sparkContext.broadcast(part) for part in filled]
    shared = spark.sparkContext.broadcast(head)
    floor = math.log10(total + distinct + 1)

    def read(part: pa.RecordBatch) -> tuple:
        t = tokens_of(part.column("text"))
        both, which = np.unique(pair_keys(t.hashes[t.places], t.sizes), return_inverse=True)  # each distinct word and pair is looked up once
        return part.column("doc_id"), t, which.astype(np.int32), np.concatenate([t.hashes, both])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {w: math.log10(n + 1) for w, n in shared.value.items()}
        part_id, at, waiting, tokens = TaskContext.get().partitionId(), 0, [], 0

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal at, tokens
            level = looked_up(np.concatenate([keys for *_, keys in waiting]), ranges, blocks, per)
            for *known, keys in waiting:
                yield from rows_of(*known, _MIDDLE[level[: len(keys)]], logs, (part_id << 33) + at)
                at, level = at + len(known[1].sizes), level[len(keys) :]
            waiting.clear()
            tokens = 0

        for part in sliced(batches, limit=1 << 22):
            waiting.append(read(part))
            tokens += len(waiting[-1][2])
            if len(ranges) == 1 or tokens >= GROUP:
                yield from told()
        if waiting:
            yield from told()

    def rows_of(ids: pa.Array, t: Tokens, which: np.ndarray, counts: np.ndarray, logs: dict[bytes, float], first: int) -> Iterator[pa.RecordBatch]:
        used, where, sizes = t.words, t.places, t.sizes
        own, both = counts[: len(used)][where], counts[len(used) :][which]
        log = np.array([logs.get(w, -1.0) for w in used])[where]  # -1: not in the head
        starts = np.cumsum(sizes) - sizes
        before = np.roll(own, 1)
        before[starts] = counts[len(used) - 1]  # the end's
        p = (own + 1) / (total + distinct + 1)
        chance = np.log10(alone * p + (1 - alone) * both / np.maximum(np.maximum(before, both), 1))
        rare = log < 0
        n = len(sizes)
        uid = first + np.arange(n)
        sums = [np.add.reduceat(x, starts) for x in (np.where(rare, 0.0, log), (~rare).astype(np.int64), chance)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid), ids, pa.array([b"\x00 %d" % u for u in uid], pa.binary()), pa.array(np.ones(n, np.int64)), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2])], names
        )
        if rare.any():
            doc = np.repeat(np.arange(n), sizes)[rare]
            pairs_, times = np.unique(doc * len(used) + where[rare], return_counts=True)
            m, nothing = len(pairs_), pa.nulls(len(pairs_), pa.int64())
            word = [used[k] for k in pairs_ % len(used)]
            yield pa.RecordBatch.from_arrays([pa.array(uid[pairs_ // len(used)]), nothing, pa.array(word, pa.binary()), pa.array(times), nothing, pa.nulls(m, pa.float64()), nothing, pa.nulls(m, pa.float64())], names)

    names = ["uid", "doc_id", "word", "times", "size", "log_sum", "n_head", "score"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "uid long, doc_id long, word binary, times long, size long, log_sum double, n_head long, score double")
    # A document's own row has a word of its own that is no token, so it passes the join alone.
    met = rows.join(words.filter(F.col("n") * HEAD < total).withColumnRenamed("n", "c"), "word", "left")
    known = F.col("c").isNotNull().cast("long") * F.col("times")
    grouped = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("size").alias("n_tokens"), (F.max("n_head") + F.sum(known)).alias("n_known"), F.max("score").alias("score"),
        (F.max("log_sum") + F.sum(F.coalesce(F.log10(F.col("c") + 1) * F.col("times"), F.lit(0.0)))).alias("logs"),
    )
    return grouped.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * floor).alias("base_score"), "score")


def op5_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 7) == 2
    out = scored(docs, docs.filter(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_log_frequency_bloom": op5_log_frequency_bloom}
#: The base score alone; the model's own score comes from the filter.
SQL: dict[str, str] = {}
