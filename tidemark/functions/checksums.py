"""CRC32C (Castagnoli): of byte columns, of concatenations from parts, of file ranges.

The loop runs over many payloads at once: a payload is cut into lanes of equal length, all
lanes are folded to their last bytes and advance together in numpy, by two bytes a step, and lanes are put together as parts are (``combine``), pair by pair.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranges import Ranges

_POLY = 0x82F63B78
LANE, WIDE = 256, 1 << 16
#: The polynomial divides x^209 + x^144 + x^54 + x^39 + x^14 + 1, and with it the same sum with all exponents times a power of two. So a byte counts as much as
#: copies of it at these places after its own, together, or at these places times a power of two.
_AFTER = (65, 155, 170, 195, 209)
TAIL = 4 << 20


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t


_TABLE = _table()


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A GF(2) matrix (column k is the image of bit k) times each element of x."""
    out = np.zeros_like(x)
    for k in range(32):
        out ^= np.where((x >> np.uint32(k)) & 1, matrix[k], np.uint32(0))
    return out


@lru_cache(64)
def _zeros(power: int) -> np.ndarray:
    """Effect of 2^power zero bytes on a checksum register."""
    if power == 0:
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return _TABLE[unit & 0xFF] ^ (unit >> 8)
    half = _zeros(power - 1)
    return _apply(half, half)


def _images(matrix: np.ndarray) -> np.ndarray:
    """For each of a register's four bytes and each of its values: what the matrix makes of it."""
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(matrix, values << np.uint32(8 * at)) for at in range(4)])


def _looked_up(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same as ``_apply``, by the matrix's images."""
    return reduce(np.bitwise_xor, [images[at][(x >> np.uint32(8 * at)) & np.uint32(255)] for at in range(4)])


@lru_cache(64)
def _zeros_images(power: int) -> np.ndarray:
    return _images(_zeros(power))


def combine(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksum of the concatenation of two parts, the second ``length`` bytes long; associative."""
    out, length = np.asarray(first, np.uint32).copy(), np.asarray(length, np.int64)
    for k in range(int(length.max(initial=0)).bit_length()):
        on = ((length >> k) & 1).astype(bool)
        if on.any():
            out[on] = _looked_up(_zeros_images(k), out[on])
    return out ^ np.asarray(second, np.uint32)


@lru_cache(1)
def _pairs() -> np.ndarray:
    """Effect of two bytes, as a little-endian number, on a register of zero."""
    x = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        x = _TABLE[x & 0xFF] ^ (x >> np.uint32(8))
    return x


def _folded(lanes: np.ndarray) -> np.ndarray:
    """The last LANE bytes of each lane (a row), which make the same register of zero once the bytes before them are moved on (``_AFTER``). The lanes are changed."""
    width, at = lanes.shape[1], 0
    for k in range((width // _AFTER[-1]).bit_length() - 1, -1, -1):  # far first: long pieces, all lanes' at once
        last = width - max(_AFTER[-1] << k, LANE)
        while at < last:
            n = min(_AFTER[0] << k, last - at)
            for far in _AFTER:
                to = lanes[:, at + (far << k) :][:, :n]
                np.bitwise_xor(to, lanes[:, at : at + n], out=to)
            at += n
    return lanes[:, width - LANE :]


def _registers(data: list) -> np.ndarray:
    """What each payload makes of a register of zero. Zero bytes before it don't count, so that its lanes are filled from the right."""
    out, longest = np.zeros(len(data), np.uint32), max(map(len, data))
    if not longest:
        return out
    lane = min(-(-longest // LANE) * LANE, WIDE)
    counts = np.array([-(-len(p) // lane) for p in data])
    ends = np.cumsum(counts)
    lanes = int(ends[-1])
    block = np.zeros(lanes * lane, np.uint8)
    for p, end in zip(data, (ends * lane).tolist(), strict=True):
        if len(p):
            block[end - len(p) : end] = np.frombuffer(p, np.uint8)
    words = _folded(block.reshape(lanes, lane)).view("<u2")
    if longest < LANE:  # short ones: what is zero in all lanes is left out
        words = words[:, (LANE - longest) // 2 :]
    reg, image, table = np.zeros(lanes, np.uint32), np.empty(lanes, np.uint32), _pairs()
    for at in np.ascontiguousarray(words.T).astype(np.uint32):
        np.bitwise_xor(at, reg, out=at)
        np.bitwise_and(at, 0xFFFF, out=at)
        np.take(table, at, out=image, mode="clip")
        np.right_shift(reg, 16, out=reg)
        np.bitwise_xor(reg, image, out=reg)
    width = 1
    while True:  # payloads of up to width lanes, of WIDE bytes where they are several; all pairs of lanes are put together at once
        own = np.flatnonzero((counts <= width) & (counts > width // 2))
        if len(own):
            held = np.zeros((len(own), width), np.uint32)
            there = np.arange(width) >= width - counts[own][:, None]
            held[there] = reg[(ends[own][:, None] - width + np.arange(width))[there]]
            power = WIDE.bit_length() - 1
            while held.shape[1] > 1:
                held, power = _looked_up(_zeros_images(power), held[:, ::2]) ^ held[:, 1::2], power + 1
            out[own] = held[:, 0]
        if width >= counts.max():
            return out
        width *= 2


def crc(payloads: list, step: int = 4 << 20) -> np.ndarray:
    """Checksums of many payloads (of bytes, or what has their buffer); a null counts as empty. About step bytes, of payloads of similar length, are at work at once."""
    data = [b"" if p is None else p for p in payloads]
    lengths = np.array([len(p) for p in data], np.int64)
    out = np.zeros(len(data), np.uint32)
    kind = np.ceil(np.log2(np.clip(-(-lengths // LANE), 1, WIDE // LANE)))
    order = np.argsort(kind, kind="stable")
    group = np.cumsum(lengths[order] + LANE) // step
    cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (np.diff(kind[order]) > 0)) + 1).tolist(), len(data)] if data else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[order[a:b]] = _registers([data[i] for i in order[a:b].tolist()])
    return combine(np.full(len(data), 0xFFFFFFFF, np.uint32), out, lengths) ^ np.uint32(0xFFFFFFFF)


def crc_bytes(payload: bytes) -> bytes:
    return int(crc([payload])[0]).to_bytes(4, "little")


def _crc32c(col: pa.Array) -> pa.Array:
    found = crc([v.as_buffer() for v in col]).tolist()  # payloads stay where Arrow has them
    return pa.array([x.to_bytes(4, "little") if held else None for x, held in zip(found, col.is_valid().to_pylist(), strict=True)], pa.binary())


def crc32c(col) -> Column:
    """CRC32C of a binary column as four little-endian bytes."""
    return F.arrow_udf(_crc32c, "binary")(col)


def crc_value(col) -> Column:
    """Four little-endian bytes as an unsigned number."""
    return F.conv(F.concat(*[F.hex(F.substring(col, i, 1)) for i in (4, 3, 2, 1)]), 16, 10).cast("long")


def _combined(values: pd.Series, lengths: pd.Series) -> tuple[bytes, int]:
    """Checksum and length of parts in order: neighbours are combined pair by pair, all pairs at once."""
    c = np.array([int.from_bytes(v, "little") for v in values], np.uint32)
    n = np.array(lengths, np.int64)
    while len(c) > 1:
        if len(c) % 2:
            c, n = np.append(c, np.uint32(0)), np.append(n, 0)
        c, n = combine(c[::2], c[1::2], n[1::2]), n[::2] + n[1::2]
    return (int(c[0]) if len(c) else 0).to_bytes(4, "little"), int(n.sum())


def _combine_group(checksum: pd.Series, length: pd.Series, at: pd.Series) -> bytes:
    order = np.argsort(at.to_numpy(), kind="stable")
    return _combined(checksum.iloc[order], length.iloc[order])[0]


def _shifted(values: pa.Array, zeros: pa.Array) -> pa.Array:
    value = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32)
    after = np.maximum(zeros.fill_null(0).to_numpy(zero_copy_only=False), 0)
    return pa.array(combine(value, np.zeros_like(value), after).astype(np.int64), mask=values.is_null().to_numpy(zero_copy_only=False))


def shifted(value: Column, zeros: Column) -> Column:
    """What a part's checksum (a number) amounts to in the whole's, if ``zeros`` bytes follow it. The whole's checksum is the exclusive or of
    these over all its parts, in any order: an aggregate that Spark sums before it shuffles."""
    return F.arrow_udf(_shifted, "long")(value.cast("long"), zeros.cast("long"))


def value_bytes(value: Column) -> Column:
    """An unsigned number of 32 bits as four little-endian bytes."""
    text = F.lpad(F.hex(value), 8, "0")
    return F.unhex(F.concat(*[F.substring(text, at, 2) for at in (7, 5, 3, 1)]))


def crc32c_combine(parts: DataFrame, keys: list[str], order: str, crc_col: str = "checksum", len_col: str = "len") -> DataFrame:
    """keys, checksum, len: the checksum of each group's parts in order, from their checksums and lengths.

    The bytes after each part are running sums over ranges, so a file of very many parts is many tasks'.
    """
    rows = parts.select(*keys, F.col(order).alias("_at"), crc_value(F.col(crc_col)).alias("_crc"), F.col(len_col).cast("long").alias("len"))
    after = Ranges(rows, keys, ["_at"]).with_running("_after", "sum", F.col("len"), before=True, back=True).done()
    return crc32c_of_parts(after, keys, F.col("_crc"), F.coalesce("_after", F.lit(0).cast("long")))


def crc32c_of_parts(parts: DataFrame, keys: list[str], value: Column, after: Column) -> DataFrame:
    """keys, checksum, len of the parts (len) of each group, of which the checksum's value and the bytes after them are known."""
    moved = parts.select(*keys, shifted(value, after).alias("_value"), "len")
    out = moved.groupBy(*keys).agg(F.bit_xor("_value").alias("_value"), F.sum("len").alias("len"))
    return out.select(*keys, value_bytes(F.col("_value")).alias("checksum"), "len")


def checksum_eq(a, b) -> Column:
    """Equality on algorithm, offset, length and value."""
    return F.col(a).eqNullSafe(F.col(b)) if isinstance(a, str) else a.eqNullSafe(b)


def tail_checksum(payload, max_len: int = TAIL) -> Column:
    """Checksum struct of the last max_len bytes of a binary column; algorithm 0 when empty."""
    size = F.octet_length(payload).cast("long")
    offset = F.greatest(size - max_len, F.lit(0)).cast("long")
    value = crc32c(F.substring(payload, offset.cast("int") + 1, F.lit(max_len)))
    return F.struct(F.when(size > 0, 1).otherwise(0).alias("algo"), offset.alias("offset"), (size - offset).alias("len"), F.when(size > 0, value).otherwise(F.lit(b"")).alias("value"))


def verify(payload, checksum) -> Column:
    """Whether a payload has the checksum: none matches an empty range alone, a range outside is false, other algorithms are an error."""
    c = F.col(checksum) if isinstance(checksum, str) else checksum
    p = F.col(payload) if isinstance(payload, str) else payload
    inside = c["offset"] + c["len"] <= F.octet_length(p)
    actual = crc32c(F.substring(p, c["offset"].cast("int") + 1, c["len"].cast("int")))
    return (
        F.when(c["algo"] == 0, c["len"] == 0)
        .when(c["algo"] != 1, F.raise_error(F.lit("unsupported checksum algorithm")).cast("boolean"))
        .when(~inside, False)
        .otherwise(actual == c["value"])
    )


def register_all(spark: SparkSession) -> None:
    """SQL functions crc32c(binary) and the aggregate crc32c_combine(checksum, len, order), the tree source and sink, and the change feed."""
    from tidemark.sources import feed, sink, tree

    spark.udf.register("crc32c", F.arrow_udf(_crc32c, "binary"))
    spark.udf.register("crc32c_combine", F.pandas_udf(_combine_group, "binary"))
    spark.dataSource.register(tree.TreeSource)
    spark.dataSource.register(sink.TreeSink)
    spark.dataSource.register(feed.ChangeFeed)
