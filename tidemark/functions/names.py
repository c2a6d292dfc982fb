"""Names, identities and sizes as column expressions; nothing here needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE = 65536
CHUNK_THRESHOLD = 65536

# The hash starts from this basis (not the usual one) and multiplies by 2^40 + 435.
_BASIS = 1469598103934665603
_LOW = 4294967295


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def path_id(name) -> Column:
    """FNV-1a over a name's UTF-8 bytes, with the top bit set.

    The product modulo 2^64 is put together from 32-bit halves, as a long product would overflow.
    """
    data = F.encode(_c(name), "utf-8")
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    positions = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        x = h.bitwiseXOR(byte(i))
        low = x.bitwiseAND(F.lit(_LOW)) * 435
        high = (F.shiftrightunsigned(x, 32) * 435 + F.shiftrightunsigned(low, 32) + F.shiftleft(x, 8).bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(_LOW))
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))

    return F.aggregate(positions, F.lit(_BASIS).cast("long"), step).bitwiseOR(F.shiftleft(F.lit(1).cast("long"), 63))


def numeric_file_id(name) -> Column:
    """n of a name ``<n>.file`` with n below 2^64 (as a signed long), else null."""
    digits = F.regexp_extract(_c(name), r"^([0-9]+)[.]file$", 1)
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.when((digits != "") & (F.length(short) <= 20), short.cast("decimal(20,0)"))
    top = F.lit("18446744073709551615").cast("decimal(20,0)")
    wrapped = F.when(n > F.lit("9223372036854775807").cast("decimal(20,0)"), n - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(n)
    return F.when(n <= top, wrapped.cast("long"))


def file_name_for_id(file_id) -> Column:
    """``<id>.file``; ids with the top bit set count as unsigned."""
    i = _c(file_id).cast("decimal(20,0)")
    return F.concat(F.when(i < 0, i + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(i).cast("decimal(20,0)").cast("string"), F.lit(".file"))


def entry_id(kind, name) -> Column:
    """Numeric id for a regular file at top level that has one, else the path's hash."""
    own = F.when((_c(kind) == 1) & ~F.contains(_c(name), F.lit("/")), numeric_file_id(name))
    return F.coalesce(own, path_id(name))


def is_safe_name(name) -> Column:
    """Whether a name is a relative path without empty, ``.`` or ``..`` parts; slashes in a row are one."""
    n = _c(name)
    bad = F.exists(F.split(n, "/+"), lambda p: p.isin("", ".", ".."))
    return F.coalesce((n != "") & ~bad, F.lit(False))


def mounted_root(mount, root) -> Column:
    """mount / root without its leading slash and ``.`` and ``..`` parts."""
    parts = F.filter(F.split(_c(root), "/+"), lambda p: ~p.isin("", ".", ".."))
    return F.when(F.size(parts) == 0, _c(mount)).otherwise(F.concat(F.rtrim(_c(mount), F.lit("/")), F.lit("/"), F.array_join(parts, "/")))


def stream_root(known_root, stream_id, default_root: str | None, use_id: bool = True) -> Column:
    """The known root, else the default root, joined with the stream's id if use_id."""
    fallback = F.concat(F.lit(default_root or ""), F.lit("/"), _c(stream_id).cast("string")) if use_id else F.lit(default_root)
    return F.coalesce(_c(known_root), fallback)


def use_chunks(size, threshold: int = CHUNK_THRESHOLD) -> Column:
    return _c(size) > threshold


def chunk_count(size, chunk_size=CHUNK_SIZE) -> Column:
    """Ceiling of size / chunk_size, 0 for an empty file; a chunk size of 0 is an error."""
    cs = F.lit(chunk_size) if isinstance(chunk_size, int) else _c(chunk_size)
    whole = F.floor((_c(size) + cs - 1) / cs)
    return F.when(cs <= 0, F.raise_error(F.lit("chunk_size must be positive")).cast("long")).otherwise(whole.cast("long"))


def chunk_span(index, size, chunk_size=CHUNK_SIZE) -> tuple[Column, Column]:
    """(offset, length) of a chunk."""
    offset = _c(index) * chunk_size
    return offset.cast("long"), F.least(F.lit(chunk_size).cast("long"), _c(size) - offset).cast("long")


def wire_bytes(msg_type, name="name", link="link_target", payload="len", received=None, missing=None, detail=None) -> Column:
    """Encoded bytes of a message, header included. The constants add up the fields' widths."""
    size = lambda c: F.coalesce(F.octet_length(_c(c)).cast("long"), F.lit(0)) if c is not None else F.lit(0)
    count = lambda c: F.coalesce(F.size(_c(c)).cast("long"), F.lit(0)) if c is not None else F.lit(0)
    t = _c(msg_type)
    return (
        F.when(t == 3, 90 + size(name) + size(link))
        .when(t.isin(4, 8), 74 + F.coalesce(_c(payload), F.lit(0)))
        .when(t == 7, 126 + size(name))
        .when(t == 9, 36)
        .when(t == 5, 68 + 24 * count(received) + 32 * count(missing))
        .when(t == 6, 73 + size(detail))
        .cast("long")
    )


def same_identity(a: str, b: str) -> Column:
    """Whether two entries (column prefixes ``a`` and ``b``) have the same id, kind and name."""
    return F.col(f"{a}.file_id").eqNullSafe(F.col(f"{b}.file_id")) & F.col(f"{a}.kind").eqNullSafe(F.col(f"{b}.kind")) & F.col(f"{a}.name").eqNullSafe(F.col(f"{b}.name"))


def same_content(a: str, b: str) -> Column:
    """Directories always match, links by target, files by size and checksum."""
    kind = F.col(f"{a}.kind")
    return (
        F.when(kind == 2, True)
        .when(kind == 3, F.col(f"{a}.link_target").eqNullSafe(F.col(f"{b}.link_target")))
        .otherwise(F.col(f"{a}.size").eqNullSafe(F.col(f"{b}.size")) & F.col(f"{a}.checksum").eqNullSafe(F.col(f"{b}.checksum")))
    )
