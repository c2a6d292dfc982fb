"""Table schemas and code tables. Codes are widened to the next signed type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHECKSUM = "struct<algo:int,offset:bigint,len:bigint,value:binary>"
ENTRIES = f"manifest_id bigint, stream_id bigint, root string, seq bigint, file_id bigint, kind int, name string, link_target string, size bigint, checksum {CHECKSUM}"
STARTS = "manifest_id bigint, stream_id bigint, action int, start_file_id bigint, start_offset bigint, conflict string"
CHUNKS = "stream_id bigint, seq bigint, file_id bigint, chunk_index bigint, offset bigint, raw_len bigint, compression int, checksum_algo int, checksum binary, payload binary"
_RECEIVED = "array<struct<seq:bigint,file_id:bigint,chunk_index:bigint>>"
_MISSING = "array<struct<seq:bigint,file_id:bigint,first:bigint,last:bigint>>"
_ENTRY = f"struct<file_id:bigint,seq:bigint,kind:int,name:string,link_target:string,size:bigint,checksum:{CHECKSUM}>"
MESSAGES = (
    "arrival bigint, line_id int, msg_type int, stream_id bigint, seq bigint, file_id bigint, kind int, name string, link_target string, "
    "final_size bigint, offset bigint, raw_len bigint, chunk_index bigint, chunk_size bigint, chunk_count bigint, compression int, checksum_algo int, checksum binary, payload binary, "
    f"file_checksum {CHECKSUM}, prev_file_id bigint, prev_final_size bigint, prev_checksum {CHECKSUM}, next_seq bigint, durable_offset bigint, recv_window_bytes bigint, "
    f"received_chunks {_RECEIVED}, missing_ranges {_MISSING}, got_seq bigint, expected_seq bigint, expected_file_id bigint, expected_offset bigint, reason int, detail string, "
    "node_id string, role int, min_version int, max_version int, feature_flags bigint, required_feature_flags bigint, max_inflight_bytes bigint, supported_compression array<int>, supported_checksum array<int>, "
    f"manifest_id bigint, streams array<struct<stream_id:bigint,root:string,entries:array<{_ENTRY}>>>, starts array<struct<stream_id:bigint,action:int,start_file_id:bigint,start_offset:bigint>>"
)

# Codes on the wire.
MSG_TYPES = {"HELLO": 1, "MANIFEST1": 2, "CREATE": 3, "DATA": 4, "HEARTBEAT": 5, "NACK": 6, "FILE_BEGIN": 7, "CHUNK": 8, "FILE_COMMIT": 9, "MANIFEST2": 10}
ROLES = {"SENDER": 1, "RECEIVER": 2}
COMPRESSIONS = {"NONE": 0, "LZ4": 1, "ZSTD": 2}
ALGOS = {"NONE": 0, "CRC32C": 1, "MD5": 2}
KINDS = {"REGULAR_FILE": 1, "DIRECTORY": 2, "SYMLINK": 3}
ACTIONS = {"IN_SYNC": 0, "RESUME_EXISTING": 1, "CREATE_MISSING": 2}
REASONS = {
    "BAD_SESSION": 1, "BAD_SEQ": 2, "BAD_OFFSET": 3, "BAD_CHECKSUM": 4, "BAD_FILE_ORDER": 5, "BAD_CREATE": 6, "FILE_EXISTS": 7, "PREV_FILE_INCOMPLETE": 8,
    "SIZE_CONFLICT": 9, "CHECKSUM_MISMATCH": 10, "UNSUPPORTED_COMPRESSION": 11, "DECODE_ERROR": 12, "IO_ERROR": 13, "BAD_CHUNK": 14, "BAD_COMMIT": 15,
}
#: Rejections after which the packet or the manifest is sent again.
RECOVERABLE = ("BAD_CHECKSUM", "BAD_COMMIT", "SIZE_CONFLICT", "CHECKSUM_MISMATCH", "BAD_SEQ", "BAD_OFFSET", "BAD_CHUNK")
TABLES = {"msg_type": MSG_TYPES, "role": ROLES, "compression": COMPRESSIONS, "checksum_algo": ALGOS, "kind": KINDS, "action": ACTIONS, "reason": REASONS}


def code_table(spark, column: str) -> DataFrame:
    """(code, name) of a code column."""
    return spark.createDataFrame([(v, k) for k, v in TABLES[column].items()], "code int, name string")


def with_names(df: DataFrame, *columns: str) -> DataFrame:
    """df with <column>_name for each code column; an unknown code has no name. The code tables have at most 15 rows."""
    for c in columns:
        names = F.broadcast(code_table(df.sparkSession, c).toDF("_code", f"{c}_name"))
        df = df.join(names, F.col(c) == F.col("_code"), "left").drop("_code")
    return df


def is_recoverable(reason):
    """Whether a rejection's reason code is one of the recoverable ones."""
    return reason.isin([REASONS[r] for r in RECOVERABLE])
