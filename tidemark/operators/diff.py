"""Comparing manifests and snapshots, and applying the answer to the transfer tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import file_name_for_id, same_content, same_identity
from tidemark.schemas import ACTIONS, REASONS


def manifest_diff(sender: DataFrame, receiver: DataFrame) -> DataFrame:
    """stream_id, outcome (IN_SYNC, RESUME, CREATE, CONFLICT), start_file_id, start_offset, conflict; one row for each sender stream.

    Entries are paired by position. The first pair that isn't equal decides; receiver entries beyond
    the sender's last are ignored. A shorter receiver file is resumed without a look at its bytes.
    """
    cols = ["file_id", "kind", "name", "link_target", "size", "checksum"]
    s = sender.select("stream_id", "seq", F.struct(*cols).alias("s"))
    r = receiver.select("stream_id", "seq", F.struct(*cols).alias("r"))
    file = F.col("s.kind") == 1
    outcome = (
        F.when(F.col("r").isNull(), "CREATE")
        .when(~same_identity("s", "r"), "IDENTITY")
        .when(~file & ~same_content("s", "r"), "CONTENT")
        .when(~file, None)
        .when(F.col("r.size") > F.col("s.size"), "LARGER")
        .when(F.col("r.size") < F.col("s.size"), "RESUME")
        .when(~F.col("s.checksum").eqNullSafe(F.col("r.checksum")), "CHECKSUM")
    )
    pairs = s.join(r, ["stream_id", "seq"], "left").withColumn("outcome", outcome)
    decisive = F.when(F.col("outcome").isNotNull(), F.col("seq"))  # min_by leaves out rows whose key is null
    first = pairs.groupBy("stream_id").agg(F.min_by(F.struct("outcome", F.col("s.file_id").alias("file_id"), F.col("r.size").alias("at"), F.col("s.name").alias("name")), decisive).alias("d"))
    o = F.col("d.outcome")
    conflict = o.isin("IDENTITY", "CONTENT", "LARGER", "CHECKSUM")
    return first.select(
        "stream_id",
        F.when(o.isNull(), "IN_SYNC").when(conflict, "CONFLICT").otherwise(o).alias("outcome"),
        F.when(o.isin("CREATE", "RESUME"), F.col("d.file_id")).otherwise(F.lit(0)).cast("long").alias("start_file_id"),
        F.when(o == "RESUME", F.col("d.at")).otherwise(F.lit(0)).cast("long").alias("start_offset"),
        F.when(conflict, F.concat(o, F.lit(" "), F.col("d.name"))).alias("conflict"),
    )


def diff_reply(diff: DataFrame, all_or_nothing: bool = True) -> DataFrame:
    """stream_id, action, start_file_id, start_offset, reason. With all_or_nothing, one conflict rejects every stream as SIZE_CONFLICT, whatever its cause."""
    bad = F.col("outcome") == "CONFLICT"
    if all_or_nothing:
        bad = F.max(bad).over(Window.partitionBy())
    action = F.when(bad, None).when(F.col("outcome") == "RESUME", ACTIONS["RESUME_EXISTING"]).when(F.col("outcome") == "CREATE", ACTIONS["CREATE_MISSING"]).otherwise(ACTIONS["IN_SYNC"])
    return diff.select(
        "stream_id", action.cast("int").alias("action"), "start_file_id", "start_offset",
        F.when(bad, REASONS["SIZE_CONFLICT"]).cast("int").alias("reason"),
    )


def apply_reply(entries: DataFrame, starts: DataFrame) -> DataFrame:
    """Entries to send, with action and start_offset: from the start entry on; the first takes the reply's action, later ones are created.

    A stream that the reply leaves out, or a start entry that doesn't exist, is an error. Streams in sync give no rows.
    """
    s = starts.select("stream_id", F.col("action").alias("_action"), F.col("start_file_id").alias("_file"), F.col("start_offset").alias("_offset"))
    joined = entries.join(s, "stream_id", "left")
    first = joined.filter("_action <> 0 and file_id = _file").groupBy("stream_id").agg(F.min("seq").alias("_seq"))
    out = joined.join(first, "stream_id", "left")
    checked = (
        F.when(F.col("_action").isNull(), F.raise_error(F.lit("the reply lacks a stream")).cast("boolean"))
        .when((F.col("_action") != 0) & F.col("_seq").isNull(), F.raise_error(F.lit("the reply's start entry does not exist")).cast("boolean"))
        .otherwise((F.col("_action") != 0) & (F.col("seq") >= F.col("_seq")))
    )
    at_start = F.col("seq") == F.col("_seq")
    out = out.filter(checked)
    return out.select(*entries.columns, F.when(at_start, F.col("_action")).otherwise(ACTIONS["CREATE_MISSING"]).cast("int").alias("action"), F.when(at_start, F.col("_offset")).otherwise(F.lit(0)).cast("long").alias("start_offset"))


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """change, path, old_size, new_size from two snapshots (path, size, mtime): CREATED, APPENDED, MODIFIED or REMOVED."""
    o = old.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("_om"))
    n = new.select("path", F.col("size").alias("new_size"), F.col("mtime").alias("_nm"))
    change = (
        F.when(F.col("old_size").isNull(), "CREATED")
        .when(F.col("new_size").isNull(), "REMOVED")
        .when(F.col("new_size") > F.col("old_size"), "APPENDED")
        .when((F.col("new_size") != F.col("old_size")) | (F.col("_om") != F.col("_nm")), "MODIFIED")
    )
    return o.join(n, "path", "full").select(change.alias("change"), "path", "old_size", "new_size").filter("change is not null")


def entry_lookup(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted (stream_id, file_id) with the entry's name, or ``<id>.file``."""
    names = entries.select("stream_id", "file_id", "name")
    return wanted.join(names, ["stream_id", "file_id"], "left").withColumn("name", F.coalesce("name", file_name_for_id("file_id")))


def predecessor_barrier(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """messages with verdict: null, PREV_FILE_INCOMPLETE or CHECKSUM_MISMATCH by their named predecessor (none if prev_file_id is 0)."""
    e = entries.select("stream_id", F.col("file_id").alias("prev_file_id"), F.col("size").alias("_size"), F.col("checksum").alias("_sum"))
    verdict = (
        F.when(F.col("prev_file_id") == 0, None)
        .when(F.col("_size").isNull() | (F.col("_size") != F.col("prev_final_size")), "PREV_FILE_INCOMPLETE")
        .when(~F.col("_sum").eqNullSafe(F.col("prev_checksum")), "CHECKSUM_MISMATCH")
    )
    return messages.join(e, ["stream_id", "prev_file_id"], "left").withColumn("verdict", verdict).drop("_size", "_sum")


def existing_targets(planned: DataFrame, target: DataFrame) -> DataFrame:
    """Planned creations (stream_id, name) whose target is there already."""
    return planned.join(target.select("stream_id", "name"), ["stream_id", "name"], "left_semi")


def removed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("path"), "path", "left_anti")
