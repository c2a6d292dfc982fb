"""Two-phase commits that are killed and run again, and names that would lead outside."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.checksums import crc_bytes
from tidemark.sources import sink

CHUNKS = "file_id long, name string, size long, file_checksum binary, offset long, payload binary"


def chunks(spark, files, step=7):
    rows = [(k, name, len(data), bytearray(crc_bytes(data)), at, bytearray(data[at : at + step])) for k, (name, data) in enumerate(files.items()) for at in range(0, max(1, len(data)), step)]
    return spark.createDataFrame(rows, CHUNKS).repartition(3)


FILES = {f"d{k % 3}/f{k}": bytes(range(k * 5)) for k in range(8)}


def there(root):
    return {os.path.relpath(os.path.join(at, n), root): open(os.path.join(at, n), "rb").read() for at, dirs, names in os.walk(root) for n in names if sink.TEMP not in at}


@pytest.mark.parametrize("killed_after", [0, 1, 4, 7])
def test_a_commit_killed_between_names_is_finished(spark, tmp_path, monkeypatch, killed_after):
    root = str(tmp_path)
    with monkeypatch.context() as m:
        m.setattr(sink, "_publish", lambda *_: None)  # killed when the plan is marked
        sink.write_files(spark, chunks(spark, FILES), root)
    assert there(root) == {}
    (job,) = os.listdir(tmp_path / sink.TEMP)
    for name in list(FILES)[:killed_after]:  # some names were given
        sink._give_name(str(tmp_path / sink.TEMP / job), root, name)
    sink.recover(spark, root)
    assert there(root) == FILES and os.listdir(tmp_path / sink.TEMP) == []
    sink.recover(spark, root)


def test_a_job_killed_before_its_plan_leaves_nothing(spark, tmp_path):
    job = sink._begin(str(tmp_path))
    sink._put(job, str(tmp_path), "a/b", 0, b"123")
    sink.recover(spark, str(tmp_path), older_s=3600)
    assert os.path.isdir(job)  # may still run
    sink.recover(spark, str(tmp_path))
    assert there(str(tmp_path)) == {} and not os.path.isdir(job)


def test_a_taken_name_undoes_the_plan_and_stays_as_it_is(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "f4").write_bytes(b"own")
    with pytest.raises(Exception, match="FILE_EXISTS"):
        sink.write_files(spark, chunks(spark, FILES), str(tmp_path))
    assert there(str(tmp_path)) == {"d1/f4": b"own"} and os.listdir(tmp_path / sink.TEMP) == []
    other = sink._begin(str(tmp_path))  # another job's folder is left alone
    (tmp_path / "d1" / "f4").unlink()
    sink.write_files(spark, chunks(spark, FILES), str(tmp_path))
    assert there(str(tmp_path)) == FILES and os.path.isdir(other)


def test_links_at_the_end_of_a_name_are_refused(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    root.mkdir()
    outside.write_bytes(b"keep")
    link = spark.createDataFrame([(str(root), "a", 3, str(outside))], "root string, name string, kind int, link_target string")
    sink.make_entries(link)
    sink.make_entries(link)  # again: as wanted
    seg = spark.createDataFrame([(str(root), "a", 4, bytearray(b"more"))], "root string, name string, offset long, payload binary")
    with pytest.raises(Exception, match="UNSAFE_NAME"):
        sink.append_segments(seg)
    with pytest.raises(Exception, match="UNSAFE_NAME"):
        sink.write_files(spark, chunks(spark, {"a": b"123"}), str(root))
    with pytest.raises(Exception, match="UNSAFE_NAME"):
        sink.make_entries(link.withColumn("link_target", F.lit("else")))
    assert outside.read_bytes() == b"keep"


def test_sink_by_its_name(spark, tmp_path):
    spark.dataSource.register(sink.TreeSink)
    chunks(spark, FILES).write.format("tree_sink").mode("append").save(str(tmp_path))
    assert there(str(tmp_path)) == FILES
    wrong = chunks(spark, {"x": b"abc"}).withColumn("file_checksum", F.lit(b"0000"))
    with pytest.raises(Exception, match="CHECKSUM_MISMATCH"):
        wrong.write.format("tree_sink").mode("append").save(str(tmp_path))
    assert there(str(tmp_path)) == FILES
