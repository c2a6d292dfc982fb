"""The change feed and listings by levels, over real trees."""

import os
import shutil

import pytest

from tidemark.sources import feed, frontier, tree


def test_feed_sees_every_kind_of_change_and_survives_restarts(spark, tmp_path):
    root, kept = tmp_path / "root", tmp_path / "kept"
    for name in ("a/b/c.txt", "a/b/gone.txt", "a/grows", "top", "a.txt", "z/same", "skip/x", f"{feed.TEMP}/t"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("12345")
    os.symlink("top", root / "link")

    def run(k):
        found = []
        stream = feed.watch_tree(spark, str(root), str(kept), buckets=3, exclude_top=("skip",))
        q = stream.writeStream.foreachBatch(lambda b, n: found.extend((r.change, r.path, r.old_size, r.new_size) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(found)

    assert run(0) == sorted(("CREATED", n, None, 5) for n in ("a/b/c.txt", "a/b/gone.txt", "a/grows", "top", "a.txt", "z/same"))
    (root / "a/b/gone.txt").unlink()
    (root / "a/grows").write_text("1234567")
    (root / "top").write_text("123")
    os.utime(root / "a.txt", (5, 5))
    (root / "old").write_text("x")
    os.utime(root / "old", (1000, 1000))  # arrives with an old time
    shutil.copytree(root / "z", root / "a" / "new")
    want = [("APPENDED", "a/grows", 5, 7), ("CREATED", "a/new/same", None, 5), ("CREATED", "old", None, 1), ("MODIFIED", "a.txt", 5, 5), ("MODIFIED", "top", 5, 3), ("REMOVED", "a/b/gone.txt", 5, None)]
    assert run(1) == want and run(2) == []
    shutil.rmtree(root / "a")
    assert [c[:2] for c in run(3)] == [("REMOVED", n) for n in ("a/b/c.txt", "a/grows", "a/new/same")]
    assert len([d for d in os.listdir(kept) if d.isdigit()]) <= 2  # earlier listings are gone


def test_a_batch_that_runs_again_gives_the_same_changes(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a").write_text("1")
    reader = feed._FeedReader({"path": str(root), "snapshots": str(tmp_path / "kept"), "buckets": "2"})
    start, end = reader.initialOffset(), reader.latestOffset()
    first = [list(reader.read(p)) for p in reader.partitions(start, end)]
    (root / "b").write_text("2")  # comes after the listing was made
    again = feed._FeedReader({"path": str(root), "snapshots": str(tmp_path / "kept"), "buckets": "2"})
    assert [list(again.read(p)) for p in again.partitions(start, end)] == first
    later = again.latestOffset()
    assert later["at"] > end["at"] and [c[:2] for p in again.partitions(end, later) for c in again.read(p)] == [("CREATED", "b")]
    with pytest.raises(ValueError, match="buckets"):
        again.partitions({"at": 1, "buckets": 5}, later)
    again.commit(later)
    assert again._kept() == [later["at"]]
    with pytest.raises(FileNotFoundError):
        list(again.read(again.partitions(end, later)[0]))  # its listing is gone: an error, not a full listing


def test_buckets_share_out_a_tree_in_order(tmp_path):
    for name in ("d/e/f", "d/e.x", "d.x/g", "b", "d/ä"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    rows = [list(feed.bucket_listing(str(tmp_path), k, 4)) for k in range(4)]
    assert sorted(r[0] for part in rows for r in part) == sorted(["d/e/f", "d/e.x", "d.x/g", "b", "d/ä"])
    assert all([r[0].split("/") for r in part] == sorted(r[0].split("/") for r in part) for part in rows)
    assert list(feed.bucket_listing(str(tmp_path / "none"), 0, 1)) == []


def test_listing_by_levels_equals_a_walk(spark, tmp_path):
    root = tmp_path / "r"
    for k in range(40):
        (root / f"d{k % 7}" / f"e{k % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"d{k % 7}" / f"e{k % 3}" / f"f{k}").write_text("x" * k)
    os.symlink("d1", root / "link")
    (root / "empty").mkdir()
    os.mkfifo(root / "pipe")
    (root / "skip").mkdir()
    (root / "skip" / "x").write_text("")
    roots = spark.createDataFrame([(1, str(root)), (2, str(root / "d1")), (3, str(root / "none"))], "stream_id long, root string")
    got = sorted((r.stream_id, r.name, r.kind, r.link_target, r.size, r.mtime) for r in frontier.list_trees(roots, ("skip",)).collect())
    want = sorted([(1, *r) for r in tree.listing(str(root), "", ("skip",))] + [(2, *r) for r in tree.listing(str(root / "d1"))])
    assert got == want and len(got) > 60
    assert frontier.list_trees(roots.filter("false")).count() == 0


def test_a_directory_with_many_names_is_read_by_many_tasks(spark, tmp_path):
    for k in range(3000):
        (tmp_path / f"n{k}").touch()
    roots = spark.createDataFrame([(1, str(tmp_path))], "stream_id long, root string")
    listed = frontier.list_trees(roots, per_task=200)
    assert listed.rdd.getNumPartitions() == 15 and listed.count() == 3000
    assert tree.scan_tree(spark, str(tmp_path), 1, regex="n1.$").count() == 10


def test_a_large_file_is_read_in_ranges(spark, tmp_path):
    from tidemark.functions.checksums import crc_bytes

    data = bytes((5 + 31 * i) % 251 for i in range(100_001))
    (tmp_path / "big").write_bytes(data)
    (tmp_path / "small").write_bytes(b"x")
    (tmp_path / "empty").touch()
    (tmp_path / "dir").mkdir()
    entries = tree.scan_tree(spark, str(tmp_path), 1, checksum=False)
    for most, tail in ((None, data), (70_000, data[-70_000:]), (10, data[-10:])):
        got = {r.name: r.checksum for r in tree.with_checksums(entries, most, step=999).collect()}
        assert bytes(got["big"].value) == crc_bytes(tail) and (got["big"].offset, got["big"].len) == (len(data) - len(tail), len(tail))
        assert bytes(got["small"].value) == crc_bytes(b"x") and got["empty"].algo == got["dir"].algo == 0 and len(got) == 4
