"""Checksums of many files at once, short and long."""

import random

from tidemark.functions.checksums import crc
from tidemark.sources import tree


def test_short_ranges_are_summed_together_in_their_places():
    texts, found = {3: b"abc", 0: b"", 2: bytes(700)}, [0, 7, 0, 0]
    tree._many(texts, found)
    assert found == [0, 7, int(crc([bytes(700)])[0]), int(crc([b"abc"])[0])]


def test_short_and_long_files_have_their_sums(spark, tmp_path):
    r = random.Random(2)
    held = {f"f{n}": r.randbytes(n) for n in (0, 1, 300, 70_000, tree.SHORT, tree.SHORT + 1)}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    rows = spark.createDataFrame([(str(tmp_path), name, 1, len(data)) for name, data in held.items()], "root string, name string, kind int, size long")
    got = {x.name: bytes(x.checksum.value) for x in tree.with_checksums(rows).collect()}
    assert got == {name: int(crc([data])[0]).to_bytes(4, "little") if data else b"" for name, data in held.items()}

