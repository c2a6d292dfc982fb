from pyspark.sql import functions as F

from tidemark.functions import names as N


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def model(name):
    h = 1469598103934665603
    for b in name.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    h |= 1 << 63
    return h - 2**64


def test_path_id_equals_a_plain_model(spark):
    rows = spark.createDataFrame([("",), ("a",), ("dir/file.txt",), ("süß/é",), ("x" * 300,)], "name string").select("name", N.path_id("name").alias("i"))
    assert all(r.i == model(r.name) for r in rows.collect())


def test_numeric_names(spark):
    cases = {"2.file": 2, "007.file": 7, "+2.file": None, "x2.file": None, "2.files": None, "18446744073709551615.file": -1, "18446744073709551616.file": None, "000000000000000000000000012.file": 12, ".file": None}
    rows = spark.createDataFrame([(k,) for k in cases], "name string").select("name", N.numeric_file_id("name").alias("i"), N.file_name_for_id(N.numeric_file_id("name")).alias("back"))
    got = {r.name: r for r in rows.collect()}
    assert {k: r.i for k, r in got.items()} == cases
    assert got["007.file"].back == "7.file" and got["18446744073709551615.file"].back == "18446744073709551615.file"


def test_entry_id_is_numeric_for_top_level_files_only(spark):
    rows = spark.createDataFrame([(1, "5.file"), (2, "5.file"), (1, "d/5.file")], "kind int, name string").select("name", N.entry_id("kind", "name").alias("i"))
    assert [r.i for r in rows.collect()] == [5, model("5.file"), model("d/5.file")]


def test_safe_names_and_mounts(spark):
    cases = {"a": True, "a/b": True, "a//b": True, "": False, "/a": False, "a/": False, "a/../b": False, "./a": False, "..": False, "a/.": False, "a..b": True, None: False}
    rows = spark.createDataFrame([(k,) for k in cases], "name string").select("name", N.is_safe_name("name").alias("ok"))
    assert {r.name: r.ok for r in rows.collect()} == cases
    roots = spark.createDataFrame([("/srv/data",), ("../x/./y",), ("/",)], "r string").select(N.mounted_root(F.lit("/mnt/"), "r").alias("m"))
    assert [r.m for r in roots.collect()] == ["/mnt/srv/data", "/mnt/x/y", "/mnt/"]


def test_chunk_geometry_and_threshold(spark):
    rows = spark.createDataFrame([(0,), (1,), (65536,), (65537,)], "size long").select("size", N.chunk_count("size").alias("n"), N.use_chunks("size").alias("c"))
    assert [(r.n, r.c) for r in rows.collect()] == [(0, False), (1, False), (1, False), (2, True)]
    offset, length = N.chunk_span(F.lit(1), F.lit(65537))
    assert spark.range(1).select(offset, length).first() == (65536, 1)


def test_wire_bytes(spark):
    rows = spark.createDataFrame([(3, "ab", "c", None), (8, None, None, 10), (9, None, None, None), (7, "ab", None, None), (1, None, None, None)], "t int, name string, link_target string, len long")
    assert [r[0] for r in rows.select(N.wire_bytes("t")).collect()] == [93, 84, 36, 128, None]
