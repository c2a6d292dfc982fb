"""Running values over ranges against plain loops, with keys that span many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ranges import Ranges


def loop(rows, kind, before, back):
    """rows (key, order, value), sorted."""
    out, held, last = {}, None, object()
    for key, at, v in reversed(rows) if back else rows:
        if key != last:
            held, last = None, key
        after = v if held is None else held if v is None else {"sum": held + v, "max": max(held, v), "min": min(held, v), "last": v}[kind]
        out[key, at] = held if before else after
        held = after
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_running_values_equal_loops(spark, parts):
    r = random.Random(4)
    rows = [(k, at, r.choice([None, r.randrange(-9, 9)])) for k in ("a", None, "b", "c") for at in range({"a": 150, "c": 1}.get(k, 12))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k string, at int, v long")
    ranges = Ranges(df, ["k"], ["at"], parts)
    cases = [(kind, before, back) for kind in ("sum", "max", "min", "last") for before in (False, True) for back in (False, True)]
    for n, case in enumerate(cases):
        ranges.with_running(f"r{n}", case[0], F.col("v"), *case[1:])
        if n % 4 == 3:
            ranges.kept()
    got = ranges.done().collect()
    assert len(got) == len(rows)
    for n, case in enumerate(cases):
        assert {(x.k, x.at): x[f"r{n}"] for x in got} == loop(rows, *case), case


def test_descending_order_and_a_key_in_many_ranges(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id")
    ranges = Ranges(df, ["k"], ["-id"], 9).with_running("n", "sum", F.lit(1))
    assert ranges.rows.select("_range").distinct().count() == 9  # one line's rows are nine tasks'
    assert all(r.n == 1000 - r.id for r in ranges.done().collect())
    assert Ranges(df.filter("false"), ["k"], ["id"]).with_running("n", "max", F.col("id")).done().count() == 0
