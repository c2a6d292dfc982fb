"""Running values along ordered rows of any number: scans over ranges, put together by their totals.

A window over a key is one task's, however long the key's history. Here all rows are dealt into ranges of
(key, order); each range's windows are a task's, and what the key's earlier ranges amount to is added. At
most one key goes over the border of a range and the next, so there are fewer such carried values than ranges, and they
are broadcast. The rows in their ranges are kept in the shared folder, as ranges come from a sample and may differ
if they are made again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import settle

#: For each kind of running value: over rows, and over two of its values.
_KINDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


class Ranges:
    """rows in ranges of (keys, order). ``order`` names columns, with ``-`` in front for descending; rows that agree in all of them are one range's, in any order."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], partitions: int | None = None):
        n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order = keys, order
        self.rows = settle(rows.repartitionByRange(n, *keys, *self._sort(False)).withColumn("_range", F.spark_partition_id()))

    def _sort(self, back: bool) -> list[Column]:
        return [(F.desc if c.startswith("-") != back else F.asc)(c.lstrip("-")) for c in self.order]

    def with_running(self, name: str, kind: str, value: Column, before: bool = False, back: bool = False) -> Ranges:
        """A column of the running sum, max, min or last value that isn't null of ``value`` up to each row of its key; ``before``: without the row
        itself; ``back``: from the key's end. Null where there is no value yet."""
        over, both = _KINDS[kind]
        inner = Window.partitionBy(*self.keys, "_range").orderBy(*self._sort(back))
        rows = self.rows.withColumn("_value", value)
        total = over("_value")
        if kind == "last":
            rows, total = rows.withColumn("_place", F.row_number().over(inner)), F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_place")))
        here = [F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]
        totals = rows.groupBy(*here, F.col("_range").alias("_r")).agg(total.alias("_total"))
        names = [f"_k{i}" for i in range(len(self.keys))]
        earlier = Window.partitionBy(*names).orderBy(F.desc("_r") if back else F.asc("_r")).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.withColumn("_carry", over("_total").over(earlier)).filter("_carry is not null").drop("_total")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)], F.col("_range") == F.col("_r"))
        local = over("_value").over(inner.rowsBetween(Window.unboundedPreceding, -1 if before else 0))
        found = rows.withColumn("_local", local).join(F.broadcast(carried), same, "left").drop(*names, "_r", "_place")
        joined = F.when(F.col("_carry").isNull(), F.col("_local")).when(F.col("_local").isNull(), F.col("_carry")).otherwise(both(F.col("_carry"), F.col("_local")))
        self.rows = found.withColumn(name, joined).drop("_value", "_local", "_carry")
        return self

    def kept(self) -> Ranges:
        """The rows so far computed once, before further steps read them several times."""
        self.rows = settle(self.rows)
        return self

    def done(self) -> DataFrame:
        return self.rows.drop("_range")


class Keyed(Ranges):
    """The same for rows of which each key has few: one window a key, without ranges."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str]):
        self.keys, self.order, self.rows = keys, order, rows

    def with_running(self, name: str, kind: str, value: Column, before: bool = False, back: bool = False) -> Keyed:
        own = Window.partitionBy(*self.keys).orderBy(*self._sort(back)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        self.rows = self.rows.withColumn(name, _KINDS[kind][0](value).over(own))
        return self


def fitting(parts: list[DataFrame], keys: list[str], many: int = 1 << 16) -> type[Ranges]:
    """The scan for rows that come together from parts: over ranges if a key has many, else a window a key. Both give the same."""
    rows = reduce(DataFrame.unionAll, [p.select(*keys) for p in parts])
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return Ranges if most > many else Keyed


def chain(jumps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _at: the nodes that each key's chain of jumps (keys, node, to) visits from node 0 on. Every round doubles the part of the chain that is known and the
    length of the jumps, so rounds grow with the log of the longest chain."""
    jumps = settle(jumps)
    reached = jumps.filter("node = 0").select(*keys, F.col("to").alias("_at"))
    while True:
        more = settle(reached.join(jumps.withColumnRenamed("node", "_at"), [*keys, "_at"]).select(*keys, F.col("to").alias("_at")))
        if more.isEmpty():
            return reached
        reached = reached.union(more)
        second = jumps.select(*keys, F.col("node").alias("to"), F.col("to").alias("far"))
        jumps = settle(jumps.join(second, [*keys, "to"]).select(*keys, "node", F.col("far").alias("to")))
