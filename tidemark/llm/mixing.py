"""Mixing sources to target weights by weighted fair queueing.

Each document, in an order shuffled by a hash of its id and text, gets a virtual finish time: the source's
words up to and including it, divided by the source's target. A second round of a source's
documents follows its first, so that a source can give up to ``most`` times its size. All rounds
are then ordered by finish time over the whole table and cut where the words reach the budget.

Prefix sums are taken in two steps, over small sub-ranges and then inside each, so that neither a
source with most of the rows nor the global order meets in one task.

Defined cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of
its own, last in order; rows that repeat a doc_id are rows of their own, shuffled by id and text; a null
doc_id is an empty one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, n_words, settle, stash

#: Sub-ranges of the shuffled order in a source, and of finish times: more rows need more of them.
BUCKETS = 1024


def targets(sizes: DataFrame, weights: tuple[float, ...], percent: int, most: int) -> DataFrame:
    """source, source_size, target from (source, source_size), one row for each source.

    A source whose fair share exceeds ``most`` times its size stops there. Sources stop in the order
    of that limit over weight; the first that doesn't fixes the level for all after it.
    """
    small = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "utf-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(small) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("most", F.lit(most) * F.col("source_size"))
    stops = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("spent", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("gone", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("budget", F.lit(percent / 100) * F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    t = t.withColumn("turn", F.row_number().over(stops)).withColumn("level", (F.col("budget") - F.col("spent")) / (F.col("all_w") - F.col("gone")))
    t = t.withColumn("free", F.min_by("level", F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("turn"))).over(every))
    fair = F.col("free") * F.col("w")
    return t.select("source", "source_size", F.when(F.col("free").isNull() | (fair > F.col("most")), F.col("most")).otherwise(fair).cast("double").alias("target"))


def fair_queue(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs."""
    return _queued(docs, weights, percent, most).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def _name() -> Column:
    """Hash of a row's id and text: only rows that repeat both share it."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))


def _queued(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """doc_id, source, key, size, source_size, target, nth and times (how often a row is taken)."""
    key = _name()
    rows = docs.select("doc_id", F.col("source").cast("string"), n_words("text").alias("size"), key.alias("key"))
    rows = stash(rows.withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * BUCKETS / 2**32)), "mix-rows")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    parts = settle(parts)
    goal = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent, most)
    goal = settle(goal)
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).select("source", "part", "before")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    info = settle(starts.join(goal, same(starts, goal)).select(starts["source"].alias("s"), F.col("part").alias("p"), "before", "source_size", "target"))
    rows = rows.join(info, rows["source"].eqNullSafe(info["s"]) & (rows["part"] == info["p"])).drop("s", "p")
    inner = Window.partitionBy("source", "part").orderBy("key", F.asc_nulls_last("doc_id"), "size")
    rows = rows.withColumn("upto", F.col("before") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("nth", F.row_number().over(inner))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("round")
    queued = rows.filter("size > 0").select("doc_id", "source", "key", "size", "nth", "target", "upto", "source_size", rounds)
    queued = queued.withColumn("finish", (F.col("round") * F.col("source_size") + F.col("upto")) / F.col("target"))
    queued = queued.withColumn("slice", F.least(F.floor(F.col("finish") * BUCKETS), F.lit(4 * BUCKETS)))
    budget = int((goal.agg(F.sum("target")).first()[0] or 0) + 0.5)
    ahead, whole, cut = 0, -1, None  # at most 4 * BUCKETS + 1 slices, whatever the input
    for s in queued.groupBy("slice").agg(F.sum("size").alias("words")).orderBy("slice").collect():
        if ahead + s["words"] > budget:
            cut = s["slice"]
            break
        ahead, whole = ahead + s["words"], s["slice"]
    # One slice straddles the budget: only its rows need the exact order.
    order = Window.partitionBy("slice").orderBy("finish", F.asc_nulls_last("source"), "key", F.asc_nulls_last("doc_id"), "round").rowsBetween(Window.unboundedPreceding, 0)
    edge = queued.filter(F.col("slice") == F.lit(cut)).withColumn("total", F.lit(ahead) + F.sum("size").over(order)).filter(F.col("total") <= budget)
    taken = settle(edge.groupBy("source", "key", "nth").agg(F.count("*").alias("edge")))
    full = F.expr(" + ".join(f"if(least(floor(({r} * source_size + upto) / target * {BUCKETS}), {4 * BUCKETS}) <= {whole}, 1, 0)" for r in range(most)))
    done = rows.withColumn("full", F.when(F.col("size") > 0, full).otherwise(0))
    out = done.join(taken, done["source"].eqNullSafe(taken["source"]) & (done["key"] == taken["key"]) & (done["nth"] == taken["nth"]), "left")
    times = F.col("full") + F.coalesce("edge", F.lit(0))
    return out.select("doc_id", done["source"], done["key"], "size", "source_size", "target", done["nth"], times.cast("int").alias("times"))


def op9_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_queue(documents(spark, sf_dir)).drop("source")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document stays as often as the mix takes it, as repeated rows."""
    among = Window.partitionBy("_source", "_key").orderBy("_nth")
    taken = _queued(docs).filter("size > 0").select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("_source"), F.col("key").alias("_key"), F.col("nth").alias("_nth"), F.col("times").alias("_times"))
    taken = taken.withColumn("_k", F.row_number().over(among)).filter("_times > 0").drop("_nth")
    rows = docs.withColumns({"_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")), "_key": _name()})
    # Rows that repeat id, source and text are numbered by their other columns, so that each gets one of the group's counts.
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_source", "_key").orderBy(F.xxhash64(*docs.columns))))
    return rows.join(taken, ["_source", "_key", "_k"]).withColumn("_round", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns)


QUERIES = {"op9_fair_queueing": op9_fair_queueing}
SQL = {
    "op9_fair_queueing": r"""
with d as (select doc_id, source, md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as key,
    len(list_filter(string_split(translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> ''))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as w, 2 * source_size as most from s),
b as (select *, coalesce(sum(most) over o, 0)::double as spent, coalesce(sum(w) over o, 0)::double as gone, 1.5::double * sum(source_size) over () as budget, sum(w) over () as all_w, row_number() over o2 as turn
      from w window o as (order by most / w, source is null, source rows between unbounded preceding and 1 preceding), o2 as (order by most / w, source is null, source)),
l as (select *, (budget - spent) / (all_w - gone) as level from b),
m as (select *, first_value(case when level * w <= most then level end) over (order by case when level * w <= most then turn else 1e18 end rows between unbounded preceding and unbounded following) as free from l),
t as (select source, source_size, (case when free is null or free * w > most then most else free * w end)::double as target from m),
q as (select d.doc_id, d.source, d.key, d.size, t.source_size, t.target, sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding) as upto
      from d join t on d.source is not distinct from t.source),
r as (select q.*, k, (k * source_size + upto)::double / target as finish from q, (values (0), (1)) v(k) where size > 0),
c as (select *, floor(finish * 1024) as slice from r),
o as (select *, sum(size) over (order by least(slice, 4096), finish, source, key, doc_id, k rows unbounded preceding) as total from c),
z as (select doc_id, count(*) as times from o where total <= (select floor(sum(target) + 0.5) from t) group by doc_id)
select q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(z.times, 0))::bigint as taken from q left join z on q.doc_id is not distinct from z.doc_id
""",
}
