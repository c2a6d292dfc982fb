"""What the steps of an operator leave on the disk while later ones run, and how often a round of labels deals rows out anew."""

import random
import time

from helpers_llm import make, text
from pyspark.sql import functions as F

from tidemark.llm import minhash
from tidemark.llm.common import settle, stash

_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
    return {x for x in found if x.startswith("shuffle_")}


def left_by(spark, act):
    """The shuffle files that act left; they go a moment after a step ends."""
    before, setting, out = shuffle_files(spark), spark.conf.get(_SETTING, None), act()
    assert spark.conf.get(_SETTING, None) == setting
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left, out


def test_steps_give_their_shuffle_files_back(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    for act in (lambda: settle(counted), lambda: stash(counted, "counted")):
        left, out = left_by(spark, act)
        assert not left and sum(r.n for r in out.collect()) == 1000
    assert sum(r.n for r in counted.collect()) == 1000  # what was settled can still be computed itself


def test_near_duplicates_keep_no_shuffle_of_an_earlier_step(spark):
    base = text(5, 120).split()
    rows = [(k, " ".join([*base[: 3 * k], f"own{k}", *base[3 * k :]]), "s") for k in range(30)]
    left, out = left_by(spark, lambda: minhash.near_duplicates(make(spark, rows)))
    assert not left and {r.component_id for r in out.collect()} == {0}


def test_components_of_paths_stars_and_rings(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 180)] + [(300, k) for k in range(200, 290)] + [(400 + k, 400 + (k + 1) % 30) for k in range(30)] + [(5, 5)]
    edges = [e if r.random() < 0.5 else e[::-1] for e in edges]
    got = {x.node: x.label for x in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 5 if k == 5 else 100 if k < 200 else 200 if k <= 300 else 400 for e in edges for k in e}


def test_a_round_of_labels_deals_out_edges_labels_and_two_results(spark):
    edges = settle(spark.range(50).selectExpr("inline(array(struct(id a, id div 2 b), struct(id div 2 a, id b), struct(id a, id b), struct(id div 2 a, id div 2 b)))").distinct())
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    after = minhash.spread(edges, labels)
    assert after._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 5  # labels twice, of which one is used again
    assert {x.node for x in after.collect()} == set(range(50))
