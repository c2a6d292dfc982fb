"""MinHash near-duplicates with tensored banding.

Two small families of ``m`` collections, each of ``r`` minhashes, are computed; every pair of a
collection from one family and one from the other is the key of one table, so ``m * m`` tables cost
``2 * m * r`` minhashes instead of ``m * m * 2 * r``. Two sets with similarity J meet in some table
with probability ``(1 - (1 - J**r) ** m) ** 2``; with r = 3, m = 10 that is 0.9998 at J = 0.85.
Rows with equal shingle sets are one class, of which one representative enters the tables. Every
link is confirmed on the full sets.

Defined cases: a null or blank text has an empty set, links with nothing and is kept; rows with
equal doc_id are one node; a row without doc_id stands alone (component null, kept); other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WordHashes, bounded_batches, documents, mix, seeds, settle, sliced, stash, words_of

_HASHES = WordHashes()
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingles(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after another, and the number for each text."""
    words = [words_of(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = _HASHES.of([w for ws in words for w in ws])
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * _STEP + flat[k : k + len(rolled)]
    rolled = mix(rolled)
    sets, at = [], 0
    for ws, k in zip(words, n, strict=True):
        if k >= width:
            sets.append(np.unique(rolled[at : at + k - width + 1]))
        elif k:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), 7)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += k
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(s) for s in sets], np.int64)


def collections(flat: np.ndarray, sizes: np.ndarray, m: int, r: int) -> np.ndarray:
    """For each set (row), 2 * m hashes, each of one collection of r minhashes; rows of empty sets are 0."""
    out = np.zeros((len(sizes), 2 * m), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    a, b = seeds(2 * m * r, "xor"), seeds(2 * m * r, "times")
    ends = np.append(starts[1:], len(flat))
    blocks, first = [], 0  # blocks of sets that stay in the CPU's cache
    for k in range(1, len(full) + 1):
        if k == len(full) or ends[k - 1] - starts[first] >= 16384:
            blocks.append((first, k))
            first = k
    with np.errstate(over="ignore"):
        for lo, hi in blocks:
            part, at = flat[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo]
            for c in range(2 * m):
                joined = np.full(hi - lo, c + 1, np.uint64)
                for k in range(c * r, c * r + r):
                    joined = joined * _STEP + np.minimum.reduceat((part ^ a[k]) * b[k], at)
                out[full[lo:hi], c] = mix(joined)
    return out


def sketches(docs: DataFrame, m: int = 10, r: int = 3, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, fp (128-bit fingerprint of the set, null if empty), sig (2 * m collections)."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            flat, sizes = shingles(batch.column("text").to_pylist(), width)
            sig = collections(flat, sizes, m, r).view(np.int64)
            ends = np.cumsum(sizes)
            prints = [xxhash.xxh3_128_digest(flat[e - n : e].tobytes()) if n else None for e, n in zip(ends, sizes, strict=True)]
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * 2 * m, pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(prints, pa.binary()), arrays], ["doc_id", "n_shingles", "fp", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sketch, "doc_id long, n_shingles long, fp binary, sig array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Those pairs (a, b) of ids in texts (rep, text) whose full sets have
    100 * intersection >= percent * union; a text travels once for each side of its pairs."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "ta"):
            n, ta, tb = part.num_rows, part.column("ta").to_pylist(), part.column("tb").to_pylist()
            distinct = list(dict.fromkeys(ta + tb))
            flat, sizes = shingles(distinct, width)
            sets = {t: flat[e - k : e] for t, e, k in zip(distinct, np.cumsum(sizes), sizes, strict=True)}
            ok = np.zeros(n, bool)
            for i in range(n):
                x, y = sets[ta[i]], sets[tb[i]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield part.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


def _sorted(df: DataFrame) -> DataFrame:
    """For joins on several columns whose sides have no bound: never broadcast, as each such table takes the driver a page of memory."""
    return df.hint("merge")


def groups_of(open_: DataFrame) -> DataFrame:
    """rep, cs (array of one): the group of a document's tables (key, rep, n, label), where at least two other members with different
    labels than the table's centre, as ``centre`` names it, remain to be compared. Tables that share a member are one group, so that no
    two documents meet in several: with each table's own centre as its group, a document's groups grow in number with its copies."""
    by_key = open_.join(open_.groupBy("key").agg(*centre(1)).select("key", "c.c"), "key").filter("rep <> c").select("c", "rep", "label").distinct()
    several = by_key.groupBy("c").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("c")
    held = settle(by_key.join(several, "c").groupBy("rep").agg(F.first("label").alias("label"), F.sort_array(F.collect_list("c")).alias("cs")))  # at most one for each table
    joined = components(held.select(F.expr("cs[0]").alias("a"), F.explode(F.expr("slice(cs, 2, size(cs))")).alias("b")).distinct())
    return held.select("rep", "label", F.expr("cs[0]").alias("node")).join(joined.withColumnRenamed("label", "c"), "node", "left").select("rep", "label", F.array(F.coalesce("c", "node")).alias("cs"))


_BITS = ["b0", "b1", "b2", "b3"]


def differences(grouped: DataFrame, texts: DataFrame, width: int, about: int = 64) -> DataFrame:
    """c, rep, v, label, n, d, bits, sh: for each member of a group c, the shingles by which its set differs from the
    group's common set, and their number d; a row with sh null stands for the member itself. bits has, in 4 numbers
    of 64 bits, whether the member has an odd number of shingles in each of 256 classes.

    The common set holds the shingles of more than half of ``about`` members. It may be any set: a good one
    only makes the differences small. v tells different texts of one id apart.
    """
    rows = stash(grouped.join(texts, "rep").withColumn("v", F.xxhash64("text")), "grouped-texts")
    members = rows.select(F.explode("cs").alias("c"), "rep", "v")
    sizes = settle(members.groupBy("c").agg(F.count("*").alias("size")))
    asked = members.join(sizes, "c").filter(f"pmod(xxhash64(rep, v, c), cast(ceil(size / {about}) as bigint)) = 0").groupBy("rep", "v").agg(F.collect_list("c").alias("asked"))

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            flat, n = shingles(part.column("text").to_pylist(), width)
            ends = np.cumsum(n)
            own = [(c, flat[e - k : e]) for e, k, cs in zip(ends, n, part.column("asked").to_pylist(), strict=True) for c in cs]
            c = np.repeat(np.array([c for c, _ in own], np.int64), [len(x) for _, x in own])
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.concatenate([x for _, x in own]).view(np.int64))], ["c", "sh"])

    counted = rows.join(_sorted(asked), ["rep", "v"]).select("text", "asked").mapInArrow(listed, "c long, sh long").groupBy("c", "sh").agg(F.count("*").alias("n"))
    voters = asked.select(F.explode("asked").alias("c")).groupBy("c").agg(F.count("*").alias("voters"))
    common = counted.join(voters, "c").filter("2 * n > voters").groupBy("c").agg(F.collect_list("sh").alias("common"))  # twice a text's mean size at most
    # A large group's common set comes in copies, among which its members are dealt.
    copies = sizes.join(common, "c", "left").select("c", "common", F.explode(F.expr("sequence(0L, size div 1000)")).alias("copy"))
    dealt = rows.select("rep", "v", "label", "text", F.explode("cs").alias("c")).join(sizes, "c").withColumn("copy", F.expr("pmod(xxhash64(rep, v), size div 1000 + 1)"))

    def differ(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            flat, n = shingles(part.column("text").to_pylist(), width)
            own = [np.setxor1d(flat[e - k : e], np.array(c or (), np.int64).view(np.uint64), assume_unique=True) for e, k, c in zip(np.cumsum(n), n, part.column("common").to_pylist(), strict=True)]
            d = np.array([len(x) for x in own], np.int64)
            parity = [np.packbits(np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64) for x in own]
            cols = [np.repeat(x, d + 1) for x in (*(part.column(k).to_numpy(zero_copy_only=False) for k in ("c", "rep", "v", "label")), n, d, *np.array(parity).T)]
            sh = np.concatenate([np.append(x, np.uint64(0)) for x in own]).view(np.int64)
            itself = np.zeros(len(sh), bool)
            itself[np.cumsum(d + 1) - 1] = True
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(sh, mask=itself)], ["c", "rep", "v", "label", "n", "d", *_BITS, "sh"])

    held = dealt.join(_sorted(copies), ["c", "copy"]).select("c", "rep", "v", "label", "text", "common")
    return held.mapInArrow(differ, f"c long, rep long, v long, label long, n long, d long, {' long, '.join(_BITS)} long, sh long")


def difference_tables(open_: DataFrame, texts: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """For the members of tables (key, rep, n, label): pairs (a, b) that link for certain, and further tables
    (c, sh, low, high) of members that may link, so that every link that the comparison with the tables' centres
    left open is in the second, or has a path of links through the first.

    Let D(x) be the difference of x from its group's common set and g(x) = (100 - p) * size - (100 + p) * |D(x)|.
    x and y link if and only if g(x) + g(y) + 2 * (100 + p) * |D(x) & D(y)| >= 0, since their symmetric difference
    is |D(x)| + |D(y)| - 2 * |D(x) & D(y)|. So, if g(x) + g(y) >= 0, both also link with the group's hub, the member
    of the largest g, and comparison with the hub is enough. Any other link has common differences; with these in
    the order of their frequency, the first common one stands at a place q with 2 * (100 + p) * (|D| - q) >= -g(x) - g(y)
    in either list. Members are classed by g, and a list goes, as far as it must, to each class that it may meet and for
    which the hub isn't enough and
    which holds the same difference, so far up in its lists, under another label. A difference whose holders have one label counts as a document's own:
    two documents that differ from the rest in their own ways never meet, however large the group is.
    """
    rows = stash(differences(settle(groups_of(open_)), texts, width), "differences")
    rows = rows.withColumn("g", F.expr(f"{100 - percent} * n - {100 + percent} * d"))
    alone = settle(rows.filter("sh is null").select("c", "rep", "v", "label", "n", "g"))
    hubs = alone.groupBy("c").agg(F.max(F.struct("g", "rep", "label")).alias("h"), F.avg("n").alias("mean"))
    certain = alone.join(hubs, "c").filter("g + h.g >= 0 and label <> h.label").select(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b"))
    step = hubs.select("c", F.expr(f"{100 + percent} * cast(ceil(mean / 50) as bigint)").alias("step"))
    classed = alone.join(step, "c").withColumn("cls", F.expr("floor(g / step)"))
    classes = settle(classed.groupBy("c", "cls").agg(F.max("g").alias("top"), F.min("g").alias("bottom")).groupBy("c").agg(F.collect_list(F.struct("cls", "top", "bottom")).alias("classes")).join(step, "c"))
    listed = rows.filter("sh is not null")
    again = listed.groupBy("c", "sh").agg(F.count("*").alias("df"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").drop("l0", "l1")
    held = listed.join(_sorted(again), ["c", "sh"])
    by_doc = Window.partitionBy("c", "rep", "v")
    ranked = held.withColumn("own", F.col("d") - F.count("*").over(by_doc)).withColumn("q", F.col("own") + F.row_number().over(by_doc.orderBy("df", "sh")) - 1)
    ranked = ranked.join(classes, "c").withColumn("cls", F.expr("floor(g / step)")).withColumn("left", F.expr(f"{2 * (100 + percent)} * (d - q)"))
    ranked = ranked.filter("exists(classes, k -> left + g + k.top >= 0 and g + k.bottom < 0)")
    heads = stash(ranked.select("c", "sh", "cls", "rep", "v", "label", "n", "g", "left", *_BITS), "difference-heads")
    met = heads.groupBy("c", "sh", "cls").agg(F.max("g").alias("top"), F.min("g").alias("bottom"), F.max("left").alias("left"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    met = met.groupBy("c", "sh").agg(F.collect_list(F.struct("cls", "top", "bottom", "left", "l0", "l1")).alias("met"), F.min("l0").alias("l0"), F.max("l1").alias("l1")).filter("l0 < l1").select("c", "sh", "met")
    to = F.expr("filter(met, k -> least(left, k.left) + g + k.top >= 0 and g + k.bottom < 0 and (k.l0 <> label or k.l1 <> label))")
    sent = heads.join(_sorted(met), ["c", "sh"]).withColumn("to", F.explode(to))
    sent = sent.select("c", "sh", F.least("cls", "to.cls").alias("low"), F.greatest("cls", "to.cls").alias("high"), "cls", "rep", "v", "n", "g", "left", *_BITS)
    return certain, stash(sent, "difference-tables")


_TABLE = ["c", "sh", "low", "high"]
_MEMBER = ["rep", "n", "label", "g", "left", *_BITS]


def mixed_tables(tables: DataFrame, label: DataFrame) -> DataFrame:
    """The difference tables whose members have several labels now, with these, if both of their classes have members."""
    now = tables.drop("label").join(label, "rep").select(*_TABLE, "cls", *_MEMBER)
    several = now.groupBy(*_TABLE).agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("cls").alias("k0"), F.max("cls").alias("k1"))
    several = several.filter("l0 < l1 and k0 = low and k1 = high").select(*_TABLE)
    return stash(now.join(_sorted(several), _TABLE), "mixed-tables")


def _can(percent: int) -> str:
    """Whether two members can link, by sizes, by where they meet, and by the classes in which their parities differ, each of
    which holds a shingle of one of them alone."""
    apart = " + ".join(f"bit_count({b} ^ o_{b})" for b in _BITS)
    return (
        f"label <> o_label and rep <> o_rep and 100 * least(n, o_n) >= {percent} * greatest(n, o_n) and least(left, o_left) + g + o_g >= 0"
        f" and {100 + percent} * ({apart}) <= {100 - percent} * (n + o_n)"
    )


def star_pairs(tables: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the members of difference tables (with label) with one member of their table."""
    first = F.min_by(F.struct(*[F.col(k).alias(f"o_{k}") for k in _MEMBER]), F.xxhash64("rep", F.lit(2)))
    centres = tables.groupBy(*_TABLE).agg(first.alias("o")).select(*_TABLE, "o.*")
    return tables.join(_sorted(centres), _TABLE).filter(_can(percent)).select(F.least("rep", "o_rep").alias("a"), F.greatest("rep", "o_rep").alias("b")).distinct()


def table_pairs(tables: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of all members of difference tables (with label) that may link and have different labels."""
    near, far = (tables.filter(x).select(*_TABLE, *_MEMBER) for x in ("cls = high", "cls = low"))
    far = far.toDF(*_TABLE, *(f"o_{k}" for k in _MEMBER))
    met = near.join(_sorted(far), _TABLE).filter(f"{_can(percent)} and (low < high or rep < o_rep) and g + o_g < 0")
    return met.select(F.least("rep", "o_rep").alias("a"), F.greatest("rep", "o_rep").alias("b")).distinct()


def spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, old, label after a round: the least label among the node's neighbours, and that label's label. As edges (a, b) has each
    node beside itself, a node's own label comes with its neighbours', and a round deals rows out anew twice only besides edges and labels."""
    near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
    step = near.agg(F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"), F.min("label").alias("mid"))
    jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
    return step.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("label"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, label: the smallest node that it reaches over the edges (a, b). Labels spread to
    neighbours and then jump to their label's label, so rounds grow with the log of the longest path."""
    both = F.inline(F.expr("array(struct(a, b), struct(b as a, a as b), struct(a, a as b), struct(b as a, b))"))
    edges = settle(edges.select(both).distinct())
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    for _ in range(most):
        after = settle(spread(edges, labels))
        labels = after.select("node", "label")
        if not after.filter("old <> label").take(1):
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")


def centre(turn: int) -> tuple[Column, Column]:
    """A table's centre c, with its least size n, and o with its largest size, negated: the smallest id, or at turn 1 another."""
    rank = (F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")).alias("rank")
    return F.min(F.struct(rank, F.col("rep").alias("c"), "n")).alias("c"), F.min(F.struct(rank, (-F.col("n")).alias("n"))).alias("o")


def near_duplicates(docs: DataFrame, percent: int = 85, m: int = 10, r: int = 3, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    In each table the members compare with two centres, the smallest id and another. A pair in one component
    needs no comparison; what is left are members of tables that hold several components. Those are compared exactly, by their differences from what their group has in
    common, so a link is lost neither to the choice of centres nor to a limit on a table's size.
    """
    with bounded_batches(docs.sparkSession):
        return _near_duplicates(docs, percent, m, r, width)


def _near_duplicates(docs: DataFrame, percent: int, m: int, r: int, width: int) -> DataFrame:
    rows = stash(sketches(docs, m, r, width), "sketches")
    classes = rows.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = rows.join(classes, "fp").filter("doc_id = rep").dropDuplicates(["fp"]).select("rep", F.col("n_shingles").alias("n"), "sig")
    table = F.expr(f"flatten(transform(sequence(0, {m - 1}), i -> transform(sequence(0, {m - 1}), j -> xxhash64(sig[i], sig[{m} + j], i * {m} + j))))")
    keys = reps.select("rep", "n", F.explode(table).alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key")
    members = stash(keys.join(shared, "key"), "members")
    nodes = members.select("rep").distinct()
    # An id with several texts has a row for each here, and links where one of them does.
    texts = stash(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).join(nodes, "rep", "left_semi").distinct(), "near-texts")
    label = nodes.withColumn("label", F.col("rep"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The labels of all nodes, where links among pairs join two labels."""
        links = settle(confirmed(settle(pairs), texts, percent, width))
        if not links.take(1):
            return label
        ends = [label.select(F.col("rep").alias(x), F.col("label").alias(f"l{x}")) for x in "ab"]
        between = links.join(ends[0], "a").join(ends[1], "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        found = components(between).toDF("label", "to")
        return settle(label.join(found, "label", "left").select("rep", F.coalesce("to", "label").alias("label")))

    centres = members.groupBy("key").agg(*[c.alias(f"{name}{turn}") for turn in (0, 1) for name, c in zip("co", centre(turn), strict=True)])
    each = F.explode(F.array(*[F.struct(F.col(f"c{k}.c").alias("c"), F.col(f"c{k}.n").alias("least"), (-F.col(f"o{k}.n")).alias("most")) for k in (0, 1)]))
    met = members.join(centres.select("key", each.alias("o")), "key").filter(f"rep <> o.c and 100 * n >= {percent} * o.least and {percent} * n <= 100 * o.most")
    label = linked(met.select(F.least("rep", "o.c").alias("a"), F.greatest("rep", "o.c").alias("b")).distinct())
    held = members.join(label, "rep").select("key", "rep", "n", "label")
    open_ = held.join(held.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("key"), "key")
    certain, tables = difference_tables(stash(open_, "open"), texts, percent, width)
    tables = mixed_tables(tables, label)
    label = linked(certain.union(star_pairs(tables, percent)).distinct())
    label = linked(table_pairs(mixed_tables(tables, label), percent))
    reach = classes.join(label, "rep", "left").select("fp", F.coalesce("label", "rep").alias("reach"))
    out = rows.join(reach, "fp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("reach", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays. Of rows that repeat its id and text, the one with the least hash
    of all columns stays; different texts of that id all do, as each is the document. Rows without an id stay."""
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    held = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    ids = held.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    repeated = ids.filter("_n > 1")
    alone = held.join(ids.filter("_n = 1"), F.col("doc_id") == F.col("_id"), "left_semi")
    several = held.join(repeated, F.col("doc_id") == F.col("_id"), "left_semi")
    one = several.groupBy("doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return alone.union(one.select("_row.*")).union(docs.filter("doc_id is null"))


QUERIES = {"op6_minhash_tensored": op6_minhash_tensored}
SQL: dict[str, str] = {}
