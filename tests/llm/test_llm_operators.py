"""Operators against brute force, SQL, exact round trips and held-out labels; and the odd cases."""

import shutil
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pytest
from helpers_llm import make, text
from oracle import rows_of, sql_rows
from pyspark.sql import functions as F

from tidemark.llm import chat, chunkstore, lm, media, minhash, mixing, packing, quality, registry, ring, tokenstore, toxicity
from tidemark.llm.common import words_of


def words(t):
    return (t or "").encode().lower().split()


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert rows_of(registry.QUERIES[name](spark, sf).toPandas()) == sql_rows(registry.SQL[name], sf)


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 14)) and "pipeline" in registry.QUERIES


# 1 and 7: stores


def test_media_round_trip(spark, sf, odd):
    for docs in (documents(spark, sf), odd):
        path = media.stash_path(spark, "test-media")
        media.write_media(docs.select("doc_id", "text"), path)
        got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.read_media(spark, path).collect())
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            p = media.padded(r.text)
            want[r.doc_id, len((r.text or "").encode()), len(p), chunkstore.digest(p).hex(), zlib.crc32(p[-32:])] += 1
        assert got == want
        stored = spark.read.parquet(f"{path}/kind=chunk")
        assert stored.count() == stored.select("digest").distinct().count()


def test_gear_hash_is_a_rolling_hash():
    data = np.frombuffer(text(1, 300).encode(), np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(chunkstore._GEAR[b])) % 2**32
        want.append(h)
    assert chunkstore.gear(data).tolist() == want
    chunks = chunkstore.payload_chunks([data.tobytes(), b"", b"x" * 9000], 1, 64, 5, 512)
    assert [b"".join(c) for c in chunks] == [data.tobytes(), b"", b"x" * 9000] and all(len(c) <= 512 for cs in chunks for c in cs)
    moved = chunkstore.payload_chunks([b"some bytes before " + data.tobytes()], 1, 64, 5, 512)[0]
    assert len(set(moved) & set(chunks[0])) > len(chunks[0]) / 2  # cuts follow content, not places


def test_damage_is_found(spark, odd):
    path = media.stash_path(spark, "damaged")
    media.write_media(odd.select("doc_id", "text"), path)
    docs, chunks = chunkstore.read(spark, path, ["doc_id"], "doc_id bigint")
    bad = docs.withColumn("own", F.when(F.octet_length("own") > 0, F.concat(F.lit(b"?"), F.expr("substring(own, 2)"))).otherwise(F.col("own")))

    def lengths(payloads, recipes):
        import pyarrow as pa

        return [pa.array([len(p) for p in payloads], pa.int64())]

    with pytest.raises(Exception, match="differs from its digest"):
        chunkstore.rebuilt(bad, chunks, ["doc_id"], lengths, "n long", ["n"]).collect()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))  # untouched, as the contract calls it


def test_ids_by_word_equal_ids_of_whole_texts(spark, sf, odd, tokenizer):
    import pyarrow as pa

    from tidemark.llm.tokens import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    more = ["it's A.B, c.. d", "x y\x1cz   é İ 12.5", "<|startoftext|> a", "x <|endoftext|>", "<|ENDOFTEXT|> b", "a<|endoftext|>b c", "<|endoftext|>", "ß. é, Ω.", ",., a,. .a", "Èé,, e\u0301a E\u0301.", "ab's ab'. ab.' ª. ǆ x_ _x x_y", "!!! a!!! a!b"]
    texts = [r.text for r in documents(spark, sf).union(odd.select(documents(spark, sf).columns)).collect()] + more
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
    for bound in (700_000, 50):  # with the small bound words are forgotten all the time
        encode = Encoder(path, bound).encode
        for at in (slice(0, 100), slice(100, None)):
            ids, sizes = encode(pa.array(texts[at], pa.string()), 7)
            assert sizes.tolist() == [len(w) for w in want[at]] and ids.tolist() == [i for w in want[at] for i in w]
    assert [x.tolist() for x in Encoder(path).encode(pa.array([], pa.string()), 7)] == [[], []]


def test_token_store_round_trip(spark, sf, odd, tokenizer):
    for docs in (documents(spark, sf), odd):
        path = tokenstore.stash_path(spark, "test-ids")
        tokenstore.write_ids(docs, path)
        want, at = [], 0
        rows = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
        for doc_id, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]))):
            want.append((str(doc_id), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.read_ids(spark, path).collect()) == sorted(want)


def test_simple_words_are_kept_at_once(tokenizer, monkeypatch):
    import pyarrow as pa

    from tidemark.llm import tokens

    words, calls, keep = [f"{a}{b}ling" for a in "bcdfghjklm" for b in "aeiouäöüß"], [], tokens.Encoder._keep
    monkeypatch.setattr(tokens.Encoder, "_keep", lambda self, *args: calls.append(1) or keep(self, *args))
    found = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    found.learn([w * k for k in range(1, 6) for w in words])
    assert len(found.known) == 5 * len(words) and len(calls) == 1
    for w in [*words, "µm", "ªb", "foo,", "foo!!", "foo'"]:
        assert found.encode(pa.array([w]), 0)[0].tolist() == [*tokenizer.encode(w, add_special_tokens=False).ids, 0]


def test_words_met_once_are_not_remembered(tokenizer):
    import pyarrow as pa

    from tidemark.llm.tokens import Encoder

    found = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    once, often = [f"{a}{b}ling{s}" for a in "bcdfghjklm" for b in "aeiouäöüß" for s in ("", ",", "'s", ".!")], ["some", "words.", "can't"]
    texts = [" ".join([*once, *often, *often, *often]), "", " ".join([*often, once[0], "new!"])]
    for _ in range(2):  # with words remembered, the same ids
        ids, sizes = found.encode(pa.array(texts), 0)
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
        assert set(often) <= set(found.known.to_pylist()) and not set(once) & set(found.known.to_pylist())


def test_words_that_part_wrongly_go_one_by_one(tokenizer, monkeypatch):
    import pyarrow as pa

    from tidemark.llm import tokens

    words = [f"{a}{b}ling" for a in "bcdfghjklm" for b in "aeiouäöüß"]
    found = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    split = found._one_by_one(pa.array(["coling"]))[0]
    found.last[split[-1]] = False  # as if this word's last token didn't end a word
    ids, sizes = found.encode(pa.array([" ".join(words)]), 0)
    assert ids.tolist() == [*tokenizer.encode(" ".join(words), add_special_tokens=False).ids, 0] and sizes.tolist() == [len(ids)]


def test_gear_hash_is_the_same_in_blocks(monkeypatch):
    data = np.frombuffer(text(2, 300).encode(), np.uint8)
    want = chunkstore.gear(data).tolist()
    for block in (1, 31, 40, len(data)):
        monkeypatch.setattr(chunkstore, "BLOCK", block)
        assert chunkstore.gear(data).tolist() == want


def test_missing_or_changed_rows_of_the_token_store_raise(spark, sf):
    docs = documents(spark, sf)
    path = tokenstore.stash_path(spark, "test-root")
    tokenstore.write_ids(docs, path)
    local = path.removeprefix("file://")

    def damaged(*tables, lost):
        other = tokenstore.stash_path(spark, "test-lost")
        shutil.copytree(local, other.removeprefix("file://"))
        for table in tables:
            shutil.rmtree(f"{other.removeprefix('file://')}/{table}")
            rows = spark.read.parquet(f"{path}/{table}")
            (rows.withColumn("doc_id", F.expr(lost)) if lost.startswith("case") else rows.filter(lost)).write.parquet(f"{other}/{table}")
        return other

    first, second = [r.doc_id for r in docs.orderBy("doc_id").limit(2).collect()]
    swapped = f"case doc_id when {first} then {second} when {second} then {first} else doc_id end"
    for tables, lost in ((["kind=doc"], f"doc_id != {first}"), (["kind=doc"], swapped), (["kind=chunk"], "false"), (["manifest"], "part != 0"), (["root"], "false")):
        with pytest.raises(Exception, match="missing|differ|no root"):
            tokenstore.read_ids(spark, damaged(*tables, lost=lost)).collect()


def test_ids_beyond_16_bits_are_kept(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    path = tokenstore.stash_path(spark, "test-wide")
    tokenstore.write_ids(docs, path, end=70_000)
    got = {r.doc_id: r.ids_crc32 for r in tokenstore.read_ids(spark, path).collect()}
    assert got[2] == zlib.crc32(np.array([70_000], "<u4").tobytes())


# 4: packing


def packed(rows, room):
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= room
    return len(used)


def test_packing_is_gapless_and_tight(spark, sf, odd, tokenizer):
    for docs in (documents(spark, sf), odd):
        rows = packing.best_fit_packing(docs, 256).collect()
        assert packed(rows, 256) <= -(-sum(r.length for r in rows) // 256) * 1.02 + 2
        got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
        want = Counter()
        for d in docs.collect():
            ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
            for k, at in enumerate(range(0, len(ids), 256)):
                own = ids[at : at + 256]
                want[d.doc_id, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
        assert got == want


def test_dominance_never_costs_a_sequence():
    import itertools
    import random

    def least(items, room):  # the optimum, by trying
        best = [len(items)]

        def put(i, loads):
            if len(loads) >= best[0]:
                return
            if i == len(items):
                best[0] = len(loads)
                return
            for k in range(len(loads)):
                if loads[k] + items[i] <= room and loads[k] not in loads[:k]:
                    put(i + 1, [*loads[:k], loads[k] + items[i], *loads[k + 1 :]])
            put(i + 1, [*loads, items[i]])

        put(0, [])
        return best[0]

    r = random.Random(4)
    for _ in range(150):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        fixed, left = packing.reduced(Counter(items), 20)
        rest = list(itertools.chain(*([k] * n for k, n in left.items())))
        assert sum(n for _, n in fixed) + least(sorted(rest, reverse=True), 20) == least(items, 20)
        groups = fixed + packing.best_fit(left, 20)
        assert Counter({k: c for k, c in sum((Counter({k: t * n for k, t in g}) for g, n in groups), Counter()).items()}) == Counter(items)
        assert all(sum(k * t for k, t in g) <= 20 for g, _ in groups)


# 5: language model


def test_base_score_and_counts(spark, sf, odd):
    for docs in (documents(spark, sf), odd):
        train = docs.filter("doc_id is null or doc_id % 3 <> 0")
        c = Counter(w for r in train.collect() for w in [*words(r.text), b" "])
        total, distinct = sum(c.values()), len(c)
        got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.scored(docs, train).collect())
        want = []
        for r in docs.collect():
            ws = [*words(r.text), b" "]
            want.append((str(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), total, round(sum(log10((c[w] + 1) / (total + distinct + 1)) for w in ws), 6)))
        assert got == sorted(want)


def test_filter_holds_quantised_counts(spark):
    n = {k: 1 + k % 50 for k in range(1, 3001)}
    rows = spark.createDataFrame([(int(np.int64(lm.mix(np.array([k], np.uint64))[0].astype(np.int64))), v) for k, v in n.items()], "key long, n long")
    held = lm.Filter(lm.build_filter(rows))
    keys = lm.mix(np.arange(1, 6001, dtype=np.uint64))
    got = held.counts(keys)
    close = [abs(got[k - 1] - v) <= 0.35 * v for k, v in n.items()]
    assert (got[:3000] >= [0.7 * v for v in n.values()]).all() and np.mean(close) > 0.9 and (got[3000:] > 0).mean() < 0.05


def test_scores_are_the_same_over_many_ranges_of_the_filter(spark, odd, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 500)
    scores = [sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.scored(odd, odd, range_bits=bits).collect()) for bits in (lm.RANGE_BITS, 2 * lm.BLOCK_BITS)]
    entries = spark.range(50_000).select(F.xxhash64("id").alias("key"), F.lit(1).cast("long").alias("n"))
    blocks, per, parts = lm.filter_ranges(entries, 2 * lm.BLOCK_BITS)
    parts = list(parts)
    assert scores[0] == scores[1] and (blocks, per, len(parts)) == (7, 2, 4) and lm.filter_ranges(lm.counted(odd).select("key", "n"))[0] > 2
    fill = np.unpackbits(np.concatenate(parts).view(np.uint8)).mean()  # three probes a level in eight bits
    assert 0.25 < fill < 0.34
    unseen = lm.Filter(np.concatenate(parts)).counts(lm.mix(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64)))
    assert (unseen > 0).mean() < 0.05


def test_pairs_seen_once_count(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "old owl"), (3, "red owl")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm.scored(docs, docs.filter("doc_id < 3")).collect()}
    assert score[1] > score[3] + 0.2


def test_scores_equal_brute_force(spark, sf, monkeypatch):
    """The model's score from counts in a dictionary, quantised as the filter does; in a roomy filter hardly any false hit changes it."""
    monkeypatch.setattr(lm, "BITS_PER_LEVEL", 100)
    docs = documents(spark, sf)
    train = docs.filter("doc_id % 3 <> 0")
    one, two = Counter(), Counter()
    for r in train.collect():
        ws = [" ", *(w.decode() for w in words_of(r.text)), " "]
        one.update(ws[1:])
        two.update(zip(ws, ws[1:], strict=False))
    level = lambda c: 0.0 if not c else lm._MIDDLE[np.searchsorted(lm._LOW, c, "right")]
    total, distinct = sum(one.values()), len(one)
    got = {r.doc_id: r.score for r in lm.scored(docs, train).collect()}
    off = []
    for r in docs.collect():
        ws = [" ", *(w.decode() for w in words_of(r.text)), " "]
        want = 0.0
        for v, w in zip(ws, ws[1:], strict=False):
            both, before = level(two[v, w]), level(one[v])
            want += log10(0.85 * (level(one[w]) + 1) / (total + distinct + 1) + 0.15 * both / max(before, both, 1))
        off.append(abs(got[r.doc_id] - want) / (len(ws) - 1))
    assert np.mean(off) < 1e-4 and np.median(off) < 1e-9 and np.max(off) < 0.02


def test_tokens(spark):
    import pyarrow as pa

    texts = [None, "", "  a\tB\x0bb\r\nc ", "É\u00a0x a", " \n ", "one"]
    t = lm.tokens_of(pa.array(texts, pa.string()))
    at = 0
    for text_, n in zip(texts, t.sizes, strict=True):
        assert [t.words[k] for k in t.places[at : at + n]] == [*words_of(text_), lm.END]
        at += n
    assert at == len(t.places) and len(lm.tokens_of(pa.array([], pa.string())).places) == 0


def test_model_beats_base_on_held_out_documents(spark):
    rows = lm.op5_log_frequency_bloom(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# 6: near-duplicates


def brute_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:])))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_components_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    base = text(77, 150)
    import random

    r = random.Random(1)
    for k in range(60):  # a group of near copies around the threshold
        ws = base.split()
        for _ in range(k % 7):
            ws[r.randrange(len(ws))] = f"new{k}"
        rows.append((100_000 + k, " ".join(ws).upper() if k % 2 else "  ".join(ws)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_components(rows)


def planted_group(n, edits, seed, base=None):
    """Near copies of one text, which is not among them: each with its own edits, and some with passages that others lack too."""
    import random

    r = random.Random(seed)
    base = (base or text(seed, 150)).split()
    rows = []
    for k in range(n):
        ws = list(base)
        for _ in range(r.choice(edits)):
            ws[r.randrange(len(ws))] = f"new{r.randrange(10**6)}"
        if k % 5 == 0:
            at = 10 * (k % 3)
            del ws[at : at + 25]
        if k % 11 == 0:
            ws[60:60] = base[:40]
        rows.append((100_000 + k, " ".join(ws)))
    return rows


@pytest.mark.parametrize("edits", [(0, 1, 2, 3, 4, 5, 6), (3, 4), (4, 5, 6, 7, 8), (1,)])
def test_links_inside_one_table_are_found_by_differences(spark, edits):
    rows = planted_group(300, edits, 5) + [(i + 1000, t) for i, t in planted_group(100, (2, 3), 6)]
    docs = make(spark, [(i, t, "s") for i, t in rows])
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    sizes = {i: n for i, (n, _) in brute_components(rows).items()}
    open_ = spark.createDataFrame([(0, i, sizes[i], i) for i, _ in rows], "key long, rep long, n long, label long")
    c = open_.agg(*minhash.centre(1)).first()["c"]["c"]
    star = open_.filter(f"rep <> {c}").select(F.least("rep", F.lit(c)).alias("a"), F.greatest("rep", F.lit(c)).alias("b"))
    certain, tables = minhash.difference_tables(open_, texts, 85, 5)
    each = [minhash.stash(certain.union(minhash.star_pairs(minhash.mixed_tables(tables, docs.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("label"))), 85)).union(star), "pairs")]
    links = minhash.stash(minhash.confirmed(each[0], texts, 85, 5), "links")
    label = open_.select("rep").join(minhash.components(links).withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    each.append(minhash.stash(minhash.table_pairs(minhash.mixed_tables(tables, label), 85), "pairs"))
    assert sum(p.count() for p in each) <= 5 * len(rows)  # all pairs are 200 times the rows
    links = links.union(minhash.confirmed(each[1], texts, 85, 5))
    got = {r.node: r.label for r in minhash.components(links).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_tables_that_share_members_are_one_group_and_differences_go_only_where_they_meet(spark):
    base, rows = text(5, 150).split(), []
    for k in range(120):  # twelve families with a passage of their own, and a word of each member's own
        ws = [*base[:50], *text(100 + k % 12, 40).split(), *base[90:]]
        ws[(k * 13) % 50] = f"new{k}"
        rows.append((1000 + k, " ".join(ws)))
    docs = make(spark, [(i, t, "s") for i, t in rows])
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    want = brute_components(rows)
    many = [(k, i, want[i][0], i) for k in range(12) for i, _ in rows if (i * 7 + k) % 4]  # each document is in nine tables
    open_ = minhash.settle(spark.createDataFrame(many, "key long, rep long, n long, label long"))
    groups = minhash.groups_of(open_).collect()
    assert len({g.cs[0] for g in groups}) == 1 and all(len(g.cs) == 1 for g in groups)
    certain, tables = minhash.difference_tables(open_, texts, 85, 5)
    assert 0 < tables.count() <= 30 * len(rows)
    label = docs.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("label"))
    star = open_.join(open_.groupBy("key").agg(*minhash.centre(1)).select("key", F.col("c.c").alias("b")), "key").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    pairs = certain.union(star).union(minhash.table_pairs(minhash.mixed_tables(tables, label), 85))
    got = {r.node: r.label for r in minhash.components(minhash.confirmed(pairs, texts, 85, 5)).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in want.items()} and len(set(got.values())) > 1


def test_an_id_with_several_texts_links_by_each(spark):
    a, b = text(1, 80), text(2, 80)
    rows = [(1, a + " x"), (5, a), (5, b), (9, b + " y"), (9, b + " y"), (12, text(3, 80))]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(make(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (12, 12)}


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = minhash.near_duplicates(odd).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in rows)
    assert len(got) == 11 and ("1", 0, "1", True) in got and ("6", 56, "5", False) in got and ("None", 56, "None", True) in got and ("9", 56, "5", False) in got
    assert minhash.near_duplicates(none).count() == 0
    stage = minhash.keep_one_of_each_group(spark, odd, "")
    assert stage.columns == odd.columns and Counter(str(r.doc_id) for r in stage.collect()) == Counter(["1", "2", "3", "4", "5", "8", "10", "None"])


# 8: toxicity


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op8_subsequence_svm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.6 * sum(r.toxic for r in rows) and hit >= 0.9 * sum(r.predicted for r in rows)


def test_kernel_tolerates_gaps_and_signs():
    bad, clean = ["you are an idiot", "what an idiot today", "idiot people here", "such idiot talk", "the idiot again"] * 8, [text(i, 30) + " ideal patio idea riot" for i in range(60)]
    m = toxicity.train([f"{t} {i}" for i, t in enumerate(bad)] + clean, [1] * len(bad) + [0] * len(clean))
    s = dict(zip(["idiot", "i-d-i*o.t", "idixot", "ideal", "table"], m.scores(["some idiot", "some i-d-i*o.t", "some idixot", "some ideal", "some table"]), strict=True))
    assert s["idiot"] == s["i-d-i*o.t"] > s["idixot"] > s["ideal"] and s["idixot"] > s["table"]


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 1), (8, 1, 0), (None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(odd.drop("toxicity"), labels).collect()
    assert len(got) == 11 and all(0 <= r.toxicity <= 1 for r in got)
    assert toxicity.scored(none.drop("toxicity"), labels).count() == 0
    assert all(r.toxicity < 1e-9 for r in toxicity.scored(odd.drop("toxicity"), labels.filter("false")).collect())


# 9 and 10: mixing and sharding


def test_mix_meets_targets(spark, odd, none):
    rows = mixing.fair_queue(documents(spark, "/root/testdata/sf0.01")).collect()
    by = defaultdict(list)
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        by[r.source].append(r)
    biggest = max(r.size for r in rows)
    assert all(abs(sum(r.taken for r in rs) - rs[0].target) <= 2 * biggest for rs in by.values())
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * sum(r.size for r in rows)) < 1
    assert len(mixing.fair_queue(odd).collect()) == 11 and mixing.fair_queue(none).count() == 0
    assert set(mixing.mix_sources(spark, odd, "").columns) == set(odd.columns)


def test_targets_stop_at_their_limit(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 100), (None, 50)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(sizes, (3, 1, 2), 150, 2).collect()}
    assert abs(sum(t.values()) - 1875) < 1e-6 and t["a"] == 200 and t[None] == 100 and all(t[k] <= 2 * s for k, s in (("b", 1000), ("c", 100)))


def brute_ring(counts, edges, shards, nodes, slack):
    """Document by document: those that fit at home, then the rest clockwise."""
    points = ring.ring(shards, nodes)
    room = ring.capacities(sum(counts.values()), shards, slack)
    out, over = {}, []
    for cell in sorted(counts):
        at = next((i for i, (p, _) in enumerate(points) if p >= edges[cell + 1] - 1), 0)
        for k in range(counts[cell]):
            if room[points[at][1]]:
                room[points[at][1]] -= 1
                out[cell, k] = points[at][1]
            else:
                over.append((cell, k, at))
    for cell, k, at in over:
        while True:
            at = (at + 1) % len(points)
            if room[points[at][1]]:
                room[points[at][1]] -= 1
                out[cell, k] = points[at][1]
                break
    return out


def test_ring_plan_equals_brute_force_and_counts_are_even(spark, odd, none):
    edges = sorted({p + 1 for p, _ in ring.ring(4, 8)} | {k * ring.TOP // 64 for k in range(65)})
    counts = {c: (c * 7) % 5 + 1 for c in range(len(edges) - 1)}
    counts[3] = 90
    got = {(c, k): s for c, a, b, s, _ in ring.plan(counts, edges, 4, 8, 0.1) for k in range(a, b)}
    assert got == brute_ring(counts, edges, 4, 8, 0.1)
    for docs in (documents(spark, "/root/testdata/sf0.01"), odd):
        rows = ring.place(docs).collect()
        assert len(rows) == docs.count()
        shards = defaultdict(list)
        for r in rows:
            shards[r.shard].append(r.slot)
        sizes = [len(shards[s]) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert ring.place(none).count() == 0
    a, b = ({r.doc_id: r.shard for r in ring.place(documents(spark, "/root/testdata/sf0.01"), n, slack=0.25).collect()} for n in (16, 17))
    assert np.mean([a[k] != b[k] for k in a]) < 0.3  # a new shard moves few


# 2 and 3: rules and chats


def test_quality_of_odd_rows(spark, odd, none):
    got = quality.line_frequency(odd)
    assert got.count() == 11 and quality.line_frequency(none).count() == 0 and got.filter("doc_id = 5 and kept").count() == 2 and not got.filter("doc_id = 1 and not base_failed").count()
    many = make(spark, [(i, "Common  line of WORDS here\n" + text(i, 60), "h") for i in range(50)])
    assert quality.line_frequency(many, max_docs=49).filter("removed_words = 5").count() == 49  # all but the line's first home
    assert quality.cleaned_texts(many, 49).filter("text like 'Common%'").count() == 1 and quality.line_frequency(many, max_docs=50).filter("removed_words > 0").count() == 0
    assert quality.line_frequency(many, max_docs=49, min_share=95).filter("kept").count() == 1


def test_rotation_of_odd_turns(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "hey"), (1, 2, None, None), (1, 2, None, None), (None, 0, "ann", "x"), (2, 0, "system", "only"), (3, 0, "system", "s"), (3, 900, "ann", "a"), (3, 5, "bob", "ü")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(1) for k in ("key", "range", "base", "n", "seats", "speaker")})
    got = {(r.conv_id, r.speaker): r for r in chat.rendered(c).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "ann"), (3, "bob")}
    assert got[3, "bob"].text == "<|system|>\ns\n<|assistant|>\nü\n<|user name=ann|>\na\n"
    for (_, speaker), r in got.items():
        said = [t or "" for conv, _, role, t in rows if conv == r.conv_id and (role or "unknown") == speaker]
        assert [r.text[s.start : s.end] for s in r.spans] == [t + "\n" for t in said]
    assert chat.rotate(c.filter("false")).count() == 0


def test_rest_on_empty_tables(spark, none):
    path = media.stash_path(spark, "none")
    media.write_media(none.select("doc_id", "text"), path)
    assert media.read_media(spark, path).count() == 0
    path = media.stash_path(spark, "none-ids")
    tokenstore.write_ids(none, path)
    assert tokenstore.read_ids(spark, path).count() == 0
    assert packing.best_fit_packing(none).count() == 0 and lm.scored(none, none).count() == 0


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    toxic = {r.doc_id for r in toxicity.op8_subsequence_svm(spark, sf).filter("predicted = 1").collect()}
    stage1 = docs.filter(~F.col("doc_id").isin(list(toxic) or [-1]))
    good = {r.doc_id for r in quality.line_frequency(stage1).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in stage1.collect() if r.doc_id in good]
    kept = {d for d, (_, c) in brute_components(rows).items() if d == c}
    taken = Counter()
    for r in mixing.fair_queue(docs.filter(F.col("doc_id").isin(list(kept)))).collect():
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == +taken
    packed(got, 2048)
    assert len(corpus_pipeline.STAGES) == 5


def test_repeated_rows_count_once_for_a_line(spark):
    rows = [(i, text(i, 60) + "\nA  shared line here", "s") for i in range(30)] + [(99, text(99, 60) + "\na shared line here", "s")] * 15
    assert not any(r.removed_words for r in quality.line_frequency(make(spark, rows)).collect())
    more = [(i, text(i, 60) + "\na shared line here", "s") for i in range(100, 110)] + [(None, text(i, 60) + "\na shared line here", "s") for i in range(200, 203)]
    got = Counter((str(r.doc_id), r.removed_words) for r in quality.line_frequency(make(spark, rows + more)).collect())
    assert got[("99", 4)] == 15 and got[("None", 4)] + got[("None", 0)] == 3 and sum(n for (_, w), n in got.items() if w == 0) == 1
    docs = make(spark, rows + more)
    kept = quality.drop_low_quality(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert kept.filter("text like '%shared line%'").count() == 1 and kept.filter("n_chars <> length(text)").count() == 0


def test_stages_on_odd_and_empty_tables(spark, odd, none, sf):
    import corpus_pipeline

    for name, stage in (s for s in corpus_pipeline.STAGES[:-1] if s[0] != "near-duplicates"):  # which has its own test
        for docs in (odd, none):
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            n = out.count()
            assert n == 0 if docs is none else 0 < n <= 2 * 11, name
    assert {str(r.doc_id) for r in corpus_pipeline.STAGES[-1][1](spark, odd, sf).collect()} == {str(r.doc_id) for r in odd.collect()}


def test_rows_that_repeat_an_id_are_mixed_each_by_its_count(spark):
    rows = [(k % 7 if k % 2 else None, text(k % 11, 5 + k % 4), "ab"[k % 2]) for k in range(60)]
    docs = make(spark, rows)
    want = Counter()
    for r in mixing.fair_queue(docs).collect():
        want[r.source] += r.taken
    got = Counter()
    for r in mixing.mix_sources(spark, docs, "").collect():
        got[r.source] += len(words(r.text))
    assert got == want and sum(got.values()) > sum(len(words(t)) for _, t, _ in rows)
