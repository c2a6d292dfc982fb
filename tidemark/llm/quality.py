"""Quality rules: frequency of lines across documents, in DataFrame functions only.

Lines are normalised (lower case, single spaces) and hashed. For each host, here the source, the
number of distinct documents with a line is counted; a line in more than ``max_docs`` of them is
boilerplate and removed everywhere but in the host's first document that has it, the one with the
smallest doc_id. A document is rejected if the base rules fail, or if fewer than ``min_words`` words
or less than ``min_share`` percent of its words remain.

Keeping a line's first home leaves one document of a large group of copies, as later near-duplicate
stages would.

Defined cases: a null or blank text has no words and fails the base; a null source is a host of its
own; rows that repeat a doc_id and text give equal rows, and count once for each line, as do several
texts of one doc_id; rows without doc_id are one document where their texts are equal; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, settle, stash

_BLANKS = "\t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")


#: Words in 3-word windows that occur twice or more. Only texts with a repeated window pay for the sort:
#: windows sorted with their places, those equal to a neighbour kept, their three places counted once.
_REPEATED = """
case when size(words) < 6 and size(array_distinct(words)) = size(words) then 0L
     when size(grams) = size(array_distinct(grams)) then 0L
     else cast(size(array_distinct(flatten(transform(filter(transform(
         array(array_sort(transform(grams, (g, i) -> struct(g as g, i as i)))),
         s -> transform(s, (x, k) -> if((k > 0 and s[k - 1].g = x.g) or (k < size(s) - 1 and s[k + 1].g = x.g), x.i, -1)))[0],
         i -> i >= 0), i -> array(i, i + 1, i + 2))))) as long) end
"""


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"))
    out = out.withColumn("words", _words(F.col("text")))
    out = out.withColumn("grams", F.expr("if(size(words) < 3, array(), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, _BLANKS + " ", "") != "")
    out = out.withColumn("filled", lines)
    computed = F.struct(
        "doc_id", "source", "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _BLANKS + " ", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
    )
    # Filters aren't pushed through a generator, so a caller's filter on a verdict doesn't repeat the features.
    out = out.select(F.inline(F.array(computed)))
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _id (never null), _host and _text (a hash), which name a row's verdict."""
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = F.coalesce(F.col("doc_id").cast("long"), -F.pmod(text, F.lit(1 << 62)) - 2)
    return docs.withColumns({"_id": own, "_host": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")), "_text": text})


def lines_of(docs: DataFrame) -> DataFrame:
    """_id, _host, _text, line (hash), words, at, first (first place of the line in its document) for each line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = F.filter(F.transform(F.split(text, "\n"), lambda x: F.array_join(_words(F.lower(x)), " ")), lambda x: x != "")
    hashed = F.array_sort(F.transform(clean, lambda x, i: F.struct(F.xxhash64(x).alias("line"), i.alias("at"), F.size(F.split(x, " ")).alias("words"))))
    out = _keyed(docs).select("_id", "_host", "_text", hashed.alias("s"))
    marked = F.transform("s", lambda x, i: F.struct(x["line"].alias("line"), x["at"].alias("at"), x["words"].alias("words"), ((i == 0) | (F.get(F.col("s"), i - 1)["line"] != x["line"])).alias("first")))
    return out.select("_id", "_host", "_text", F.inline(marked))


def removed_lines(docs: DataFrame, max_docs: int) -> DataFrame:
    """_id, _host, _text, removed_words, gone (hashes of the removed lines) for documents that lose lines.

    Lines with more than max_docs rows are few; only for these the distinct documents are counted."""
    lines = lines_of(docs)
    often = settle(lines.filter("first").groupBy("_host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).select("_host", "line"))
    held = stash(lines.drop("first").join(often, ["_host", "line"]), "frequent-lines")
    documents_ = held.select("_host", "line", "_id").distinct().groupBy("_host", "line").agg(F.count("*").alias("n"), F.min("_id").alias("home"))
    frequent = documents_.filter(F.col("n") > max_docs).select("_host", "line", "home")
    gone = held.join(frequent, ["_host", "line"]).filter("_id <> home").groupBy("_id", "_host", "_text").agg(F.collect_set(F.struct("at", "words", "line")).alias("g"))
    # A set, so that a repeated row doesn't count twice.
    return gone.select("_id", "_host", "_text", F.aggregate("g", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("removed_words"), F.array_distinct(F.transform("g", lambda x: x["line"])).alias("gone"))


def line_frequency(docs: DataFrame, max_docs: int = 40, min_words: int = 50, min_share: int = 30) -> DataFrame:
    """The base features of each row of docs, with removed_words and kept."""
    return _judged(docs, removed_lines(docs, max_docs), min_words, min_share).drop("_id", "_host", "_text")


def _judged(docs: DataFrame, removed: DataFrame, min_words: int, min_share: int) -> DataFrame:
    rows = base_features(docs)
    rows = _keyed(rows).drop("text")
    out = rows.join(removed.drop("gone"), ["_id", "_host", "_text"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed_words")
    kept = ~F.col("base_failed") & ((F.col("removed_words") == 0) | ((left >= min_words) & (100 * left >= min_share * F.col("n_words"))))
    return out.select("_id", "_host", "_text", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "removed_words")


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with the removed lines taken out of text, and n_chars, where there is one, counted anew; the other columns stay as they are."""
    columns = docs.columns
    stay = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(F.array_join(_words(F.lower(x)), " "))))
    joined = _keyed(docs).join(removed.select("_id", "_host", "_text", "gone"), ["_id", "_host", "_text"], "left")
    joined = joined.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return joined.select(columns)


def cleaned_texts(docs: DataFrame, max_docs: int = 40) -> DataFrame:
    """docs with the frequent lines taken out of text."""
    return without_lines(docs, removed_lines(docs, max_docs))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency(documents(spark, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, max_docs: int = 40, min_words: int = 50, min_share: int = 30) -> DataFrame:
    """Pipeline stage: documents that the rules reject go, and the others lose their frequent lines."""
    removed = settle(removed_lines(docs, max_docs))
    kept = _judged(docs, removed, min_words, min_share).filter("kept").select("_id", "_host", "_text").distinct()
    kept = settle(kept.join(removed.select("_id", "_host", "_text", "gone"), ["_id", "_host", "_text"], "left"))
    return without_lines(_keyed(docs).join(kept.select("_id", "_host", "_text"), ["_id", "_host", "_text"], "left_semi").select(docs.columns), kept)


QUERIES = {"op2_line_frequency": op2_line_frequency}
SQL = {
    "op2_line_frequency": r"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, list_filter(string_split(translate(text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') as words,
        list_filter(string_split(text, chr(10)), lambda x: translate(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ', '') <> '') as filled from d),
g as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
h as (select doc_id, i, words[i]||' '||words[i+1]||' '||words[i+2] as gram from g),
c as (select doc_id, i, count(*) over (partition by doc_id, gram) as n from h),
p as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i+1, i+2]) as j from c where n > 1) group by doc_id),
l as (select doc_id, source, array_to_string(list_filter(string_split(translate(lower(x), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda y: y <> ''), ' ') as line
      from (select doc_id, source, unnest(filled) as x from w)),
f as (select source, line, min(doc_id) as home from l group by source, line having count(distinct doc_id) > 40),
r as (select l.doc_id, sum(len(string_split(l.line, ' ')))::bigint as removed_words from l join f on l.line = f.line and l.source is not distinct from f.source where l.doc_id <> f.home group by l.doc_id),
b as (select w.doc_id, len(words)::bigint as n_words, length(translate(text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ', ''))::bigint as word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols, (len(filled) - len(list_distinct(filled)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(removed_words, 0)::bigint as removed_words
      from w left join p using (doc_id) left join r using (doc_id)),
e as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (removed_words = 0 or (n_words - removed_words >= 50 and 100 * (n_words - removed_words) >= 30 * n_words)) as kept, removed_words from e
""",
}
